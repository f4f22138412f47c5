"""Interval and position-axis operators, tiled along the coordinate.

Rows are first reduced to one per position, so a tile holds at most ``tile`` rows however crowded a locus is.
What earlier tiles contribute (a running maximum, the last position) comes from a per-tile aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .ranking import best_row, join_back, window_order

TILE = 1 << 18
#: Candidates of ``greedy_intervals`` that one task puts into their bins.
CANDIDATES_PER_TASK = 1 << 15
UP_TO_PREVIOUS = (Window.unboundedPreceding, -1)


def _tile_of(position: Column, tile: int) -> Column:
    return F.floor(position / F.lit(tile)).cast("bigint")


def _carry(df: DataFrame, by: list[str], column: str, aggregate: Column, name: str, over: str = "max") -> DataFrame:
    """Attach the aggregate of all earlier tiles of the group (running max or running sum)."""
    across = Window.partitionBy(*by).orderBy("_tile").rowsBetween(*UP_TO_PREVIOUS)
    combine = F.max if over == "max" else F.sum
    per_tile = df.groupBy(*by, "_tile").agg(aggregate.alias(column)).select(*by, "_tile", combine(column).over(across).alias(name))
    return join_back(df, per_tile, [*by, "_tile"])


def merge_intervals(df: DataFrame, by: Sequence[str], start: str, end: str, *, tile: int = TILE) -> DataFrame:
    """Union of overlapping or touching intervals per group; a start beyond the running end opens a new one."""
    by = list(by)
    per_start = df.groupBy(*by, F.col(start).cast("bigint").alias("_s")).agg(
        F.max(F.col(end).cast("bigint")).alias("_e"), F.count(F.lit(1)).alias("_n")
    )
    tiled = _carry(per_start.withColumn("_tile", _tile_of(F.col("_s"), tile)), by, "_m", F.max("_e"), "_carried_end")
    within = Window.partitionBy(*by, "_tile").orderBy("_s")
    reach = F.greatest(F.col("_carried_end"), F.max("_e").over(within.rowsBetween(*UP_TO_PREVIOUS)))
    opened = tiled.withColumn("_open", F.when(reach.isNull() | (F.col("_s") > reach), 1).otherwise(0))
    numbered = _carry(opened.drop("_carried_end"), by, "_o", F.sum("_open"), "_opened_before", over="sum")
    island = F.coalesce("_opened_before", F.lit(0)) + F.sum("_open").over(
        within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        numbered.withColumn("_island", island)
        .groupBy(*by, "_island")
        .agg(F.min("_s").alias("start"), F.max("_e").alias("end"), F.sum("_n").cast("bigint").alias("n_merged"))
        .drop("_island")
    )


#: Each level of nested bins is this many times as wide as the one below.
FAN, LEVELS = 8, 8


def _nested_bins(df: DataFrame, start: str, end: str, bin_width: int, *, first: bool, levels: int = LEVELS) -> DataFrame:
    """One row per place (``_level``, ``_bin``, ``_side``) at which an inclusive interval meets others.

    An interval is at home at the level whose bins are at least as long as it, in the one or two bins it touches there; it
    also shows in the bins above its home. A pair meets where the longer one is at home. ``_side`` tells homes from shows,
    so that two shows never meet; of a pair at home on one level, the ``first`` table's is the home. The number of rows
    does not depend on the interval's length (up to the width of the top level's bins, the one above ``levels`` others)."""
    s, e = F.col(start).cast("bigint"), F.col(end).cast("bigint")
    widths = [bin_width * FAN**level for level in range(levels + 1)]
    lower = F.array(*[F.lit(w).cast("bigint") for w in widths[:-1]]).cast("array<bigint>")
    level = F.size(F.filter(lower, lambda w: w < e - s + 1))

    def places(at: Column, side: int) -> Column:
        width = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in widths]), at.cast("int") + 1)
        bins = F.sequence(F.floor(s / width).cast("bigint"), F.floor(e / width).cast("bigint"))
        return F.transform(bins, lambda b: F.struct(at.cast("int").alias("_level"), b.alias("_bin"), F.lit(side).alias("_side")))

    shown = F.sequence(level, F.lit(levels))
    shown = F.filter(shown, lambda at: at > level) if first else shown
    homes = places(level, 0 if first else 1)
    shows = F.flatten(F.transform(shown, lambda at: places(at, 1 if first else 0)))
    rows = df.where((s <= e)).withColumn("_place", F.explode(F.concat(homes, shows)))
    return rows.select("*", "_place.*").drop("_place")


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    *,
    start: str,
    end: str,
    other_start: str,
    other_end: str,
    bin_width: int,
    levels: int = LEVELS,
) -> DataFrame:
    """Pairs of overlapping inclusive intervals of any length through nested bins of ``bin_width`` and up; each pair is
    emitted only in the bin of its first shared position, so no duplicate removal is needed. Every row is copied to each
    of ``levels`` levels above its home: where intervals are no longer than a few bins, 0 gives plain bins and the same
    pairs from one or two copies."""
    keys = [*by, "_level", "_bin", "_side"]
    # sizes are judged before rows are copied to their bins, so a side that looks small may be too large to broadcast
    others = _nested_bins(right, other_start, other_end, bin_width, first=False, levels=levels)
    met = others.where((F.col("_side") == 0) | (F.col("_level") < levels))  # nothing shows above the top level
    joined = _nested_bins(left, start, end, bin_width, first=True, levels=levels).hint("merge").join(met, keys)
    width = F.pow(F.lit(FAN), F.col("_level")).cast("bigint") * bin_width
    first_shared = F.floor(F.greatest(F.col(start).cast("bigint"), F.col(other_start).cast("bigint")) / width)
    touches = (F.col(start) <= F.col(other_end)) & (F.col(end) >= F.col(other_start))
    return joined.where(touches & (F.col("_bin") == first_shared)).drop("_level", "_bin", "_side")


def covering_nodes(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row per node (``_level``, ``_node``) of those that make up a half-open interval: at each level, whose nodes are
    ``FAN`` times as wide as those of the one below, whole nodes that are in no whole node of the level above. A position
    lies in one node per level, so it meets an interval in exactly one of its nodes."""
    s, e = F.col(start).cast("bigint"), F.col(end).cast("bigint")

    def whole(width: int) -> tuple[Column, Column]:
        return F.ceil(s / width).cast("bigint"), F.floor(e / width).cast("bigint")

    def run(level: int, first: Column, stop: Column) -> Column:
        nodes = F.when(first < stop, F.sequence(first, F.greatest(stop - 1, first))).otherwise(F.array().cast("array<bigint>"))
        return F.transform(nodes, lambda n: F.struct(F.lit(level).alias("_level"), n.alias("_node")))

    runs = []
    for level in range(LEVELS + 1):
        first, stop = whole(FAN**level)
        if level == LEVELS:
            runs.append(run(level, first, stop))
        else:
            above, beyond = (x * FAN for x in whole(FAN ** (level + 1)))
            nested = above < beyond
            runs += [run(level, first, F.when(nested, above).otherwise(stop)), run(level, F.when(nested, beyond).otherwise(stop), stop)]
    return df.where(s < e).withColumn("_n", F.explode(F.concat(*runs))).select("*", "_n.*").drop("_n")


def nodes_of_position(position: Column) -> Column:
    """The node of every level that holds a position."""
    nodes = [F.struct(F.lit(k).alias("_level"), F.floor(position / FAN**k).cast("bigint").alias("_node")) for k in range(LEVELS + 1)]
    return F.array(*nodes)


def flag_overlaps_merged(
    df: DataFrame, merged: DataFrame, by: Sequence[str], *, start: str, end: str, bin_width: int, name: str = "overlaps"
) -> DataFrame:
    """Whether each half-open [start, end) meets any interval of a merged, disjoint set.

    Distinct query intervals are probed once against the set through nested bins and joined back."""
    by = list(by)
    spans = df.select(*by, start, end).distinct()
    probe = _nested_bins(spans.withColumn("_last", F.greatest(F.col(end) - 1, F.col(start))), start, "_last", bin_width, first=True)
    closed = merged.select(*by, F.col("start").alias("_ms"), F.col("end").alias("_me"), F.greatest(F.col("end") - 1, F.col("start")).alias("_ml"))
    members = _nested_bins(closed, "_ms", "_ml", bin_width, first=False)
    keys = [*by, "_level", "_bin", "_side"]
    renamed = members.select(*[F.col(c).alias(f"_k_{c}") for c in keys], "_ms", "_me")
    condition = (F.col("_ms") < F.col(end)) & (F.col("_me") > F.col(start))
    for c in keys:
        condition = condition & (F.col(c) == F.col(f"_k_{c}"))
    hits = probe.join(renamed, condition, "left_semi").select(*by, start, end).distinct().withColumn("_hit", F.lit(True))
    return df.join(hits, [*by, start, end], "left").withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_hit")


def greedy_intervals(
    df: DataFrame,
    by: Sequence[str],
    *,
    key: str,
    start: str,
    end: str,
    order: Sequence[Column],
    bin_width: int,
    limit: int | None = None,
) -> DataFrame:
    """Take inclusive intervals of any widths in ``order`` (ties by ``key``), skipping those that overlap a taken one, up
    to ``limit`` per group; ``pick`` is the order in which they were taken.

    Rounds of local bests give what one pass in order would: an interval is taken when it comes first among all that it
    may meet in its nested bins, then what overlaps a taken one goes, and the rest has another round. Bests are kept per
    bin, so no pairs of candidates are formed however crowded a locus is; every round's rest is written once."""
    by = list(by)
    group = F.to_json(F.struct(*by)) if by else F.lit("")  # never NULL, so a group of NULL keys is one like others
    placed = df.select(
        group.alias("_g"), *by, F.col(key).alias("_key"), F.col(start).cast("bigint").alias("start"), F.col(end).cast("bigint").alias("end"),
        F.struct(*[c.alias(f"o{i}") for i, c in enumerate([*order, F.col(key)])]).alias("_o"),
    )
    rest, taken, cell = staged(placed, "candidates"), None, ["_g", "_level", "_bin"]
    while n_left := rest.count():
        # every candidate becomes a row per level, which small files packed into one task would not show
        rest = rest.repartition(-(-n_left // CANDIDATES_PER_TASK), "_g", "_key")
        shown = _nested_bins(rest, "start", "end", bin_width, first=False)  # side 1: at home, side 0: at home or above
        bests = shown.groupBy(*cell).agg(F.min(F.when(F.col("_side") == 1, F.col("_o"))).alias("_home"), F.min("_o").alias("_any"))
        # at home everything in the bin counts, above it what is at home there
        ahead = F.when(F.col("_side") == 1, F.col("_any")).otherwise(F.col("_home"))
        firsts = shown.join(bests, cell).groupBy("_g", *by, "_key", "start", "end", "_o").agg(F.min(ahead).alias("_ahead"))
        firsts = staged(firsts.where(F.col("_ahead") >= F.col("_o")).drop("_ahead"), "taken")
        spans = firsts.select("_g", "start", (F.col("end") + 1).alias("end"))
        flagged = flag_overlaps_merged(rest.withColumn("_stop", F.col("end") + 1), spans, ["_g"], start="start", end="_stop", bin_width=bin_width)
        rest = staged(flagged.where("NOT overlaps").drop("overlaps", "_stop"), "candidates")  # a taken one overlaps itself
        taken = firsts if taken is None else taken.unionByName(firsts)
    found = placed.limit(0) if taken is None else taken
    numbered = found.withColumn("pick", F.row_number().over(Window.partitionBy("_g").orderBy("_o")))
    kept = numbered if limit is None else numbered.where(F.col("pick") <= limit)
    return kept.select(*by, F.col("_key").alias(key), F.col("start").alias(start), F.col("end").alias(end), "pick")


def neighbour_run(df: DataFrame, by: Sequence[str], *, position: str, eligible: Column, step: int, name: str = "in_run") -> DataFrame:
    """True where the row and both neighbours exactly one ``step`` away are eligible."""
    by = list(by)
    around = (
        df.where(eligible)
        .select(*by, F.col(position).alias("_p"))
        .withColumn("_o", F.explode(F.array(*[F.lit(d).cast("bigint") for d in (-step, 0, step)])))
        .groupBy(*by, (F.col("_p") + F.col("_o")).alias(position))
        .agg(F.count_distinct("_o").alias("_k"))
        .where("_k = 3")
        .withColumn("_run", F.lit(True))
        .drop("_k")
    )
    return df.join(around, [*by, position], "left").withColumn(name, F.coalesce("_run", F.lit(False))).drop("_run")


def position_chunks(df: DataFrame, by: Sequence[str], position: str, size: int, *, tile: int = TILE) -> DataFrame:
    """Split each run of consecutive positions into half-open chunks of at most ``size`` positions."""
    by = list(by)
    spots = df.select(*by, F.col(position).cast("bigint").alias("_p")).distinct().withColumn("_tile", _tile_of(F.col("_p"), tile))
    carried = _carry(spots, by, "_m", F.max("_p"), "_last")
    within = Window.partitionBy(*by, "_tile").orderBy("_p")
    previous = F.coalesce(F.lag("_p").over(within), F.col("_last"))
    begun = carried.withColumn("_begin", F.when(previous.isNull() | (F.col("_p") != previous + 1), F.col("_p"))).drop("_last")
    begun = _carry(begun, by, "_m", F.max("_begin"), "_begin_before")
    run_start = F.greatest(
        "_begin_before", F.max("_begin").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    return (
        begun.withColumn("_run", run_start)
        .withColumn("_chunk", F.floor((F.col("_p") - F.col("_run")) / F.lit(size)))
        .groupBy(*by, "_run", "_chunk")
        .agg(F.min("_p").alias("chunk_start"), (F.max("_p") + 1).alias("chunk_end"), F.count(F.lit(1)).alias("n_positions"))
        .drop("_run", "_chunk")
    )


def sliding_windows(
    df: DataFrame,
    by: Sequence[str],
    *,
    position: str,
    value: str,
    width: int,
    protected: tuple[int, int] | None = None,
    tile: int = TILE,
) -> DataFrame:
    """Mean, sum, peak and first peak position of every window of ``width`` consecutive positions that is fully
    covered and clear of the protected inclusive range. One row per position is expected."""
    if width > tile:
        raise ValueError("a window must not be wider than a tile")
    by = list(by)
    own = df.select(*by, F.col(position).cast("bigint").alias("start"), F.col(value).alias("_v"))
    home = _tile_of(F.col("start"), tile)
    # rows near a tile's left edge also serve the windows that start in the tile before
    tiles = F.array_distinct(F.array(home, _tile_of(F.col("start") - F.lit(width - 1), tile)))
    spread = own.withColumn("_tile", F.explode(tiles))
    ahead = Window.partitionBy(*by, "_tile").orderBy("start").rangeBetween(0, width - 1)
    scored = spread.select(
        *by,
        "_tile",
        "start",
        (F.col("start") + F.lit(width - 1)).alias("end"),
        F.count(F.lit(1)).over(ahead).alias("_n"),
        F.avg("_v").over(ahead).alias("mean_value"),
        F.sum("_v").over(ahead).alias("sum_value"),
        F.max("_v").over(ahead).alias("peak_value"),
        F.min(F.struct((-F.col("_v")).alias("v"), F.col("start").alias("p"))).over(ahead).getField("p").alias("peak_position"),
    ).where((F.col("_n") == width) & (F.col("_tile") == home))
    if protected is not None:
        a, b = protected
        scored = scored.where(~((F.col("start") <= b) & (F.col("end") >= a)))
    return scored.drop("_n", "_tile")


def greedy_non_overlapping(
    df: DataFrame,
    by: Sequence[str],
    *,
    start: str,
    width: int,
    order: Sequence[Column],
    margin: int = 0,
    limit: int,
    step: int = 1,
    unique_starts: bool = False,
) -> DataFrame:
    """Take windows of one fixed width in ``order``, skipping any that comes within ``margin`` of a taken one,
    until ``limit`` are taken per group; ``pick`` is the order in which they were taken.

    Starts are made unique per group (skipped when they are known to be) and lie at least ``step`` apart, so a taken
    window blocks at most 2 * ((width - 1 + margin) // step) others and the first ``limit`` picks always lie among
    the first limit * (blocked + 1) candidates: exactly those are folded, however large the group is."""
    by = list(by)
    reach = width - 1 + margin
    needed = limit * (2 * (reach // step) + 1)
    if not unique_starts:
        df = best_row(df, [*by, start], list(order))
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*window_order(order), start))).where(F.col("_r") <= needed)
    # every row is given its group's few candidates, so that it tells by itself whether it is taken: no second pass
    candidate = F.struct(F.col("_r"), F.col(start).cast("bigint").alias("s"))
    listed = ranked.withColumn("_c", F.array_sort(F.collect_list(candidate).over(Window.partitionBy(*by))))
    taken = F.aggregate(
        "_c",
        F.array().cast("array<bigint>"),
        lambda kept, c: F.when(
            (F.size(kept) >= limit) | F.exists(kept, lambda t: F.abs(t - c["s"]) <= F.lit(reach)), kept
        ).otherwise(F.array_append(kept, c["s"])),
    )
    same = F.transform(F.col("_t"), lambda t: t.eqNullSafe(F.col(start).cast("bigint")))
    picked = listed.withColumn("_t", F.explode(F.array(taken))).withColumn("pick", F.array_position(same, F.lit(True)).cast("int"))
    return picked.where(F.col("pick") > 0).select(*df.columns, "pick")


def covered_positions(df: DataFrame, by: Sequence[str], *, start: str, end: str) -> DataFrame:
    """Distinct positions inside any of the inclusive windows."""
    return df.select(*by, F.explode(F.sequence(F.col(start), F.col(end))).alias("position")).distinct()
