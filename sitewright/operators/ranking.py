"""Order statistics that never put a whole group into one task.

Every group is cut into at most ``SPLIT_POINTS + 1`` cells. The cut points are taken from the entries whose content
hash falls on a fixed grid (about one in ``SPLIT_EVERY``, the smallest hashes first), so small groups stay in one
cell, huge ones get the full number, and every evaluation of the plan finds the same points: a lost executor cannot
shift them. NULL keys form a group like any other. Ranks inside a cell come from a window over (group, cell); the entries in earlier cells come from a
small per-cell aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import null_matching_join

SPLIT_EVERY = 4096
SPLIT_POINTS = 255
SPREAD = 32

UP_TO_PREVIOUS = (Window.unboundedPreceding, -1)


def join_back(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join an aggregate back to the rows it came from: NULL keys match; without keys the aggregate is one row."""
    if keys:
        return null_matching_join(left, right, list(keys), how=how)
    return left.join(F.broadcast(right), F.lit(True), how)


def join_spread(left: DataFrame, right: DataFrame, keys: Sequence[str], on: Column, how: str = "inner") -> DataFrame:
    """``join_back`` of one row per group where a few groups may hold most rows: each group is dealt over ``SPREAD`` parts
    by a hash of ``on``, and its one row goes to all of them."""
    if not keys:
        return join_back(left, right, keys, how)
    parted = left.withColumn("_part", F.pmod(F.xxhash64(on), F.lit(SPREAD)).cast("int"))
    copies = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return join_back(parted, copies, [*keys, "_part"], how).drop("_part")


def nulls_last(order: Sequence[Column]) -> list[Column]:
    """The ascending ``order`` with missing values after all others."""
    return [part for c in order for part in (c.isNull(), c)]


def window_order(order: Sequence[Column]) -> list[Column]:
    """An order for windows with missing values last; a column that states its direction keeps it (descending columns
    have missing values last by themselves)."""
    return [c if str(c).rstrip("'>").endswith(("NULLS FIRST", "NULLS LAST")) else c.asc_nulls_last() for c in order]


def _cut_points(df: DataFrame, by: list[str], value: str, split_every: int) -> DataFrame:
    """At most ``SPLIT_POINTS`` cut points per group, each once. The grid is the group's own, so that even a value that
    all groups have is a cut point in a few of them only: there are about as many points as entries / ``split_every``."""
    hashed = df.where(F.col(value).isNotNull()).select(*by, value, F.xxhash64(*by, value).alias("_h"))
    hashed = hashed.where(F.pmod("_h", F.lit(split_every)) == 0).distinct()
    if not by:
        hashed = hashed.orderBy("_h", value).limit(SPLIT_POINTS)
        return hashed.agg(F.sort_array(F.collect_list(value)).alias("_cuts"))
    smallest = Window.partitionBy(*by).orderBy("_h", value)
    return (
        hashed.withColumn("_r", F.row_number().over(smallest))
        .where(F.col("_r") <= SPLIT_POINTS)
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list(value)).alias("_cuts"))
    )


def count_below(df: DataFrame, cuts: str, entry: Column, most: int, *, name: str) -> DataFrame:
    """How many of a row's ascending ``cuts`` (``most`` at the most, NULL is none) lie below the ``entry``.

    A bisection in as many steps as ``most`` has bits. Each step is a column of its own, which Spark compiles; a
    higher-order function would be interpreted for every row."""
    df = df.withColumn(name, F.lit(0))
    for k in reversed(range(most.bit_length())):
        below = F.get(cuts, F.col(name) + F.lit((1 << k) - 1)) < entry
        df = df.withColumn(name, F.col(name) + F.when(below, F.lit(1 << k)).otherwise(F.lit(0)))
    return df


def with_cells(df: DataFrame, by: Sequence[str], value: str, *, split_every: int = SPLIT_EVERY) -> DataFrame:
    """Add ``_cell``, a bucket number that grows with ``value`` inside each group (0 everywhere in small groups).

    Groups without cut points are not in the small table of cuts, so it is broadcast: a join on the groups alone would
    send each group to one task."""
    by = list(by)
    cuts = F.broadcast(_cut_points(df, by, value, split_every))
    entry = F.col(value)
    joined = join_back(df, cuts, by, "left")
    return count_below(joined, "_cuts", entry, SPLIT_POINTS, name="_cell").drop("_cuts")


def _ranked(
    df: DataFrame, by: list[str], value: str, weight: str | None, split_every: int, with_mean: bool
) -> DataFrame:
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    distinct = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(size.cast("bigint").alias("n"))
    celled = with_cells(distinct, by, value, split_every=split_every)
    across = Window.partitionBy(*by).orderBy("_cell").rowsBetween(*UP_TO_PREVIOUS)
    whole = Window.partitionBy(*by)
    sums = [F.sum("n").alias("_n")]
    carried = [
        F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("n_total"),
    ]
    if with_mean:
        sums.append(F.sum(F.col("n") * F.col(value)).alias("_s"))
        carried.append((F.sum("_s").over(whole) / F.sum("_n").over(whole)).alias("mean"))
    per_cell = celled.groupBy(*by, "_cell").agg(*sums).select(*by, "_cell", *carried)
    within = Window.partitionBy(*by, "_cell").orderBy(value).rowsBetween(*UP_TO_PREVIOUS)
    return join_back(celled, per_cell, [*by, "_cell"]).select(
        *by,
        value,
        "n",
        (F.col("_before") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("n_less"),
        "n_total",
        *(["mean"] if with_mean else []),
    )


def value_ranks(
    df: DataFrame, by: Sequence[str], value: str, *, weight: str | None = None, split_every: int = SPLIT_EVERY
) -> DataFrame:
    """One row per distinct (group, value): ``n`` entries (or summed weight) equal to the value, ``n_less`` entries
    below it and ``n_total`` entries in the group. NULL values do not take part."""
    return _ranked(df, list(by), value, weight, split_every, False)


def row_positions(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    *,
    name: str = "position",
    split_every: int = SPLIT_EVERY,
) -> DataFrame:
    """Dense 1-based position of every row in its group under an ascending, total ``order``."""
    by = list(by)
    keyed = df.withColumn("_order", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    celled = with_cells(keyed, by, "_order", split_every=split_every)
    across = Window.partitionBy(*by).orderBy("_cell").rowsBetween(*UP_TO_PREVIOUS)
    # nothing lies before a first cell, so there are no more rows than cut points: few enough to broadcast
    before = (
        celled.groupBy(*by, "_cell")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*by, "_cell", F.sum("_n").over(across).alias("_before"))
        .where(F.col("_cell") > 0)
    )
    within = Window.partitionBy(*by, "_cell").orderBy("_order")
    return (
        join_back(celled, F.broadcast(before), [*by, "_cell"], "left")
        .withColumn(name, (F.coalesce("_before", F.lit(0)) + F.row_number().over(within)).cast("bigint"))
        .drop("_order", "_cell", "_before")
    )


def _quantile_parts(probs: dict[str, float], value: str) -> tuple[list[Column], list[Column]]:
    """Aggregates that pick the two neighbouring order statistics, and the interpolations between them."""
    aggregates, columns = [], []
    for name, p in probs.items():
        place = F.lit(float(p)) * (F.col("n_total") - 1)
        for side, target in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            covers = (F.col("n_less") <= target) & (target < F.col("n_less") + F.col("n"))
            aggregates.append(F.max(F.when(covers, F.col(value).cast("double"))).alias(f"_{name}_{side}"))
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        columns.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return aggregates, columns


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], *, split_every: int = SPLIT_EVERY
) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per entry of ``probs`` (name -> probability)."""
    aggregates, columns = _quantile_parts(probs, value)
    ranks = value_ranks(df, by, value, split_every=split_every)
    return ranks.groupBy(*by).agg(F.max("n_total").alias("n_total"), *aggregates).select(*by, *columns)


def distribution(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: dict[str, float],
    *,
    threshold: float | None = None,
    split_every: int = SPLIT_EVERY,
) -> DataFrame:
    """Count, mean, sd, extremes, sign fractions and exact quantiles per group from one pass over the input:
    everything after it works on the distinct values and their counts."""
    v, n = F.col(value).cast("double"), F.col("n")

    def share(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(F.lit(0))) / F.sum(n)

    aggregates, columns = _quantile_parts(probs, value)
    spread = F.sum(n * (v - F.col("mean")) * (v - F.col("mean")))
    grouped = _ranked(df, list(by), value, None, split_every, True).groupBy(*by).agg(
        F.max("n_total").alias("n_total"),
        F.max("mean").alias("mean"),
        F.sqrt(spread / F.when(F.sum(n) > 1, F.sum(n) - 1)).alias("sd"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        share(v > 0).alias("fraction_positive"),
        share(v < 0).alias("fraction_negative"),
        *([share(v >= threshold).alias("fraction_at_least")] if threshold is not None else []),
        *aggregates,
    )
    extra = ["fraction_at_least"] if threshold is not None else []
    return grouped.select(
        *by, F.col("n_total").alias("n"), "mean", "sd", "min", "max", "fraction_positive", "fraction_negative", *extra, *columns
    )


def mid_rank(ranks_n: Column | None = None, ranks_less: Column | None = None) -> Column:
    """Average rank of tied values from the columns of ``value_ranks``."""
    n = F.col("n") if ranks_n is None else ranks_n
    less = F.col("n_less") if ranks_less is None else ranks_less
    return less + (n + 1) / F.lit(2.0)


def attach_ranks(df: DataFrame, by: Sequence[str], value: str, columns: dict[str, Column], **split: int) -> DataFrame:
    """Join rank columns (expressions over n, n_less, n_total) back to the rows; NULL values get NULL ranks."""
    by = list(by)
    ranks = value_ranks(df, by, value, **split).select(*by, value, *[c.alias(k) for k, c in columns.items()])
    return join_back(df, ranks, [*by, value], "left")


def min_rank_descending() -> Column:
    """Rank by decreasing value where ties share the smallest rank."""
    return F.col("n_total") - F.col("n_less") - F.col("n") + 1


def average_percentile() -> Column:
    """Average rank divided by the group size."""
    return mid_rank() / F.col("n_total")


def top_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, *, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group; Spark trims every input partition to ``n`` rows before the shuffle."""
    window = Window.partitionBy(*by).orderBy(*window_order(order))
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)


def best_row(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group under an ascending ``order``, missing values last: one combinable aggregate, no
    window."""
    by = list(by)
    payload = [c for c in df.columns if c not in by]
    keyed = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(nulls_last(order))])
    # only the order key is compared, so the payload may hold any type
    best = df.groupBy(*by).agg(F.min_by(F.struct(*payload), keyed).alias("_best"))
    return best.select(*by, *[F.col(f"_best.{c}").alias(c) for c in payload])


def force_member(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, member: Column, *, name: str = "rank") -> DataFrame:
    """Top ``n`` per group where the mandatory row takes the last place if it did not make the cut. Equal rows stay
    separate."""
    by = list(by)
    flagged = df.withColumn("_must", F.coalesce(member, F.lit(False)))
    top = top_rows(flagged, by, order, n, name="_r")
    top = top.withColumn("_has", F.max("_must").over(Window.partitionBy(*by)))
    best = top_rows(flagged.where("_must"), by, order, 1, name="_r").drop("_r")
    present = top.where("_has").select(*by, F.lit(True).alias("_in")).distinct()
    missing = join_back(best, present, by, "left").where(F.col("_in").isNull()).drop("_in")
    wanted = missing.select(*by, F.lit(True).alias("_wanted"))
    full = join_back(top, wanted, by, "left")
    kept = full.where(F.col("_wanted").isNull() | (F.col("_r") < n)).drop("_r", "_has", "_wanted")
    final = Window.partitionBy(*by).orderBy((~F.col("_must")).cast("int"), *window_order(order))
    return kept.unionByName(missing).withColumn(name, F.row_number().over(final)).drop("_must")


def cohort_bounds(total: Column, size: int) -> dict[str, tuple[Column, Column]]:
    """1-based inclusive position ranges of the first, middle and last ``size`` rows."""
    middle = F.greatest(F.lit(0), F.floor((total - F.lit(size)) / F.lit(2)))
    return {
        "bottom": (F.lit(1), F.lit(size)),
        "middle": (middle + 1, middle + F.lit(size)),
        "top": (total - F.lit(size) + 1, total),
    }


def cohorts(df: DataFrame, by: Sequence[str], order: Sequence[Column], size: int, **split: int) -> DataFrame:
    """First, middle and last ``size`` rows of each ordered group, labelled in ``cohort``; a row may sit in several."""
    by = list(by)
    positioned = row_positions(df, by, order, name="cohort_position", **split)
    totals = positioned.groupBy(*by).agg(F.max("cohort_position").alias("_total"))
    joined = join_back(positioned, totals, by)
    labels = [
        F.when(F.col("cohort_position").between(low, high), F.lit(label))
        for label, (low, high) in cohort_bounds(F.col("_total"), size).items()
    ]
    return (
        joined.withColumn("cohort", F.explode(F.array_compact(F.array(*labels))))
        .drop("_total")
    )
