"""Perturbation designs as tables: every state is a row with its factors, its sequence and the sequence's hash."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..functions.expressions import bound, col, with_checks
from ..functions.intervals import overlap_length, upstream_placement_start

BASE_LIST = ("A", "C", "G", "T")


def tile_sequences(df: DataFrame, *, sequence: str, tile: int, halo: int = 0, start: str = "tile_start") -> DataFrame:
    """Cut long sequences into rows of ``tile`` bases plus ``halo`` bases of what follows."""
    n = F.length(sequence)
    begins = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(tile)))
    return df.withColumn(start, F.explode(begins)).withColumn(
        sequence, F.substring(F.col(sequence), F.col(start) + 1, F.lit(tile + halo))
    )


def regions_from_tiles(regions: DataFrame, tiles: DataFrame, by: Sequence[str], *, region_id: str, start0: str, end0: str, tile: int) -> DataFrame:
    """Sequence of each half-open region from a tiled table (by..., tile_start, sequence): equi join on the
    touched tiles, slice, ordered concatenation. A region that is not fully covered fails the job."""
    by = list(by)
    first = (F.floor(F.col(start0) / tile) * tile).cast("bigint")
    last = (F.floor((F.col(end0) - 1) / tile) * tile).cast("bigint")
    touched = regions.withColumn("_t", F.explode(F.sequence(first, last, F.lit(tile).cast("bigint"))))
    stored = tiles.select(*by, F.col("tile_start").cast("bigint").alias("_t"), F.col("sequence").alias("_s"))
    low = F.greatest(F.col(start0) - F.col("_t"), F.lit(0))
    high = F.least(F.col(end0) - F.col("_t"), F.lit(tile))
    pieces = touched.join(stored, [*by, "_t"], "left").withColumn(
        "_piece", F.substring(F.upper("_s"), (low + 1).cast("int"), (high - low).cast("int"))
    )
    # a region of n bases gathers n / tile + 2 pieces: bounded by its own length
    gathered = pieces.groupBy(*[c for c in regions.columns]).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_t", "_piece"))), lambda p: p["_piece"]), "").alias("sequence")
    )
    return with_checks(
        gathered,
        F.length("sequence") == F.col(end0) - F.col(start0),
        F.concat(F.lit("region is not covered by the tiles: "), F.col(region_id).cast("string")),
    )


def substitutions(df: DataFrame, *, sequence: str, start_position: str | Column | int = 1) -> DataFrame:
    """Each canonical position x the three other bases."""
    origin = F.lit(start_position) if isinstance(start_position, int) else col(start_position)
    keep = [c for c in df.columns if c != sequence]
    return (
        df.select(*keep, origin.alias("_origin"), F.posexplode(F.split(F.upper(F.col(sequence)), "")).alias("_i", "ref"))
        .where(sq.is_single_base("ref"))
        .withColumn("alt", F.explode(F.array(*[F.lit(b) for b in BASE_LIST])))
        .where(F.col("alt") != F.col("ref"))
        .withColumn("position", F.col("_origin") + F.col("_i"))
        .drop("_origin", "_i")
    )


def deletion_grid(df: DataFrame, *, sequence: str, cut: str, upstream: int, downstream: int, length: str | Column | int) -> DataFrame:
    """Delete u bases before and d bases after the cut for every (u, d); the extended sequence refills the tail up
    to the common ``length``."""
    keep = F.lit(length) if isinstance(length, int) else col(length)
    grid = df.withColumn("upstream", F.explode(F.sequence(F.lit(0), F.lit(upstream)))).withColumn(
        "downstream", F.explode(F.sequence(F.lit(0), F.lit(downstream)))
    )
    edited = sq.replace_segment(F.col(sequence), F.col(cut) - F.col("upstream"), F.col(cut) + F.col("downstream"), "")
    return grid.withColumn("edited", F.substring(edited, F.lit(1), keep)).withColumn(
        "sequence_sha256", sq.content_hash("edited")
    )


def apply_event(df: DataFrame, *, sequence: str, boundary: str, operation: str, event: str, length: str | Column | int) -> DataFrame:
    """Insert or delete ``event`` right of ``boundary`` (0-based) and trim to the common length. A deletion whose
    bases differ from the background fails the job."""
    keep = F.lit(length) if isinstance(length, int) else col(length)
    n = F.length(event)
    present = F.substring(F.col(sequence), F.col(boundary) + 1, n)
    checked = with_checks(
        df,
        (F.col(operation) != "deletion") | (present == F.col(event)),
        F.concat(F.lit("deleted bases differ from the background: "), F.col(event), F.lit(" vs "), present),
    )
    deletion = sq.replace_segment(sequence, F.col(boundary), F.col(boundary) + n, "")
    insertion = sq.replace_segment(sequence, F.col(boundary), F.col(boundary), F.col(event))
    edited = F.when(F.col(operation) == "deletion", deletion).otherwise(insertion)
    return checked.withColumn("edited", F.substring(edited, F.lit(1), keep)).withColumn(
        "sequence_sha256", sq.content_hash("edited")
    )


def complement_windows(df: DataFrame, *, sequence: str, width: int, step: int) -> DataFrame:
    """Sliding windows whose bases are swapped for their complements, as an edit (start, replacement)."""
    last = F.length(sequence) - F.lit(width)
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)))
    windows = df.withColumn("window_start", F.explode(starts)).withColumn(
        "native", F.substring(F.upper(F.col(sequence)), F.col("window_start") + 1, F.lit(width))
    )
    return windows.drop(sequence).select(
        "*",
        (F.col("window_start") + F.lit(width - 1)).alias("window_end"),
        sq.complement("native").alias("replacement"),
        sq.canonical_count("native").alias("n_changed"),
    )


def _texts(key: Sequence[Column]) -> list[Column]:
    return [k.cast("string") for k in key]


def shuffled(text: Column, *key: Column, protected: Column | None = None, must_differ: bool = False) -> Column:
    """Permute the canonical bases of ``text`` by keyed digest order. ``protected`` is an array of 0-based indices
    that stay; non-canonical characters stay too. With ``must_differ`` a draw that repeats the text is turned by one
    base, and the result is NULL where the free bases are all the same, so that no other order exists."""

    def movable(x: Column) -> Column:
        free = x["c"].isin(*BASE_LIST)
        return free if protected is None else free & ~F.array_contains(protected, x["i"])

    def keyed(x: Column) -> Column:
        digest = F.md5(F.concat_ws(":", *_texts(key), x["i"].cast("string")))
        return F.struct(digest.alias("k"), x["i"].alias("i"), x["c"].alias("c"))

    def permute(letters: Column) -> Column:
        def place(free: Column) -> Column:
            drawn = F.transform(F.array_sort(F.transform(free, keyed)), lambda x: x["c"])
            own = F.transform(free, lambda x: x["c"])

            def other(order: Column) -> Column:
                turned = F.concat(F.slice(order, 2, F.size(order)), F.slice(order, 1, 1))
                return F.when(order != own, order).when(turned != own, turned)

            order = bound(drawn, other) if must_differ else drawn
            moved = F.zip_with(free, order, lambda spot, base: F.struct(spot["i"].alias("i"), base.alias("c")))
            fixed = F.filter(letters, lambda x: ~movable(x))
            return F.array_join(F.transform(F.array_sort(F.concat(moved, fixed)), lambda x: x["c"]), "")

        return bound(F.filter(letters, movable), place)

    letters = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    return bound(letters, permute)


def shuffled_texts(text: Column, *key: Column) -> Column:
    """``shuffled`` of whole long texts, in batches: the same order at a fraction of its time a base."""

    @F.pandas_udf("string")
    def order(texts: pd.Series, prefixes: pd.Series) -> pd.Series:
        made = []
        for own, prefix in zip(texts, prefixes):
            letters = np.array(list(own or ""), dtype=object)
            spots = np.flatnonzero(np.isin(letters.astype("U1"), BASE_LIST))
            begun = hashlib.md5(prefix.encode())
            digests = bytearray()
            for i in spots.tolist():
                digest = begun.copy()
                digest.update(b"%d" % i)
                digests += digest.digest()
            high, low = np.frombuffer(bytes(digests), dtype=">u8").reshape(-1, 2).T
            letters[spots] = letters[spots[np.lexsort((low, high))]]
            made.append("".join(letters))
        return pd.Series(made, dtype=object)

    return F.when(text.isNotNull(), order(text, F.concat_ws(":", *_texts(key), F.lit(""))))


def shuffle_range(s: Column, start0: Column, end0: Column, *key: Column, must_differ: bool = False, anchor0: Column | None = None) -> Column:
    """Shuffle the half-open slice [start0, end0); with ``anchor0`` that index keeps its base."""
    piece = F.substring(s, start0 + 1, end0 - start0)
    protected = None if anchor0 is None else F.array((anchor0 - start0).cast("int"))
    order = shuffled(piece, *key, protected=protected, must_differ=must_differ)
    return F.when(end0 > start0, sq.replace_segment(s, start0, end0, order)).otherwise(s)


def component_design(
    df: DataFrame,
    *,
    sequence: str,
    anchor: str,
    components: Sequence[tuple[str, str, Sequence[tuple[int, int]]]],
    seeds: Sequence[int],
    alleles: dict[str, str],
    region: Sequence[str] = (),
) -> DataFrame:
    """Scramble each component's intervals (offsets from the anchor, inclusive) without the anchor base, for every
    seed, and set each allele at the anchor. A component without intervals is the native state. The states of
    one background must differ from each other at the anchor alone. ``region`` names the background in the shuffle key."""
    interval = "array<struct<a:int,b:int>>"
    levels = F.array(
        *[
            F.struct(
                F.lit(name).alias("component"),
                F.lit(family).alias("family"),
                (F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in spans]) if spans else F.array()).cast(interval).alias("spans"),
            )
            for name, family, spans in components
        ]
    )
    expanded = (
        df.withColumn("_c", F.explode(levels))
        .withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
        .select("*", "_c.*")
        .drop("_c")
    )
    start = F.struct(F.col(sequence).alias("s"), F.lit(0).alias("g"))

    def scramble(acc: Column, span: Column) -> Column:
        a, b = F.col(anchor) + span["a"], F.col(anchor) + span["b"] + 1
        inside = (F.col(anchor) >= a) & (F.col(anchor) < b)
        key = [F.col("seed"), F.col("component"), acc["g"], *map(F.col, region)]
        with_anchor = shuffle_range(acc["s"], a, b, *key, must_differ=True, anchor0=F.col(anchor))
        plain = shuffle_range(acc["s"], a, b, *key, must_differ=True)
        return F.struct(F.when(inside, with_anchor).otherwise(plain).alias("s"), (acc["g"] + 1).alias("g"))

    background = expanded.withColumn("background", F.aggregate("spans", start, scramble)["s"]).withColumn(
        "n_changed", _differences(F.col("background"), F.col(sequence))
    )
    return with_alleles(background.drop("spans"), background="background", anchor=anchor, alleles=alleles)


def _differences(a: Column, b: Column) -> Column:
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x != y, 1).otherwise(0))
    return F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x)


def with_alleles(df: DataFrame, *, background: str, anchor: str, alleles: dict[str, str]) -> DataFrame:
    """One row per allele, the allele's base set at the anchor; equal to the background everywhere else by
    construction of the edit."""
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("allele"), F.lit(v).alias("_base")) for k, v in alleles.items()]))
    return (
        df.withColumn("_a", levels)
        .select("*", "_a.*")
        .withColumn("edited", sq.set_base(background, F.col(anchor), F.col("_base")))
        .withColumn("sequence_sha256", sq.content_hash("edited"))
        .drop("_a", "_base", background)
    )


def arm_template(
    df: DataFrame, *, sequence: str, anchor: str, half: int, seed: Column, protect_from: int, protect_to: int, name: str = "template",
    region: Sequence[str] = (),
) -> DataFrame:
    """Shuffle the two arms of the anchor's neighbourhood independently; offsets protect_from..protect_to stay.
    Composition of each arm is kept by construction."""
    a, n = F.col(anchor), F.length(sequence)
    left0, left1 = F.greatest(a - half, F.lit(0)), a + protect_from
    right0, right1 = a + protect_to + 1, F.least(a + half + 1, n)
    once = shuffle_range(F.col(sequence), left0, left1, seed, F.lit("left"), *map(F.col, region))
    return df.withColumn(name, once).withColumn(name, shuffle_range(F.col(name), right0, right1, seed, F.lit("right"), *map(F.col, region)))


def copy_native(background: Column, native: Column, start0: Column, end0: Column) -> Column:
    """Put the native bases back on [start0, end0)."""
    return F.when(
        end0 > start0, sq.replace_segment(background, start0, end0, F.substring(native, start0 + 1, end0 - start0))
    ).otherwise(background)


def recovery_design(
    df: DataFrame,
    *,
    sequence: str,
    anchor: str,
    half: int,
    seeds: Sequence[int],
    upstream_extents: Sequence[int],
    downstream_extents: Sequence[int],
    protect_from: int,
    protect_to: int,
    alleles: dict[str, str],
    region: Sequence[str] = (),
) -> DataFrame:
    """Native state, motif-only baseline, and one-sided recovery of native sequence by growing extents."""
    seeded = df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    based = arm_template(
        seeded, sequence=sequence, anchor=anchor, half=half, seed=F.col("seed"), protect_from=protect_from, protect_to=protect_to,
        region=region,
    )

    def level(condition: str, arm: str, extent: int) -> Column:
        return F.struct(F.lit(condition).alias("condition"), F.lit(arm).alias("arm"), F.lit(extent).alias("extent"))

    levels = [level("native", "none", -1), level("motif_only", "shared", 0)]
    levels += [level("upstream_recovery", "upstream", e) for e in upstream_extents if e > 0]
    levels += [level("downstream_recovery", "downstream", e) for e in downstream_extents if e > 0]
    grid = based.withColumn("_l", F.explode(F.array(*levels))).select("*", "_l.*").drop("_l")
    a, native, template = F.col(anchor), F.col(sequence), F.col("template")
    background = (
        F.when(F.col("condition") == "native", native)
        .when(F.col("condition") == "upstream_recovery", copy_native(template, native, F.greatest(a - F.col("extent"), F.lit(0)), a + protect_from))
        .when(F.col("condition") == "downstream_recovery", copy_native(template, native, a + protect_to + 1, F.least(a + F.col("extent") + 1, F.length(native))))
        .otherwise(template)
    )
    return with_alleles(grid.withColumn("background", background).drop("template"), background="background", anchor=anchor, alleles=alleles)


def boundary_design(
    df: DataFrame,
    *,
    sequence: str,
    anchor: str,
    half: int,
    seeds: Sequence[int],
    upstream: tuple[int, int],
    downstream: tuple[int, int],
    alleles: dict[str, str],
    region: Sequence[str] = (),
) -> DataFrame:
    """All (upstream, downstream) windows x seeds x {outside scrambled, inside scrambled} x alleles. The template
    leaves only the anchor base alone."""
    seeded = df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    based = arm_template(seeded, sequence=sequence, anchor=anchor, half=half, seed=F.col("seed"), protect_from=0, protect_to=0, region=region)
    grid = (
        based.withColumn("upstream", F.explode(F.sequence(F.lit(upstream[0]), F.lit(upstream[1]))))
        .withColumn("downstream", F.explode(F.sequence(F.lit(downstream[0]), F.lit(downstream[1]))))
        .withColumn("condition", F.explode(F.array(F.lit("outside_scramble"), F.lit("inside_scramble"))))
    )
    a = F.col(anchor)
    start0, end0 = a - F.col("upstream"), a + F.col("downstream") + 1
    outside = copy_native(F.col("template"), F.col(sequence), start0, end0)
    inside = copy_native(F.col(sequence), F.col("template"), start0, end0)
    background = F.when(F.col("condition") == "outside_scramble", outside).otherwise(inside)
    return with_alleles(grid.withColumn("background", background).drop("template"), background="background", anchor=anchor, alleles=alleles)


def donor_fragments(df: DataFrame, *, sequence: str, anchor: str, upstream: int, downstream: int, native_base: str, other_base: str, seed: int, region: Sequence[str] = ()) -> DataFrame:
    """Native-allele, other-allele and scrambled-control fragments around the anchor; the scramble keeps the
    anchor base and the composition. A background without the expected base fails the job."""
    fragment = F.substring(F.col(sequence), F.col(anchor) - upstream + 1, F.lit(upstream + downstream + 1))
    cut = with_checks(
        df.withColumn("_native", fragment),
        sq.base_at(sequence, F.col(anchor)) == native_base,
        F.concat(F.lit("unexpected base at the anchor: "), sq.base_at(sequence, F.col(anchor))),
    )
    other = sq.set_base("_native", upstream, other_base)
    scrambled = shuffled(F.col("_other"), F.lit(seed), *map(F.col, region), protected=F.array(F.lit(upstream)))
    keep = [c for c in df.columns if c != sequence]
    return cut.withColumn("_other", other).select(
        *keep,
        F.explode(
            F.array(
                F.struct(F.lit("native").alias("donor_group"), F.col("_native").alias("donor")),
                F.struct(F.lit("other").alias("donor_group"), F.col("_other").alias("donor")),
                F.struct(F.lit("scrambled").alias("donor_group"), scrambled.alias("donor")),
            )
        ).alias("_d"),
    ).select(*keep, "_d.*")


def place_upstream(df: DataFrame, *, sequence: str, tss: str, strand: str, origin0: str | Column, donor: str, distances: Sequence[int]) -> DataFrame:
    """Put the donor ``distance`` bases upstream of the start site on its strand, length kept; a donor that does not
    fit the sequence fails the job."""
    start = origin0 if isinstance(origin0, Column) else F.col(origin0)
    placed = df.withColumn("distance", F.explode(F.array(*[F.lit(d) for d in distances]))).withColumn(
        "_s", (upstream_placement_start(tss, strand, F.length(donor), F.col("distance")) - 1 - start).cast("int")
    )
    fits = (F.col("_s") >= 0) & (F.col("_s") + F.length(donor) <= F.length(sequence))
    checked = with_checks(placed, fits, F.concat(F.lit("donor does not fit at offset "), F.col("_s").cast("string")))
    return (
        checked.withColumn("edited", sq.replace_segment(sequence, F.col("_s"), F.col("_s") + F.length(donor), F.upper(donor)))
        .withColumn("placement_start", F.col("_s") + 1 + start)
        .withColumn("sequence_sha256", sq.content_hash("edited"))
        .drop("_s")
    )


def site_states(
    sites: DataFrame, by: Sequence[str], *, sequence: str, origin0: str, role: str, replacement_start: str, donors: dict[str, str]
) -> DataFrame:
    """The native state once per key plus each site x donor replacement on the key's shared window."""
    by = list(by)
    native = sites.groupBy(*by, origin0).agg(F.first(sequence).alias("edited")).select(
        *by, F.lit("native_shared").alias(role), F.lit("native").alias("construct"), "edited"
    )
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("construct"), F.lit(v).alias("_donor")) for k, v in donors.items()]))
    slot = (F.col(replacement_start) - F.col(origin0)).cast("int")
    edited = (
        sites.withColumn("_d", levels)
        .select("*", "_d.*")
        .withColumn("edited", sq.replace_segment(sequence, slot, slot + F.length("_donor"), F.col("_donor")))
    )
    edited = with_checks(edited, F.length("edited") == F.length(sequence), "replacement changed the sequence length")
    return native.unionByName(edited.select(*by, role, "construct", "edited")).withColumn(
        "sequence_sha256", sq.content_hash("edited")
    )


def spanning_deletion(df: DataFrame, *, sequence: str, origin: int | Column, anchor: str, deletion_start: str, deletion_end: str) -> DataFrame:
    """One variant record covering both the anchor and a deletion (1-based inclusive): reference span and the
    alternate with the deleted bases removed."""
    at = origin if isinstance(origin, Column) else F.lit(origin)
    low = F.least(F.col(anchor), F.col(deletion_start) - 1)
    high = F.greatest(F.col(anchor), F.col(deletion_end))
    ref = F.substring(F.col(sequence), (low - at + 1).cast("int"), (high - low + 1).cast("int"))
    alt = sq.replace_segment(ref, (F.col(deletion_start) - low).cast("int"), (F.col(deletion_end) - low + 1).cast("int"), "")
    return df.withColumn("position", low).withColumn("ref", ref).withColumn("alt", alt)


def combined_edits(
    windows: DataFrame, choices: DataFrame, by: Sequence[str], *, start: str, end: str, sequence: str, origin: str | Column
) -> DataFrame:
    """Apply the chosen base at every position inside each inclusive window to the window's sequence; positions
    without a choice keep theirs. ``edits`` lists them in order."""
    by = list(by)
    o = origin if isinstance(origin, Column) else F.col(origin)
    listed = windows.withColumn("position", F.explode(F.sequence(F.col(start), F.col(end))))
    found = listed.join(choices.select(*by, "position", F.col("alt").alias("_alt")), [*by, "position"])
    keys = [*by, start, end]
    # a window gathers at most its own width of edits
    gathered = found.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("position"), F.col("_alt").alias("alt")))).alias("_e")
    )
    joined = windows.join(gathered, keys, "left")
    edited = F.aggregate(
        F.coalesce("_e", F.array().cast(gathered.schema["_e"].dataType)),
        F.col(sequence),
        lambda s, e: sq.set_base(s, (e["position"] - o).cast("int"), e["alt"]),
    )
    return joined.withColumn("edited", edited).withColumn(
        "edits", F.coalesce(F.array_join(F.transform("_e", lambda e: F.concat(e["position"].cast("string"), F.lit(">"), e["alt"])), ";"), F.lit(""))
    ).drop("_e")


def junction_facts(
    df: DataFrame,
    *,
    sequence: str,
    cut: str,
    upstream: str,
    downstream: str,
    anchor: str,
    pattern: str,
    features: dict[str, tuple[str, str]],
    flank: int = 20,
) -> DataFrame:
    """What a deletion does around its junction. ``sequence`` is the native one; ``cut``, ``anchor`` and the inclusive
    features are 1-based positions in it, and positions cut-upstream+1 .. cut+downstream go.

    Adds the deleted span (``event_start``, ``event_end``), ``<feature>_overlap``, the 2 * ``flank`` bases around the
    junction after the deletion (only those are put together), the index of the junction in them, ``hits`` of the pattern,
    ``crossing`` (those that the junction runs through) and ``anchor_index`` (NULL where the anchor is gone). What such
    facts amount to is the caller's: see ``labelled``."""
    out = df.withColumn("event_start", F.col(cut) - F.col(upstream) + 1).withColumn("event_end", F.col(cut) + F.col(downstream))
    for name, (a, b) in features.items():
        out = out.withColumn(f"{name}_overlap", overlap_length("event_start", "event_end", F.col(a), F.col(b)))
    begin = F.col(cut) - flank + 1
    kept = F.col("event_start") - begin  # bases of the window before the junction
    before = F.substring(F.col(sequence), begin.cast("int"), kept.cast("int"))
    after = F.substring(F.col(sequence), (F.col("event_end") + 1).cast("int"), (F.lit(2 * flank) - kept).cast("int"))
    out = out.withColumn("junction_index", kept).withColumn("local_sequence", F.concat(before, after))
    out = out.withColumn("hits", sq.occurrences("local_sequence", pattern))
    at, size = F.col("junction_index"), F.lit(len(pattern))
    lost = F.col("event_end") - F.col("event_start") + 1
    place = F.col(anchor) - begin - F.when(F.col(anchor) > F.col("event_end"), lost).otherwise(F.lit(0))
    gone = (F.col(anchor) >= F.col("event_start")) & (F.col(anchor) <= F.col("event_end"))
    return out.withColumn("crossing", F.filter("hits", lambda h: (h < at) & (h + size > at))).withColumn(
        "anchor_index", F.when(~gone, place)
    )


def labelled(df: DataFrame, name: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Add the label of the first rule (a SQL condition and its label) that holds, NULL where none does."""
    label = F.lit(None).cast("string")
    for condition, text in reversed(list(rules)):
        label = F.when(F.expr(condition), F.lit(text)).otherwise(label)
    return df.withColumn(name, label)


def reference_allele_report(df: DataFrame, *, sequence: str, index0: str | Column, candidates: Sequence[str]) -> DataFrame:
    """Which of the candidate alleles the reference sequence carries at the position; ``reference_ok`` is false
    when none does."""
    base = sq.base_at(sequence, col(index0))
    matched = F.when(base == F.col(candidates[0]), F.col(candidates[0])).when(base == F.col(candidates[1]), F.col(candidates[1]))
    other = F.when(base == F.col(candidates[0]), F.col(candidates[1])).when(base == F.col(candidates[1]), F.col(candidates[0]))
    return df.withColumn("reference_base", base).withColumn("ref", matched).withColumn("alt", other).withColumn(
        "reference_ok", matched.isNotNull()
    )
