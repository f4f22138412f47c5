"""Content-addressed batch scoring with a pluggable scorer, a sharded append-only store and resumable scans.

A state is a region and a list of edits; its key is a hash of the region's content hash and the edits. Designs, dedupe
and the anti join with the store carry keys and edits only; a region's sequence joins once, and a state's sequence is put
together next to the scorer.

Scans of very many states per region go further: their states are named by places in a region, and a region's places and
stored scores cross a shuffle as one row each (``score_places``, ``scores_in_regions``)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import sequences as sq
from ..session import staged
from .design import complement_windows, substitutions
from .intervals import greedy_non_overlapping
from .ranking import best_row

Scorer = Callable[[pd.DataFrame], pd.DataFrame]
#: Sequences of a frame to one array (positions x tracks) each.
TrackScorer = Callable[[pd.Series], list[np.ndarray]]

SIGNAL = "signal double, n_bases bigint"
EDITS = "array<struct<start: int, stop: int, text: string>>"
#: What a score store holds beside the key and the outputs: the call that made a row, and the attempts it took.
CALLS = "call string, attempts int"


def composition_scorer(frame: pd.DataFrame) -> pd.DataFrame:
    """Deterministic stand-in for a model: G+C share and length of each sequence."""
    text = frame["sequence"]
    size = text.str.len()
    gc = text.str.count("G") + text.str.count("C")
    return pd.DataFrame({"signal": gc / size.where(size > 0), "n_bases": size.astype("int64")})


def weight_scorer(weights: dict[str, float]) -> Scorer:
    """A closed-form scorer that edits do change: the sum of a weight per base."""

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        texts = list(frame["sequence"])
        signal = np.zeros(len(texts))
        for base, weight in weights.items():
            signal += np.array([text.count(base) for text in texts], dtype=np.float64) * weight
        return pd.DataFrame({"signal": signal, "n_bases": np.array([len(text) for text in texts], dtype=np.int64)})

    return score


# --- states -----------------------------------------------------------------------------------------------------------


def no_edits() -> Column:
    return F.array().cast(EDITS)


def one_edit(start: str | Column, stop: str | Column, text: str | Column, native: str | Column) -> Column:
    """The edit of a half-open slice (0-based), none where it changes nothing, NULL where there is no text to put there."""
    at = [(F.col(c) if isinstance(c, str) else c) for c in (start, stop, text, native)]
    edit = F.struct(at[0].cast("int").alias("start"), at[1].cast("int").alias("stop"), at[2].alias("text"))
    return F.when(at[2] == at[3], no_edits()).when(at[2].isNotNull(), F.array(edit).cast(EDITS))


def state_key(region_hash: str | Column, edits: str | Column) -> Column:
    """The region's hash for its native state, else a hash of it and the edits in ascending order; NULL without a state."""
    h, e = (F.col(c) if isinstance(c, str) else c for c in (region_hash, edits))

    def told(x: Column) -> Column:
        return F.concat_ws(":", x["start"].cast("string"), x["stop"].cast("string"), x["text"])

    # one edit, which most states have, is not left to a function that Spark interprets
    listed = F.when(F.size(e) == 1, told(F.get(e, F.lit(0)))).otherwise(F.array_join(F.transform(e, told), "|"))
    return F.when(F.size(e) == 0, h).when(e.isNotNull(), F.sha2(F.concat_ws("|", h, listed), 256))


#: Hex digits that the keys of a region's states have in common in a store, and those after them that tell them apart: 64
#: bits among the states of one region, so that any two of 100 million regions of 100 states share a key by chance of 3e-8.
REGION_DIGITS, STATE_DIGITS = 32, 16


def region_of(key: str | Column) -> Column:
    """The digits of a stored key, or of a region's hash, that name the region."""
    return F.substring(F.col(key) if isinstance(key, str) else key, 1, REGION_DIGITS)


def stored_key(region_hash: str | Column, edits: str | Column) -> Column:
    """The key of a scan's state: the region's hash for its native state, else the digits that name the region and the
    first of ``state_key``. The states of a region begin alike, so they share a shard, lie side by side and are found by
    their region."""
    h, e = (F.col(c) if isinstance(c, str) else c for c in (region_hash, edits))
    return F.when(F.size(e) == 0, h).otherwise(F.concat(region_of(h), F.substring(state_key(h, e), 1, STATE_DIGITS)))


def with_region_hash(regions: DataFrame, *, sequence: str) -> DataFrame:
    return regions.withColumn("region_hash", sq.content_hash(sequence))


def native_states(regions: DataFrame, by: Sequence[str], *, sequence: str) -> DataFrame:
    """The unedited state of every region that has a sequence."""
    hashed = with_region_hash(regions.where(F.col(sequence).isNotNull()), sequence=sequence)
    return hashed.select(*by, F.col("region_hash").alias("key"), no_edits().alias("edits"))


def window_states(regions: DataFrame, by: Sequence[str], *, sequence: str, width: int, step: int) -> DataFrame:
    """Complement windows of a coarse scan, with the region's hash and the native bases of each window."""
    windows = complement_windows(with_region_hash(regions, sequence=sequence), sequence=sequence, width=width, step=step)
    edits = one_edit("window_start", F.col("window_start") + width, "replacement", "native")
    made = windows.select(*by, "region_hash", "window_start", "window_end", "native", edits.alias("edits"))
    return made.withColumn("key", stored_key("region_hash", "edits"))


def substitution_states(
    windows: DataFrame, by: Sequence[str], *, native: str = "native", start: str = "window_start"
) -> DataFrame:
    """The three substitutions of every base of each window. Windows bring their bases and the region's hash, so no
    sequence is read."""
    bases = windows.select(*by, "region_hash", start, F.posexplode(F.split(F.col(native), "")).alias("_i", "ref"))
    bases = bases.where(sq.is_single_base("ref")).withColumn("alt", F.explode(F.array(*[F.lit(b) for b in "ACGT"])))
    bases = bases.where(F.col("alt") != F.col("ref")).withColumn("position", F.col(start) + F.col("_i")).drop("_i")
    made = bases.withColumn("edits", one_edit("position", F.col("position") + 1, "alt", "ref"))
    return made.withColumn("key", stored_key("region_hash", "edits"))


def exhaustive_candidates(df: DataFrame, *, sequence: str, chrom: str, start_position: str | int = 1) -> DataFrame:
    """All substitutions with their variant keys."""
    return substitutions(df, sequence=sequence, start_position=start_position).withColumn(
        "variant_key", F.concat(F.col(chrom).cast("string"), F.lit(":"), sq.variant_label("position", "ref", "alt"))
    )


# --- the scorer's side ------------------------------------------------------------------------------------------------


def score_batches(
    states: DataFrame, scorer: Scorer, *, outputs: str, batch_size: int = 64, attempts: int = 3, extra: Sequence[str] = ()
) -> DataFrame:
    """Run the scorer over batches of at most ``batch_size`` rows of (key, sequence, extra...), retrying a failed batch;
    a lost executor's batches are run again as a task. Each row names the call that made it (the key of its first row)
    and the attempts that took, so counts taken from committed rows are right however often tasks were repeated."""
    schema = StructType([states.schema["key"], *StructType.fromDDL(f"{outputs}, {CALLS}").fields])
    named = StructType.fromDDL(outputs).names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done, sizes, tries = [], [], []  # the calls of a frame leave the task together, not as a small Arrow batch each
            for at in range(0, len(frame), batch_size):
                piece = frame.iloc[at : at + batch_size].reset_index(drop=True)
                for attempt in range(1, attempts + 1):
                    try:
                        scored = scorer(piece)
                        break
                    except Exception:
                        if attempt == attempts:
                            raise
                if len(scored) != len(piece):
                    raise ValueError(f"the scorer gave {len(scored)} rows for {len(piece)} sequences")
                done.append(scored)
                sizes.append(len(piece))
                tries.append(attempt)
            if done:
                # columns are joined, not frames: a frame per call costs more than many a scorer
                columns = {name: np.concatenate([part[name].to_numpy() for part in done]) for name in named}
                calls = np.repeat(frame["key"].to_numpy()[::batch_size], sizes)
                yield pd.DataFrame({"key": frame["key"].to_numpy(), **columns, "call": calls, "attempts": np.repeat(np.array(tries, np.int32), sizes)})

    return states.select("key", "sequence", *extra).mapInPandas(run, schema)


@dataclass(frozen=True)
class Gene:
    """A gene and the half-open window of a region (0-based) that its signal is the mean of."""

    name: str
    strand: str
    start: int
    stop: int


@dataclass(frozen=True)
class Track:
    """What column of a scorer's array is which track."""

    name: str
    strand: str
    modality: str


#: What a track store holds of a state: a value per entry of ``gene_tracks`` and their mean per entry of ``gene_cells``,
#: NULL where the scorer gave none.
TRACK_VALUES = "tracks array<double>, cells array<double>"


def gene_tracks(tracks: Sequence[Track], genes: Sequence[Gene]) -> list[tuple[Gene, int, Track]]:
    """Each gene with the strand-compatible tracks and their columns, those of a modality and gene side by side."""
    pairs = [(g, k, t) for g in genes for k, t in enumerate(tracks) if g.strand not in ("+", "-") or t.strand in (g.strand, ".")]
    return sorted(pairs, key=lambda pair: (pair[2].modality, pair[0].name))


def gene_cells(pairs: Sequence[tuple[Gene, int, Track]]) -> dict[tuple[str, str], list[int]]:
    """The places in ``gene_tracks`` of each (modality, gene)."""
    cells: dict[tuple[str, str], list[int]] = {}
    for i, (gene, _, track) in enumerate(pairs):
        cells.setdefault((track.modality, gene.name), []).append(i)
    return cells


def reduced_tracks(scorer: TrackScorer, tracks: Sequence[Track], genes: Sequence[Gene]) -> Scorer:
    """A scorer with two lists per state (``TRACK_VALUES``): for each gene and strand-compatible track the mean over the
    gene's window, and their means per modality and gene. Arrays are reduced where they are made; no full track leaves the
    task, and no name is repeated per state."""
    windows = list(dict.fromkeys((g.start, g.stop) for g in genes))
    pairs = gene_tracks(tracks, genes)
    places = [windows.index((g.start, g.stop)) * len(tracks) + k for g, k, _ in pairs]
    starts = [run[0] for run in gene_cells(pairs).values()]

    def means(sums: np.ndarray, counts: np.ndarray) -> list:
        rows = np.divide(sums, counts, out=np.zeros(sums.shape), where=counts > 0)
        if (counts > 0).all():
            return list(rows)
        rows = rows.astype(object)
        rows[counts == 0] = None
        return rows.tolist()

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        arrays = scorer(frame["sequence"])
        alike: dict[int, list[int]] = {}
        for i, array in enumerate(arrays):
            if array.ndim != 2 or array.shape[1] != len(tracks):
                raise ValueError(f"the scorer gave an array of shape {array.shape} for {len(tracks)} tracks")
            alike.setdefault(len(array), []).append(i)
        rows, cells = np.empty(len(arrays), dtype=object), np.empty(len(arrays), dtype=object)
        for of in alike.values():
            # arrays of a length are reduced together, all tracks of a window at once
            sums, counts = np.zeros((2, len(of), len(windows), len(tracks)))
            for w, (start, stop) in enumerate(windows):
                part = np.array([arrays[i][start:stop] for i in of], dtype=np.float64)
                there = ~np.isnan(part)
                counts[:, w] = there.sum(axis=1)
                sums[:, w] = np.where(there, part, 0.0).sum(axis=1)
            sums, counts = (x.reshape(len(of), -1)[:, places] for x in (sums, counts))
            given = np.divide(sums, counts, out=np.zeros(sums.shape), where=counts > 0)
            held = [means(sums, counts)]
            held.append(means(np.add.reduceat(given, starts, axis=1), np.add.reduceat(counts > 0, starts, axis=1, dtype=int)) if starts else held[0])
            for i, values, shared in zip(of, *held):
                rows[i], cells[i] = values, shared
        return pd.DataFrame({"tracks": rows, "cells": cells})

    return score


# --- the store --------------------------------------------------------------------------------------------------------


#: Files that a task writes at the same time.
MOST_OPEN_FILES = 16


def shard_of(key: str | Column = "key", prefix: int = 1) -> Column:
    return F.substring(F.col(key) if isinstance(key, str) else key, 1, prefix)


def sorted_side(df: DataFrame) -> DataFrame:
    """The side of a join that must not be broadcast. Stores and designs shrink in their files (one region's rows share a
    hash, a call's rows its name), so Spark takes them for small and would hold many times that size on the driver."""
    return df.hint("merge")


def read_store(spark: SparkSession, path: str, outputs: str, shards: Sequence[str] | None = None) -> DataFrame:
    """The score store (key, outputs, call, attempts), empty before the first append. With ``shards`` only those folders
    are read."""
    schema = f"key string, {outputs}, {CALLS}"
    try:
        stored = spark.read.schema(f"{schema}, shard string").parquet(path)
        stored.columns
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        # no rows without a Python task
        none = StructType.fromDDL(schema)
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in none])
    if shards is not None:
        stored = stored.where(F.col("shard").isin(list(shards)))
    return stored.drop("shard")


def append_store(scored: DataFrame, path: str, prefix: int = 1, *, gathered: bool = True) -> None:
    """Append scored rows, each shard's in one folder and, per append, up to 16 files of rows sorted by key: shards alone
    would be fewer tasks than a cluster has cores. Not ``gathered``, rows are written by the tasks that scored them in the
    order in which they come, one file per task and shard, and cross neither a shuffle nor a sort."""
    sharded, open_files = scored.withColumn("shard", shard_of("key", prefix)), "spark.sql.maxConcurrentOutputFileWriters"
    if gathered:
        sharded = sharded.repartition("shard", shard_of("key", prefix + 1)).sortWithinPartitions("shard", "key")
    conf = scored.sparkSession.conf
    before = conf.get(open_files)
    if not gathered and int(before) < 16**prefix <= MOST_OPEN_FILES:
        conf.set(open_files, str(16**prefix))  # else Spark sorts all rows of a task by shard first
    try:
        # keys are digits of a hash: zstd halves them, which snappy cannot
        sharded.write.mode("append").option("compression", "zstd").partitionBy("shard").parquet(path)
    finally:
        conf.set(open_files, before)


def pending_states(spark: SparkSession, designs: DataFrame, by: Sequence[str], store_path: str, outputs: str, *, prefix: int = 1, prune: bool = False) -> DataFrame:
    """Distinct states (key, by..., edits) that the store lacks. With ``prune`` the shards that the designs' keys lie in
    are looked up first (at most 16 ** ``prefix`` names reach the driver) and only those are read: right for a
    micro-batch, whereas a whole design touches every shard anyway."""
    shards = None
    if prune:
        shards = [row.shard for row in designs.select(shard_of("key", prefix).alias("shard")).distinct().collect()]
    states = designs.select("key", *by, "edits").dropDuplicates(["key"])
    return states.join(sorted_side(read_store(spark, store_path, outputs, shards).select("key")), "key", "left_anti")


def score_pending(
    spark: SparkSession,
    designs: DataFrame,
    regions: DataFrame,
    by: Sequence[str],
    store_path: str,
    scorer: Scorer,
    *,
    sequence: str,
    outputs: str = SIGNAL,
    extra: Sequence[str] = (),
    batch_size: int = 64,
    attempts: int = 3,
    prefix: int = 1,
    prune: bool = False,
) -> None:
    """Score the states of ``designs`` (by..., key, edits) that the store lacks and append them.

    ``by`` names the region of a state; ``regions`` has its ``sequence`` and the ``extra`` columns that the scorer reads.
    The join ships a region's sequence once, however many states it has; edited sequences cross no shuffle."""
    todo = pending_states(spark, designs, by, store_path, outputs, prefix=prefix, prune=prune)
    joined = todo.join(sorted_side(regions.select(*by, F.col(sequence).alias("_region"), *extra)), list(by))
    states = joined.select("key", sq.apply_edits("_region", "edits").alias("sequence"), *extra)
    scored = score_batches(states, scorer, outputs=outputs, batch_size=batch_size, attempts=attempts, extra=extra)
    append_store(scored, store_path, prefix)


def with_scores(spark: SparkSession, designs: DataFrame, store_path: str, outputs: str = SIGNAL) -> DataFrame:
    """Expand stored scores to all design rows."""
    scores = latest(read_store(spark, store_path, outputs).drop("call", "attempts"), ["key"])
    return designs.join(sorted_side(scores), "key", "left")


def latest(store: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """One stored row per key: the newest by ``order`` (ascending = newest first), or any of equal rows."""
    if order is None:
        return store.dropDuplicates(list(keys))
    return best_row(store, keys, order)


def scoring_counters(store: DataFrame) -> DataFrame:
    """Scored ``units``, scorer ``calls``, ``requests`` (attempts of all calls) and ``retries``, from the store's rows."""
    calls = store.groupBy("call").agg(F.count(F.lit(1)).alias("units"), F.max("attempts").cast("bigint").alias("requests"))
    return calls.agg(
        F.coalesce(F.sum("units"), F.lit(0)).alias("units"),
        F.count(F.lit(1)).alias("calls"),
        F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"),
        F.coalesce(F.sum(F.col("requests") - 1), F.lit(0)).alias("retries"),
    )


# --- scans ------------------------------------------------------------------------------------------------------------


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns from a generator row: filters on them stay above it and do not work them out again."""
    return df.select("*", F.inline(F.array(F.struct(*[column.alias(name) for name, column in columns.items()]))))


def is_empty_store(spark: SparkSession, path: str) -> bool:
    """Whether nothing was ever appended."""
    try:
        spark.read.schema("key string").parquet(path).columns
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return True
    return False


def _region_id(key: str | Column) -> Column:
    """``region_of`` as bytes."""
    return F.unhex(region_of(key))


def _state_id(key: str | Column) -> Column:
    """What tells the states of one region apart: the digits of their stored keys after the region's, as a number."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(key, REGION_DIGITS + 1, STATE_DIGITS), 16, -10).cast("bigint")


def _by_region(spark: SparkSession, store_path: str, outputs: str, value: str | None = None) -> DataFrame:
    """One row per region (``_region``) with its stored states' ``_ids`` and, in the same order, their ``_values``; states
    without a value are left out. A region's rows lie together in the store, so lists are made before the shuffle."""
    there = [] if value is None else [F.col(value).alias("_value")]
    rows = read_store(spark, store_path, outputs).select(_region_id("key").alias("_region"), _state_id("key").alias("_id"), *there)
    for column in rows.columns[1:]:
        rows = rows.where(F.col(column).isNotNull())  # lists leave out what is missing, each for itself
    return rows.groupBy("_region").agg(F.collect_list("_id").alias("_ids"), *[F.collect_list("_value").alias("_values") for _ in there])


def scores_in_regions(
    spark: SparkSession,
    rows: DataFrame,
    stores: dict[str, dict[str, str]],
    make: Callable[[DataFrame, list[str]], DataFrame] | None = None,
    *,
    value: str = "signal",
    outputs: str = SIGNAL,
) -> DataFrame:
    """The states that ``make`` makes of ``rows`` (region_hash), or the rows themselves, with stored ``value``s: ``stores``
    gives for each store the columns that hold a ``stored_key`` and what to call the value of that state there, NULL where
    there is none. Rows may have ``_region_id`` and ``_state_id`` (``_region`` and numbers as keys) instead.

    Rows meet their region's scores before they become states, so neither is shuffled per state. ``make`` is given the
    joined rows and the columns it has to keep."""
    joined, kept, wanted = rows if "_region" in rows.columns else rows.withColumn("_region", _region_id("region_hash")), [], []
    for n, (path, names) in enumerate(stores.items()):
        ids, values = f"_ids{n}", f"_values{n}"
        lists = _by_region(spark, path, outputs, value).withColumnsRenamed({"_ids": ids, "_values": values})
        joined = joined.join(sorted_side(lists), "_region", "left")
        kept += [ids, values]
        wanted += [(key, ids, values, name) for key, name in names.items()]
    made = joined.drop("_region") if make is None else make(joined.drop("_region"), kept)
    numbers = {f.name for f in made.schema.fields if f.dataType.typeName() == "long"}
    found = {
        name: F.get(values, F.array_position(ids, F.col(key) if key in numbers else _state_id(key)).cast("int") - 1) for key, ids, values, name in wanted
    }
    return _once(made, **found).drop(*kept)


def placed_regions(places: DataFrame, regions: DataFrame, *, sequence: str, always: Column | None = None) -> DataFrame:
    """One row (_region, sequence, _places) per region content that has ``places`` (region_hash or its id, place), or of
    every region with the place that it ``always`` has. What the places of
    a region and its sequence add to the row is gathered before the shuffle."""
    region, kind = _region_id(sq.content_hash(sequence)).alias("_region"), places.schema["place"].dataType
    known = regions.where(F.col(sequence).isNotNull()).select(region, F.col(sequence).alias("sequence"), (F.lit(None) if always is None else always).cast(kind).alias("place"))
    named = F.col("_region") if "_region" in places.columns else _region_id("region_hash").alias("_region")
    wanted = places.select(named, F.lit(None).cast("string").alias("sequence"), "place")
    rows = known.unionByName(wanted).groupBy("_region").agg(F.max("sequence").alias("sequence"), F.collect_set("place").alias("_places"))
    return rows.where(F.col("sequence").isNotNull() & (F.size("_places") > 0))


def score_places(
    spark: SparkSession,
    placed: DataFrame,
    store_path: str,
    scorer: Scorer,
    make: Callable[[DataFrame, list[str]], DataFrame],
    *,
    outputs: str = SIGNAL,
    batch_size: int = 64,
    attempts: int = 3,
    prefix: int = 1,
) -> None:
    """Score the states of ``placed_regions`` that the store lacks and append them.

    ``make`` turns rows (region_hash, sequence, place) into states (edits, and ``key`` by ``stored_key``) and keeps the
    columns it is told; different places of a region must make different states, NULL edits make none. No row per state
    crosses a shuffle."""
    kept, first = ["sequence"], is_empty_store(spark, store_path)
    if not first:
        placed, kept = placed.join(sorted_side(_by_region(spark, store_path, outputs)), "_region", "left"), ["sequence", "_ids"]
    rows = with_region_hash(placed, sequence="sequence").select("region_hash", *kept, F.explode("_places").alias("place"))
    states = make(rows, kept).where(F.col("edits").isNotNull())
    if not first:
        states = _once(states.withColumnRenamed("key", "_key"), key=F.col("_key"))
        states = states.where(~F.coalesce(F.array_contains("_ids", _state_id("key")), F.lit(False)))
    ready = states.select("key", sq.apply_edits("sequence", "edits").alias("sequence"))
    append_store(score_batches(ready, scorer, outputs=outputs, batch_size=batch_size, attempts=attempts), store_path, prefix, gathered=False)


def contrast_to_native(
    spark: SparkSession, rows: DataFrame, store_path: str, *, make: Callable[[DataFrame, list[str]], DataFrame] | None = None, signal: str = "signal", outputs: str = SIGNAL
) -> DataFrame:
    """States (key, region_hash) with their stored ``signal``, the native state's as ``native_signal``, and ``contrast``
    between them. With ``make`` rows become states after they met their region's scores (``scores_in_regions``)."""
    names = {"key": "signal", "region_hash": "native_signal"}
    found = scores_in_regions(spark, rows, {store_path: names}, make, value=signal, outputs=outputs)
    return found.withColumn("contrast", F.col("signal") - F.col("native_signal"))


def coarse_to_fine(
    spark: SparkSession,
    regions: DataFrame,
    store_path: str,
    scorer: Scorer,
    *,
    by: Sequence[str],
    tile: str,
    sequence: str,
    width: int,
    step: int,
    limit: int,
    owned: Column | None = None,
    outputs: str = SIGNAL,
    signal: str = "signal",
    batch_size: int = 64,
    prefix: int = 1,
) -> DataFrame:
    """Two-round scan of regions (``by`` and the start of their ``tile``): complement windows are scored, the ``limit``
    windows of each ``by`` with the largest absolute contrast to the native state that do not overlap are taken (ties to
    the first), and every substitution inside them is scored.

    The second design is made from the first round's stored scores. Both rounds go through the store, so a scan that
    stopped anywhere goes on where it was, and one that is repeated scores nothing. Windows that do not satisfy
    ``owned`` (a halo's) are left to the next tile. One row per substitution: by..., tile, window_start and position in
    absolute coordinates, ref, alt, window_contrast, native_signal, signal, effect."""
    by, where = list(by), [*by, tile]

    def windows_of(rows: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
        windows = window_states(rows, [*where, *kept], sequence=sequence, width=width, step=step)
        return windows if owned is None else windows.where(owned)

    def complemented(rows: DataFrame, kept: Sequence[str]) -> DataFrame:
        """The complement window at a place; place -1 is the native state, which a window without bases would repeat."""
        made = _once(rows, native=F.substring(F.upper("sequence"), F.col("place") + 1, F.lit(width)))
        made = _once(made, replacement=sq.complement("native"))
        edits = one_edit("place", F.col("place") + width, "replacement", "native")
        made = _once(made, edits=F.when(F.col("place") < 0, no_edits()).when(F.col("native") != F.col("replacement"), edits))
        return made.select(*kept, "edits", stored_key("region_hash", "edits").alias("key"))

    def substituted(rows: DataFrame, kept: Sequence[str]) -> DataFrame:
        return substitution_states(rows.withColumn("native", sq.base_at(F.upper("sequence"), "place")), kept, start="place")

    run = dict(outputs=outputs, batch_size=batch_size, prefix=prefix)
    coarse = windows_of(regions).select("region_hash", F.col("window_start").alias("place"))
    score_places(spark, placed_regions(coarse, regions, sequence=sequence, always=F.lit(-1)), store_path, scorer, complemented, **run)

    hashed = with_region_hash(regions.select(*where, sequence), sequence=sequence)
    scored = contrast_to_native(spark, hashed, store_path, make=windows_of, signal=signal, outputs=outputs)
    scored = scored.withColumn("absolute_start", (F.col(tile) + F.col("window_start")).cast("bigint"))
    scored = scored.select(*where, "region_hash", "window_start", "absolute_start", "native", "contrast", "native_signal")
    picked = greedy_non_overlapping(
        scored.where(F.col("contrast").isNotNull()), by, start="absolute_start", width=width, step=step, limit=limit,
        order=[-F.abs("contrast"), F.col("absolute_start")], unique_starts=True,
    )
    picked = staged(picked, "picked")  # a few rows per ``by``: the second round does not compute the first again
    bases = F.sequence(F.col("window_start"), F.col("window_start") + F.length("native") - 1)
    places = picked.select("region_hash", F.explode(bases).alias("place"))
    score_places(spark, placed_regions(places, regions, sequence=sequence), store_path, scorer, substituted, **run)

    def fine(rows: DataFrame, kept: Sequence[str]) -> DataFrame:
        return substitution_states(rows, [*where, "contrast", "native_signal", "absolute_start", *kept])

    found = scores_in_regions(spark, picked, {store_path: {"key": "_signal"}}, fine, value=signal, outputs=outputs)
    return found.select(
        *where,
        F.col("absolute_start").alias("window_start"),
        (F.col(tile) + F.col("position")).cast("bigint").alias("position"),
        "ref",
        "alt",
        F.col("contrast").alias("window_contrast"),
        "native_signal",
        F.col("_signal").alias("signal"),
        (F.col("_signal") - F.col("native_signal")).alias("effect"),
    )


def variant_effects(
    spark: SparkSession,
    variants: DataFrame,
    regions: DataFrame,
    store_root: str,
    regimes: dict[str, TrackScorer],
    *,
    by: Sequence[str],
    variant: str,
    sequence: str,
    tracks: Sequence[Track],
    genes: Sequence[Gene],
    batch_size: int = 64,
    prefix: int = 1,
    together: Sequence[str] | None = None,
) -> DataFrame:
    """Effects of variants (by..., variant, offset0, ref, alt) on genes, from scored states.

    The reference and the alternative state of each variant are scored under every regime, each with a store of its own.
    A variant whose reference base is not the region's fails the job. One row per (variant, regime, modality, gene):
    means over strand-compatible tracks of both states, ``effect`` (alternative minus reference) and ``n_tracks``. Rows
    alike in the columns ``together`` of ``by`` come in one partition, so that grouping by them takes no other shuffle;
    name columns of many values."""
    by = list(by)
    placed = with_region_hash(variants.join(sorted_side(regions.select(*by, sequence)), by), sequence=sequence)
    read = F.upper(sq.base_at(sequence, "offset0"))
    told = F.concat(F.lit("reference base differs from the region: "), F.col(variant).cast("string"))
    placed = placed.withColumn("_ok", F.when(read == F.col("ref"), F.lit(True)).otherwise(F.raise_error(told)))
    edited = placed.where("_ok").withColumn("edits", one_edit("offset0", F.col("offset0") + 1, "alt", "ref"))
    ids = _region_id("region_hash").alias("_region"), _state_id("region_hash").alias("_native"), _state_id(stored_key("region_hash", "edits")).alias("_edited")
    # a row per variant that scoring and every regime read: the join with the regions and the hashes are made once
    states = staged(edited.select(*by, variant, *ids, "edits"), "states", compression="zstd")
    places = states.select("_region", F.explode(F.array(no_edits(), "edits")).alias("place"))
    gathered = staged(placed_regions(places, regions, sequence=sequence), "places", compression="zstd")

    def at_place(rows: DataFrame, kept: Sequence[str]) -> DataFrame:
        return rows.select(*kept, F.col("place").alias("edits"), stored_key("region_hash", "place").alias("key"))

    pairs = gene_tracks(tracks, genes)
    # a store's values have places, not names: other genes or tracks make another store
    named = hashlib.sha256(repr(pairs).encode()).hexdigest()[:16]
    stores = {}
    for n, (regime, scorer) in enumerate(regimes.items()):
        store, reduced = f"{store_root}/{regime}-{named}", reduced_tracks(scorer, tracks, genes)
        score_places(spark, gathered, store, reduced, at_place, outputs=TRACK_VALUES, batch_size=batch_size, prefix=prefix)
        stores[store] = {"_native": f"_ref{n}", "_edited": f"_alt{n}"}
    scored = scores_in_regions(spark, states.drop("edits"), stores, value="cells", outputs=TRACK_VALUES).drop("_native", "_edited")
    scored = scored.repartition(*together) if together else scored

    # a row per variant holds the means of both states under all regimes; a variant may have several
    packed = F.array(*[
        F.struct(F.lit(regime).alias("regime"), F.collect_list(f"_ref{n}").alias("ref"), F.collect_list(f"_alt{n}").alias("alt")) for n, regime in enumerate(regimes)
    ])
    per_regime = scored.groupBy(*by, variant).agg(packed.alias("_r")).select(*by, variant, F.inline("_r"))
    cells = [
        F.struct(F.lit(modality).alias("modality"), F.lit(gene).alias("gene"), F.lit(len({pairs[i][2].name for i in run})).cast("bigint").alias("n_tracks"), F.lit(n).alias("_at"))
        for n, ((modality, gene), run) in enumerate(gene_cells(pairs).items())
    ]
    each = per_regime.where(F.size("ref") + F.size("alt") > 0).select(
        "*", F.inline(F.array(*cells).cast("array<struct<modality: string, gene: string, n_tracks: bigint, _at: int>>"))
    )

    def mean(lists: str) -> Column:
        """The cell's value, or the mean over the rows of a variant that has several."""
        held = F.filter(F.transform(lists, lambda c: F.get(c, F.col("_at"))), F.isnotnull)
        several = F.aggregate(held, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(held), F.lit(0))
        return F.when(F.size(lists) == 1, F.get(F.get(lists, F.lit(0)), F.col("_at"))).otherwise(several)

    effects = each.select(*by, variant, "regime", "modality", "gene", mean("ref").alias("ref_value"), mean("alt").alias("alt_value"), "n_tracks")
    return effects.withColumn("effect", F.col("alt_value") - F.col("ref_value"))
