"""Bootstrap of rank statistics by blocks of replicates.

A cluster carries one array with its multiplicity in every replicate, and last a 1 for the sample as it is. Rows are sorted
once per axis, whatever the number of replicates: totals of a group's cells give what lies before each cell, and within a
cell prefix sums run over whole arrays. No row is repeated per replicate and no group meets in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from ..functions.expressions import finite
from ..session import staged
from .association import complete_pairs
from .joins import null_matching_join
from .ranking import SPLIT_EVERY, with_cells
from .resampling import cluster_draws, packed_draws

#: Partial sums that a task holds before it hands them on.
HELD_GROUPS = 4096
#: Rows of a batch with the same value from which on they are added up before the shuffle.
OFTEN = 16


def multiplicities(
    clusters: DataFrame, by: Sequence[str], *, cluster: str, replicates: int, seed: int, method: str = "multinomial",
    split_every: int = SPLIT_EVERY,
) -> DataFrame:
    """``_m`` of every cluster (one row each): how often it enters each replicate, a byte each, and a closing 1."""
    by = list(by)
    if method == "multinomial":
        drawn = packed_draws(clusters, by, cluster=cluster, replicates=replicates, seed=seed, split_every=split_every)
        drawn = drawn.select(*by, cluster, "_d")
    else:
        draws = cluster_draws(clusters, by, cluster=cluster, replicates=replicates, seed=seed, method=method, split_every=split_every)
        drawn = draws.groupBy(*by, cluster).agg(F.collect_list(F.struct("_b", F.col("_times").cast("long").alias("_times"))).alias("_d"))
    every = null_matching_join(clusters.select(*by, cluster), drawn, [*by, cluster], how="left")

    def dense(batches):
        for batch in batches:
            lists, out = batch.column("_d"), np.zeros((batch.num_rows, replicates + 1), np.uint8)
            owner = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            flat = lists.flatten()
            times = flat.field("_times").to_numpy()
            if len(times) and times.max() > 255:
                raise ValueError("a cluster was drawn more than 255 times in one replicate")
            out[owner, flat.field("_b").to_numpy()] = times
            out[:, replicates] = 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keys] + [pa.array([row.tobytes() for row in out], pa.binary())], names=[*keys, "_m"]
            )

    keys = [*by, cluster]
    schema = StructType([*(clusters.schema[c] for c in keys), StructField("_m", BinaryType())])
    return every.select(*keys, "_d").mapInArrow(dense, schema)


# --- streams of sorted rows -------------------------------------------------------------------------------------------


def _matrix(column: pa.Array, kind) -> np.ndarray:
    """The rows of a binary column, all of one length, as a matrix over the column's own bytes."""
    ends, data = column.buffers()[1:]
    places = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    first, last = places[column.offset], places[column.offset + len(column)]
    if first == last:
        return np.zeros((len(column), 0), kind)
    return np.frombuffer(data, kind, (last - first) // np.dtype(kind).itemsize, first).reshape(len(column), -1)


def _bytes(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows, np.float64)
    size = rows.shape[1] * rows.itemsize
    if not size or rows.nbytes >= 1 << 31:
        return pa.array([row.tobytes() for row in rows], pa.binary())
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(size)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def _codes(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Equal numbers for rows with equal keys, from 0 without gaps; nulls are equal."""
    codes = np.zeros(batch.num_rows, np.int64)
    for name in names:
        coded = pc.dictionary_encode(batch.column(name), null_encoding="encode")
        codes = codes * len(coded.dictionary) + coded.indices.to_numpy()
        codes = np.unique(codes, return_inverse=True)[1].reshape(-1)
    return codes


def _changes(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """True where a row's keys differ from those of the row before it; nulls are equal."""
    out = np.zeros(batch.num_rows, bool)
    if batch.num_rows:
        out[0] = True
    for name in names:
        a, b = batch.column(name).slice(1), batch.column(name).slice(0, batch.num_rows - 1)
        differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        out[1:] |= differs | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return out


def _whole(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The rows of a sorted stream in batches that part no run of equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changes = np.zeros(batch.num_rows, bool)
        if held:
            changes = _changes(pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), batch]), names)[1:]
        elif names:
            changes[1:] = _changes(batch, names)[1:]
        found = np.flatnonzero(changes)
        if not len(found):
            held.append(batch)  # a run over many batches is joined once
            continue
        at = int(found[-1])
        yield pa.concat_batches([*held, batch.slice(0, at)])
        held = [batch.slice(at)]
    if held:
        yield pa.concat_batches(held)


def _runs(batch: pa.RecordBatch, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    starts = np.flatnonzero(_changes(batch, names)) if names else np.zeros(1, np.int64)
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(int(a), int(b - a))


def _key(batch: pa.RecordBatch, names: Sequence[str]) -> tuple:
    return tuple(batch.column(name)[0].as_py() for name in names)


def _summed(rows: DataFrame, keys: Sequence[str], vectors: Callable[[pa.RecordBatch], np.ndarray], order: Sequence[str] = ()) -> DataFrame:
    """Sums of vectors per ``keys``: each task adds up its rows, then partial sums meet key by key in a stream."""
    keys = list(keys)
    schema = StructType([*(rows.schema[k] for k in keys), StructField("sums", BinaryType())])
    arrow = {}

    def partial(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            arrow.update({k: batch.schema.field(k).type for k in keys})
            codes = _codes(batch, keys)
            order = np.argsort(codes, kind="stable")
            sorted_rows = batch.take(pa.array(order))
            firsts = np.searchsorted(codes[order], np.arange(codes[order[-1]] + 1))
            heads = sorted_rows.take(pa.array(firsts))
            names = list(zip(*(heads.column(k).to_pylist() for k in keys))) or [()]
            for name, sums in zip(names, np.add.reduceat(vectors(sorted_rows), firsts, axis=0)):
                held[name] = held[name] + sums if name in held else sums
            if len(held) > HELD_GROUPS:
                yield emitted(held)
                held = {}
        if held:
            yield emitted(held)

    def emitted(held):
        columns = [pa.array([name[i] for name in held], arrow[k]) for i, k in enumerate(keys)]
        return pa.RecordBatch.from_arrays([*columns, _bytes(np.array(list(held.values())))], names=[*keys, "sums"])

    def final(batches):
        for batch in _whole(batches, keys):
            runs = list(_runs(batch, keys))
            sums = _bytes(np.array([_matrix(run.column("sums"), np.float64).sum(axis=0) for run in runs]))
            heads = pa.concat_batches([run.slice(0, 1) for run in runs])
            yield pa.RecordBatch.from_arrays([*(heads.column(k) for k in keys), sums], names=[*keys, "sums"])

    sums = rows.mapInArrow(partial, schema)
    dealt = sums.repartition(*keys).sortWithinPartitions(*keys) if keys else sums.coalesce(1)
    return dealt.mapInArrow(final, schema)


def _weights(batch: pa.RecordBatch, counts: Sequence[str]) -> np.ndarray:
    """Per row and replicate the weighted counts, those of the first count first; a row of ``_gathered`` has them added up."""
    added = batch.column("_added").is_valid().to_numpy(zero_copy_only=False) if "_added" in batch.schema.names else None
    if added is not None and added.all():
        return _matrix(batch.column("_added"), np.float64)
    single = batch if added is None or not added.any() else batch.filter(pa.array(~added))
    m = _matrix(single.column("_m"), np.uint8)
    own = np.empty((single.num_rows, m.shape[1] * len(counts)))
    for i, c in enumerate(counts):
        np.multiply(m, single.column(c).to_numpy().astype(np.float64)[:, None], out=own[:, i * m.shape[1] : (i + 1) * m.shape[1]])
    if single is batch:
        return own
    out = np.empty((batch.num_rows, own.shape[1]))
    out[~added] = own
    out[added] = _matrix(batch.column("_added").filter(pa.array(added)), np.float64)
    return out


def _gathered(rows: DataFrame, keys: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Rows with ``_m``, those whose keys a batch has ``OFTEN`` times or more added up in their task to one row with
    ``_added``: few values shared by many clusters would else be one cell's rows, however many there are."""
    keys = list(keys)
    rows = rows.select(*keys, *counts, "_m")
    names = [*keys, *counts, "_m", "_added"]

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = _codes(batch, keys)
            often = np.bincount(codes)[codes] >= OFTEN
            if not often.all():
                rare = batch.filter(pa.array(~often))
                yield pa.RecordBatch.from_arrays([*rare.columns, pa.nulls(rare.num_rows, pa.binary())], names=names)
            if often.any():
                places = np.flatnonzero(often)
                places = places[np.argsort(codes[places], kind="stable")]
                taken = batch.take(pa.array(places))
                firsts = np.flatnonzero(np.diff(codes[places], prepend=-1))
                heads = taken.take(pa.array(firsts))
                for name, sums in zip(zip(*(heads.column(k).to_pylist() for k in keys)), np.add.reduceat(_weights(taken, counts), firsts, axis=0)):
                    held[name] = held[name] + sums if name in held else sums
            if len(held) > HELD_GROUPS:
                yield emitted(held, batch.schema)
                held = {}
        if held:
            yield emitted(held, batch.schema)

    def emitted(held, schema):
        columns = [pa.array([name[i] for name in held], schema.field(k).type) for i, k in enumerate(keys)]
        columns += [pa.nulls(len(held), schema.field(c).type) for c in [*counts, "_m"]]
        return pa.RecordBatch.from_arrays([*columns, _bytes(np.array(list(held.values())))], names=names)

    fields = [StructField(f.name, f.dataType) for f in rows.schema]
    return rows.mapInArrow(run, StructType([*fields, StructField("_added", BinaryType())]))


def _with_leads(rows: DataFrame, by: Sequence[str], value: str, vectors: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """Rows sorted by ``value`` within (by, ``_cell``), each cell led by a row (``_lead`` true) whose ``_sums`` are the
    vectors' sums over the group's earlier cells, then over the whole group."""
    by = list(by)
    totals = _summed(rows, [*by, "_cell"], vectors)
    schema = StructType([*(rows.schema[k] for k in by), StructField("_cell", IntegerType()), StructField("_sums", BinaryType())])

    def running(batches):
        # a group has at most 256 cells, so one group at a time is held
        for batch in _whole(batches, by):
            for run in _runs(batch, by):
                own = _matrix(run.column("sums"), np.float64)
                up_to = np.cumsum(own, axis=0)
                lead = np.concatenate([up_to - own, np.broadcast_to(up_to[-1], own.shape)], axis=1)
                columns = [*(run.column(k) for k in by), run.column("_cell"), _bytes(lead)]
                yield pa.RecordBatch.from_arrays(columns, names=[*by, "_cell", "_sums"])

    dealt = totals.repartition(*by) if by else totals.coalesce(1)
    leads = dealt.sortWithinPartitions(*by, "_cell").mapInArrow(running, schema).withColumn("_lead", F.lit(True))
    both = rows.withColumn("_lead", F.lit(False)).unionByName(leads, allowMissingColumns=True)
    return both.repartition(*by, "_cell").sortWithinPartitions(*by, "_cell", F.desc("_lead"), value)


def _celled_blocks(batches: Iterator[pa.RecordBatch], by: Sequence[str], value: str):
    """Of a stream of ``_with_leads``: cell by cell, blocks of rows with whole values, where values start, and the sums
    (before the cell, in the group); the caller moves the first one on."""
    before = whole = None
    for batch in _whole(batches, [*by, "_cell", "_lead", value]):
        for run in _runs(batch, [*by, "_cell", "_lead"]):
            if run.column("_lead")[0].as_py():
                before, whole = np.split(_matrix(run.column("_sums"), np.float64)[0].copy(), 2)
            else:
                yield run, np.flatnonzero(_changes(run, [value])), before, whole


def _cells(df: DataFrame, by: Sequence[str], value: str, split_every: int) -> DataFrame:
    return with_cells(df, by, value, split_every=split_every).withColumn("_cell", F.col("_cell").cast("int"))


# --- statistics -------------------------------------------------------------------------------------------------------


def _interval(values: np.ndarray) -> tuple[float | None, float | None, float | None]:
    """The sample's value and the percentile interval of the replicates that have one."""
    drawn = values[:-1][np.isfinite(values[:-1])]
    point = float(values[-1]) if np.isfinite(values[-1]) else None
    return (point, *(map(float, np.quantile(drawn, [0.025, 0.975])) if len(drawn) else (None, None)))


def bootstrap_spearman(
    df: DataFrame, by: Sequence[str], x: str, y: str, *, cluster: str, replicates: int, seed: int, split_every: int = SPLIT_EVERY
) -> DataFrame:
    """Rank correlation with a percentile interval over resampled clusters; ranks are redone in every replicate.

    Mid-ranks of y, centred, are summed per value of x with the rows' weights; mid-ranks of x then meet one sum per value."""
    by = list(by)
    pairs = complete_pairs(df, x, y).groupBy(*by, cluster, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    pairs = staged(pairs, "pairs")
    clusters = staged(pairs.select(*by, cluster).distinct(), "clusters")
    m = staged(multiplicities(clusters, by, cluster=cluster, replicates=replicates, seed=seed, split_every=split_every), "multiplicities")
    rows = null_matching_join(_cells(pairs, by, "_y", split_every), m, [*by, cluster], how="inner")
    sorted_y = _with_leads(rows.select(*by, "_cell", "_x", "_y", "_n", "_m"), by, "_y", lambda batch: _weights(batch, ["_n"]))
    fields = [df.schema[k] for k in by]
    per_x = StructType([*fields, StructField("_x", pairs.schema["_x"].dataType), StructField("sums", BinaryType())])

    def ranked_y(batches):
        for run, starts, before, whole in _celled_blocks(batches, by, "_y"):
            w = _weights(run, ["_n"])
            sizes = np.add.reduceat(w, starts, axis=0)
            above = before + np.cumsum(sizes, axis=0) - sizes
            before += sizes.sum(axis=0)
            counts = np.diff([*starts, run.num_rows])
            rank = np.repeat(above + (sizes + 1) / 2 - (whole + 1) / 2, counts, axis=0)
            # weights, centred ranks of y and their squares, per value of x
            coded = run.column("_x").dictionary_encode()
            codes = coded.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            firsts = np.searchsorted(codes[order], np.arange(len(coded.dictionary)))
            sums = np.add.reduceat(np.concatenate([w, w * rank, w * rank * rank], axis=1)[order], firsts, axis=0)
            keys = [pa.array([run.column(k)[0].as_py()] * len(sums), run.schema.field(k).type) for k in by]
            yield pa.RecordBatch.from_arrays([*keys, coded.dictionary, _bytes(sums)], names=[*by, "_x", "sums"])

    summed = _summed(sorted_y.mapInArrow(ranked_y, per_x), [*by, "_x"], lambda batch: _matrix(batch.column("sums"), np.float64))
    celled = _cells(staged(summed, "sums"), by, "_x", split_every)
    sorted_x = _with_leads(celled, by, "_x", lambda batch: _matrix(batch.column("sums"), np.float64)[:, : replicates + 1])
    per_group = StructType([*fields, StructField("sums", BinaryType())])

    def ranked_x(batches):
        for run, starts, before, whole in _celled_blocks(batches, by, "_x"):
            w, s, yy = np.split(_matrix(run.column("sums"), np.float64), 3, axis=1)
            above = before + np.cumsum(w, axis=0) - w
            before += w.sum(axis=0)
            rank = above + (w + 1) / 2 - (whole + 1) / 2
            total = np.concatenate([(rank * s).sum(axis=0), (w * rank * rank).sum(axis=0), yy.sum(axis=0), w.sum(axis=0)])
            yield pa.RecordBatch.from_arrays([*(run.column(k).slice(0, 1) for k in by), _bytes(total[None])], names=[*by, "sums"])

    groups = _summed(sorted_x.mapInArrow(ranked_x, per_group), by, lambda batch: _matrix(batch.column("sums"), np.float64))
    out = StructType.fromDDL("n bigint, spearman double, ci_low double, ci_high double")

    def finished(batches):
        for batch in batches:
            found = []
            for row in _matrix(batch.column("sums"), np.float64) if batch.num_rows else []:
                xy, xx, yy, n = np.split(row, 4)
                with np.errstate(invalid="ignore", divide="ignore"):
                    rho = np.where((xx > 0) & (yy > 0), xy / np.sqrt(xx * yy), np.nan)
                found.append((int(n[-1]), *_interval(rho)))
            if found:
                columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.float64(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in by), *columns], names=[*by, *out.names])

    return groups.mapInArrow(finished, StructType([*fields, *out.fields]))




def ranking_quality_bootstrap(
    df: DataFrame, by: Sequence[str], *, scores: Sequence[str], positive: Column, cluster: str, replicates: int, seed: int,
    split_every: int = SPLIT_EVERY,
) -> DataFrame:
    """ROC AUC (mid-ranks) and PR AUC (average precision, ties taken together) of every score, with percentile intervals
    over resampled clusters. All scores share their draws, so the paired ``difference`` to the first score has an interval
    of its own. Rows where any score is missing take no part: the comparison is on the same rows.

    One row per group and score: ``score``, ``n``, ``n_positive``, and for ``roc_auc``, ``pr_auc``, ``roc_difference`` and
    ``pr_difference`` the value with ``_low`` and ``_high``; differences of the first score are NULL."""
    by, axis = list(by), [*by, "_axis"]
    finite_scores = df
    for score in scores:
        finite_scores = finite_scores.withColumn(score, finite(F.col(score).cast("double")))
    used = finite_scores.dropna(subset=list(scores)).withColumn("_y", F.coalesce(positive.cast("bigint"), F.lit(0)))
    long = used.select(*by, cluster, "_y", F.posexplode(F.array(*scores)).alias("_axis", "_v"))
    counts = long.groupBy(*axis, cluster, "_v").agg(F.sum("_y").alias("_p"), F.count(F.lit(1)).alias("_t"))
    counts = staged(counts, "scores")
    clusters = staged(counts.where("_axis = 0").select(*by, cluster).distinct(), "clusters")
    m = staged(multiplicities(clusters, by, cluster=cluster, replicates=replicates, seed=seed, split_every=split_every), "multiplicities")
    rows = null_matching_join(_cells(counts, axis, "_v", split_every), m, [*by, cluster], how="inner")
    rows = _gathered(rows, [*axis, "_cell", "_v"], ["_p", "_t"])
    ordered = _with_leads(rows, axis, "_v", lambda batch: _weights(batch, ["_p", "_t"]))
    fields = [df.schema[k] for k in by]
    keyed = StructType([*fields, StructField("_axis", IntegerType()), StructField("sums", BinaryType())])

    def areas(batches):
        for run, starts, before, whole in _celled_blocks(batches, axis, "_v"):
            sizes = np.add.reduceat(_weights(run, ["_p", "_t"]), starts, axis=0)
            below = before + np.cumsum(sizes, axis=0) - sizes
            before += sizes.sum(axis=0)
            p, t = np.split(sizes, 2, axis=1)
            p_below, t_below = np.split(below, 2, axis=1)
            p_all, t_all = np.split(whole, 2)
            won = p * ((t_below - p_below) + 0.5 * (t - p))
            reached = np.maximum(t_all - t_below, 1.0)  # nothing at or above a value: nothing of it either
            precise = p * (p_all - p_below) / reached
            total = np.concatenate([won.sum(axis=0), precise.sum(axis=0), p.sum(axis=0), t.sum(axis=0)])
            yield pa.RecordBatch.from_arrays([*(run.column(k).slice(0, 1) for k in axis), _bytes(total[None])], names=[*axis, "sums"])

    groups = _summed(ordered.mapInArrow(areas, keyed), axis, lambda batch: _matrix(batch.column("sums"), np.float64))
    names = [f"{kind}{end}" for kind in ("roc_auc", "pr_auc", "roc_difference", "pr_difference") for end in ("", "_low", "_high")]
    out = StructType.fromDDL("score string, n bigint, n_positive bigint, " + ", ".join(f"{name} double" for name in names))

    def finished(batches):
        for batch in _whole(batches, by):
            for run in _runs(batch, by):
                found, first = [], None
                for k, row in zip(run.column("_axis").to_pylist(), _matrix(run.column("sums"), np.float64)):
                    won, precise, p, t = np.split(row, 4)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        both = np.array([np.where(p * (t - p) > 0, won / (p * (t - p)), np.nan), np.where(p > 0, precise / p, np.nan)])
                    first = both if first is None else first
                    apart = [_interval(d) if k else (None,) * 3 for d in both - first]
                    found.append((scores[k], int(t[-1]), int(p[-1]), *(v for a in both for v in _interval(a)), *(v for a in apart for v in a)))
                kinds = [pa.string(), pa.int64(), pa.int64()] + [pa.float64()] * len(names)
                columns = [pa.array(c, kind) for c, kind in zip(zip(*found), kinds)]
                yield pa.RecordBatch.from_arrays([*(run.column(k) for k in by), *columns], names=[*by, *out.names])

    dealt = groups.repartition(*by) if by else groups.coalesce(1)
    return dealt.sortWithinPartitions(*by, "_axis").mapInArrow(finished, StructType([*fields, *out.fields]))
