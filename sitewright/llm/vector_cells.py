"""Near duplicates among embeddings: spherical k-means cells and blocked cosine products within them."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chosen_path import grouped
from .common import keyed_rank, staged
from .components import components, local_roots


def unit_rows(blobs: list[bytes]) -> np.ndarray:
    """Unit vectors in double precision. Scaling by the largest component first keeps squares within range."""
    rows = np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def spherical_means(rows: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit rows by Lloyd's rounds under the cosine; an empty cell takes the row worst served."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        nearest, best = np.empty(len(rows), np.int64), np.empty(len(rows))
        for a in range(0, len(rows), 4096):
            cosines = rows[a : a + 4096] @ centres.T
            nearest[a : a + 4096] = cosines.argmax(axis=1)
            best[a : a + 4096] = cosines.max(axis=1)
        order = np.argsort(nearest, kind="stable")
        cells, starts = np.unique(nearest[order], return_index=True)
        centres[cells] = np.add.reduceat(rows[order], starts)
        empty = np.setdiff1d(np.arange(k), cells)
        centres[empty] = rows[np.argsort(best, kind="stable")[: len(empty)]]
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    return centres


def near_duplicate_vectors(
    vectors: DataFrame,
    threshold: float = 0.95,
    recall: float = 0.99,
    cell: int = 512,
    most_cells: int = 4096,
    sample: int = 32_768,
    block: int = 2048,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """One row per row of ``vectors``: the id, ``n_links`` (other rows with a cosine of ``threshold`` or more that were
    found), ``component_id`` (smallest id reachable by links) and ``kept`` (the id is that one).

    Equal vectors are one node with a number of copies. Centroids, one for every ``cell`` vectors and ``most_cells`` at
    most, are fitted on ``sample`` vectors (the bound of the sample). A vector lives in the cell of its nearest centroid
    and visits every cell to which a vector at the threshold, in a direction of no preference, may fall with a
    probability above 1 - ``recall``; pairs of a resident and another resident or a visitor are compared, each in one
    cell only. Cells of more than ``block`` vectors are compared block by block, each pair of blocks with a key of its
    own. Vectors whose lengths differ have no cosine.

    Null vectors, zero vectors and those with null or non-finite components link with nothing and are components of their own.
    A null id stands for a component only where no other is there. An empty table gives no rows; further columns are
    not read."""
    id_type = vectors.schema[id_column].dataType
    doubles = F.col(vector_column).cast("array<double>")
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = ~bad & F.exists(doubles, lambda x: x != 0)
    rows = vectors.select(F.col(id_column).alias("id"), F.when(usable, doubles).alias("vector"))

    def packed(batches):
        for batch in batches:
            # -0.0 and 0.0 are one component
            blobs = [None if v is None else (np.array(v, "<f8") + 0.0).tobytes() for v in batch.column("vector").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(blobs, pa.binary())], names=["id", "vector"])

    rows = staged(rows.mapInArrow(packed, T.StructType([T.StructField("id", id_type), T.StructField("vector", T.BinaryType())])), "vectors")
    nodes = rows.filter("vector IS NOT NULL").groupBy("vector").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first"), F.count("*").alias("copies")
    )
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    sizes = nodes.groupBy(F.length("vector").alias("bytes")).count().orderBy("bytes").collect()  # one row per dimension
    links = None
    for size in sizes:
        own = nodes.filter(F.length("vector") == size["bytes"])
        found = _linked(own, size["count"], size["bytes"] // 8, threshold, recall, cell, most_cells, sample, block)
        links = found if links is None else links.union(found)
    if links is None:
        links = nodes.select("node", F.col("node").alias("root"), F.col("copies").alias("linked")).limit(0)
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("linked").alias("linked"))
    classes = nodes.join(roots, "node", "left").join(counts, "node", "left").filter("copies > 1 OR root IS NOT NULL")
    classes = staged(classes.select("vector", "first", "copies", "linked", F.coalesce("root", "node").alias("root")), "classes")
    heads = classes.groupBy("root").agg(F.min("first").alias("head"))
    classes = classes.join(heads, "root").select("vector", "head", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    component = F.when(F.col("head").isNull(), F.col("id")).otherwise(F.col("head.id"))
    return rows.join(classes, "vector", "left").select(
        F.col("id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def _linked(nodes, count, dimensions, threshold, recall, cell, most_cells, sample, block) -> DataFrame:
    """Per node and compared block: ``root`` (smallest node linked with it there) and ``linked`` (rows linked)."""
    k = max(1, min(most_cells, math.ceil(count / cell)))
    drawn = nodes.orderBy(keyed_rank("node", 3), "node").limit(max(sample, k)).select("vector").collect()
    centres = spherical_means(unit_rows([r.vector for r in drawn]), min(k, len(drawn)))
    spread = math.sqrt(max(0.0, 1 - threshold**2)) / math.sqrt(max(1, dimensions - 1)) / max(threshold, 1e-9)
    margin = NormalDist().inv_cdf(recall) * spread

    def assign(batches):
        apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
        for batch in batches:
            names, blobs = batch.column("node").to_numpy(), batch.column("vector").to_pylist()
            for a in range(0, len(names), 2048):
                cosines = unit_rows(blobs[a : a + 2048]) @ centres.T
                home = cosines.argmax(axis=1)
                lead = cosines[np.arange(len(home)), home][:, None] - cosines
                visits = lead <= margin * apart[home]
                visits[np.arange(len(home)), home] = True
                row, cells = np.nonzero(visits)
                guests = [np.flatnonzero(v).tolist() for v in visits]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cells.astype(np.int32)),
                        pa.array(names[a + row]),
                        pa.array(home[row].astype(np.int32)),
                        pa.array([guests[i] for i in row], pa.list_(pa.int32())),
                        pa.array([blobs[a + i] for i in row], pa.binary()),
                        batch.column("copies").take(pa.array(a + row)),
                    ],
                    names=["cell", "node", "home", "visits", "vector", "copies"],
                )

    schema = "cell int, node long, home int, visits array<int>, vector binary, copies long"
    placed = nodes.select("node", "vector", "copies").mapInArrow(assign, schema)
    placed = staged(placed, "cells")
    # as many rows as there are cells, at most ``most_cells``
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    placed = placed.join(F.broadcast(parts), "cell")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    keys = ["cell", "low", "high"]
    dealt = placed.drop("parts", "other").repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches):
        for (here, low, high), table in grouped(batches, keys):
            names, homes, copies, side = (table.column(c).to_numpy() for c in ("node", "home", "copies", "own"))
            rows = unit_rows(table.column("vector").to_pylist())
            one, two = np.flatnonzero(side == low), np.flatnonzero(side == high)
            lists = table.column("visits").to_pylist()
            left, right = [], []
            for a in range(0, len(one), 512):
                i, j = np.nonzero(rows[one[a : a + 512]] @ rows[two].T >= threshold)
                i, j = one[a + i], two[j]
                use = (i < j) if low == high else np.ones(len(i), bool)
                use &= (homes[i] == here) | (homes[j] == here)
                left.append(i[use])
                right.append(j[use])
            left, right = np.concatenate(left), np.concatenate(right)
            if not len(left):
                continue
            # a resident and a visitor meet twice if each visits the other's home: the lower cell counts
            known, number = np.unique(homes, return_inverse=True)
            visiting = np.zeros((len(names), len(known)), bool)
            for i in np.union1d(left, right):
                places = np.searchsorted(known, lists[i])
                fits = places < len(known)
                places = places[fits]
                visiting[i, places[known[places] == np.array(lists[i])[fits]]] = True
            resident = np.where(homes[left] == here, left, right)
            guest = np.where(homes[left] == here, right, left)
            counted = (homes[guest] == here) | (homes[guest] > here) | ~visiting[resident, number[guest]]
            left, right = left[counted], right[counted]
            if not len(left):
                continue
            linked = np.zeros(len(names), np.int64)
            np.add.at(linked, left, copies[right])
            np.add.at(linked, right, copies[left])
            roots = local_roots(len(names), left, right)
            touched = np.flatnonzero(linked)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[touched]), pa.array(names[roots[touched]]), pa.array(linked[touched])], names=["node", "root", "linked"]
            )

    return staged(dealt.mapInArrow(compare, "node long, root long, linked long"), "linked")
