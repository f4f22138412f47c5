"""Connected components of link tables, by repeated joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Per item of 0..n-1 the smallest item it is linked with through the given pairs."""
    roots = np.arange(n)
    while True:
        low = np.minimum(roots[left], roots[right])
        before = roots.copy()
        np.minimum.at(roots, left, low)
        np.minimum.at(roots, right, low)
        np.minimum.at(roots, before[left], low)
        np.minimum.at(roots, before[right], low)
        roots = roots[roots]
        if (roots == before).all():
            return roots


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of every node in ``edges`` (columns ``a`` and ``b``).

    Each round takes the smallest root among neighbours, then follows roots of roots; rounds repeat until nothing
    changes. Every round's labels are written to the shared folder, so lineage stays short; only a count reaches the
    driver. Minima are combined before they are shuffled; joins carry two longs a row. No edges: no rows."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = staged(both.filter("a <> b").distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "roots")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hook = labels.join(near, "node").groupBy(F.col("root").alias("node")).agg(F.min("near").alias("hook"))
        lower = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low")).join(hook, "node", "left")
        lower = lower.select("node", F.col("root").alias("was"), F.least("low", F.coalesce("hook", "low")).alias("root"))
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("next"))
        fresh = lower.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("next", "root")).alias("root"))
        fresh = staged(fresh, "roots")
        if fresh.filter("was <> root").isEmpty():
            return fresh.select("node", "root")
        labels = fresh.select("node", "root")
