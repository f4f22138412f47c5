"""Cluster bootstrap, empirical percentiles and p-values, right-closed bins and seeded sampling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import Z95, guarded_ratio, hash_index, keyed_digest
from ..session import staged
from .ranking import SPLIT_EVERY, count_below, exact_quantiles, join_back, join_spread, row_positions, value_ranks

#: Draws of clusters that one task makes or counts.
DRAWS_PER_TASK = 1 << 18


def cluster_counts(df: DataFrame, by: Sequence[str], cluster: str, positive: Column) -> DataFrame:
    """Rows and positives per cluster: all the bootstrap needs to know about the data."""
    return df.groupBy(*by, cluster).agg(
        F.count(F.lit(1)).alias("_size"), F.sum(positive.cast("int")).cast("bigint").alias("_positive")
    )


def cluster_bootstrap(
    df: DataFrame,
    by: Sequence[str],
    *,
    cluster: str,
    positive: Column,
    replicates: int,
    seed: int,
    low: float = 0.025,
    high: float = 0.975,
    method: str = "multinomial",
    split_every: int = SPLIT_EVERY,
) -> DataFrame:
    """Share of positive rows per stratum with a percentile interval over resampled clusters.

    "multinomial" draws n cluster indices with replacement per replicate and stratum by keyed hashing. Draws are counted per
    (cluster, replicate) before they meet the clusters. "poisson" gives every cluster its own Poisson(1)
    weight per replicate and needs no join, for very many clusters."""
    by = list(by)
    # one row per cluster, read by the point estimate, the draws and the sums
    clusters = staged(cluster_counts(df, by, cluster, positive), "clusters")
    point = clusters.groupBy(*by).agg(
        F.sum("_size").cast("bigint").alias("n"),
        F.count(F.lit(1)).alias("n_clusters"),
        (F.sum("_positive") / F.sum("_size")).alias("fraction"),
    )
    drawn = cluster_draws(
        clusters, by, cluster=cluster, replicates=replicates, seed=seed, method=method, split_every=split_every
    )
    sums = drawn.groupBy(*by, "_b").agg(
        guarded_ratio(F.sum(F.col("_times") * F.col("_positive")), F.sum(F.col("_times") * F.col("_size")), 0.0).alias("_f")
    )
    # at most ``replicates`` values per stratum, so the built-in exact percentile is safe here
    interval = sums.groupBy(*by).agg(F.percentile("_f", [low, high]).alias("_ci"))
    joined = join_back(point, interval, by)
    return joined.select(
        *by, "n", "n_clusters", "fraction", F.col("_ci")[0].alias("ci_low"), F.col("_ci")[1].alias("ci_high")
    )


def cluster_draws(
    clusters: DataFrame,
    by: Sequence[str],
    *,
    cluster: str,
    replicates: int,
    seed: int,
    method: str = "multinomial",
    split_every: int = SPLIT_EVERY,
) -> DataFrame:
    """How often (``_times``) each cluster enters each replicate (``_b``); ``clusters`` has one row per cluster."""
    by = list(by)
    if method == "poisson":
        drawn = clusters.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
        return drawn.withColumn("_times", poisson_weight(seed, F.col(cluster), F.col("_b"), *[F.col(c) for c in by]))
    packed = packed_draws(clusters, by, cluster=cluster, replicates=replicates, seed=seed, split_every=split_every)
    return packed.select(*clusters.columns, F.inline("_d"))


def packed_draws(
    clusters: DataFrame, by: Sequence[str], *, cluster: str, replicates: int, seed: int, split_every: int = SPLIT_EVERY
) -> DataFrame:
    """The clusters that any replicate draws, with ``_d``: a list of (``_b``, ``_times``).

    Draws are made and counted in as many tasks as there are ``DRAWS_PER_TASK`` of them, whatever the number of groups, and
    leave their task as one list per cluster. Clusters are counted first, so they should be staged."""
    by = list(by)
    tasks = -(-clusters.count() * replicates // DRAWS_PER_TASK) or 1
    indexed = row_positions(clusters, by, [F.col(cluster)], name="_slot", split_every=split_every)
    sizes = clusters.groupBy(*by).agg(F.count(F.lit(1)).alias("_k"))
    slots = join_back(indexed.select(*by, "_slot"), sizes, by).repartition(tasks, *by, "_slot")
    drawn = hash_index(F.col("_k"), seed, *[F.col(c) for c in by], F.col("_b"), F.col("_slot")) + 1
    draws = (
        slots.select(*by, "_slot", "_k", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_b"))
        .select(*by, drawn.alias("_slot"), "_b")
        .repartition(tasks, *by, "_slot")
        .groupBy(*by, "_slot", "_b")
        .agg(F.count(F.lit(1)).alias("_times"))
        .groupBy(*by, "_slot")
        .agg(F.collect_list(F.struct("_b", "_times")).alias("_d"))
    )
    return join_back(indexed, draws, [*by, "_slot"])


def poisson_weight(seed: int, *key: Column) -> Column:
    """Poisson(1) count from a keyed hash by inverting the distribution function."""
    u = hash_index(2**32, seed, *key) / F.lit(float(2**32))
    expression, cumulative = F.lit(12), 0.0
    steps = []
    for k in range(12):
        cumulative += math.exp(-1.0) / math.factorial(k)
        steps.append((cumulative, k))
    for bound, k in reversed(steps):
        expression = F.when(u < bound, F.lit(k)).otherwise(expression)
    return expression


def cut_right_closed(x: Column, edges: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """Bin by explicit edges: (lo, hi], the first bin also holds its lower edge; NULL outside."""
    names = list(range(1, len(edges))) if labels is None else list(labels)
    result = F.lit(None)
    for i in reversed(range(len(edges) - 1)):
        lower = x >= edges[i] if i == 0 else x > edges[i]
        result = F.when(lower & (x <= edges[i + 1]), F.lit(names[i])).otherwise(result)
    return result


def equal_width_edges(start: float, stop: float, width: float) -> list[float]:
    n = round((stop - start) / width)
    return [start + i * width for i in range(n + 1)]


def quantile_bins(
    df: DataFrame, by: Sequence[str], value: str, bins: int, *, name: str = "quantile_bin", split_every: int = SPLIT_EVERY
) -> DataFrame:
    """1-based bins between the group's own quantile edges, right-closed, repeated edges dropped."""
    by = list(by)
    probs = {f"_e{i}": i / bins for i in range(bins + 1)}
    edges = exact_quantiles(df, by, value, probs, split_every=split_every)
    packed = edges.select(*by, F.array_sort(F.array_distinct(F.array(*probs))).alias("_edges"))
    joined = join_spread(df, packed, by, F.col(value), "left")
    counted = count_below(joined, "_edges", F.col(value), bins + 1, name="_below")
    inside = F.col(value).isNotNull() & (F.size("_edges") > 1)
    return counted.withColumn(name, F.when(inside, F.greatest("_below", F.lit(1)))).drop("_edges", "_below")


def observed_in_null(
    observed: DataFrame, null: DataFrame, by: Sequence[str], *, value: str, split_every: int = SPLIT_EVERY
) -> DataFrame:
    """Place every observed value in its group's null: size, mean, sd, z, mid-rank percentile and the one-sided
    (+1) p-value. Observed values enter the ranking with weight 0, so no observed x null pairs are formed."""
    by = list(by)
    entries = null.select(*by, F.col(value), F.lit(1).alias("_w")).unionByName(
        observed.select(*by, F.col(value), F.lit(0).alias("_w"))
    )
    ranks = value_ranks(entries, by, value, weight="_w", split_every=split_every)
    moments = null.groupBy(*by).agg(
        F.count(value).alias("null_n"), F.avg(value).alias("null_mean"), F.stddev_samp(value).alias("null_sd")
    )
    joined = join_back(observed, ranks, [*by, value], "left")
    joined = join_back(joined, moments, by, "left")
    n = F.col("null_n")
    return (
        joined.withColumn("z", guarded_ratio(F.col(value) - F.col("null_mean"), "null_sd", 0.0))
        .withColumn("percentile", F.lit(100.0) * (F.col("n_less") + F.lit(0.5) * F.col("n")) / F.when(n > 0, n))
        .withColumn("p_high", (n - F.col("n_less") + 1) / (n + 1))
        .drop("n", "n_less", "n_total")
    )


def sample_without_replacement(df: DataFrame, n: int, *, seed: int, key: Sequence[str]) -> DataFrame:
    """``n`` rows in keyed-hash order; the same rows come out of every run."""
    return (
        df.withColumn("_d", keyed_digest(seed, *[F.col(k) for k in key])).orderBy("_d", *key).limit(n).drop("_d")
    )


def random_alternate(base: str, *, seed: int, key: Sequence[str]) -> Column:
    """One of the three other bases, chosen by keyed hash."""
    others = F.filter(F.array(*[F.lit(b) for b in "ACGT"]), lambda b: b != F.col(base))
    return F.get(others, hash_index(3, seed, "alt", *[F.col(k) for k in key]).cast("int"))


def proportion_tolerance(clusters: str, other_clusters: str, z: float = Z95) -> Column:
    """Widest accepted difference of two proportions, worst case 0.5, from the smaller cluster count."""
    n = F.least(clusters, other_clusters).cast("double")
    return F.lit(z) * F.sqrt(F.lit(0.5) / n)


