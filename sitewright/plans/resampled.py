"""Resampling and empirical-statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as qc
from ..operators import ranking as rk
from ..operators import resampling as rs
from .registry import cents, query, rounded, table

DRAW = "('0x' || substr(md5(concat_ws(':', {seed}, {stratum}b, slot)), 1, 15))::BIGINT % k"


def bootstrap_sql(cells: str, by: str, seed: int, replicates: int) -> str:
    """Cluster bootstrap in SQL over a ``cells`` table (by, cluster, pos)."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    using = f"USING ({by})" if by else "ON true"
    join = f"JOIN c ON c.slot = d.pick AND c.{by} = d.{by}" if by else "JOIN c ON c.slot = d.pick"
    pick = f"d.{by}, " if by else ""
    draw = DRAW.format(seed=seed, stratum=f"c.{by}, " if by else "")
    return f"""
{cells},
c AS (SELECT {keys}cluster, n, p, row_number() OVER ({part}ORDER BY cluster) AS slot FROM (
  SELECT {keys}cluster, count(*) AS n, sum(CASE WHEN pos THEN 1 ELSE 0 END) AS p FROM cells GROUP BY ALL)),
k AS (SELECT {keys}count(*) AS k, sum(n) AS n, sum(p) / sum(n)::DOUBLE AS fraction FROM c {"GROUP BY " + by if by else ""}),
d AS (SELECT {"c." + by + ", " if by else ""}b, {draw} + 1 AS pick FROM c JOIN k {using}, range(0, {replicates}) r(b)),
f AS (SELECT {pick}d.b, sum(c.p) / sum(c.n)::DOUBLE AS f FROM d {join} GROUP BY ALL)
SELECT {"k." + by + ", " if by else ""}k.n::BIGINT AS n, k.k AS n_clusters, round(k.fraction, 6) AS fraction,
       round(quantile_cont(f.f, 0.025), 6) AS ci_low, round(quantile_cont(f.f, 0.975), 6) AS ci_high
FROM f JOIN k {using} GROUP BY {"k." + by + ", " if by else ""}k.n, k.k, k.fraction
"""


@query(
    "cluster_bootstrap",
    bootstrap_sql("WITH cells AS (SELECT l_suppkey AS cluster, l_extendedprice > 50000 AS pos FROM lineitem)", "", 20, 200),
)
def cluster_bootstrap(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cluster"), (F.col("l_extendedprice") > 50000).alias("pos"))
    return rounded(rs.cluster_bootstrap(rows, [], cluster="cluster", positive=F.col("pos"), replicates=200, seed=20))


BANDS = [0, 10, 20, 30, 40, 50]
BAND_SQL = "CASE WHEN l_quantity <= 10 THEN 1 WHEN l_quantity <= 20 THEN 2 WHEN l_quantity <= 30 THEN 3 WHEN l_quantity <= 40 THEN 4 ELSE 5 END"


@query(
    "cluster_bootstrap_by_band",
    bootstrap_sql(
        f"WITH cells AS (SELECT {BAND_SQL} AS band, l_suppkey AS cluster, l_discount > 0.05 AS pos FROM lineitem)", "band", 7, 100
    ),
)
def cluster_bootstrap_by_band(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        rs.cut_right_closed(F.col("l_quantity"), BANDS).alias("band"), F.col("l_suppkey").alias("cluster"), (F.col("l_discount") > 0.05).alias("pos")
    )
    return rounded(rs.cluster_bootstrap(rows, ["band"], cluster="cluster", positive=F.col("pos"), replicates=100, seed=7))


@query(
    "cluster_bootstrap_quantile_cells",
    bootstrap_sql(
        f"""
WITH b AS (SELECT {BAND_SQL} AS band, l_suppkey, l_discount, round(l_extendedprice * 100)::BIGINT AS x FROM lineitem),
e AS (SELECT band, quantile_cont(x, 0.2) AS e1, quantile_cont(x, 0.4) AS e2, quantile_cont(x, 0.6) AS e3, quantile_cont(x, 0.8) AS e4 FROM b GROUP BY 1),
cells AS (SELECT band * 10 + CASE WHEN x <= e1 THEN 1 WHEN x <= e2 THEN 2 WHEN x <= e3 THEN 3 WHEN x <= e4 THEN 4 ELSE 5 END AS cell,
                 l_suppkey AS cluster, l_discount > 0.05 AS pos FROM b JOIN e USING (band))
""",
        "cell",
        11,
        50,
    ),
)
def cluster_bootstrap_quantile_cells(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        rs.cut_right_closed(F.col("l_quantity"), BANDS).alias("band"), F.col("l_suppkey").alias("cluster"), "l_discount", cents("l_extendedprice").alias("x")
    )
    binned = rs.quantile_bins(rows, ["band"], "x", 5, name="quintile")
    cells = binned.select((F.col("band") * 10 + F.col("quintile")).alias("cell"), "cluster", (F.col("l_discount") > 0.05).alias("pos"))
    return rounded(rs.cluster_bootstrap(cells, ["cell"], cluster="cluster", positive=F.col("pos"), replicates=50, seed=11))


@query(
    "quantile_bins",
    """
WITH e AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.2) AS e1, quantile_cont(c_acctbal, 0.4) AS e2, quantile_cont(c_acctbal, 0.6) AS e3, quantile_cont(c_acctbal, 0.8) AS e4
           FROM customer GROUP BY 1)
SELECT c_custkey, CASE WHEN c_acctbal <= e1 THEN 1 WHEN c_acctbal <= e2 THEN 2 WHEN c_acctbal <= e3 THEN 3 WHEN c_acctbal <= e4 THEN 4 ELSE 5 END AS quintile
FROM customer JOIN e USING (c_mktsegment)
""",
)
def quantile_bins(spark, sf_dir):
    return rs.quantile_bins(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal", 5, name="quintile").select("c_custkey", "quintile")


@query(
    "observed_in_null",
    """
WITH m AS (SELECT p_brand, l_partkey, avg(round(l_extendedprice * 100)::BIGINT) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
o AS (SELECT p_brand, l_partkey, v FROM m WHERE l_partkey % 100 < 25),
n AS (SELECT p_brand, v FROM m WHERE l_partkey % 100 >= 25)
SELECT o.l_partkey, count(*) AS null_n, round(avg(n.v), 4) AS null_mean, round(stddev_samp(n.v), 4) AS null_sd, round((any_value(o.v) - avg(n.v)) / stddev_samp(n.v), 6) AS z,
       round(100.0 * (sum(CASE WHEN n.v < o.v THEN 1.0 WHEN n.v = o.v THEN 0.5 ELSE 0.0 END)) / count(*), 6) AS percentile,
       round((sum(CASE WHEN n.v >= o.v THEN 1 ELSE 0 END) + 1) / (count(*) + 1.0), 6) AS p_high
FROM o JOIN n USING (p_brand) GROUP BY 1
""",
)
def observed_in_null(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    means = table(spark, sf_dir, "lineitem").select("l_partkey", cents("l_extendedprice").alias("c")).groupBy("l_partkey").agg(F.avg("c").alias("v")).join(parts, "l_partkey")
    seen = F.col("l_partkey") % 100 < 25
    placed = rs.observed_in_null(means.where(seen), means.where(~seen), ["p_brand"], value="v")
    return placed.select(
        "l_partkey", "null_n", F.round("null_mean", 4).alias("null_mean"), F.round("null_sd", 4).alias("null_sd"),
        F.round("z", 6).alias("z"), F.round("percentile", 6).alias("percentile"), F.round("p_high", 6).alias("p_high"),
    )


@query(
    "seeded_sample",
    """
WITH s AS (SELECT p_partkey, substr('ACGT', (p_size % 4 + 1)::INTEGER, 1) AS ref FROM part ORDER BY md5(concat_ws(':', 20, p_partkey)), p_partkey LIMIT 100)
SELECT p_partkey, ref, substr(replace('ACGT', ref, ''), (('0x' || substr(md5(concat_ws(':', 20, 'alt', p_partkey)), 1, 15))::BIGINT % 3 + 1)::INTEGER, 1) AS alt FROM s
""",
)
def seeded_sample(spark, sf_dir):
    from .variants import pick_base

    rows = table(spark, sf_dir, "part").select("p_partkey", pick_base(F.col("p_size")).alias("ref"))
    drawn = rs.sample_without_replacement(rows, 100, seed=20, key=["p_partkey"])
    return drawn.withColumn("alt", rs.random_alternate("ref", seed=20, key=["p_partkey"]))


@query(
    "proportion_gate",
    """
WITH g AS (SELECT l_suppkey, avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END) AS f, count(DISTINCT l_partkey) AS k FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1),
r AS (SELECT l_suppkey, avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END) AS f, count(DISTINCT l_partkey) AS k FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT l_suppkey, round(abs(g.f - r.f), 6) AS difference, round(1.96 * sqrt(0.5 / least(g.k, r.k)), 6) AS tolerance, abs(g.f - r.f) <= 1.96 * sqrt(0.5 / least(g.k, r.k)) AS passed
FROM g JOIN r USING (l_suppkey)
""",
)
def proportion_gate(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")

    def side(status, f, k):
        return lines.where(F.col("l_linestatus") == status).groupBy("l_suppkey").agg(
            F.avg((F.col("l_discount") > 0.05).cast("double")).alias(f), F.count_distinct("l_partkey").alias(k)
        )

    joined = side("O", "f", "k").join(side("F", "f_ref", "k_ref"), "l_suppkey")
    gated = qc.proportion_gate(joined, generated="f", expected="f_ref", clusters="k", expected_clusters="k_ref")
    return rounded(gated.select("l_suppkey", "difference", "tolerance", "passed"))


@query(
    "value_ranks",
    """
WITH d AS (SELECT l_returnflag, round(l_extendedprice * 100)::BIGINT AS c, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, c, n, coalesce(sum(n) OVER (PARTITION BY l_returnflag ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_less,
       (sum(n) OVER (PARTITION BY l_returnflag))::BIGINT AS n_total FROM d
""",
)
def value_ranks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", cents("l_extendedprice").alias("c"))
    return rk.value_ranks(rows, ["l_returnflag"], "c")
