"""Queries for the statistics the analysis plans specify."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prespecified as ps
from ..operators import ranking as rk
from ..operators import replicates as rp
from ..session import fresh_folder
from .registry import cents, query, rounded, table


@query(
    "matched_sampling",
    """
WITH k AS (SELECT p_partkey AS k, p_brand, p_type FROM part WHERE p_size % 4 = 0), c AS (SELECT p_partkey AS k, p_brand, p_type FROM part WHERE p_size % 4 <> 0),
k0 AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY md5(concat_ws(':', 1, 'case', k)), k) AS r FROM k),
c0 AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY md5(concat_ws(':', 1, 'control', k)), k) AS r FROM c),
m0 AS (SELECT k0.k AS "case", c0.k AS control, 0 AS level FROM k0 JOIN c0 USING (p_brand, p_type, r)),
k1 AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY md5(concat_ws(':', 1, 'case', k)), k) AS r FROM k WHERE k NOT IN (SELECT "case" FROM m0)),
c1 AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY md5(concat_ws(':', 1, 'control', k)), k) AS r FROM c WHERE k NOT IN (SELECT control FROM m0)),
m1 AS (SELECT k1.k AS "case", c1.k AS control, 1 AS level FROM k1 JOIN c1 USING (p_brand, r))
SELECT * FROM m0 UNION ALL SELECT * FROM m1
""",
)
def matched_sampling(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_brand", "p_type", "p_size")
    chosen = F.col("p_size") % 4 == 0
    return ps.matched_sample(parts.where(chosen), parts.where(~chosen), [["p_brand", "p_type"], ["p_brand"]], key="k", seed=1, store=fresh_folder(spark, "matched"))


@query(
    "smallest_q_per_variant",
    """
SELECT l_partkey, l_tax AS q, l_discount AS p, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_tax, l_discount, l_orderkey) AS rn FROM lineitem) WHERE rn = 1
""",
)
def smallest_q_per_variant(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_tax").alias("q"), F.col("l_discount").alias("p"), "l_orderkey")
    return rk.best_row(rows, ["l_partkey"], [F.col("q"), F.col("p"), F.col("l_orderkey")])


@query(
    "ranking_quality",
    """
WITH r AS (SELECT l_returnflag, floor(l_extendedprice)::BIGINT AS s, CASE WHEN l_discount > 0.06 THEN 1 ELSE 0 END AS y FROM lineitem),
v AS (SELECT l_returnflag, s, count(*) AS n, sum(y) AS p FROM r GROUP BY 1, 2),
c AS (SELECT *, coalesce(sum(n - p) OVER w, 0) AS neg_below, sum(n) OVER (PARTITION BY l_returnflag ORDER BY s DESC) AS n_ge, sum(p) OVER (PARTITION BY l_returnflag ORDER BY s DESC) AS p_ge,
             sum(n) OVER (PARTITION BY l_returnflag) AS nt, sum(p) OVER (PARTITION BY l_returnflag) AS pt FROM v WINDOW w AS (PARTITION BY l_returnflag ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT l_returnflag, max(nt)::BIGINT AS n, max(pt)::BIGINT AS n_positive, round(sum(p * (neg_below + 0.5 * (n - p))) / (max(pt) * (max(nt) - max(pt))), 6) AS roc_auc, round(sum(p * p_ge / n_ge::DOUBLE) / max(pt), 6) AS pr_auc
FROM c GROUP BY 1
""",
)
def ranking_quality(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.floor("l_extendedprice").cast("bigint").alias("s"), "l_discount")
    return rounded(ps.ranking_quality(rows, ["l_returnflag"], score="s", positive=F.col("l_discount") > 0.06))


@query(
    "ranking_quality_bootstrap",
    f"""
WITH r AS (SELECT l_returnflag AS g, l_suppkey AS cluster, floor(l_extendedprice)::DOUBLE AS price, l_quantity::DOUBLE AS quantity, CASE WHEN l_discount > 0.06 THEN 1 ELSE 0 END AS y FROM lineitem),
c AS (SELECT g, cluster, row_number() OVER (PARTITION BY g ORDER BY cluster) AS slot, count(*) OVER (PARTITION BY g) AS k FROM (SELECT DISTINCT g, cluster FROM r)),
d AS (SELECT c.g, b, ('0x' || substr(md5(concat_ws(':', 5, c.g, b, slot)), 1, 15))::BIGINT % k + 1 AS pick FROM c, range(0, 40) t(b)),
e AS (SELECT d.g, d.b, r.price, r.quantity, r.y FROM d JOIN c ON c.g = d.g AND c.slot = d.pick JOIN r ON r.g = c.g AND r.cluster = c.cluster
      UNION ALL SELECT g, -1, price, quantity, y FROM r),
l AS (SELECT g, b, 'price' AS score, price AS s, y FROM e UNION ALL SELECT g, b, 'quantity', quantity, y FROM e),
v AS (SELECT g, b, score, s, count(*) AS n, sum(y) AS p FROM l GROUP BY ALL),
w AS (SELECT *, coalesce(sum(n - p) OVER (PARTITION BY g, b, score ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
      sum(n) OVER (PARTITION BY g, b, score ORDER BY s DESC) AS n_ge, sum(p) OVER (PARTITION BY g, b, score ORDER BY s DESC) AS p_ge,
      sum(n) OVER (PARTITION BY g, b, score) AS nt, sum(p) OVER (PARTITION BY g, b, score) AS pt FROM v),
a AS (SELECT g, b, score, max(nt) AS n, max(pt) AS n_positive, sum(p * (neg_below + 0.5 * (n - p)))::DOUBLE / (max(pt) * (max(nt) - max(pt))) AS roc, sum(p * p_ge / n_ge::DOUBLE) / max(pt) AS pr FROM w GROUP BY 1, 2, 3),
x AS (SELECT a.*, a.roc - f.roc AS roc_d, a.pr - f.pr AS pr_d FROM a JOIN a f ON f.g = a.g AND f.b = a.b AND f.score = 'price')
SELECT g, score, max(n)FILTER (WHERE b = -1)::BIGINT AS n, max(n_positive) FILTER (WHERE b = -1)::BIGINT AS n_positive,
{", ".join(
    f"round(max({c}) FILTER (WHERE b = -1 AND {w}), 6) AS {name}, round(quantile_cont({c}, 0.025) FILTER (WHERE b >= 0 AND {w}), 6) AS {name}_low, round(quantile_cont({c}, 0.975) FILTER (WHERE b >= 0 AND {w}), 6) AS {name}_high"
    for c, name, w in (("roc", "roc_auc", "true"), ("pr", "pr_auc", "true"), ("roc_d", "roc_difference", "score <> 'price'"), ("pr_d", "pr_difference", "score <> 'price'"))
)}
FROM x GROUP BY g, score
""",
)
def ranking_quality_bootstrap(spark, sf_dir):
    """Both areas of two scores on the same draws, and the paired difference between them."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("g"), F.col("l_suppkey").alias("cluster"), F.floor("l_extendedprice").cast("double").alias("price"),
        F.col("l_quantity").cast("double").alias("quantity"), "l_discount",
    )
    out = rp.ranking_quality_bootstrap(
        rows, ["g"], scores=["price", "quantity"], positive=F.col("l_discount") > 0.06, cluster="cluster", replicates=40, seed=5
    )
    return rounded(out)


def bisected(side: str) -> str:
    """Bisection in SQL for the share at which a binomial tail (``k`` or more, or ``k`` or fewer, of n) is 2.5%."""
    terms = "range(k, n + 1)" if side == "low" else "range(0, k + 1)"
    middle = "((a.lo + a.hi) / 2)"
    tail = (
        f"list_sum(list_transform({terms}, lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({middle}) + (n - i) * ln(1 - {middle}))))"
    )
    up, down = f"{{'lo': {middle}, 'hi': a.hi}}", f"{{'lo': a.lo, 'hi': {middle}}}"
    step = f"CASE WHEN {tail} < 0.025 THEN {up if side == 'low' else down} ELSE {down if side == 'low' else up} END"
    return f"list_reduce(list_transform(range(0, 41), lambda i: {{'lo': 0.0::DOUBLE, 'hi': 1.0::DOUBLE}}), lambda a, b: {step}).lo"


@query(
    "binomial_interval",
    f"""
WITH c AS (SELECT l_suppkey, count(*) FILTER (WHERE l_discount > 0.05) AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey, k, n, round(CASE WHEN k = 0 THEN 0.0 ELSE {bisected('low')} END, 6) AS low, round(CASE WHEN k = n THEN 1.0 ELSE {bisected('high')} END, 6) AS high FROM c
""",
)
def binomial_interval(spark, sf_dir):
    """Exact interval of the discounted share per supplier."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.when(F.col("l_discount") > 0.05, 1)).alias("k"), F.count(F.lit(1)).alias("n")
    )
    return rounded(counts.withColumn("_ci", ps.exact_binomial_interval("k", "n")).select("l_suppkey", "k", "n", "_ci.low", "_ci.high"))


@query(
    "adjusted_p_values",
    """
WITH m AS (SELECT l_returnflag, l_partkey, exp(-abs(avg(round(l_extendedprice * 100)::BIGINT) - 4950000) / 500000) AS p FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, p * count(*) OVER (PARTITION BY l_returnflag) / rank_max AS raw FROM (SELECT *, count(*) OVER (PARTITION BY l_returnflag ORDER BY p) AS rank_max FROM m))
SELECT l_returnflag, l_partkey, round(least(1.0, min(raw) OVER (PARTITION BY l_returnflag ORDER BY p DESC)), 8) AS q FROM r
""",
)
def adjusted_p_values(spark, sf_dir):
    means = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey", cents("l_extendedprice").alias("c")).groupBy("l_returnflag", "l_partkey").agg(
        F.exp(-F.abs(F.avg("c") - 4950000) / 500000).alias("p")
    )
    return rounded(ps.adjusted_p_values(means, ["l_returnflag"], "p").select("l_returnflag", "l_partkey", "q"), 8)


@query(
    "control_adjusted_effects",
    """
WITH c AS (SELECT l_partkey, quantile_cont(l_quantity, 0.5) AS control_median FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
b AS (SELECT l_partkey, max(l_quantity) AS best FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT l_partkey, best AS l_quantity, round(best - control_median, 6) AS adjusted_effect FROM b LEFT JOIN c USING (l_partkey)
""",
)
def control_adjusted_effects(spark, sf_dir):
    """Largest effect per key (its best orientation) minus the median control."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_returnflag")
    adjusted = ps.control_adjusted(rows, ["l_partkey"], effect="l_quantity", is_control=F.col("l_returnflag") == "N")
    best = rk.best_row(adjusted, ["l_partkey"], [-F.col("l_quantity"), F.col("l_returnflag")])
    return rounded(best.select("l_partkey", "l_quantity", "adjusted_effect"))


@query(
    "top_sign_agreement",
    """
WITH r AS (SELECT l_suppkey, l_discount - 0.05 AS x, l_tax - 0.04 AS y, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rk FROM lineitem)
SELECT l_suppkey, round(avg(CASE WHEN sign(x) = sign(y) THEN 1.0 ELSE 0.0 END), 6) AS sign_agreement, count(*) AS n FROM r WHERE rk <= 5 GROUP BY 1
""",
)
def top_sign_agreement(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_discount") - 0.05).alias("x"), (F.col("l_tax") - 0.04).alias("y"), "l_extendedprice", "l_orderkey", "l_linenumber")
    out = ps.top_sign_agreement(rows, ["l_suppkey"], order=[F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], n=5, x="x", y="y")
    return rounded(out)


@query(
    "bootstrap_spearman",
    """
WITH r AS (SELECT l_returnflag AS g, l_suppkey AS cluster, l_quantity AS x, l_extendedprice AS y FROM lineitem),
c AS (SELECT g, cluster, row_number() OVER (PARTITION BY g ORDER BY cluster) AS slot, count(*) OVER (PARTITION BY g) AS k FROM (SELECT DISTINCT g, cluster FROM r)),
d AS (SELECT c.g, b, ('0x' || substr(md5(concat_ws(':', 3, c.g, b, slot)), 1, 15))::BIGINT % k + 1 AS pick FROM c, range(0, 200) t(b)),
e AS (SELECT d.g, d.b, r.x, r.y FROM d JOIN c ON c.g = d.g AND c.slot = d.pick JOIN r ON r.g = c.g AND r.cluster = c.cluster),
k AS (SELECT g, b, rank() OVER (PARTITION BY g, b ORDER BY x) + (count(*) OVER (PARTITION BY g, b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY g, b ORDER BY y) + (count(*) OVER (PARTITION BY g, b, y) - 1) / 2.0 AS ry FROM e),
s AS (SELECT g, b, corr(rx, ry) AS rho FROM k GROUP BY 1, 2),
p AS (SELECT g, count(*) AS n, corr(rx, ry) AS rho FROM (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS ry FROM r) GROUP BY 1)
SELECT p.g, p.n, round(p.rho, 6) AS spearman, round(quantile_cont(s.rho, 0.025), 6) AS ci_low, round(quantile_cont(s.rho, 0.975), 6) AS ci_high FROM p JOIN s USING (g) GROUP BY p.g, p.n, p.rho
""",
)
def bootstrap_spearman(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("g"), F.col("l_suppkey").alias("cluster"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")
    )
    return rounded(rp.bootstrap_spearman(rows, ["g"], "x", "y", cluster="cluster", replicates=200, seed=3))
