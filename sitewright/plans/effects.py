"""Aggregation and paired-effect queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as ag
from ..operators import joins as jn
from ..functions import expressions as ex
from ..operators import ranking as rk
from .registry import cents, query, rounded, table

SCORED_SQL = """
scored AS (
  SELECT l_returnflag AS component, l_suppkey AS seed, l_linestatus AS allele, avg(l_extendedprice) AS signal
  FROM lineitem GROUP BY 1, 2, 3),
paired AS (
  SELECT component, seed,
         max(CASE WHEN allele = 'O' THEN signal END) - max(CASE WHEN allele = 'F' THEN signal END) AS delta
  FROM scored GROUP BY 1, 2 HAVING count(*) = 2),
retained AS (
  SELECT p.component, p.seed, p.delta, n.delta AS native_delta,
         CASE WHEN abs(n.delta) > 1e-12 THEN abs(p.delta) / abs(n.delta) END AS retention,
         CASE WHEN abs(n.delta) > 1e-12 THEN p.delta / n.delta END AS signed_retention
  FROM paired p JOIN paired n ON n.seed = p.seed AND n.component = 'A')
"""


def scored_states(spark, sf_dir):
    """Signal of each (component, seed, allele) state."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("component"), F.col("l_suppkey").alias("seed"), F.col("l_linestatus").alias("allele"))
        .agg(F.avg("l_extendedprice").alias("signal"))
    )


def retained(spark, sf_dir):
    paired = jn.paired_states(
        scored_states(spark, sf_dir), ["component", "seed"], state="allele", value="signal", treated="O", control="F"
    )
    return jn.retention(paired, ["seed"], is_native=F.col("component") == "A")


@query(
    "paired_retention_summary",
    f"""
WITH {SCORED_SQL}
SELECT component, count(DISTINCT seed) AS n_seeds, round(avg(retention), 6) AS mean_retention,
       round(quantile_cont(retention, 0.5), 6) AS median_retention, round(stddev_samp(retention), 6) AS sd_retention,
       round(avg(signed_retention), 6) AS mean_signed_retention,
       round(avg(CASE WHEN signed_retention > 0 THEN 1.0 WHEN signed_retention <= 0 THEN 0.0 END), 6) AS sign_preserved
FROM retained GROUP BY 1
""",
)
def paired_retention_summary(spark, sf_dir):
    rows = retained(spark, sf_dir)
    summary = ag.group_summary(rows, ["component"], "retention", unit="seed")
    signs = rows.groupBy("component").agg(
        F.avg("signed_retention").alias("mean_signed"), ag.fraction(F.col("signed_retention") > 0).alias("kept")
    )
    return summary.join(signs, "component").select(
        "component",
        F.col("n_units").alias("n_seeds"),
        F.round("mean", 6).alias("mean_retention"),
        F.round("median", 6).alias("median_retention"),
        F.round("sd", 6).alias("sd_retention"),
        F.round("mean_signed", 6).alias("mean_signed_retention"),
        F.round("kept", 6).alias("sign_preserved"),
    )


@query(
    "retention_by_seed",
    f"""
WITH {SCORED_SQL}
SELECT component, seed, round(delta, 4) AS delta, round(native_delta, 4) AS native_delta,
       round(retention, 4) AS retention, round(signed_retention, 4) AS signed_retention
FROM retained
""",
)
def retention_by_seed(spark, sf_dir):
    return rounded(
        retained(spark, sf_dir).select("component", "seed", "delta", "native_delta", "retention", "signed_retention"), 4
    )


@query(
    "retention_two_level",
    f"""
WITH {SCORED_SQL},
nations AS (SELECT s_suppkey AS seed, s_nationkey AS batch FROM supplier),
inner_means AS (SELECT r.component, n.batch, avg(r.retention) AS m FROM retained r JOIN nations n USING (seed) GROUP BY 1, 2)
SELECT component, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(m)), 6) AS sem,
       round(quantile_cont(m, 0.5), 6) AS median, count(m) AS n_replicates
FROM inner_means GROUP BY 1
""",
)
def retention_two_level(spark, sf_dir):
    batches = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seed"), F.col("s_nationkey").alias("batch"))
    rows = retained(spark, sf_dir).join(batches, "seed")
    return rounded(ag.two_level_summary(rows, ["component"], ["batch"], "retention"))


@query(
    "mean_and_size",
    """
SELECT l_suppkey, round(avg(l_discount), 6) AS mean_l_discount, count(*) AS n FROM lineitem GROUP BY 1
""",
)
def mean_and_size(spark, sf_dir):
    return rounded(ag.mean_and_size(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_discount"))


@query(
    "replicate_consensus",
    """
SELECT l_partkey, l_returnflag, round(avg(l_discount), 6) AS mean_effect,
       round(coalesce(stddev_samp(l_discount), 0.0), 6) AS sd_effect, count(*) AS n_replicates,
       min(l_tax) AS min_p, round(sum(l_quantity), 6) AS total_l_quantity
FROM lineitem GROUP BY 1, 2
""",
)
def replicate_consensus(spark, sf_dir):
    return rounded(
        ag.replicate_consensus(
            table(spark, sf_dir, "lineitem"), ["l_partkey", "l_returnflag"], value="l_discount", p_value="l_tax", totals=["l_quantity"]
        )
    )


@query(
    "group_summary",
    """
SELECT l_returnflag, l_linestatus, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd,
       round(min(v), 6) AS min, round(max(v), 6) AS max,
       round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END), 6) AS fraction_positive,
       round(avg(CASE WHEN v < 0 THEN 1.0 ELSE 0.0 END), 6) AS fraction_negative,
       round(avg(CASE WHEN v >= 10000 THEN 1.0 ELSE 0.0 END), 6) AS fraction_at_least,
       round(quantile_cont(v, 0.5), 6) AS median, count(DISTINCT l_suppkey) AS n_units
FROM (SELECT *, l_extendedprice - 40000.0 AS v FROM lineitem) GROUP BY 1, 2
""",
)
def group_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_extendedprice") - 40000.0)
    return rounded(ag.group_summary(rows, ["l_returnflag", "l_linestatus"], "v", unit="l_suppkey", threshold=10000.0))


@query(
    "distribution_deciles",
    """
SELECT c_mktsegment, count(c_acctbal) AS n, round(avg(c_acctbal), 4) AS mean, round(quantile_cont(c_acctbal, 0.1), 4) AS q10,
       round(quantile_cont(c_acctbal, 0.25), 4) AS q25, round(quantile_cont(c_acctbal, 0.5), 4) AS median,
       round(quantile_cont(c_acctbal, 0.75), 4) AS q75, round(quantile_cont(c_acctbal, 0.9), 4) AS q90
FROM customer GROUP BY 1
""",
)
def distribution_deciles(spark, sf_dir):
    rows = rk.distribution(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal", ag.DECILES)
    return rounded(rows.select("c_mktsegment", "n", "mean", *ag.DECILES), 4)


@query(
    "standard_error",
    """
SELECT event_type, user_id, count(*) AS n, round(avg(value), 6) AS mean,
       round(stddev_samp(value) / sqrt(count(value)), 6) AS sem,
       round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 6) AS fraction_above
FROM events GROUP BY 1, 2
""",
)
def standard_error(spark, sf_dir):
    return rounded(
        table(spark, sf_dir, "events")
        .groupBy("event_type", "user_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("value").alias("mean"),
            ag.sem("value").alias("sem"),
            ag.fraction(F.col("value") > 20).alias("fraction_above"),
        )
    )


@query(
    "two_level_summary",
    """
WITH m AS (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY 1, 2)
SELECT event_type, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(m)), 6) AS sem,
       round(quantile_cont(m, 0.5), 6) AS median, count(m) AS n_replicates
FROM m GROUP BY 1
""",
)
def two_level_summary(spark, sf_dir):
    return rounded(ag.two_level_summary(table(spark, sf_dir, "events"), ["event_type"], ["user_id"], "value"))


@query(
    "fused_records",
    """
WITH f AS (
  SELECT l_partkey, min(l_linenumber) AS best_rank, max(l_discount) AS max_share, sum(l_quantity) AS total_reads,
         first(l_orderkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS l_orderkey,
         first(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS l_extendedprice
  FROM lineitem GROUP BY 1),
s AS (SELECT l_partkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS sources FROM lineitem GROUP BY 1)
SELECT f.*, s.sources FROM f JOIN s USING (l_partkey)
""",
)
def fused_records(spark, sf_dir):
    return ag.fused_records(
        table(spark, sf_dir, "lineitem"),
        ["l_partkey"],
        rank="l_linenumber",
        share="l_discount",
        reads="l_quantity",
        order=[F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_extendedprice")],
        first=["l_orderkey", "l_extendedprice"],
        label="l_returnflag",
    )


@query(
    "inverse_variance",
    """
SELECT l_partkey, round(sum(l_discount / greatest(l_tax * l_tax, 1e-12)) / sum(1.0 / greatest(l_tax * l_tax, 1e-12)), 6) AS beta_ivw,
       round(sqrt(1.0 / sum(1.0 / greatest(l_tax * l_tax, 1e-12))), 6) AS se_ivw, round(min(l_quantity / 51.0), 6) AS min_p,
       round(max(-log10(greatest(l_quantity / 51.0, 2.2250738585072014e-308))), 6) AS max_neglog10_p,
       count(DISTINCT l_suppkey) AS n_units
FROM lineitem GROUP BY 1
""",
)
def inverse_variance(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_discount", (F.col("l_tax") * F.col("l_tax")).alias("variance"), (F.col("l_quantity") / 51.0).alias("p")
    )
    return rounded(
        ag.inverse_variance(rows, ["l_partkey"], beta="l_discount", variance="variance", p_value="p", unit="l_suppkey")
    )


@query(
    "modal_value",
    """
WITH c AS (SELECT p_brand, p_size, count(*) FILTER (WHERE p_type = 'ECONOMY') AS pref, count(*) AS n FROM part GROUP BY 1, 2),
b AS (SELECT p_brand, max(pref) > 0 AS from_preferred FROM c GROUP BY 1),
r AS (SELECT c.*, b.from_preferred, row_number() OVER (PARTITION BY c.p_brand ORDER BY CASE WHEN b.from_preferred THEN pref ELSE n END DESC, p_size) AS rn
      FROM c JOIN b USING (p_brand))
SELECT p_brand, p_size, CASE WHEN from_preferred THEN pref ELSE n END AS support, from_preferred FROM r WHERE rn = 1
""",
)
def modal_value(spark, sf_dir):
    return ag.modal_value(table(spark, sf_dir, "part"), ["p_brand"], "p_size", preferred=F.col("p_type") == "ECONOMY")


@query(
    "best_row_per_group",
    """
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1
""",
)
def best_row_per_group(spark, sf_dir):
    return rk.best_row(
        table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"),
        ["o_custkey"],
        [-F.col("o_totalprice"), F.col("o_orderkey")],
    )


@query(
    "share_of_total",
    """
SELECT c_custkey, c_mktsegment, round(c_acctbal / sum(c_acctbal) OVER (PARTITION BY c_mktsegment), 8) AS share FROM customer
""",
)
def share_of_total(spark, sf_dir):
    rows = ag.share_of_total(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal")
    return rounded(rows.select("c_custkey", "c_mktsegment", "share"), 8)


@query(
    "weighted_mixture",
    """
WITH s AS (SELECT *, l_quantity / sum(l_quantity) OVER (PARTITION BY l_suppkey) AS share FROM lineitem)
SELECT l_suppkey, round(sum(share * l_discount), 6) AS mixture, count(*) AS n_parts, round(sum(share), 6) AS share_sum FROM s GROUP BY 1
""",
)
def weighted_mixture(spark, sf_dir):
    shared = ag.share_of_total(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity")
    return rounded(ag.weighted_mixture(shared, ["l_suppkey"], share="share", value="l_discount"))


@query(
    "track_window_mean",
    """
WITH x AS (SELECT label, vec_id, CASE vec_id % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END AS strand,
                  unnest(embedding) AS v, unnest(range(64)) AS pos FROM embeddings),
t AS (SELECT label, vec_id, strand IN ('+', '.') AS matched, avg(v::DOUBLE) AS m FROM x WHERE pos BETWEEN 16 AND 47 GROUP BY 1, 2, 3)
SELECT label, round(avg(m), 6) AS mean_all, round(avg(m) FILTER (WHERE matched), 6) AS mean_matched, count(*) AS n_tracks,
       count(*) FILTER (WHERE matched) AS n_matched, round(coalesce(avg(m) FILTER (WHERE matched), avg(m)), 6) AS primary_mean
FROM t GROUP BY 1
""",
)
def track_window_mean(spark, sf_dir):
    strand = F.when(F.col("vec_id") % 3 == 0, "+").when(F.col("vec_id") % 3 == 1, "-").otherwise(".")
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", strand.alias("strand"), F.posexplode("embedding").alias("pos", "v"))
    return rounded(
        ag.track_window_mean(
            rows.withColumn("v", F.col("v").cast("double")),
            ["label"],
            track="vec_id",
            value="v",
            in_window=F.col("pos").between(16, 47),
            strand_matched=F.col("strand").isin("+", "."),
        )
    )


@query(
    "composite_group",
    """
WITH m AS (SELECT user_id, event_type, avg(value) AS value FROM events GROUP BY 1, 2)
SELECT user_id, event_type, round(value, 6) AS value FROM m
UNION ALL
SELECT user_id, 'engaged_mean' AS event_type, round(avg(value), 6) AS value FROM m WHERE event_type IN ('click', 'view') GROUP BY 1
""",
)
def composite_group(spark, sf_dir):
    means = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("value"))
    return rounded(
        ag.with_composite(means, ["user_id"], member="event_type", members=["click", "view"], label="engaged_mean", value="value")
    )


COORDINATED_SQL = """
d AS (SELECT l_partkey, l_linenumber, l_returnflag, avg(round(l_extendedprice * 100)::BIGINT) - 4000000.0 AS delta FROM lineitem GROUP BY 1, 2, 3),
c AS (SELECT l_partkey, l_linenumber, CASE WHEN min(delta) > 0 THEN min(delta) ELSE 0.0 END AS score,
             min(delta) AS min_delta, avg(delta) AS mean_delta FROM d GROUP BY 1, 2)
"""


@query(
    "coordinated_score",
    f"""
WITH {COORDINATED_SQL}
SELECT l_partkey, l_linenumber, round(score, 4) AS score, round(min_delta, 4) AS min_delta, round(mean_delta, 4) AS mean_delta FROM c
""",
)
def coordinated_score(spark, sf_dir):
    return rounded(coordinated(spark, sf_dir), 4)


def coordinated(spark, sf_dir):
    deltas = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey", "l_linenumber", "l_returnflag")
        .agg((F.avg(cents("l_extendedprice")) - 4000000.0).alias("delta"))
    )
    return ag.coordinated_score(deltas, ["l_partkey", "l_linenumber"], "delta")


@query(
    "best_coordinated",
    f"""
WITH {COORDINATED_SQL}
SELECT l_partkey, l_linenumber, round(score, 4) AS score, round(min_delta, 4) AS min_delta, round(mean_delta, 4) AS mean_delta FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY round(score, 4) DESC, round(min_delta, 4) DESC, round(mean_delta, 4) DESC, l_linenumber) AS rn FROM c) WHERE rn = 1
""",
)
def best_coordinated(spark, sf_dir):
    return ag.best_coordinated(rounded(coordinated(spark, sf_dir), 4), ["l_partkey"])


@query(
    "replicate_value_check",
    """
SELECT l_orderkey, round(avg(d), 6) AS order_day FROM (
  SELECT l_orderkey, (date_diff('day', DATE '1970-01-01', o_orderdate::DATE))::DOUBLE AS d
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1
""",
)
def replicate_value_check(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.unix_date(F.col("o_orderdate").cast("date")).cast("double").alias("d"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey").join(orders, "l_orderkey", "left")
    return rounded(jn.replicate_value(rows, ["l_orderkey"], "d", "order_day", tolerance=1e-9))


@query(
    "baseline_percent_change",
    """
WITH m AS (SELECT l_suppkey, l_returnflag, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2),
b AS (SELECT l_suppkey, v AS base FROM m WHERE l_returnflag = 'N')
SELECT l_suppkey, l_returnflag, round(v - base, 4) AS delta, round(100.0 * (v - base) / base, 4) AS percent_change,
       round(log2(v / base), 6) AS log2_fold_change, round(100.0 * (exp((v - base) / 100000.0) - 1), 6) AS implied_percent
FROM m LEFT JOIN b USING (l_suppkey)
""",
)
def baseline_percent_change(spark, sf_dir):
    means = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_extendedprice").alias("v"))
    based = jn.attach_baseline(means, ["l_suppkey"], is_baseline=F.col("l_returnflag") == "N", value="v", name="base", tolerance=1e-9)
    out = based.select(
        "l_suppkey",
        "l_returnflag",
        F.round(F.col("v") - F.col("base"), 4).alias("delta"),
        F.round(ex.percent_change("v", "base"), 4).alias("percent_change"),
        F.round(ex.log2_fold_change("v", "base"), 6).alias("log2_fold_change"),
        F.round(ex.percent_from_log_change((F.col("v") - F.col("base")) / 100000.0), 6).alias("implied_percent"),
    )
    return out


@query(
    "pivot_mean",
    """
SELECT user_id, round(avg(CASE WHEN event_type = 'click' THEN value END), 6) AS rna_click,
       round(avg(CASE WHEN event_type = 'view' THEN value END), 6) AS rna_view,
       round(avg(CASE WHEN event_type = 'purchase' THEN value END), 6) AS rna_purchase,
       round(avg(CASE WHEN event_type = 'error' THEN value END), 6) AS rna_error,
       round(avg(CASE WHEN event_type = 'signup' THEN value END), 6) AS rna_signup
FROM events GROUP BY 1
""",
)
def pivot_mean(spark, sf_dir):
    return rounded(ag.pivot_mean(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["click", "view", "purchase", "error", "signup"], "value", prefix="rna_"))


@query(
    "pivot_many_row_mean",
    """
WITH w AS (
  SELECT l_suppkey, avg(CASE WHEN l_returnflag = 'A' THEN l_discount END) AS l_discount_A,
         avg(CASE WHEN l_returnflag = 'R' THEN l_discount END) AS l_discount_R,
         avg(CASE WHEN l_returnflag = 'A' THEN l_tax END) AS l_tax_A, avg(CASE WHEN l_returnflag = 'R' THEN l_tax END) AS l_tax_R
  FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(l_discount_A, 6) AS "l_discount_A", round(l_discount_R, 6) AS "l_discount_R", round(l_tax_A, 6) AS "l_tax_A",
       round(l_tax_R, 6) AS "l_tax_R",
       round(CASE WHEN l_discount_A IS NULL THEN l_discount_R WHEN l_discount_R IS NULL THEN l_discount_A ELSE (l_discount_A + l_discount_R) / 2 END, 6) AS mean_discount,
       round(greatest(l_tax_A, l_tax_R), 6) AS max_tax
FROM w
""",
)
def pivot_many_row_mean(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    wide = ag.pivot_many(rows, ["l_suppkey"], "l_returnflag", ["A", "R"], ["l_discount", "l_tax"])
    return rounded(
        wide.withColumn("mean_discount", ex.mean_of(["l_discount_A", "l_discount_R"])).withColumn(
            "max_tax", ex.largest_of(["l_tax_A", "l_tax_R"])
        )
    )


@query(
    "melt_measures",
    """
SELECT l_partkey, 'quantity' AS measure, round(sum(l_quantity), 4) AS total FROM lineitem GROUP BY 1
UNION ALL SELECT l_partkey, 'price', round(sum(l_extendedprice), 4) FROM lineitem GROUP BY 1
UNION ALL SELECT l_partkey, 'discount', round(sum(l_discount), 4) FROM lineitem GROUP BY 1
""",
)
def melt_measures(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"), F.sum("l_discount").alias("discount")
    )
    return rounded(ag.melt(sums, ["l_partkey"], ["quantity", "price", "discount"], variable="measure", value="total"), 4)


@query(
    "completeness",
    """
SELECT l_partkey, count(DISTINCT l_returnflag) AS n_members, count(*) AS n_rows, count(DISTINCT l_returnflag) = 3 AS complete
FROM lineitem GROUP BY 1
""",
)
def completeness(spark, sf_dir):
    return ag.completeness(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_returnflag", 3)


@query(
    "interaction_effect",
    """
WITH s AS (
  SELECT l_partkey % 50 + 50 * (l_suppkey % 20) AS promoter, CASE WHEN l_linenumber = 7 THEN 'native_shared' WHEN l_linenumber % 3 = 0 THEN 'high'
         WHEN l_linenumber % 3 = 1 THEN 'low_1' ELSE 'low_2' END AS role,
         CASE WHEN l_linenumber = 7 THEN 'native' WHEN l_linestatus = 'O' THEN 'T' ELSE 'G' END AS construct, avg(round(l_extendedprice * 100)::BIGINT) AS v
  FROM lineitem GROUP BY 1, 2, 3),
w AS (
  SELECT promoter, count(*) FILTER (WHERE construct = 'native') AS nat, max(CASE WHEN construct = 'native' THEN v END) AS native_value,
         max(CASE WHEN role = 'high' AND construct = 'T' THEN v END) - max(CASE WHEN role = 'high' AND construct = 'G' THEN v END) AS h,
         max(CASE WHEN role = 'low_1' AND construct = 'T' THEN v END) - max(CASE WHEN role = 'low_1' AND construct = 'G' THEN v END) AS l1,
         max(CASE WHEN role = 'low_2' AND construct = 'T' THEN v END) - max(CASE WHEN role = 'low_2' AND construct = 'G' THEN v END) AS l2
  FROM s GROUP BY 1)
SELECT promoter, round(native_value, 4) AS native_value, round(h, 4) AS high_delta, round((l1 + l2) / 2, 4) AS mean_low_delta,
       round(h - (l1 + l2) / 2, 4) AS interaction
FROM w WHERE nat = 1 AND h IS NOT NULL AND l1 IS NOT NULL AND l2 IS NOT NULL
""",
)
def interaction_effect(spark, sf_dir):
    k = F.col("l_linenumber")
    states = (
        table(spark, sf_dir, "lineitem")
        .select(
            (F.col("l_partkey") % 50 + 50 * (F.col("l_suppkey") % 20)).alias("promoter"),
            F.when(k == 7, "native_shared").when(k % 3 == 0, "high").when(k % 3 == 1, "low_1").otherwise("low_2").alias("role"),
            F.when(k == 7, "native").when(F.col("l_linestatus") == "O", "T").otherwise("G").alias("construct"),
            cents("l_extendedprice").alias("price"),
        )
        .groupBy("promoter", "role", "construct")
        .agg(F.avg("price").alias("v"))
    )
    return rounded(
        ag.interaction_effect(
            states, ["promoter"], role="role", state="construct", value="v", high="high", lows=["low_1", "low_2"], treated="T", control="G", native="native"
        ),
        4,
    )


@query(
    "scaled_by_largest",
    """
WITH m AS (SELECT event_type, user_id, avg(value) - 25.0 AS effect FROM events GROUP BY 1, 2)
SELECT event_type, user_id, round(effect / greatest(max(abs(effect)) OVER (PARTITION BY event_type), 1e-12), 6) AS scaled FROM m
""",
)
def scaled_by_largest(spark, sf_dir):
    means = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg((F.avg("value") - 25.0).alias("effect"))
    return rounded(ag.scaled_by_largest(means, ["event_type"], "effect").drop("effect"))


@query(
    "boundary_surface",
    """
WITH r AS (
  SELECT l_linenumber AS upstream, l_quantity::INTEGER AS downstream, CASE WHEN l_linestatus = 'O' THEN 'outside' ELSE 'inside' END AS cond,
         l_suppkey AS seed, sum(round(l_discount * 100)::BIGINT)::DOUBLE / 16 AS retention
  FROM lineitem GROUP BY 1, 2, 3, 4),
g AS (
  SELECT upstream, downstream, cond, count(DISTINCT seed) AS n_units, avg(retention) AS mean, quantile_cont(retention, 0.5) AS median,
         stddev_samp(retention) AS sd, min(retention) AS min, max(retention) AS max,
         avg(CASE WHEN retention >= 0.5 THEN 1.0 ELSE 0.0 END) AS fal
  FROM r GROUP BY 1, 2, 3),
p AS (SELECT o.upstream, o.downstream, o.n_units AS outside_n_units, i.n_units AS inside_n_units, o.mean AS om, i.mean AS im, o.median AS omd, i.median AS imd,
             o.sd AS outside_sd, i.sd AS inside_sd, o.min AS outside_min, i.min AS inside_min, o.max AS outside_max, i.max AS inside_max, o.fal AS ofal, i.fal AS ifal
      FROM g o JOIN g i ON o.upstream = i.upstream AND o.downstream = i.downstream AND o.cond = 'outside' AND i.cond = 'inside')
SELECT upstream, downstream, outside_n_units, inside_n_units, round(om, 9) AS outside_mean, round(im, 9) AS inside_mean,
       round(omd, 9) AS outside_median, round(imd, 9) AS inside_median, round(outside_sd, 9) AS outside_sd, round(inside_sd, 9) AS inside_sd,
       round(outside_min, 9) AS outside_min, round(inside_min, 9) AS inside_min, round(outside_max, 9) AS outside_max, round(inside_max, 9) AS inside_max,
       round(ofal, 9) AS outside_fraction_at_least, round(ifal, 9) AS inside_fraction_at_least,
       om >= 0.5 AND im <= 0.5 AND downstream >= 8 AS passes_mean, omd >= 0.5 AND im <= 0.5 AND downstream >= 8 AS passes_median
FROM p
""",
)
def boundary_surface(spark, sf_dir):
    rows = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_linenumber").alias("upstream"),
            F.col("l_quantity").cast("int").alias("downstream"),
            F.when(F.col("l_linestatus") == "O", "outside").otherwise("inside").alias("cond"),
            F.col("l_suppkey").alias("seed"),
        )
        # sixteenths are exact in binary, so the thresholds cannot hang on the order of a sum
        .agg((F.sum(cents("l_discount")).cast("double") / 16).alias("retention"))
    )
    return rounded(
        ag.boundary_surface(
            rows, ["upstream", "downstream"], condition="cond", outside="outside", inside="inside", value="retention", replicate="seed",
            keep_at_least=0.5, keep_at_most=0.5, extra_criterion=F.col("downstream") >= 8,
        ),
        9,
    )


@query(
    "select_primary_geometry",
    """
WITH r AS (SELECT l_linenumber AS upstream, l_quantity::INTEGER AS downstream, l_linestatus AS cond, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2, 3),
p AS (SELECT upstream, downstream, max(CASE WHEN cond = 'O' THEN m END) AS outside_mean, max(CASE WHEN cond = 'F' THEN m END) AS inside_mean FROM r GROUP BY 1, 2)
SELECT upstream, downstream, upstream + downstream + 1 AS window_length, round(outside_mean, 4) AS outside_mean
FROM p WHERE outside_mean > inside_mean ORDER BY window_length, outside_mean DESC, downstream LIMIT 1
""",
)
def select_primary_geometry(spark, sf_dir):
    rows = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_linenumber").alias("upstream"), F.col("l_quantity").cast("int").alias("downstream"))
        .agg(
            F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice"))).alias("outside_mean"),
            F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice"))).alias("inside_mean"),
        )
        .where(F.col("outside_mean") > F.col("inside_mean"))
        .withColumn("window_length", F.col("upstream") + F.col("downstream") + 1)
    )
    best = rows.orderBy("window_length", F.desc("outside_mean"), "downstream").limit(1)
    return rounded(best.select("upstream", "downstream", "window_length", "outside_mean"), 4)


@query(
    "composition_percentages",
    """
WITH s AS (SELECT sum(l_quantity::BIGINT)::BIGINT AS total_reads, (sum(l_quantity::BIGINT) FILTER (WHERE l_returnflag = 'N'))::BIGINT AS unedited_reads,
                  (sum(l_quantity::BIGINT) FILTER (WHERE l_returnflag = 'A'))::BIGINT AS modeled_reads FROM lineitem)
SELECT *, total_reads - unedited_reads - modeled_reads AS other_reads,
       round(100.0 * (total_reads - unedited_reads) / total_reads, 6) AS edited_percent,
       round(100.0 * modeled_reads / (total_reads - unedited_reads), 6) AS modeled_percent FROM s
""",
)
def composition_percentages(spark, sf_dir):
    q = F.col("l_quantity").cast("bigint")
    return rounded(
        ag.composition_percentages(
            table(spark, sf_dir, "lineitem"),
            total=q,
            unedited=F.when(F.col("l_returnflag") == "N", q),
            modeled=F.when(F.col("l_returnflag") == "A", q),
        )
    )


@query(
    "log_transforms",
    """
SELECT c_custkey, round(log10(c_acctbal + 1000.1), 6) AS log_balance, round(-log10(greatest(abs(c_acctbal) / 100000.0, 2.2250738585072014e-308)), 6) AS neg_log,
       round(CASE WHEN abs(c_acctbal) > 1e-12 THEN 1000.0 / c_acctbal END, 6) AS guarded
FROM customer
""",
)
def log_transforms(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.round(ex.log10_with_offset("c_acctbal", 1000.1), 6).alias("log_balance"),
        F.round(ex.neg_log10(F.abs("c_acctbal") / 100000.0), 6).alias("neg_log"),
        F.round(ex.guarded_ratio(F.lit(1000.0), "c_acctbal"), 6).alias("guarded"),
    )
