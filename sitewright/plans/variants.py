"""Harmonisation, matching, covariance and correlation queries.

Variants come from ``part`` (position = part key, alleles from size and key), effect records from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..functions import sequences as sq
from ..operators import aggregates as ag
from ..operators import association as asn
from ..operators import joins as jn
from ..operators import ranking as rk
from ..sources import readers
from .registry import cents, query, rounded, table

VARIANTS_SQL = """
variants AS (
  SELECT p_partkey AS pos, substr('ACGT', (p_size % 4 + 1)::INTEGER, 1) AS lowering,
         substr('ACGT', ((p_size + 1 + p_partkey % 3) % 4 + 1)::INTEGER, 1) AS raising,
         CASE WHEN p_type = 'ECONOMY' THEN '-' ELSE '+' END AS strand FROM part),
records AS (
  SELECT l_partkey AS pos, substr('ACGT', (l_suppkey % 4 + 1)::INTEGER, 1) AS ref,
         substr('ACGT', ((l_suppkey + 1 + l_linenumber % 3) % 4 + 1)::INTEGER, 1) AS alt,
         l_discount - 0.05 AS slope, l_tax AS se, l_quantity AS p, l_orderkey, l_linenumber, l_extendedprice FROM lineitem),
turned AS (
  SELECT v.*, r.slope, r.se, r.p, r.l_orderkey, r.l_linenumber, r.l_extendedprice,
         CASE WHEN strand = '-' THEN translate(ref, 'ACGT', 'TGCA') ELSE ref END AS ref,
         CASE WHEN strand = '-' THEN translate(alt, 'ACGT', 'TGCA') ELSE alt END AS alt
  FROM variants v JOIN records r ON v.pos = r.pos)
"""


def pick_base(index):
    return F.substring(F.lit("ACGT"), (index % 4 + 1).cast("int"), F.lit(1))


def variant_table(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pos"),
        pick_base(F.col("p_size")).alias("lowering"),
        pick_base(F.col("p_size") + 1 + F.col("p_partkey") % 3).alias("raising"),
        F.when(F.col("p_type") == "ECONOMY", "-").otherwise("+").alias("strand"),
    )


def effect_records(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("pos"),
        pick_base(F.col("l_suppkey")).alias("ref"),
        pick_base(F.col("l_suppkey") + 1 + F.col("l_linenumber") % 3).alias("alt"),
        (F.col("l_discount") - 0.05).alias("slope"),
        F.col("l_tax").alias("se"),
        F.col("l_quantity").alias("p"),
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
    )


@query(
    "allele_oriented_join",
    f"""
WITH {VARIANTS_SQL}
SELECT pos, lowering, raising, count(*) AS n,
       round(avg(CASE WHEN alt = lowering THEN slope ELSE -slope END), 6) AS mean_effect
FROM turned WHERE (alt = lowering AND ref = raising) OR (ref = lowering AND alt = raising) GROUP BY 1, 2, 3
""",
)
def allele_oriented_join(spark, sf_dir):
    matched = jn.allele_join(
        variant_table(spark, sf_dir), effect_records(spark, sf_dir), ["pos"],
        lowering="lowering", raising="raising", ref="ref", alt="alt", strand="strand", effect="slope",
    )
    return rounded(
        matched.groupBy("pos", "lowering", "raising").agg(F.count(F.lit(1)).alias("n"), F.avg("oriented_effect").alias("mean_effect"))
    )


@query(
    "fallback_match",
    f"""
WITH {VARIANTS_SQL},
r AS (SELECT *, (alt = lowering AND ref = raising) OR (ref = lowering AND alt = raising) AS hit FROM turned),
k AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY hit DESC, l_orderkey, l_linenumber, l_extendedprice) AS rn FROM r)
SELECT v.pos, round(CASE WHEN NOT k.hit THEN NULL WHEN k.alt = v.lowering THEN k.slope ELSE -k.slope END, 6) AS effect, k.se, k.p,
       CASE WHEN k.hit IS NULL THEN 'absent' WHEN k.hit THEN 'allele_match' ELSE 'position_only' END AS match_status
FROM variants v LEFT JOIN k ON v.pos = k.pos AND k.rn = 1
""",
)
def fallback_match(spark, sf_dir):
    out = jn.fallback_match(
        variant_table(spark, sf_dir), effect_records(spark, sf_dir), position="pos", lowering="lowering", raising="raising",
        strand="strand", ref="ref", alt="alt", order=["l_orderkey", "l_linenumber", "l_extendedprice"], effect="slope", carried=["se", "p"],
    )
    return rounded(out.select("pos", "effect", "se", "p", "match_status"))


@query(
    "position_join_same_alleles",
    f"""
WITH {VARIANTS_SQL},
m AS (SELECT v.pos, CASE WHEN r.ref = v.lowering THEN r.slope ELSE -r.slope END AS e FROM variants v JOIN records r ON v.pos = r.pos
      WHERE (r.ref = v.lowering AND r.alt = v.raising) OR (r.ref = v.raising AND r.alt = v.lowering))
SELECT pos, count(*) AS n, round(sum(e), 6) AS total FROM m GROUP BY 1
""",
)
def position_join_same_alleles(spark, sf_dir):
    kept = jn.same_position_same_alleles(
        effect_records(spark, sf_dir), variant_table(spark, sf_dir), ["pos"], ref="ref", alt="alt", other_ref="lowering", other_alt="raising",
        effect="slope", oriented="e",
    )
    return rounded(kept.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("total")))


@query(
    "checked_join",
    """
SELECT l_orderkey, l_linenumber, l_suppkey, o_custkey, o_orderstatus FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
""",
)
def checked_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    return jn.checked_join(lines, orders, ["l_orderkey"], how="left", validate="many_to_one")


@query(
    "inner_composite_join",
    """
WITH a AS (SELECT l_partkey, l_suppkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS open_cents FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2),
b AS (SELECT l_partkey, l_suppkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS final_cents FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2)
SELECT * FROM a JOIN b USING (l_partkey, l_suppkey)
""",
)
def inner_composite_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linestatus", cents("l_extendedprice").alias("c"))
    one, two = (
        lines.where(F.col("l_linestatus") == s).groupBy("l_partkey", "l_suppkey").agg(F.sum("c").alias(n))
        for s, n in (("O", "open_cents"), ("F", "final_cents"))
    )
    return one.join(two, ["l_partkey", "l_suppkey"], "inner")


@query(
    "shared_state_expansion",
    """
WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents), s AS (SELECT h, count(*) AS n_designs FROM d GROUP BY 1)
SELECT d.doc_id, d.h AS state, s.n_designs FROM d JOIN s USING (h)
""",
)
def shared_state_expansion(spark, sf_dir):
    designs = table(spark, sf_dir, "documents").select("doc_id", sq.content_hash("text").alias("state"))
    states = designs.groupBy("state").agg(F.count(F.lit(1)).alias("n_designs"))
    return designs.join(states, "state").select("doc_id", "state", "n_designs")


@query(
    "null_key_join",
    """
WITH a AS (SELECT c_nationkey AS n, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS seg, count(*) AS customers FROM customer GROUP BY 1, 2),
b AS (SELECT c_nationkey AS n, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS seg, round(avg(c_acctbal), 4) AS balance FROM customer GROUP BY 1, 2)
SELECT a.n, a.seg, a.customers, b.balance FROM a JOIN b ON a.n IS NOT DISTINCT FROM b.n AND a.seg IS NOT DISTINCT FROM b.seg
""",
)
def null_key_join(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("n"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("seg"), "c_acctbal"
    )
    counts = rows.groupBy("n", "seg").agg(F.count(F.lit(1)).alias("customers"))
    balances = rows.groupBy("n", "seg").agg(F.round(F.avg("c_acctbal"), 4).alias("balance"))
    return jn.null_matching_join(counts, balances, ["n", "seg"])


@query(
    "pending_and_done",
    """
SELECT c_custkey, 'pending' AS state FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 300000)
UNION ALL
SELECT c_custkey, 'done' FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 300000)
""",
)
def pending_and_done(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' AND o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return (
        jn.pending(customers, done, ["c_custkey"])
        .withColumn("state", F.lit("pending"))
        .unionByName(jn.matching(customers, done, ["c_custkey"]).withColumn("state", F.lit("done")))
    )


@query(
    "factor_grid",
    """
SELECT s_suppkey, seed, allele, md5(concat_ws(':', s_suppkey, seed, allele)) AS state
FROM supplier, (VALUES (11), (12), (13)) a(seed), (VALUES ('REF'), ('ALT')) b(allele)
""",
)
def factor_grid(spark, sf_dir):
    grid = jn.factor_grid(table(spark, sf_dir, "supplier").select("s_suppkey"), {"seed": [11, 12, 13], "allele": ["REF", "ALT"]})
    return grid.withColumn("state", ex.keyed_digest(F.col("s_suppkey"), F.col("seed"), F.col("allele")))


@query(
    "stable_id_lookup",
    """
SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
""",
)
def stable_id_lookup(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        jn.checked_join(customers, nations, ["c_nationkey"])
        .transform(lambda d: jn.checked_join(d, regions, ["n_regionkey"]))
        .select("c_custkey", "n_name", "r_name")
    )


@query(
    "chained_lookup",
    """
WITH a AS (SELECT l_partkey, count(*) AS n_lines FROM lineitem GROUP BY 1),
b AS (SELECT l_partkey, round(avg(l_discount), 6) AS mean_discount FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
c AS (SELECT l_partkey, max(l_tax) AS max_tax FROM lineitem GROUP BY 1)
SELECT p_partkey AS l_partkey, n_lines, mean_discount, max_tax FROM part LEFT JOIN a ON p_partkey = a.l_partkey LEFT JOIN b ON p_partkey = b.l_partkey
LEFT JOIN c ON p_partkey = c.l_partkey
""",
)
def chained_lookup(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"))
    counts = lines.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_lines"))
    returned = lines.where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.count(F.lit(1)).alias("n_lines"))
    taxes = lines.groupBy("l_partkey").agg(F.max("l_tax").alias("max_tax"))
    return jn.chained_lookup(parts, ["l_partkey"], [(counts, ["n_lines"]), (returned, ["mean_discount", "n_lines"]), (taxes, ["max_tax"])])


HAPLOTYPE_SQL = """
g AS (SELECT user_id AS sample, event_type AS variant, max(CASE WHEN hour(ts) < 12 AND value > 20 THEN 1 ELSE 0 END) AS a0,
             max(CASE WHEN hour(ts) >= 12 AND value > 20 THEN 1 ELSE 0 END) AS a1 FROM events GROUP BY 1, 2),
m AS (SELECT g.variant, g.a0, g.a1, t.a0 AS t0, t.a1 AS t1 FROM g JOIN g t ON t.sample = g.sample AND t.variant = 'purchase'),
c AS (SELECT variant, count(*) * 2 AS n, sum(a0 + a1) AS s, sum(t0 + t1) AS t, sum(a0 * t0 + a1 * t1) AS st FROM m GROUP BY 1),
f AS (SELECT variant, n, s / n::DOUBLE AS ps, t / n::DOUBLE AS pt, st / n::DOUBLE AS pst FROM c),
cov AS (SELECT *, CASE WHEN ps > 0 AND ps < 1 THEN (pst - ps * pt) / (ps * (1 - ps)) END AS coef FROM f)
"""


def haplotype_table(spark, sf_dir):
    late = F.hour("ts") >= 12
    big = F.col("value") > 20
    alleles = F.concat_ws(
        "|", F.max(F.when(~late & big, 1).otherwise(0)).cast("string"), F.max(F.when(late & big, 1).otherwise(0)).cast("string")
    )
    calls = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("sample"), F.col("event_type").alias("variant"))
        .agg(alleles.alias("genotype"))
    )
    return asn.diploid_calls(calls, "genotype").withColumn("counted", F.lit(1))


def haplotype_stats(spark, sf_dir):
    calls = haplotype_table(spark, sf_dir)
    anchor = calls.where("variant = 'purchase'").select("sample", "alleles", "counted")
    return asn.haplotype_covariance(
        calls, anchor, ["variant"], sample="sample", alleles="alleles", counted_allele="counted", anchor_alleles="alleles", anchor_allele="counted"
    )


@query(
    "haplotype_covariance",
    f"""
WITH {HAPLOTYPE_SQL}
SELECT variant, n::BIGINT AS n_haplotypes, round(ps, 6) AS p_site, round(pt, 6) AS p_anchor, round(pst, 6) AS p_both,
       round(coef, 6) AS tagging_coefficient, round(CASE WHEN ps > 0 THEN pst / ps END, 6) AS p_anchor_given_site FROM cov
""",
)
def haplotype_covariance(spark, sf_dir):
    return rounded(haplotype_stats(spark, sf_dir))


@query(
    "tagging_model",
    f"""
WITH {HAPLOTYPE_SQL},
d AS (SELECT event_type AS variant, user_id % 7 AS gene, avg(value) AS direct FROM events GROUP BY 1, 2)
SELECT d.variant, d.gene, round(d.direct, 6) AS direct,
       round(CASE WHEN d.variant = 'purchase' THEN d.direct ELSE coalesce(d.direct + c.coef * a.direct, d.direct) END, 6) AS tagged_effect
FROM d LEFT JOIN cov c USING (variant) JOIN d a ON a.variant = 'purchase' AND a.gene = d.gene
""",
)
def tagging_model(spark, sf_dir):
    direct = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("variant"), (F.col("user_id") % 7).alias("gene")).agg(F.avg("value").alias("direct"))
    rows = direct.join(haplotype_stats(spark, sf_dir).select("variant", "tagging_coefficient"), "variant", "left")
    tagged = asn.tagging_model(rows, ["gene"], is_anchor=F.col("variant") == "purchase", direct="direct", coefficient="tagging_coefficient")
    return rounded(tagged.select("variant", "gene", "direct", "tagged_effect"))


@query(
    "matched_records",
    f"""
WITH {VARIANTS_SQL},
a AS (SELECT v.pos, v.lowering, v.raising, min(r.l_orderkey) FILTER (WHERE (r.ref = v.lowering AND r.alt = v.raising) OR (r.ref = v.raising AND r.alt = v.lowering)) AS l_orderkey
      FROM variants v LEFT JOIN records r ON r.pos = v.pos GROUP BY 1, 2, 3)
SELECT pos, l_orderkey, CASE WHEN l_orderkey IS NULL THEN 'missing_from_records' ELSE 'matched' END AS match_status FROM a
""",
)
def matched_records(spark, sf_dir):
    records = effect_records(spark, sf_dir).withColumn("alts", F.array("alt"))
    found = asn.matched_records(
        variant_table(spark, sf_dir), records, position="pos", lowering="lowering", raising="raising", ref="ref", alts="alts", order="l_orderkey"
    )
    return found.select("pos", "l_orderkey", "match_status")


CORRELATION_SQL = """
r AS (SELECT l_returnflag AS modality, l_suppkey AS element, l_quantity AS x, l_extendedprice AS y,
             rank() OVER (PARTITION BY l_returnflag, l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_suppkey, l_quantity) - 1) / 2.0 AS rx,
             rank() OVER (PARTITION BY l_returnflag, l_suppkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_suppkey, l_extendedprice) - 1) / 2.0 AS ry
      FROM lineitem),
s AS (SELECT modality, element, count(*) AS n, corr(rx, ry) AS spearman, corr(x, y) AS pearson,
             avg(CASE WHEN sign(x) = sign(y) THEN 1.0 ELSE 0.0 END) AS direction_agreement FROM r GROUP BY 1, 2)
"""


def correlations(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("modality"), F.col("l_suppkey").alias("element"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")
    )
    return asn.correlation_summary(rows, ["modality", "element"], "x", "y")


@query(
    "correlation_summary",
    f"""
WITH {CORRELATION_SQL}
SELECT modality, element, n, round(spearman, 6) AS spearman, round(pearson, 6) AS pearson, round(direction_agreement, 6) AS direction_agreement,
       round(tanh(atanh(greatest(least(spearman, 0.999999), -0.999999)) - 1.96 / sqrt(n - 3)), 6) AS spearman_low,
       round(tanh(atanh(greatest(least(spearman, 0.999999), -0.999999)) + 1.96 / sqrt(n - 3)), 6) AS spearman_high
FROM s
""",
)
def correlation_summary(spark, sf_dir):
    return rounded(correlations(spark, sf_dir))


@query(
    "random_effects",
    f"""
WITH {CORRELATION_SQL},
z AS (SELECT modality, atanh(greatest(least(spearman, 0.999999), -0.999999)) AS z, n - 3.0 AS w FROM s),
f AS (SELECT modality, count(*) AS k, sum(w) AS sw, sum(w * w) AS sw2, sum(w * z) / sum(w) AS zbar FROM z GROUP BY 1),
q AS (SELECT z.modality, f.k, f.sw, f.sw2, sum(z.w * (z.z - f.zbar) * (z.z - f.zbar)) AS q FROM z JOIN f USING (modality) GROUP BY 1, 2, 3, 4),
t AS (SELECT modality, k, q, greatest(0.0, (q - (k - 1)) / (sw - sw2 / sw)) AS tau2 FROM q),
p AS (SELECT z.modality, t.k, t.q, t.tau2, sum(z.z / (1.0 / z.w + t.tau2)) / sum(1.0 / (1.0 / z.w + t.tau2)) AS pz, sqrt(1.0 / sum(1.0 / (1.0 / z.w + t.tau2))) AS se
      FROM z JOIN t USING (modality) GROUP BY 1, 2, 3, 4)
SELECT modality, k, round(tanh(pz), 6) AS pooled, round(tanh(pz - 1.96 * se), 6) AS pooled_low, round(tanh(pz + 1.96 * se), 6) AS pooled_high,
       round(tau2, 6) AS tau2, round(q, 6) AS q, (k - 1)::BIGINT AS q_df, round(CASE WHEN q > 0 THEN greatest(0.0, (q - (k - 1)) / q) * 100 ELSE 0.0 END, 6) AS i2_percent,
       round(CASE WHEN q <= 0 OR k <= 1 THEN 1.0 ELSE
         CASE WHEN (k - 1) % 2 = 0 THEN 0.0 WHEN q > 100 THEN 0.0
              ELSE 1.0 - exp(-q / 2) * list_sum(list_transform(range(0, 200), lambda m: exp((2 * m + 1) * ln(sqrt(q / 2)) - lgamma(m + 1.5)))) END
         + coalesce(list_sum(list_transform(range(0, (k - 1) // 2), lambda m: exp((m + ((k - 1) % 2) / 2.0) * ln(q / 2) - q / 2 - lgamma(m + ((k - 1) % 2) / 2.0 + 1)))), 0.0) END, 6) AS q_p
FROM p
""",
)
def random_effects(spark, sf_dir):
    return rounded(asn.random_effects(correlations(spark, sf_dir), ["modality"], r="spearman", n="n"))


@query(
    "linear_fit",
    """
SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
       count(*) AS n FROM lineitem GROUP BY 1
""",
)
def linear_fit(spark, sf_dir):
    return rounded(asn.linear_fit(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"), 4)


@query(
    "two_regime_comparison",
    """
WITH m AS (SELECT l_partkey, CASE WHEN l_orderkey % 2 = 0 THEN 'full' ELSE 'fold' END AS regime, avg(round(l_extendedprice * 100)::BIGINT) AS effect FROM lineitem GROUP BY 1, 2),
w AS (SELECT l_partkey, max(CASE WHEN regime = 'full' THEN effect END) AS f, max(CASE WHEN regime = 'fold' THEN effect END) AS g FROM m GROUP BY 1),
c AS (SELECT f, g, rank() OVER (ORDER BY f) + (count(*) OVER (PARTITION BY f) - 1) / 2.0 AS rf, rank() OVER (ORDER BY g) + (count(*) OVER (PARTITION BY g) - 1) / 2.0 AS rg
      FROM w WHERE f IS NOT NULL AND g IS NOT NULL)
SELECT count(*) AS n, round(corr(rf, rg), 6) AS spearman, round(corr(f, g), 6) AS pearson FROM c
""",
)
def two_regime_comparison(spark, sf_dir):
    regime = F.when(F.col("l_orderkey") % 2 == 0, "full").otherwise("fold")
    means = table(spark, sf_dir, "lineitem").select("l_partkey", regime.alias("regime"), cents("l_extendedprice").alias("c")).groupBy("l_partkey", "regime").agg(F.avg("c").alias("effect"))
    wide = ag.pivot_mean(means, ["l_partkey"], "regime", ["full", "fold"], "effect")
    return rounded(asn.correlation_summary(wide, [], "full", "fold").select("n", "spearman", "pearson"))


@query(
    "track_selection_fallback",
    """
WITH t AS (SELECT user_id % 100 AS gene, event_type AS track, user_id % 3 AS context, count(*) AS n FROM events GROUP BY 1, 2, 3),
a AS (SELECT gene, bool_or(track = 'purchase' AND context = 0 AND n > 12) AS any_hit FROM t GROUP BY 1)
SELECT t.gene, t.track, t.context, t.n FROM t JOIN a USING (gene) WHERE (track = 'purchase' AND context = 0 AND n > 12) OR NOT any_hit
""",
)
def track_selection_fallback(spark, sf_dir):
    tracks = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 100).alias("gene"), F.col("event_type").alias("track"), (F.col("user_id") % 3).alias("context")).agg(F.count(F.lit(1)).alias("n"))
    wanted = (F.col("track") == "purchase") & (F.col("context") == 0) & (F.col("n") > 12)
    return readers.select_tracks(tracks, ["gene"], wanted)


@query(
    "strand_compatible_tracks",
    """
WITH g AS (SELECT s_suppkey AS gene, s_nationkey, CASE s_suppkey % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END AS gene_strand FROM supplier),
t AS (SELECT c_custkey AS track, c_nationkey, CASE c_custkey % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END AS track_strand FROM customer)
SELECT gene, count(*) AS n_tracks, sum(track)::BIGINT AS track_sum FROM g JOIN t ON s_nationkey = c_nationkey AND (gene_strand = '.' OR track_strand IN (gene_strand, '.')) GROUP BY 1
""",
)
def strand_compatible_tracks(spark, sf_dir):
    def strand(key):
        return F.when(F.col(key) % 3 == 0, "+").when(F.col(key) % 3 == 1, "-").otherwise(".")

    genes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("gene"), F.col("s_nationkey").alias("nation"), strand("s_suppkey").alias("gene_strand"))
    tracks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("track"), F.col("c_nationkey").alias("nation"), strand("c_custkey").alias("track_strand"))
    # tracks are counted per (nation, strand) first: a gene then meets at most three rows
    counted = tracks.groupBy("nation", "track_strand").agg(F.count(F.lit(1)).alias("_n"), F.sum("track").alias("_s"))
    pairs = genes.join(counted, "nation").where(readers.strand_compatible("gene_strand", "track_strand"))
    return pairs.groupBy("gene").agg(F.sum("_n").alias("n_tracks"), F.sum("_s").alias("track_sum"))


@query(
    "construct_axis_rewrite",
    """
WITH v AS (SELECT p_partkey, substr('ACGT', (p_size % 4 + 1)::INTEGER, 1) AS ref, substr('ACGT', ((p_size + 1 + p_partkey % 3) % 4 + 1)::INTEGER, 1) AS alt FROM part),
c AS (SELECT *, CASE WHEN p_partkey % 100 = 7 THEN 'T' ELSE ref END AS cref, CASE WHEN p_partkey % 100 = 7 AND alt = 'T' THEN 'G' ELSE alt END AS calt FROM v)
SELECT p_partkey, p_partkey::VARCHAR || ':' || ref || '>' || alt AS genome_label, p_partkey::VARCHAR || ':' || cref || '>' || calt AS construct_label,
       cref <> calt AS is_substitution FROM c
""",
)
def construct_axis_rewrite(spark, sf_dir):
    v = table(spark, sf_dir, "part").select(
        "p_partkey", pick_base(F.col("p_size")).alias("ref"), pick_base(F.col("p_size") + 1 + F.col("p_partkey") % 3).alias("alt")
    )
    at = F.col("p_partkey") % 100 == 7
    c = v.withColumn("cref", F.when(at, "T").otherwise(F.col("ref"))).withColumn("calt", F.when(at & (F.col("alt") == "T"), "G").otherwise(F.col("alt")))
    return c.select(
        "p_partkey",
        sq.variant_label("p_partkey", "ref", "alt").alias("genome_label"),
        sq.variant_label("p_partkey", "cref", "calt").alias("construct_label"),
        sq.is_substitution("cref", "calt").alias("is_substitution"),
    )


@query(
    "absolute_rank_gate",
    """
WITH m AS (SELECT l_returnflag, l_suppkey, avg(round(l_extendedprice * 100)::BIGINT) - 4950000 AS e FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY abs(e) DESC) AS rk, count(*) OVER (PARTITION BY l_returnflag) AS n FROM m)
SELECT l_returnflag, rk AS target_rank, n, rk <= 50 AS passed FROM r WHERE l_suppkey = 7
""",
)
def absolute_rank_gate(spark, sf_dir):
    from ..operators import quality

    means = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey", cents("l_extendedprice").alias("c")).groupBy("l_returnflag", "l_suppkey").agg((F.avg("c") - 4950000).alias("e"))
    return quality.rank_gate(means, ["l_returnflag"], value="e", target=F.col("l_suppkey") == 7, worst_rank=50)


@query(
    "absolute_rank",
    """
WITH m AS (SELECT l_returnflag, l_suppkey, avg(round(l_extendedprice * 100)::BIGINT) - 4950000 AS e FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_suppkey, rank() OVER (PARTITION BY l_returnflag ORDER BY abs(e) DESC) AS absolute_rank FROM m
""",
)
def absolute_rank(spark, sf_dir):
    means = (
        table(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey", cents("l_extendedprice").alias("c")).groupBy("l_returnflag", "l_suppkey").agg(F.abs(F.avg("c") - 4950000).alias("e"))
    )
    return rk.attach_ranks(means, ["l_returnflag"], "e", {"absolute_rank": rk.min_rank_descending()}).select("l_returnflag", "l_suppkey", "absolute_rank")
