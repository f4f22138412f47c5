"""Comparison, validation, source and sink queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..functions import sequences as sq
from ..operators import quality as qc
from ..session import fresh_folder
from ..sources import readers, writers
from .registry import cents, query, rounded, table

PAIR_SQL = """
g AS (SELECT l_suppkey, l_returnflag, avg(round(l_discount * 100)::BIGINT) AS d, CASE WHEN l_suppkey % 17 = 3 THEN NULL ELSE avg(round(l_tax * 100)::BIGINT) END AS t FROM lineitem GROUP BY 1, 2),
r AS (SELECT l_suppkey, l_returnflag, avg(round(l_discount * 100)::BIGINT) + CASE WHEN l_linestatus_o > 0 THEN 1e-7 ELSE 0 END AS d, CASE WHEN l_suppkey % 17 = 3 THEN NULL ELSE avg(round(l_tax * 100)::BIGINT) * (1 + (l_suppkey % 5) / 10.0) END AS t
      FROM (SELECT *, count(*) FILTER (WHERE l_linestatus = 'O') OVER (PARTITION BY l_suppkey) AS l_linestatus_o FROM lineitem WHERE l_suppkey % 29 <> 11) GROUP BY l_suppkey, l_returnflag, l_linestatus_o),
j AS (SELECT coalesce(g.l_suppkey, r.l_suppkey) AS k, g.d AS dg, r.d AS dr, g.t AS tg, r.t AS tr, g.l_suppkey IS NOT NULL AS ig, r.l_suppkey IS NOT NULL AS ir FROM g FULL OUTER JOIN r ON g.l_suppkey = r.l_suppkey AND g.l_returnflag = r.l_returnflag),
b AS (SELECT * FROM j WHERE ig AND ir)
"""


def generated_pair(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", cents("l_discount").alias("d"), cents("l_tax").alias("t"))
    k = F.col("l_suppkey")
    means = lines.groupBy("l_suppkey", "l_returnflag").agg(F.avg("d").alias("d"), F.avg("t").alias("t"))
    generated = means.withColumn("t", F.when(k % 17 != 3, F.col("t")))
    any_open = lines.groupBy("l_suppkey").agg(F.count(F.when(F.col("l_linestatus") == "O", 1)).alias("_o"))
    expected = (
        generated.where(k % 29 != 11)
        .join(any_open, "l_suppkey")
        .withColumn("d", F.col("d") + F.when(F.col("_o") > 0, 1e-7).otherwise(0.0))
        .withColumn("t", F.col("t") * (1 + (k % 5) / 10.0))
        .drop("_o")
    )
    return generated, expected


@query(
    "compare_tables",
    f"""
WITH {PAIR_SQL}
SELECT 'd' AS "column", count(dg) AS n, round(max(abs(dg - dr)), 6) AS max_abs_difference, round(corr(dg, dr), 6) AS pearson_r,
       bool_and(abs(dg - dr) <= 1e-6 + 1e-5 * abs(dr)) AND corr(dg, dr) >= 0.99 AS passed FROM b
UNION ALL
SELECT 't', count(*) FILTER (WHERE tg IS NOT NULL AND tr IS NOT NULL), round(max(abs(tg - tr)), 6), round(corr(tg, tr), 6),
       bool_and(coalesce(abs(tg - tr) <= 0.1 + 0.05 * abs(tr), false) OR (tg IS NULL AND tr IS NULL)) FROM b
UNION ALL
SELECT 'rows', count(*) FILTER (WHERE ig AND ir), NULL, NULL, count(*) FILTER (WHERE NOT (ig AND ir)) = 0 FROM j
""",
)
def compare_tables(spark, sf_dir):
    generated, expected = generated_pair(spark, sf_dir)
    specs = [qc.Tolerance("d", min_r=0.99), qc.Tolerance("t", rtol=0.05, atol=0.1)]
    return rounded(qc.compare_tables(generated, expected, ["l_suppkey", "l_returnflag"], specs))


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "compare_matrices",
    """
WITH g AS (SELECT user_id, event_type AS c, avg(value) AS v FROM events GROUP BY 1, 2),
m AS (SELECT v, v * 1.25 + 0.5 AS moved FROM g)
SELECT 'v' AS "column", count(*) AS n, round(max(abs(v - moved)), 6) AS max_abs_difference, round(corr(v, moved), 6) AS pearson_r,
       max(abs(v - moved)) <= 20 AND corr(v, moved) >= 0.99 AS passed FROM m
UNION ALL SELECT 'rows', count(*), NULL, NULL, true FROM g
""",
)
def compare_matrices(spark, sf_dir):
    """A wide matrix against a stretched and shifted copy of it, within an absolute tolerance."""
    means = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    wide = writers.labelled_matrix(means, "user_id", "event_type", "v", EVENT_TYPES)
    moved = wide.select("user_id", *[(F.col(c) * 1.25 + 0.5).alias(c) for c in EVENT_TYPES])
    return rounded(qc.compare_matrices(wide, moved, "user_id", EVENT_TYPES, qc.Tolerance("v", rtol=0.0, atol=20.0, min_r=0.99)))


@query(
    "set_overlap_gate",
    """
WITH g AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_discount > 0.01), e AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_discount > 0.02),
s AS (SELECT g.l_partkey AS a, e.l_partkey AS b FROM g FULL OUTER JOIN e ON g.l_partkey = e.l_partkey AND g.l_suppkey = e.l_suppkey)
SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS n_shared, count(*) FILTER (WHERE b IS NULL) AS n_generated_only, count(*) FILTER (WHERE a IS NULL) AS n_expected_only, count(b) AS n_expected,
       round(count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) / count(b)::DOUBLE, 6) AS overlap, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) / count(b)::DOUBLE >= 0.9 AS passed FROM s
""",
)
def set_overlap_gate(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return rounded(qc.set_overlap_gate(lines.where("l_discount > 0.01"), lines.where("l_discount > 0.02"), ["l_partkey", "l_suppkey"], 0.9))


MANIFEST_SQL = """
m AS (SELECT 'doc/' || doc_id::VARCHAR AS path, CASE WHEN doc_id % 13 = 0 THEN repeat('0', 64) ELSE sha256(text) END AS recorded FROM documents WHERE doc_id % 11 <> 0),
f AS (SELECT 'doc/' || doc_id::VARCHAR AS path, sha256(text) AS actual, octet_length(encode(text))::BIGINT AS bytes FROM documents WHERE doc_id % 7 <> 0),
s AS (SELECT coalesce(m.path, f.path) AS path, recorded, actual, CASE WHEN actual IS NULL THEN 'missing' WHEN recorded IS NULL THEN 'unrecorded' WHEN actual <> recorded THEN 'checksum_mismatch' ELSE 'ok' END AS state
      FROM m FULL OUTER JOIN f ON m.path = f.path)
"""


def manifest_sides(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").cast("bigint").alias("bytes"), sq.content_hash("text").alias("sha256")
    )
    recorded = docs.where("doc_id % 11 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 13 == 0, F.repeat(F.lit("0"), F.lit(64))).otherwise(F.col("sha256")))
    return recorded, docs.where("doc_id % 7 <> 0")


@query("manifest_reconciliation", f"WITH {MANIFEST_SQL} SELECT * FROM s")
def manifest_reconciliation(spark, sf_dir):
    return qc.reconcile_manifest(*manifest_sides(spark, sf_dir))


@query(
    "size_reconciliation",
    f"""
WITH {MANIFEST_SQL} SELECT count(*) AS n_files, sum(bytes)::BIGINT AS total_bytes, count(*) FILTER (WHERE NOT regexp_full_match(actual, '[0-9a-f]{{64}}')) AS bad_digests,
  count(*) FILTER (WHERE NOT regexp_full_match(actual, '[0-9a-f]{{64}}')) = 0 AS passed FROM f
""",
)
def size_reconciliation(spark, sf_dir):
    return qc.size_reconciliation(manifest_sides(spark, sf_dir)[1], size="bytes", digest="sha256")


RULES_SQL = """
v AS (
  SELECT 'documents' AS "table", doc_id::VARCHAR AS key, 'language' AS rule, 'error' AS severity, 'language outside the vocabulary' AS message FROM documents WHERE lang NOT IN ('en', 'fr', 'de')
  UNION ALL SELECT 'documents', doc_id::VARCHAR, 'short', 'warn', 'text is short' FROM documents WHERE n_chars < 60
  UNION ALL SELECT 'documents', doc_id::VARCHAR, 'placeholder', 'error', 'text starts with a placeholder' FROM documents WHERE starts_with(text, 'The') OR starts_with(text, 'Der')
  UNION ALL SELECT 'documents', doc_id::VARCHAR, 'blank_source', 'error', 'source is blank' FROM documents WHERE trim(coalesce(source, '')) = ''
  UNION ALL SELECT 'documents', doc_id::VARCHAR, 'tokens', 'warn', 'unknown token' FROM documents WHERE lang || ';' || source NOT IN ('en;src0', 'fr;src0', 'de;src0', 'es;src0')
  UNION ALL SELECT 'conversations', conv_id::VARCHAR, 'duplicate_key', 'error', 'key occurs more than once' FROM conversations GROUP BY conv_id HAVING count(*) > 1)
"""


def violations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("tokens", F.concat_ws(";", "lang", "source"))
    rules = [
        qc.Rule("language", qc.not_in_vocabulary("lang", ["en", "fr", "de"]), "language outside the vocabulary"),
        qc.Rule("short", F.col("n_chars") < 60, "text is short", "warn"),
        qc.Rule("placeholder", qc.is_placeholder("text", ["The", "Der"]), "text starts with a placeholder"),
        qc.Rule("blank_source", qc.blank("source"), "source is blank"),
        qc.Rule("tokens", qc.unknown_tokens("tokens", ["en", "fr", "de", "es", "src0"]), "unknown token", "warn"),
    ]
    repeated = qc.duplicate_keys(table(spark, sf_dir, "conversations"), ["conv_id"], table="conversations")
    return qc.row_violations(docs, rules, table="documents", key="doc_id").unionByName(repeated)


@query("row_rules", f"WITH {RULES_SQL} SELECT * FROM v")
def row_rules(spark, sf_dir):
    return violations(spark, sf_dir)


@query("violation_summary", f"WITH {RULES_SQL} SELECT severity, count(*) AS n, count(DISTINCT key) AS n_keys FROM v GROUP BY 1")
def violation_summary(spark, sf_dir):
    return qc.violation_summary(violations(spark, sf_dir))


@query(
    "marker_scan",
    """
SELECT page_id, marker FROM pages, (VALUES ('<script>'), ('track('), ('ad 0'), ('nowhere to be found')) m(marker) WHERE contains(html, marker)
""",
)
def marker_scan(spark, sf_dir):
    return qc.marker_scan(table(spark, sf_dir, "pages"), key="page_id", text="html", markers=["<script>", "track(", "ad 0", "nowhere to be found"])


@query(
    "overall_verdict",
    f"""
WITH {PAIR_SQL}, c AS (
SELECT bool_and(abs(dg - dr) <= 1e-6 + 1e-5 * abs(dr)) AS passed FROM b
UNION ALL SELECT bool_and(coalesce(abs(tg - tr) <= 0.1 + 0.05 * abs(tr), false) OR (tg IS NULL AND tr IS NULL)) FROM b
UNION ALL SELECT count(*) FILTER (WHERE NOT (ig AND ir)) = 0 FROM j)
SELECT bool_and(passed) AS passed, count(*) AS n_checks, count(*) FILTER (WHERE NOT passed) AS n_failed FROM c
""",
)
def overall_verdict(spark, sf_dir):
    generated, expected = generated_pair(spark, sf_dir)
    specs = [qc.Tolerance("d"), qc.Tolerance("t", rtol=0.05, atol=0.1)]
    return qc.overall_pass(qc.compare_tables(generated, expected, ["l_suppkey", "l_returnflag"], specs))


# --- sources and sinks --------------------------------------------------------------------------------------


@query(
    "association_scan",
    """
SELECT 'chr' || l_returnflag AS chrom, l_partkey AS pos, 'rs' || l_orderkey::VARCHAR AS rsid, 'A' AS effect_allele, 'G' AS other_allele, round(l_discount - 0.05, 6) AS beta, l_tax AS se, l_quantity AS p
FROM lineitem WHERE l_returnflag = 'N' AND l_partkey BETWEEN 100 AND 900
""",
)
def association_scan(spark, sf_dir):
    """Write an association table as text and scan one region of it."""
    path = fresh_folder(spark, "association")
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("chr"), "l_returnflag", F.lit(":"), F.col("l_partkey").cast("string")).alias("SNP_hg19"), F.concat(F.lit("rs"), F.col("l_orderkey").cast("string")).alias("rsid"),
        F.lit("a").alias("A1"), F.lit("g").alias("A2"), F.round(F.col("l_discount") - 0.05, 6).alias("beta"), F.col("l_tax").alias("se"), F.col("l_quantity").alias("P-value"),
    )
    writers.write_delimited(lines, path, digits=12)
    return rounded(readers.association_table(spark, path, chrom="chrN", low=100, high=900))


@query(
    "packed_effect_scan",
    """
WITH w AS (SELECT DISTINCT 'g' || (l_suppkey % 10)::VARCHAR AS gene_id, l_partkey AS pos FROM lineitem WHERE l_linenumber = 7)
SELECT 'g' || (l.l_suppkey % 10)::VARCHAR AS gene_id, '1' AS chrom, l.l_partkey AS pos, 'A' AS ref, l.l_returnflag AS alt, l.l_discount AS slope, l.l_tax AS se, l.l_quantity AS p
FROM lineitem l WHERE EXISTS (SELECT 1 FROM w WHERE w.gene_id = 'g' || (l.l_suppkey % 10)::VARCHAR AND w.pos = l.l_partkey)
""",
)
def packed_effect_scan(spark, sf_dir):
    path = fresh_folder(spark, "effects")
    gene = F.concat(F.lit("g"), (F.col("l_suppkey") % 10).cast("string"))
    lines = table(spark, sf_dir, "lineitem")
    packed = lines.select(
        gene.alias("gene_id"), F.concat_ws("_", F.lit("1"), F.col("l_partkey").cast("string"), F.lit("A"), "l_returnflag", F.lit("b37")).alias("variant_id"),
        F.col("l_discount").alias("slope"), F.col("l_tax").alias("slope_se"), F.col("l_quantity").alias("pval_nominal"),
    )
    packed.write.option("compression", "gzip").csv(path, sep="\t", header=True)
    wanted = lines.where("l_linenumber = 7").select(gene.alias("gene_id"), F.col("l_partkey").alias("pos")).distinct()
    return readers.eqtl_pairs(spark, path, wanted)


@query(
    "element_scan",
    """
SELECT 'E' || l_returnflag AS "Element", '1' AS chrom, l_partkey AS pos, 'A' AS ref, substr('CGT', (l_suppkey % 3 + 1)::INTEGER, 1) AS alt, round(l_discount * 3 - 0.2, 2) AS effect, l_tax AS p, l_quantity::BIGINT AS tags, l_suppkey AS dna, l_linenumber::BIGINT AS rna
FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_suppkey % 4 <> 3 AND l_linestatus = 'O'
""",
)
def element_scan(spark, sf_dir):
    path = fresh_folder(spark, "elements")
    k = F.col("l_suppkey")
    lines = table(spark, sf_dir, "lineitem").select(
        F.lit("1.0").alias("Chrom"), F.col("l_partkey").cast("string").alias("Pos"), F.lit("a").alias("Ref"), F.when(k % 4 == 3, "-").otherwise(F.substring(F.lit("CGT"), (k % 3 + 1).cast("int"), F.lit(1))).alias("Alt"),
        F.concat(F.lit("E"), "l_returnflag").alias("Element"), F.when(F.col("l_linestatus") == "O", "GRCh38").otherwise("GRCh37").alias("Release"), F.col("l_quantity").cast("string").alias("Barcodes"),
        k.cast("string").alias("DNA"), F.col("l_linenumber").cast("string").alias("RNA"), (F.col("l_discount") * 3 - 0.2).cast("string").alias("Coefficient"), F.col("l_tax").cast("string").alias("pValue"),
    )
    lines.write.csv(path, sep="\t", header=True)
    return readers.mpra_elements(spark, path, release="GRCh38", elements=["EA", "ER"])


@query(
    "peak_effect_scan",
    """
SELECT 'chr' || l_returnflag AS chrom, l_partkey AS pos, 'A' AS ref, 'T' AS alt, 'peak' || l_suppkey::VARCHAR AS peak, l_discount AS beta, l_tax AS varbeta, l_quantity AS pvalue FROM lineitem
""",
)
def peak_effect_scan(spark, sf_dir):
    path = fresh_folder(spark, "peaks")
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("chr"), "l_returnflag", F.lit(":"), F.col("l_partkey").cast("string"), F.lit(":A:T")).alias("variant"), F.concat(F.lit("peak"), F.col("l_suppkey").cast("string")).alias("peak"),
        F.col("l_discount").alias("beta"), F.col("l_tax").alias("varbeta"), F.col("l_quantity").alias("pvalue"),
    )
    lines.write.csv(path, sep="\t", header=True)
    return readers.caqtl_table(spark, path)


@query(
    "annotation_scan",
    """
SELECT p_brand AS chrom, count(*) AS n_genes, min((p_partkey * 977) % 100000)::BIGINT AS first_start, count(*) FILTER (WHERE p_type = 'ECONOMY') AS n_coding FROM part WHERE p_size > 10 GROUP BY 1
""",
)
def annotation_scan(spark, sf_dir):
    path = fresh_folder(spark, "annotation")
    k = F.col("p_partkey")
    table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("Chromosome"), F.when(F.col("p_size") > 10, "gene").otherwise("exon").alias("Feature"), ((k * 977) % 100000).alias("Start"), ((k * 977) % 100000 + 50).alias("End"),
        F.lit("+").alias("Strand"), F.col("p_name").alias("gene_name"), F.concat(F.lit("G"), k.cast("string"), F.lit(".2")).alias("gene_id"), F.col("p_type").alias("gene_type"),
        F.lit("t").alias("transcript_id"), F.lit("x").alias("transcript_type"),
    ).write.parquet(path)
    genes = readers.annotation(spark, path, feature="gene")
    return genes.groupBy("chrom").agg(F.count(F.lit(1)).alias("n_genes"), F.min("start").alias("first_start"), F.count(F.when(F.col("gene_type") == "ECONOMY", 1)).alias("n_coding"))


@query(
    "genotype_records",
    """
SELECT user_id AS pos, 'rs' || user_id::VARCHAR AS id, 'G' AS ref, event_type AS sample, CASE WHEN count(*) > 12 THEN '0|1' WHEN count(*) > 8 THEN '1|1' ELSE '.|0' END AS genotype FROM events GROUP BY user_id, event_type
""",
)
def genotype_records(spark, sf_dir):
    """One text line per variant with SAMPLE=CALL fields, parsed into long records."""
    n = F.col("n")
    call = F.when(n > 12, "0|1").when(n > 8, "1|1").otherwise(".|0")
    counted = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    fields = counted.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat("event_type", F.lit("="), call))), "\t").alias("calls"))
    key = F.col("user_id").cast("string")
    lines = fields.select(F.concat_ws("\t", key, F.concat(F.lit("rs"), key), F.lit("G"), F.lit("T,A"), "calls").alias("value"))
    return readers.genotype_calls(lines).select("pos", "id", "ref", "sample", "genotype")


@query(
    "repair_outcomes",
    """
WITH e AS (SELECT l_returnflag AS experiment, floor(l_extendedprice)::BIGINT AS reads, l_partkey AS position, '*/' || CASE WHEN l_linestatus = 'O' THEN '-' ELSE '+' END || substr('ACGTACGTACGT', 1, l_linenumber) AS cons, l_orderkey, l_suppkey
           FROM lineitem WHERE l_linenumber < 6),
r AS (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY reads DESC, position, cons) AS k, sum(reads) OVER (PARTITION BY experiment) AS tot FROM e)
SELECT experiment, k AS rank_in_experiment, position, reads, CASE WHEN cons LIKE '*/-%' THEN 'deletion' ELSE 'insertion' END AS operation, substr(cons, 4) AS event_sequence, (length(cons) - 3)::INTEGER AS event_length, round(reads / tot, 10) AS share,
       experiment || '_rank' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END || '_' || position::VARCHAR || '_' || replace(substr(cons, 3), '+', '_') AS edit_id
FROM r
""",
)
def repair_outcomes(spark, sf_dir):
    k = F.col("l_linenumber")
    sheet = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("experiment"), F.floor("l_extendedprice").cast("bigint").cast("string").alias("Reads"), F.col("l_partkey").cast("string").alias("Position (hg18)"),
        F.when(k < 6, F.concat(F.lit("*/"), F.when(F.col("l_linestatus") == "O", "-").otherwise("+"), F.substring(F.lit("ACGTACGTACGT"), F.lit(1), k))).otherwise("A/G").alias("Cons"),
    )
    out = readers.repair_outcomes(sheet, experiment="experiment")
    return rounded(
        out.select("experiment", "rank_in_experiment", "position", "reads", "operation", "event_sequence", "event_length", "share", "edit_id"), 10
    )


@query(
    "expression_scan",
    """
WITH r AS (SELECT 'G' || (c_custkey % 700)::VARCHAR AS gene_id_base, upper(c_name) AS gene_name, c_acctbal AS value FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0)
SELECT gene_id_base, gene_name, value FROM (SELECT *, row_number() OVER (PARTITION BY gene_id_base ORDER BY gene_name, value) AS rn FROM r) WHERE rn = 1
""",
)
def expression_scan(spark, sf_dir):
    path = fresh_folder(spark, "expression")
    table(spark, sf_dir, "customer").select(
        F.concat(F.lit("G"), (F.col("c_custkey") % 700).cast("string"), F.lit(".3")).alias("Gene"), F.col("c_name").alias("Gene name"), F.initcap("c_mktsegment").alias("Tissue"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("string")).otherwise("n/a").alias("nTPM"),
    ).write.csv(path, sep="\t", header=True)
    return readers.tissue_expression(spark, path, tissue="building")


@query(
    "lifted_positions",
    """
WITH b AS (SELECT s_suppkey AS chain_id, s_suppkey % 7 * 10 AS score, 'c' || (s_nationkey % 3)::VARCHAR AS chrom, (s_suppkey * 131) % 5000 AS s, (s_suppkey * 131) % 5000 + 900 AS e, (s_suppkey * 17) % 3000 AS t, CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM supplier),
v AS (SELECT p_partkey, 'c' || (p_size % 3)::VARCHAR AS chrom, (p_partkey * 29) % 6000 + 1 AS pos FROM part),
m AS (SELECT v.*, b.strand, CASE WHEN b.strand = '-' THEN 9000 - (b.t + pos - 1 - b.s) ELSE b.t + pos - b.s END AS lifted, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, chain_id) AS rn FROM v JOIN b ON b.chrom = v.chrom AND pos - 1 >= b.s AND pos - 1 < b.e)
SELECT v.p_partkey, v.pos, m.lifted AS lifted_pos, m.strand AS lifted_strand FROM v LEFT JOIN m ON m.p_partkey = v.p_partkey AND m.rn = 1
""",
)
def lifted_positions(spark, sf_dir):
    k = F.col("s_suppkey")
    blocks = table(spark, sf_dir, "supplier").select(
        k.alias("chain_id"), (k % 7 * 10).alias("score"), F.concat(F.lit("c"), (F.col("s_nationkey") % 3).cast("string")).alias("source_chrom"), ((k * 131) % 5000).alias("source_start"),
        ((k * 131) % 5000 + 900).alias("source_end"), F.lit("t").alias("target_chrom"), ((k * 17) % 3000).alias("target_start"), F.when(k % 2 == 0, "+").otherwise("-").alias("target_strand"), F.lit(9000).cast("bigint").alias("target_size"),
    )
    variants = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit("c"), (F.col("p_size") % 3).cast("string")).alias("chrom"), ((F.col("p_partkey") * 29) % 6000 + 1).alias("pos")
    )
    out = readers.lift_positions(variants, blocks, chrom="chrom", pos="pos", key=["p_partkey"], bin_width=512)
    return out.select("p_partkey", "pos", "lifted_pos", "lifted_strand")


@query(
    "contact_range_scan",
    """
WITH r AS (SELECT l_returnflag AS ctx, l_partkey % 40 AS bin_x, l_partkey % 40 + l_suppkey % 20 AS bin_y, count(*)::DOUBLE AS value FROM lineitem GROUP BY 1, 2, 3),
i AS (SELECT * FROM r WHERE bin_x BETWEEN 5 AND 30 AND bin_y BETWEEN 5 AND 30)
SELECT * FROM i UNION ALL SELECT ctx, bin_y, bin_x, value FROM i WHERE bin_x <> bin_y
""",
)
def contact_range_scan(spark, sf_dir):
    x = F.col("l_partkey") % 40
    records = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("ctx"), x.alias("bin_x"), (x + F.col("l_suppkey") % 20).alias("bin_y")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return readers.contact_records(records, ["ctx"], low=5, high=30)


@query(
    "sequence_tiles",
    """
WITH n AS (SELECT doc_id, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS s FROM documents),
t AS (SELECT doc_id, unnest(range(0, length(s), 64)) AS tile_start, s FROM n WHERE length(s) > 0)
SELECT doc_id::VARCHAR AS chrom, tile_start, substr(s, tile_start + 1, 64) AS sequence FROM t
""",
)
def sequence_tiles(spark, sf_dir):
    """Lines of 50 letters per sequence re-cut into tiles of 64."""
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = texts.select(F.col("doc_id").cast("string").alias("chrom"), letters.alias("s"))
    starts = F.when(F.length("s") > 0, F.sequence(F.lit(0), F.length("s") - 1, F.lit(50)))
    lines = docs.withColumn("line_start", F.explode(starts)).select("chrom", F.col("line_start").cast("bigint").alias("line_start"), F.substring(F.col("s"), F.col("line_start") + 1, F.lit(50)).alias("text"))
    return readers.fasta_tiles(lines, tile=64)


@query(
    "strict_track_selection",
    """
SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2
""",
)
def strict_track_selection(spark, sf_dir):
    tracks = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return readers.strict_tracks(tracks, ["user_id"], F.col("event_type").isin("click", "view"), 2)


@query(
    "recovered_scores",
    """
WITH d AS (SELECT doc_id, sha256(text) AS state FROM documents), s AS (SELECT DISTINCT sha256(text) AS state, length(text)::BIGINT AS n_chars FROM documents WHERE doc_id % 3 = 0)
SELECT d.doc_id, d.state, s.n_chars FROM d LEFT JOIN s USING (state)
""",
)
def recovered_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", sq.content_hash("text").alias("state"), F.length("text").cast("bigint").alias("n_chars"))
    return readers.recover_scores(docs.select("doc_id", "state"), docs.where("doc_id % 3 = 0").select("state", "n_chars"), key="state")


@query(
    "checkpoint_keep_last",
    """
WITH m AS (SELECT user_id, event_type, round(avg(value), 6) AS value FROM events GROUP BY 1, 2)
SELECT user_id, arg_max(value, event_type) AS value FROM m GROUP BY 1
""",
)
def checkpoint_keep_last(spark, sf_dir):
    """One append for each event type, in order, under the same keys; the last one wins."""
    path = fresh_folder(spark, "checkpoint")
    means = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("value"))
    for kind in EVENT_TYPES:
        writers.append_checkpoint(means.where(F.col("event_type") == kind).select("user_id", "value"), path)
    return writers.keep_last(spark.read.parquet(path), ["user_id"]).select("user_id", "value")


@query(
    "chunked_rewrite",
    """
SELECT o_orderstatus AS chunk, count(*) AS n, (CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END)::INTEGER AS version FROM orders GROUP BY 1
""",
)
def chunked_rewrite(spark, sf_dir):
    """Rewriting one chunk leaves the others as they were."""
    path = fresh_folder(spark, "chunks")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("chunk"))
    writers.write_chunks(orders.withColumn("version", F.lit(1)), path, "chunk")
    writers.write_chunks(orders.where("chunk = 'P'").withColumn("version", F.lit(2)), path, "chunk")
    stored = spark.read.parquet(path)
    return stored.groupBy(F.col("chunk").cast("string").alias("chunk"), "version").agg(F.count(F.lit(1)).alias("n"))


@query(
    "summary_roundtrip",
    """
SELECT l_returnflag, count(*) AS n, min(l_linenumber) AS lowest, max(l_linenumber) AS highest FROM lineitem GROUP BY 1
""",
)
def summary_roundtrip(spark, sf_dir):
    """Nested JSON summary written and parsed back."""
    path = fresh_folder(spark, "summary")
    summary = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.struct(F.min("l_linenumber").alias("low"), F.max("l_linenumber").alias("high")).alias("lines")
    )
    writers.write_summary(summary, path)
    read = spark.read.schema("l_returnflag string, n bigint, lines struct<low:int,high:int>").json(path)
    return read.select("l_returnflag", "n", F.col("lines.low").alias("lowest"), F.col("lines.high").alias("highest"))


@query(
    "labelled_matrix",
    """
SELECT user_id, nullif(count(*) FILTER (WHERE event_type = 'click'), 0)::BIGINT AS click, nullif(count(*) FILTER (WHERE event_type = 'error'), 0)::BIGINT AS error,
       nullif(count(*) FILTER (WHERE event_type = 'purchase'), 0)::BIGINT AS purchase, nullif(count(*) FILTER (WHERE event_type = 'signup'), 0)::BIGINT AS signup,
       nullif(count(*) FILTER (WHERE event_type = 'view'), 0)::BIGINT AS "view"
FROM events GROUP BY 1
""",
)
def labelled_matrix(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return writers.labelled_matrix(counts, "user_id", "event_type", "n", EVENT_TYPES)


@query(
    "general_float_text",
    """
SELECT c_custkey, printf('%.10g', c_acctbal * 1e-7) AS small, printf('%.10g', c_acctbal * 1e7 / 3) AS large, printf('%.10g', c_acctbal) AS plain FROM customer
""",
)
def general_float_text(spark, sf_dir):
    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", ex.format_general(b * 1e-7).alias("small"), ex.format_general(b * 1e7 / 3).alias("large"), ex.format_general(b).alias("plain")
    )


@query("file_manifest")
def file_manifest(spark, sf_dir):
    """Bytes and digest of every input file."""
    return readers.file_manifest(spark, sf_dir, pattern="*.parquet").select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "bytes", "sha256")


@query(
    "heterogeneous_union",
    """
SELECT 'customer' AS origin, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, NULL::INTEGER AS size FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL, NULL FROM supplier UNION ALL SELECT 'part', p_partkey, NULL, NULL, p_size FROM part
""",
)
def heterogeneous_union(spark, sf_dir):
    frames = [
        table(spark, sf_dir, "customer").select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")),
        table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")),
        table(spark, sf_dir, "part").select(F.lit("part").alias("origin"), F.col("p_partkey").alias("id"), F.col("p_size").alias("size")),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


@query("distinct_by_key", "SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem")
def distinct_by_key(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag").dropDuplicates(["l_partkey", "l_suppkey", "l_returnflag"])
