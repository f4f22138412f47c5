"""Motif queries. Count matrices come from the texts themselves: base by (text position mod 8) per language."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..operators import design as ds
from ..operators import motifs as mt
from ..operators import ranking as rk
from ..session import staged
from ..sources import readers
from .designs import NUC_SQL, designed, long_sequences, nuc_sql, nucleotides
from .registry import query, rounded, table

LENGTH, TILE = 8, 1024

PFM_SQL = f"""
b AS (SELECT d.lang, unnest(range(0, length(seq))) % {LENGTH} AS o, unnest(string_split(seq, '')) AS base FROM nuc JOIN documents d USING (doc_id) WHERE length(seq) > 0),
cnt AS (SELECT lang AS matrix_id, o, base, count(*) AS c FROM b GROUP BY 1, 2, 3),
tot AS (SELECT matrix_id, o, sum(c + 0.5) AS t FROM cnt GROUP BY 1, 2),
w AS (SELECT c.matrix_id, c.o, c.base, log2((c.c + 0.5) / t.t / 0.25) AS lo FROM cnt c JOIN tot t USING (matrix_id, o)),
rng AS (SELECT matrix_id, sum(lo) AS lowest, sum(hi) AS highest FROM (SELECT matrix_id, o, min(lo) AS lo, max(lo) AS hi FROM w GROUP BY 1, 2) GROUP BY 1),
pk AS (SELECT matrix_id, list(lo ORDER BY o, base) AS ws FROM w GROUP BY 1)
"""


def count_matrices(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("lang").alias("matrix_id"), F.explode(F.array(sq.as_nucleotides("text"))).alias("seq"))
    letters = texts.select("matrix_id", F.posexplode(F.split("seq", "")).alias("p", "base"))
    counted = (
        letters.where(sq.is_single_base("base"))
        .groupBy("matrix_id", (F.col("p") % LENGTH).alias("offset"), "base")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return staged(counted, "counts")  # a few rows that several branches read


def weight_table(spark, sf_dir):
    return mt.log_odds(count_matrices(spark, sf_dir), matrix="matrix_id", offset="offset", base="base", count="count")


def packed(spark, sf_dir):
    return mt.pack_matrices(weight_table(spark, sf_dir), matrix="matrix_id", offset="offset", base="base")


@query(
    "log_odds_matrices",
    f"WITH {NUC_SQL}, {PFM_SQL} SELECT matrix_id, o::INTEGER AS \"offset\", base, round(lo, 6) AS log_odds FROM w",
)
def log_odds_matrices(spark, sf_dir):
    return rounded(weight_table(spark, sf_dir))


@query(
    "count_matrix_records",
    f"WITH {NUC_SQL}, {PFM_SQL} SELECT matrix_id, matrix_id || ' motif' AS name, o::INTEGER AS \"offset\", base, c AS count FROM cnt",
)
def count_matrix_records(spark, sf_dir):
    """Render the matrices as text records and parse them back."""
    per_base = count_matrices(spark, sf_dir).groupBy("matrix_id", "base").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "count"))), lambda x: x["count"].cast("string")), "  ").alias("row")
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct("base", "row"))), lambda x: F.concat(x["base"], F.lit("  [ "), x["row"], F.lit(" ]")))
    text = per_base.groupBy("matrix_id").agg(F.concat(F.lit(">"), F.first("matrix_id"), F.lit("\tmotif\n"), F.array_join(lines, "\n")).alias("value"))
    parsed = readers.matrix_records(text.select("value"))
    return parsed.withColumn("name", F.concat("matrix_id", F.lit(" "), "name"))


def best_scan_sql(where: str = "") -> str:
    fwd = " + ".join(f"ws[{4 * k} + c{k}]" for k in range(LENGTH))
    rev = " + ".join(f"ws[{4 * k} + 5 - c{LENGTH - 1 - k}]" for k in range(LENGTH))
    leads = ", ".join(f"lead(c, {k}) OVER q AS c{k}" for k in range(1, LENGTH))
    return f"""
codes AS (SELECT doc_id, i, strpos('ACGT', ch) AS c FROM (SELECT doc_id, unnest(range(0, length(seq))) AS i, unnest(string_split(seq, '')) AS ch FROM nuc WHERE length(seq) > 0)),
km AS (SELECT doc_id, i, c AS c0, {leads} FROM codes WINDOW q AS (PARTITION BY doc_id ORDER BY i)),
sc AS (SELECT doc_id, i, matrix_id, {fwd} AS f, {rev} AS r FROM km, pk WHERE c{LENGTH - 1} IS NOT NULL),
hit AS (SELECT s.doc_id, s.matrix_id, s.i AS start, CASE WHEN f >= r THEN '+' ELSE '-' END AS strand, greatest(f, r) AS score, (greatest(f, r) - lowest) / greatest(highest - lowest, 1e-9) AS score_fraction
        FROM sc s JOIN rng USING (matrix_id) {where})
"""


@query(
    "motif_scan",
    f"""
WITH {NUC_SQL}, {PFM_SQL}, {best_scan_sql()}
SELECT doc_id, matrix_id, count(*) AS n_hits, count(*) FILTER (WHERE strand = '+') AS n_forward, sum(start)::BIGINT AS start_sum, round(max(score), 6) AS best_score, round(avg(score_fraction), 4) AS mean_fraction
FROM hit WHERE score_fraction >= 0.7 GROUP BY 1, 2
""",
)
def motif_scan(spark, sf_dir):
    tiles = ds.tile_sequences(nucleotides(spark, sf_dir), sequence="seq", tile=TILE, halo=LENGTH - 1)
    hits = mt.scan_matrices(tiles, packed(spark, sf_dir), sequence="seq", tile=TILE, min_fraction=0.7)
    return hits.groupBy("doc_id", "matrix_id").agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.count(F.when(F.col("strand") == "+", 1)).alias("n_forward"),
        F.sum(F.col("start").cast("bigint")).alias("start_sum"),
        F.round(F.max("score"), 6).alias("best_score"),
        F.round(F.avg("score_fraction"), 4).alias("mean_fraction"),
    )


DISRUPTION_SQL = f"""
win AS (SELECT doc_id, 'W' || k::VARCHAR AS win, a - 30 + 25 * k AS ws0, a - 30 + 25 * k + 11 AS we0 FROM long, range(0, 3) r(k)),
ed AS (SELECT doc_id, string_agg(CASE WHEN i % 5 = 0 THEN translate(ch, 'ACGT', 'CATG') ELSE ch END, '' ORDER BY i) AS edited FROM (
  SELECT doc_id, unnest(range(0, length(seq))) AS i, unnest(string_split(seq, '')) AS ch FROM long) GROUP BY 1),
touch AS (SELECT h.*, win, ws0, we0, h.start + {LENGTH - 1} AS fin, n.seq, e.edited FROM hit h JOIN win w ON w.doc_id = h.doc_id AND h.start <= w.we0 AND h.start + {LENGTH - 1} >= w.ws0
          JOIN nuc n ON n.doc_id = h.doc_id JOIN ed e ON e.doc_id = h.doc_id WHERE h.score_fraction >= 0.7),
ori AS (SELECT *, CASE WHEN strand = '-' THEN reverse(translate(substr(edited, start + 1, {LENGTH}), 'ACGT', 'TGCA')) ELSE substr(edited, start + 1, {LENGTH}) END AS em FROM touch),
es AS (SELECT o.*, {" + ".join(f"ws[{4 * k} + strpos('ACGT', substr(em, {k + 1}, 1))]" for k in range(LENGTH))} AS escore FROM ori o JOIN pk USING (matrix_id)),
dis AS (SELECT e.*, greatest(0.0, score_fraction - (escore - lowest) / greatest(highest - lowest, 1e-9)) AS loss, (least(fin, we0) - greatest(start, ws0) + 1) / {LENGTH}.0 AS ov FROM es e JOIN rng USING (matrix_id))
"""


#: From the first to the last base of the windows around the middle one.
WINDOWS_ROOM = 63


@designed(
    "motif_disruption",
    f"""
WITH {nuc_sql(WINDOWS_ROOM)}, {PFM_SQL}, {best_scan_sql()}, {DISRUPTION_SQL}
SELECT doc_id, win AS "window", upper(matrix_id) AS family, round(max(score_fraction * loss * ov), 6) AS disruption FROM dis GROUP BY 1, 2, 3
""",
    room=WINDOWS_ROOM,
)
def motif_disruption(spark, sf_dir):
    base = long_sequences(spark, sf_dir, WINDOWS_ROOM)
    # what a motif that touches a window may cover: the windows and a motif less one base on both sides
    reach = WINDOWS_ROOM // 2 + LENGTH - 2
    cut = base.select("doc_id", F.greatest(F.col("a") - reach, F.lit(0)).alias("origin"), "a", "seq")
    cut = cut.select("doc_id", "origin", F.substring(F.col("seq"), F.col("origin") + 1, F.col("a") + reach + 2 - F.col("origin")).alias("native"))
    letters = F.filter(F.split("native", ""), lambda c: c != "")
    every_fifth = F.transform(letters, lambda c, k: F.when((k + F.col("origin")) % 5 == 0, F.translate(c, "ACGT", "CATG")).otherwise(c))
    pieces = cut.withColumn("edited", F.array_join(every_fifth, ""))
    tiles = pieces.withColumn("tile_start", F.lit(0)).withColumn("text", F.col("native"))
    hits = mt.scan_matrices(tiles, packed(spark, sf_dir), sequence="text", tile=TILE, min_fraction=0.7)
    hits = hits.withColumn("start", F.col("start") + F.col("origin")).withColumn("end", F.col("end") + F.col("origin"))
    k = F.explode(F.sequence(F.lit(0), F.lit(2)))
    windows = base.select("doc_id", "a", k.alias("k")).select(
        "doc_id", F.concat(F.lit("W"), F.col("k").cast("string")).alias("window"), (F.col("a") - 30 + 25 * F.col("k")).alias("window_start"), (F.col("a") - 19 + 25 * F.col("k")).alias("window_end")
    )
    scored = mt.motif_disruption(
        hits, windows, weight_table(spark, sf_dir), ["doc_id"], matrix="matrix_id", offset="offset", base="base", family="matrix_id", native="native",
        edited="edited", origin="origin", min_fraction=0.7, bin_width=32,
    )
    scored = scored.select("doc_id", "window", "family", "disruption", "start", "strand")
    best = mt.best_per_window_family(scored, ["doc_id"], [F.col("start"), F.col("strand")])
    return rounded(best.select("doc_id", "window", F.upper("family").alias("family"), "disruption"))


@query(
    "displayed_families",
    f"""
WITH {nuc_sql(WINDOWS_ROOM)}, {PFM_SQL}, {best_scan_sql()}, {DISRUPTION_SQL},
fam AS (SELECT win, matrix_id AS family, max(score_fraction * loss * ov) AS s FROM dis GROUP BY 1, 2),
rk AS (SELECT family, max(s) AS best FROM fam GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY best DESC, family) AS r FROM rk),
f AS (SELECT coalesce(max(r), 0) AS fr FROM o WHERE family = 'es'),
k AS (SELECT o.* FROM o, f WHERE r < 2 OR (r = 2 AND fr <= 2) OR family = 'es')
SELECT family, round(best, 6) AS best, row_number() OVER (ORDER BY family <> 'es', best DESC, family) AS rank,
       (SELECT count(*) FROM nuc WHERE coalesce(length(seq), 0) < {WINDOWS_ROOM}) AS n_short_texts FROM k
""",
)
def displayed_families(spark, sf_dir):
    best = motif_disruption(spark, sf_dir).groupBy(F.lower("family").alias("family")).agg(F.max("disruption").alias("best"))
    top = rk.force_member(best, [], [F.desc("best"), F.col("family")], 2, F.col("family") == "es")
    short = nucleotides(spark, sf_dir).where(F.coalesce(F.length("seq"), F.lit(0)) < WINDOWS_ROOM).agg(F.count(F.lit(1)).alias("n_short_texts"))
    named = top.select("family", "best", F.col("rank").cast("bigint").alias("rank"))
    return rounded(named.join(F.broadcast(short), F.lit(True)))
