"""Contact-map queries. Cells count order lines by (part bin, supplier bin) per return flag."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contacts as cm
from ..operators import intervals as op
from ..operators import resampling as rs
from ..session import staged
from .registry import cents, query, rounded, table

N = 64

COO_SQL = f"""
raw AS (SELECT l_returnflag AS ctx, least(l_partkey % {N}, l_suppkey % {N}) AS i, greatest(l_partkey % {N}, l_suppkey % {N}) AS j, count(*)::DOUBLE AS value FROM lineitem GROUP BY 1, 2, 3),
coo AS (SELECT ctx, i, j, CASE WHEN (i * 7 + j) % 61 = 0 THEN NULL ELSE value END AS value, true AS stored FROM raw WHERE (i + j) % 9 <> 0),
sym AS (SELECT * FROM coo UNION ALL SELECT ctx, j, i, value, stored FROM coo WHERE i <> j),
ax AS (SELECT range::BIGINT AS a FROM range(0, {N})),
ctxs AS (SELECT DISTINCT ctx FROM coo),
dense AS (SELECT c.ctx, x.a AS i, y.a AS j, CASE WHEN s.stored THEN s.value ELSE 0.0 END AS v FROM ctxs c, ax x, ax y LEFT JOIN sym s ON s.ctx = c.ctx AND s.i = x.a AND s.j = y.a),
tg AS (SELECT l_returnflag AS ctx, l_linenumber * 4 AS anchor, (l_linenumber * 4 + 3 + 5 * (l_linenumber % 3))::BIGINT AS target FROM lineitem GROUP BY ALL)
"""


def contact_cells(spark, sf_dir):
    """Upper triangle, some cells absent and some missing."""
    i, j = F.col("l_partkey") % N, F.col("l_suppkey") % N
    raw = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("ctx"), F.least(i, j).alias("i"), F.greatest(i, j).alias("j")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return raw.where((F.col("i") + F.col("j")) % 9 != 0).withColumn("value", F.when((F.col("i") * 7 + F.col("j")) % 61 != 0, F.col("value")))


def full_matrix(spark, sf_dir):
    return cm.symmetrise(contact_cells(spark, sf_dir), ["ctx"])


def anchor_targets(spark, sf_dir):
    k = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("ctx"), (k * 4).cast("bigint").alias("anchor"), (k * 4 + 3 + 5 * (k % 3)).cast("bigint").alias("target")
    ).distinct()


NULL_COLUMNS = """
SELECT t.ctx, t.anchor::BIGINT AS anchor, t.target, (t.target - t.anchor)::BIGINT AS distance, round(o.m, 6) AS contact, count(n.m) AS null_n, round(avg(n.m), 6) AS null_mean, round(stddev_samp(n.m), 6) AS null_sd,
       round((o.m - avg(n.m)) / stddev_samp(n.m), 6) AS z,
       round(100.0 * sum(CASE WHEN n.m < o.m THEN 1.0 WHEN n.m = o.m THEN 0.5 ELSE 0.0 END) / count(n.m), 6) AS percentile,
       round((sum(CASE WHEN n.m >= o.m THEN 1 ELSE 0 END) + 1) / (count(n.m) + 1.0), 6) AS p_high
"""


def box_null_sql(flank: int, skip: bool) -> str:
    keep = "" if skip else "HAVING count(d.v) = count(*)"
    return f"""
WITH {COO_SQL},
box AS (SELECT c.ctx, c.i, c.j, avg(d.v) AS m FROM dense c JOIN dense d ON d.ctx = c.ctx AND abs(d.i - c.i) <= {flank} AND abs(d.j - c.j) <= {flank}
        WHERE (c.ctx, c.j - c.i) IN (SELECT ctx, target - anchor FROM tg) GROUP BY 1, 2, 3 {keep})
{NULL_COLUMNS}
FROM tg t JOIN box o ON o.ctx = t.ctx AND o.i = t.anchor AND o.j = t.target
JOIN box n ON n.ctx = t.ctx AND n.j - n.i = t.target - t.anchor AND n.i BETWEEN {flank} AND {N - 1 - flank} - (t.target - t.anchor)
WHERE n.m IS NOT NULL AND o.m IS NOT NULL GROUP BY t.ctx, t.anchor, t.target, o.m
"""


def placed(df):
    return rounded(df.select("ctx", "anchor", "target", "distance", "contact", "null_n", "null_mean", "null_sd", "z", "percentile", "p_high"))


@query("contact_null_box", box_null_sql(1, True))
def contact_null_box(spark, sf_dir):
    """3x3 box, missing cells skipped."""
    return placed(cm.same_distance_null(full_matrix(spark, sf_dir), anchor_targets(spark, sf_dir), ["ctx"], n_bins=N, flank=1))


@query("contact_null_single_bin", box_null_sql(0, False))
def contact_null_single_bin(spark, sf_dir):
    """Single bin, plain mean."""
    return placed(cm.same_distance_null(full_matrix(spark, sf_dir), anchor_targets(spark, sf_dir), ["ctx"], n_bins=N, flank=0, skip_missing=False))


@query("contact_null_plain_box", box_null_sql(1, False))
def contact_null_plain_box(spark, sf_dir):
    """3x3 box, a missing cell makes the mean missing."""
    return placed(cm.same_distance_null(full_matrix(spark, sf_dir), anchor_targets(spark, sf_dir), ["ctx"], n_bins=N, flank=1, skip_missing=False))


ROW_NULL_SQL = f"""
rowbox AS (SELECT c.ctx, c.i, c.j, avg(d.v) AS m FROM dense c JOIN dense d ON d.ctx = c.ctx AND d.i = c.i AND abs(d.j - c.j) <= 1
           WHERE (c.ctx, c.j - c.i) IN (SELECT ctx, target - anchor FROM tg) GROUP BY 1, 2, 3)
{NULL_COLUMNS}
FROM tg t JOIN rowbox o ON o.ctx = t.ctx AND o.i = t.anchor AND o.j = t.target
JOIN rowbox n ON n.ctx = t.ctx AND n.j - n.i = t.target - t.anchor AND n.i BETWEEN 0 AND {N - 2} - (t.target - t.anchor)
WHERE n.m IS NOT NULL AND o.m IS NOT NULL GROUP BY t.ctx, t.anchor, t.target, o.m
"""


@query("contact_null_virtual_row", f"WITH {COO_SQL}, {ROW_NULL_SQL}")
def contact_null_virtual_row(spark, sf_dir):
    """Virtual row of the anchor, three target bins."""
    return placed(cm.same_distance_null(full_matrix(spark, sf_dir), anchor_targets(spark, sf_dir), ["ctx"], n_bins=N, flank=1, axis="row"))


@query(
    "box_means",
    f"""
WITH {COO_SQL}
SELECT c.ctx, c.i, c.j, round(avg(d.v), 6) AS box_mean FROM dense c JOIN dense d ON d.ctx = c.ctx AND abs(d.i - c.i) <= 1 AND abs(d.j - c.j) <= 1
WHERE (c.ctx, c.i, c.j) IN (SELECT ctx, i, j FROM sym) GROUP BY 1, 2, 3
""",
)
def box_means(spark, sf_dir):
    full = full_matrix(spark, sf_dir)
    return rounded(cm.box_means(full, full.select("ctx", "i", "j"), ["ctx"], n_bins=N, row_flank=1, column_flank=1))


@query(
    "offset_submatrix",
    f"""
WITH {COO_SQL} SELECT ctx, i, j, i - 30 AS row_offset, j - 30 AS column_offset, value FROM sym WHERE i - 30 BETWEEN -8 AND 12 AND j - 30 BETWEEN -8 AND 12
""",
)
def offset_submatrix(spark, sf_dir):
    return cm.offset_submatrix(full_matrix(spark, sf_dir), anchor=30, low=-8, high=12)


@query(
    "virtual_profile",
    f"""
WITH {COO_SQL},
a AS (SELECT DISTINCT ctx, anchor FROM tg),
p AS (SELECT a.ctx, a.anchor, d.j AS bin, avg(d.v) AS contact FROM a JOIN dense d ON d.ctx = a.ctx AND abs(d.i - a.anchor) <= 1 GROUP BY 1, 2, 3),
s AS (SELECT *, (contact + coalesce(lag(contact) OVER w, 0) + coalesce(lead(contact) OVER w, 0)) / 3 AS smoothed FROM p WINDOW w AS (PARTITION BY ctx, anchor ORDER BY bin))
SELECT ctx, anchor::BIGINT AS anchor, bin, round(contact, 6) AS contact, round(smoothed, 6) AS smoothed FROM s
""",
)
def virtual_profile(spark, sf_dir):
    return rounded(cm.virtual_profile(full_matrix(spark, sf_dir), anchor_targets(spark, sf_dir), ["ctx"], n_bins=N, anchor_flank=1))


@query(
    "contact_delta_map",
    f"""
WITH {COO_SQL},
a AS (SELECT i, j, value / 10 AS value FROM sym WHERE ctx = 'A'), r AS (SELECT i, j, value / 10 AS value FROM sym WHERE ctx = 'R')
SELECT coalesce(a.i, r.i) AS i, coalesce(a.j, r.j) AS j, round(coalesce(a.value, 0) - coalesce(r.value, 0), 6) AS value,
       round(100.0 * (exp(coalesce(a.value, 0) - coalesce(r.value, 0)) - 1), 4) AS percent_change FROM a FULL OUTER JOIN r ON a.i = r.i AND a.j = r.j
""",
)
def contact_delta_map(spark, sf_dir):
    full = full_matrix(spark, sf_dir).withColumn("value", F.col("value") / 10)
    delta = cm.delta_map(full.where("ctx = 'A'"), full.where("ctx = 'R'"), [])
    return delta.select("i", "j", F.round("value", 6).alias("value"), F.round("percent_change", 4).alias("percent_change"))


@query(
    "contact_mean_over_tracks",
    f"""
SELECT l_returnflag AS ctx, i, j, round(avg(value), 6) AS value FROM (
  SELECT l_returnflag, l_linestatus, l_partkey % {N} AS i, l_suppkey % {N} AS j, count(*)::DOUBLE AS value FROM lineitem GROUP BY ALL) GROUP BY 1, 2, 3
""",
)
def contact_mean_over_tracks(spark, sf_dir):
    tracks = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("ctx"), "l_linestatus", (F.col("l_partkey") % N).alias("i"), (F.col("l_suppkey") % N).alias("j")
    ).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return rounded(cm.mean_over_tracks(tracks, ["ctx"]))


@query(
    "signal_by_position",
    """
SELECT label, pos AS position, round(avg(v::DOUBLE), 6) AS signal, count(v) AS n_tracks FROM (
  SELECT label, unnest(embedding) AS v, unnest(range(64))::INTEGER AS pos FROM embeddings WHERE vec_id % 4 <> 1) GROUP BY 1, 2
""",
)
def signal_by_position(spark, sf_dir):
    return rounded(cm.signal_by_position(table(spark, sf_dir, "embeddings"), ["label"], values="embedding", keep=F.col("vec_id") % 4 != 1))


# --- anchored profiles and matched control sites along the day axis -------------------------------------------

RES, NEAR, FAR, LENGTH = 28, 56, 1120, 2520

DAYS_SQL = f"""
pairs AS (
  SELECT l_returnflag AS chrom, o AS x, s AS y FROM (
    SELECT l_returnflag, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) // {RES} * {RES} AS o, date_diff('day', DATE '1995-01-01', l_shipdate::DATE) // {RES} * {RES} AS s
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)),
recs AS (SELECT chrom, least(x, y) AS x, greatest(x, y) AS y, count(*)::DOUBLE AS v FROM pairs GROUP BY ALL),
mir AS (SELECT chrom, x AS a, y AS t, v FROM recs WHERE x <> y UNION ALL SELECT chrom, y, x, v FROM recs WHERE x <> y),
anchors AS (SELECT s_suppkey AS promoter, CASE s_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS chrom, (s_suppkey * 37) % 2400 AS tss FROM supplier),
bins AS (SELECT promoter, chrom, tss, unnest(range(greatest(0, tss - {FAR} - {RES}) // {RES} * {RES}, (least({LENGTH}, tss + {FAR} + {RES} + 1) - 1) // {RES} * {RES} + 1, {RES})) AS t FROM anchors),
dn AS (SELECT b.*, coalesce(m.v, 0.0) AS contact, CASE WHEN m.v IS NULL THEN 0 ELSE 1 END AS n_records FROM bins b LEFT JOIN mir m ON m.chrom = b.chrom AND m.a = b.tss // {RES} * {RES} AND m.t = b.t),
sm AS (SELECT *, (coalesce(lag(contact) OVER w, 0) + contact + coalesce(lead(contact) OVER w, 0)) / 3 AS smooth FROM dn WINDOW w AS (PARTITION BY promoter ORDER BY t)),
prof AS (SELECT promoter, chrom, tss, t, t + {RES // 2} AS center, contact, smooth, n_records, t + {RES // 2} - tss AS sd, abs(t + {RES // 2} - tss) AS ad FROM sm
         WHERE abs(t + {RES // 2} - tss) BETWEEN {NEAR} AND {FAR} AND t >= 0 AND t + {RES} <= {LENGTH})
"""


def day_records(spark, sf_dir):
    from .positions import day

    def binned(column):
        return (F.floor(day(column) / RES) * RES).cast("bigint")

    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("chrom"), binned("l_shipdate").alias("y"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), binned("o_orderdate").alias("x"))
    return (
        lines.join(orders, "l_orderkey")
        .groupBy("chrom", F.least("x", "y").alias("bin_x"), F.greatest("x", "y").alias("bin_y"))
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
    )


def day_profile(spark, sf_dir):
    k = F.col("s_suppkey")
    anchors = table(spark, sf_dir, "supplier").select(
        k.alias("promoter"), F.when(k % 3 == 0, "A").when(k % 3 == 1, "N").otherwise("R").alias("chrom"), ((k * 37) % 2400).alias("tss")
    )
    return cm.anchored_profile(
        day_records(spark, sf_dir), anchors, ["chrom"], anchor_id="promoter", position="tss", resolution=RES, min_distance=NEAR, max_distance=FAR, length=LENGTH
    )


@query(
    "anchored_profile",
    f"""
WITH {DAYS_SQL}
SELECT promoter, chrom, tss, t AS target_bin, center AS target_center, contact, round(smooth, 6) AS contact_smooth3, n_records::BIGINT AS n_records, sd AS signed_distance, ad AS absolute_distance FROM prof
""",
)
def anchored_profile(spark, sf_dir):
    return rounded(day_profile(spark, sf_dir))


CONTEXT_SQL = f"""
gc AS (SELECT l_returnflag AS chrom, date_diff('day', DATE '1995-01-01', l_shipdate::DATE) // {RES} * {RES} AS t, avg(round(l_discount * 100)::BIGINT) / 100 AS gc, avg(round(l_tax * 100)::BIGINT) / 100 AS cpg FROM lineitem GROUP BY 1, 2),
ctx AS (SELECT p.*, g.gc, g.cpg, (p.t // {RES} + p.promoter) % 11 <> 0 AND g.gc IS NOT NULL AS ok FROM prof p LEFT JOIN gc g ON g.chrom = p.chrom AND g.t = p.t),
el AS (SELECT c.*, EXISTS (SELECT 1 FROM ctx a WHERE a.promoter = c.promoter AND a.t = c.t - {RES} AND a.ok) AND EXISTS (SELECT 1 FROM ctx b WHERE b.promoter = c.promoter AND b.t = c.t + {RES} AND b.ok) AS run FROM ctx c WHERE c.ok)
"""

MATCH_SQL = f"""
pk AS (SELECT promoter, t, center, smooth, contact, n_records, ad, (rank() OVER (PARTITION BY promoter ORDER BY smooth) + (count(*) OVER (PARTITION BY promoter, smooth) - 1) / 2.0) / count(*) OVER (PARTITION BY promoter) AS pct FROM el WHERE run),
pr AS (SELECT *, row_number() OVER (PARTITION BY promoter ORDER BY smooth DESC, contact DESC, n_records DESC, ad, t) AS prk FROM pk WHERE smooth >= 1.0 AND pct >= 0.8),
hi AS (SELECT p.promoter, p.prk, p.pct, p.center AS peak_center, e.t, e.center, e.contact, e.tss, e.sd, e.ad, e.gc, e.cpg,
              row_number() OVER (PARTITION BY p.promoter, p.prk ORDER BY e.contact DESC, e.smooth DESC, e.n_records DESC, e.ad, e.t) AS rn
       FROM pr p JOIN el e ON e.promoter = p.promoter AND abs(e.center - p.center) <= {RES}),
hd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY promoter, t ORDER BY prk) AS dup FROM hi WHERE rn = 1) WHERE dup = 1 AND contact > 0),
pool AS (SELECT h.promoter, h.prk, e.t, e.center, e.contact, e.ad, e.gc, e.cpg, h.contact AS hc, h.gc AS hgc, h.cpg AS hcpg, h.ad AS had,
                quantile_cont(e.contact, 0.25) OVER (PARTITION BY h.promoter, h.prk) AS thr, count(*) OVER (PARTITION BY h.promoter, h.prk) AS npool
         FROM hd h JOIN el e ON e.promoter = h.promoter AND sign(e.sd) = sign(h.sd) AND abs(e.ad - h.ad) <= 420 AND abs(e.center - h.center) >= 84),
low AS (SELECT *, abs(ad - had) / 420.0 + abs(gc - hgc) / 0.02 + abs(cpg - hcpg) / 0.01 AS score FROM pool WHERE npool >= 2 AND contact <= thr AND contact < hc AND abs(gc - hgc) <= 0.02),
lr AS (SELECT *, row_number() OVER (PARTITION BY promoter, prk ORDER BY score, contact, ad, t) AS o FROM low),
pp AS (SELECT a.promoter, a.prk, a.t AS t1, b.t AS t2, a.contact AS c1, b.contact AS c2, a.score + b.score AS ss, a.contact + b.contact AS cs, abs(a.center) + abs(b.center) AS ab, a.o AS o1, b.o AS o2,
              least(h.tss - 20, h.center - 5, a.center - 5, b.center - 5) AS need0, greatest(h.tss + 21, h.center + 5, a.center + 5, b.center + 5) AS need1
       FROM lr a JOIN lr b ON a.promoter = b.promoter AND a.prk = b.prk AND a.o < b.o AND abs(a.center - b.center) >= 84 JOIN hd h ON h.promoter = a.promoter AND h.prk = a.prk),
ps AS (SELECT *, greatest(0, least((need0 + need1) // 2 - 400, {LENGTH} - 800)) AS s0 FROM pp WHERE need1 - need0 <= 800),
best AS (SELECT *, row_number() OVER (PARTITION BY promoter ORDER BY prk, ss, cs, ab, o1, o2) AS w FROM ps WHERE s0 <= need0 AND need1 <= s0 + 800)
SELECT b.promoter, h.peak_center, round(h.pct, 6) AS peak_percentile, h.t AS high_target_bin, h.contact AS high_contact, b.t1 AS low1_bin, b.t2 AS low2_bin, b.c1 AS low1_contact, b.c2 AS low2_contact,
       round(b.ss, 6) AS score_sum, b.s0 AS span_start
FROM best b JOIN hd h ON h.promoter = b.promoter AND h.prk = b.prk WHERE b.w = 1
"""


@query("matched_controls", f"WITH {DAYS_SQL}, {CONTEXT_SQL}, {MATCH_SQL}")
def matched_controls(spark, sf_dir):
    from ..operators.catalog import matched_controls as match
    from .positions import day

    context = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("chrom"), (F.floor(day("l_shipdate") / RES) * RES).cast("bigint").alias("target_bin"))
        .agg((F.avg(cents("l_discount")) / 100).alias("flank_gc"), (F.avg(cents("l_tax")) / 100).alias("flank_cpg"))
    )
    kept = (F.floor(F.col("target_bin") / RES) + F.col("promoter")) % 11 != 0
    profile = (
        day_profile(spark, sf_dir)
        .join(context, ["chrom", "target_bin"], "left")
        .withColumn("eligible", kept & F.col("flank_gc").isNotNull())
        .withColumn("flank_ambiguous", F.lit(0.0))
    )
    profile = staged(profile, "profile")  # its rows are met by their own neighbours
    marked = op.neighbour_run(profile, ["promoter"], position="target_bin", eligible=F.col("eligible"), step=RES)
    out = match(
        marked, ["promoter"], anchor="tss", resolution=RES, slot=10, span=800, bound=LENGTH, min_smooth=1.0, min_percentile=0.8, caliper=420,
        separation=84, low_quantile=0.25, gc_tolerance=0.02, cpg_scale=0.01, anchor_before=20, anchor_after=21,
    )
    return rounded(
        out.select(
            "promoter", "peak_center", "peak_percentile", "high_target_bin", "high_contact", "low1_bin", "low2_bin", "low1_contact", "low2_contact", "score_sum", "span_start",
        )
    )


@query(
    "contact_null_sampled",
    f"""
WITH {COO_SQL},
cells AS (SELECT ctx, i, j, v FROM dense WHERE v IS NOT NULL AND j > i),
obs AS (SELECT ctx, v FROM cells WHERE i = 5 AND j = 20),
n AS (SELECT c.ctx, c.i, c.v FROM cells c WHERE c.j - c.i = 15 AND c.i <> 5)
SELECT o.ctx, count(*) AS null_n, round((sum(CASE WHEN n.v >= o.v THEN 1 ELSE 0 END) + 1) / (count(*) + 1.0), 6) AS p_high,
       round(100.0 * sum(CASE WHEN n.v < o.v THEN 1.0 WHEN n.v = o.v THEN 0.5 ELSE 0.0 END) / count(*), 6) AS percentile
FROM obs o JOIN n USING (ctx) GROUP BY 1, o.v
""",
)
def contact_null_sampled(spark, sf_dir):
    """One observed cell against its own diagonal without it."""
    full = full_matrix(spark, sf_dir)
    here = full.select("ctx").distinct().withColumn("anchor", F.lit(5).cast("bigint")).withColumn("target", F.lit(20).cast("bigint"))
    diagonal = cm.same_distance_cells(here, ["ctx"], n_bins=N, row_flank=0, column_flank=0)
    values = cm.box_means(full, diagonal, ["ctx"], n_bins=N, row_flank=0, column_flank=0).where("box_mean IS NOT NULL")
    observed = values.where("i = 5").select("ctx", "box_mean")
    placed_cell = rs.observed_in_null(observed, values.where("i <> 5").select("ctx", "box_mean"), ["ctx"], value="box_mean")
    return rounded(placed_cell.select("ctx", "null_n", "p_high", "percentile"))
