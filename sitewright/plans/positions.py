"""Interval, window and ranking queries. Days since 1995-01-01 play the part of coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..operators import intervals as op
from ..operators import joins as jn
from ..operators import ranking as rk
from ..operators import resampling as rs
from ..sources import readers
from .registry import cents, query, rounded, table

EPOCH = 9131  # 1995-01-01 in days since 1970-01-01

SPANS_SQL = """
spans AS (
  SELECT o_custkey AS grp, least(o, s) AS start, greatest(o, s) + 1 AS "end", l_orderkey, l_linenumber FROM (
    SELECT o_custkey, l_orderkey, l_linenumber, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS o, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)
           + l_quantity::BIGINT AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey))
"""

# equal intervals are one row here: the two windows would order such ties each in its own way
MERGED_SQL = """
uniq AS (SELECT grp, start, "end", count(*) AS n FROM spans GROUP BY 1, 2, 3),
flags AS (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY grp ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                 OR row_number() OVER (PARTITION BY grp ORDER BY start, "end") = 1 THEN 1 ELSE 0 END AS opened FROM uniq),
isl AS (SELECT *, sum(opened) OVER (PARTITION BY grp ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM flags),
merged AS (SELECT grp, min(start) AS start, max("end") AS "end", sum(n)::BIGINT AS n_merged FROM isl GROUP BY grp, island)
"""


def day(column):
    return F.unix_date(F.col(column).cast("date")) - EPOCH


def order_spans(spark, sf_dir):
    """One interval per order line: order day, as many days long as its quantity."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("q"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("grp"), day("o_orderdate").cast("bigint").alias("o"))
    return lines.join(orders, "l_orderkey").select(
        "grp", F.col("o").alias("start"), (F.col("o") + F.col("q") + 1).alias("end"), "l_orderkey", "l_linenumber"
    )


@query("merged_intervals", f"WITH {SPANS_SQL}, {MERGED_SQL} SELECT * FROM merged")
def merged_intervals(spark, sf_dir):
    return op.merge_intervals(order_spans(spark, sf_dir), ["grp"], "start", "end", tile=512)


EVENT_DAYS_SQL = """
probes AS (SELECT c_custkey AS grp, (c_custkey * 37 + k * 211) % 2500 AS a, (c_custkey * 37 + k * 211) % 2500 + 5 + k AS b FROM customer, range(0, 4) t(k))
"""


def probe_spans(spark, sf_dir):
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint")))
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", k.alias("k")).select(
        c.alias("grp"), ((c * 37 + F.col("k") * 211) % 2500).alias("a"), ((c * 37 + F.col("k") * 211) % 2500 + 5 + F.col("k")).alias("b")
    )


@query(
    "overlaps_merged_set",
    f"""
WITH {SPANS_SQL}, {MERGED_SQL}, {EVENT_DAYS_SQL}
SELECT p.grp, p.a, p.b, EXISTS (SELECT 1 FROM merged m WHERE m.grp = p.grp AND m.start < p.b AND m."end" > p.a) AS overlaps FROM probes p
""",
)
def overlaps_merged_set(spark, sf_dir):
    merged = op.merge_intervals(order_spans(spark, sf_dir), ["grp"], "start", "end", tile=512)
    return op.flag_overlaps_merged(probe_spans(spark, sf_dir), merged, ["grp"], start="a", end="b", bin_width=64)


@query(
    "interval_overlap_pairs",
    f"""
WITH {SPANS_SQL}, {EVENT_DAYS_SQL}
SELECT p.grp, p.a, p.b, count(*) AS n_hits, sum(least(p.b, s."end") - greatest(p.a, s.start) + 1)::BIGINT AS shared,
       round(sum((least(p.b, s."end") - greatest(p.a, s.start) + 1) / (p.b - p.a + 1)::DOUBLE), 6) AS fraction_sum
FROM probes p JOIN spans s ON s.grp = p.grp AND p.a <= s."end" AND p.b >= s.start GROUP BY 1, 2, 3
""",
)
def interval_overlap_pairs(spark, sf_dir):
    # spans of days: an order line's lasts as many as its quantity
    pairs = op.overlap_join(
        probe_spans(spark, sf_dir), order_spans(spark, sf_dir), ["grp"], start="a", end="b", other_start="start", other_end="end", bin_width=64, levels=0
    )
    shared = iv.overlap_length("a", "b", "start", "end")
    return rounded(
        pairs.groupBy("grp", "a", "b").agg(
            F.count(F.lit(1)).alias("n_hits"), F.sum(shared).alias("shared"), F.sum(iv.overlap_fraction("a", "b", "start", "end")).alias("fraction_sum")
        )
    )


@query(
    "neighbour_runs",
    """
WITH d AS (SELECT l_suppkey, date_diff('day', DATE '1995-01-01', l_shipdate::DATE) // 28 AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2),
e AS (SELECT *, n >= 5 AS ok, lag(bin) OVER w AS pb, lead(bin) OVER w AS nb, lag(n) OVER w AS pn, lead(n) OVER w AS nn FROM d WINDOW w AS (PARTITION BY l_suppkey ORDER BY bin))
SELECT l_suppkey, bin, n, coalesce(ok AND bin - pb = 1 AND nb - bin = 1 AND pn >= 5 AND nn >= 5, false) AS in_run FROM e
""",
)
def neighbour_runs(spark, sf_dir):
    binned = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.floor(day("l_shipdate") / 28).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return op.neighbour_run(binned, ["l_suppkey"], position="bin", eligible=F.col("n") >= 5, step=1)


@query(
    "position_chunks",
    """
WITH d AS (SELECT DISTINCT o_custkey % 40 AS grp, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS p FROM orders),
g AS (SELECT *, p - row_number() OVER (PARTITION BY grp ORDER BY p) AS island FROM d),
c AS (SELECT *, (row_number() OVER (PARTITION BY grp, island ORDER BY p) - 1) // 3 AS chunk FROM g)
SELECT grp, min(p) AS chunk_start, max(p) + 1 AS chunk_end, count(*) AS n_positions FROM c GROUP BY grp, island, chunk
""",
)
def position_chunks(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("grp"), day("o_orderdate").alias("p"))
    return op.position_chunks(days, ["grp"], "p", 3, tile=256)


DAILY_SQL = """
daily AS (SELECT o_orderstatus AS gene, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS p, max(round(o_totalprice * 100)::BIGINT) AS v FROM orders GROUP BY 1, 2),
slid AS (
  SELECT gene, p AS start, p + 11 AS "end", count(*) OVER w AS n, sum(v) OVER w AS s, max(v) OVER w AS peak FROM daily
  WINDOW w AS (PARTITION BY gene ORDER BY p RANGE BETWEEN CURRENT ROW AND 11 FOLLOWING)),
win AS (SELECT gene, start, "end", s / 12.0 AS mean_value, s, peak FROM slid WHERE n = 12 AND NOT (start <= 1208 AND "end" >= 1199))
"""


def daily_signal(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("gene"), day("o_orderdate").alias("p")).agg(F.max(cents("o_totalprice")).alias("v"))


def slid_windows(spark, sf_dir):
    return op.sliding_windows(daily_signal(spark, sf_dir), ["gene"], position="p", value="v", width=12, protected=(1199, 1208), tile=256)


@query(
    "sliding_windows",
    f"""
WITH {DAILY_SQL}
SELECT w.gene, w.start, w."end", round(w.mean_value, 4) AS mean_value, w.s::BIGINT AS sum_value, w.peak AS peak_value, min(d.p) AS peak_position
FROM win w JOIN daily d ON d.gene = w.gene AND d.p BETWEEN w.start AND w."end" AND d.v = w.peak GROUP BY ALL
""",
)
def sliding_windows(spark, sf_dir):
    return rounded(slid_windows(spark, sf_dir), 4)


@query(
    "greedy_windows",
    f"""
WITH RECURSIVE {DAILY_SQL},
ranked AS (SELECT gene, start, row_number() OVER (PARTITION BY gene ORDER BY s DESC, peak DESC, start) AS r FROM win),
g AS (
  SELECT gene, r, start, [start] AS kept, 1 AS pick FROM ranked WHERE r = 1
  UNION ALL
  SELECT n.gene, n.r, n.start,
         CASE WHEN len(g.kept) < 6 AND len(list_filter(g.kept, lambda t: abs(t - n.start) <= 16)) = 0 THEN list_append(g.kept, n.start) ELSE g.kept END,
         CASE WHEN len(g.kept) < 6 AND len(list_filter(g.kept, lambda t: abs(t - n.start) <= 16)) = 0 THEN len(g.kept) + 1 ELSE 0 END
  FROM g JOIN ranked n ON n.gene = g.gene AND n.r = g.r + 1 WHERE len(g.kept) < 6)
SELECT gene, start, pick::INTEGER AS pick FROM g WHERE pick > 0
""",
)
def greedy_windows(spark, sf_dir):
    windows = slid_windows(spark, sf_dir)
    taken = op.greedy_non_overlapping(
        windows, ["gene"], start="start", width=12, margin=5, limit=6, order=[-F.col("sum_value"), -F.col("peak_value"), F.col("start")]
    )
    return taken.select("gene", "start", "pick")


@query(
    "covered_positions",
    """
WITH w AS (SELECT o_custkey % 50 AS grp, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS a FROM orders)
SELECT DISTINCT grp, unnest(range(a, a + 10)) AS position FROM w
""",
)
def covered_positions(spark, sf_dir):
    windows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("grp"), day("o_orderdate").cast("bigint").alias("a"))
    return op.covered_positions(windows.withColumn("b", F.col("a") + 9), ["grp"], start="a", end="b")


@query(
    "keep_first",
    """
SELECT l_orderkey, l_partkey, l_suppkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey) AS rn FROM lineitem) WHERE rn = 1
""",
)
def keep_first(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    first = rk.best_row(rows, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_extendedprice"), F.col("l_partkey")])
    return first.select("l_orderkey", "l_partkey", "l_suppkey")


@query(
    "keep_last",
    """
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
""",
)
def keep_last(spark, sf_dir):
    from ..sources.writers import keep_last as newest

    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    return newest(rows, ["user_id", "event_type"], stamp="ts", ties=[-F.col("event_id")]).drop("ts")


@query(
    "row_positions",
    """
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() OVER (
  PARTITION BY l_suppkey ORDER BY round(l_extendedprice * 100)::BIGINT DESC, l_orderkey, l_linenumber, l_partkey) AS position FROM lineitem
""",
)
def row_positions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", cents("l_extendedprice").alias("c"))
    return rk.row_positions(rows, ["l_suppkey"], [-F.col("c"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]).drop("c")


@query(
    "percentile_rank",
    """
WITH r AS (SELECT c_custkey, c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS lo,
                  count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) AS ties, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT c_custkey, c_mktsegment, round((lo + (ties - 1) / 2.0) / n, 8) AS percentile FROM r
""",
)
def percentile_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    ranked = rk.attach_ranks(rows, ["c_mktsegment"], "c_acctbal", {"percentile": rk.average_percentile()})
    return rounded(ranked.select("c_custkey", "c_mktsegment", "percentile"), 8)


@query(
    "repeated_labels",
    """
WITH r AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) AS k FROM part)
SELECT p_partkey, CASE WHEN k = 1 THEN p_name ELSE p_name || ' (' || k::VARCHAR || ')' END AS column_label FROM r
""",
)
def repeated_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    return readers.label_rows(rows, "p_name", [-F.col("p_retailprice"), F.col("p_partkey")]).select("p_partkey", "column_label")


@query(
    "expression_cohorts",
    """
WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_name, c_custkey) AS cohort_position, count(*) OVER () AS n FROM customer),
m AS (SELECT *, greatest(0, (n - 50) // 2) AS mid FROM r)
SELECT c_custkey, cohort_position, 'bottom' AS cohort FROM m WHERE cohort_position <= 50
UNION ALL SELECT c_custkey, cohort_position, 'middle' FROM m WHERE cohort_position BETWEEN mid + 1 AND mid + 50
UNION ALL SELECT c_custkey, cohort_position, 'top' FROM m WHERE cohort_position > n - 50
""",
)
def expression_cohorts(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return rk.cohorts(rows, [], [F.col("c_acctbal"), F.col("c_name"), F.col("c_custkey")], 50).select("c_custkey", "cohort_position", "cohort")


@query(
    "top_rows_per_group",
    """
SELECT o_custkey, o_orderkey, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3
""",
)
def top_rows_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    top = rk.top_rows(rows, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)
    return top.select("o_custkey", "o_orderkey", F.col("rank").cast("bigint").alias("rank"))


@query(
    "forced_member_top",
    """
WITH b AS (SELECT p_type, p_brand, max(p_retailprice * 1000 + p_partkey % 1000) AS s FROM part GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY s DESC, p_brand) AS r FROM b),
f AS (SELECT p_type, max(r) AS fr FROM r WHERE p_brand = 'Brand#7' GROUP BY 1),
k AS (SELECT r.p_type, r.p_brand, r.s FROM r LEFT JOIN f USING (p_type) WHERE r.r < 8 OR (r.r = 8 AND coalesce(fr, 0) <= 8) OR (r.p_brand = 'Brand#7'))
SELECT p_type, p_brand, row_number() OVER (PARTITION BY p_type ORDER BY p_brand <> 'Brand#7', s DESC, p_brand) AS rank FROM k
""",
)
def forced_member_top(spark, sf_dir):
    best = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.max(F.col("p_retailprice") * 1000 + F.col("p_partkey") % 1000).alias("s"))
    top = rk.force_member(best, ["p_type"], [F.desc("s"), F.col("p_brand")], 8, F.col("p_brand") == "Brand#7")
    return top.select("p_type", "p_brand", F.col("rank").cast("bigint").alias("rank"))


@query(
    "right_closed_bins",
    """
WITH b AS (SELECT l_suppkey, l_extendedprice AS x, CASE WHEN l_extendedprice >= 900 AND l_extendedprice <= 20000 THEN '0.9-20' WHEN l_extendedprice > 20000 AND l_extendedprice <= 40000 THEN '20-40'
             WHEN l_extendedprice > 40000 AND l_extendedprice <= 60000 THEN '40-60' WHEN l_extendedprice > 60000 AND l_extendedprice <= 80000 THEN '60-80' END AS bin FROM lineitem)
SELECT bin, count(*) AS n, round(quantile_cont(x, 0.5), 4) AS median, round(quantile_cont(x, 0.25), 4) AS q25, round(quantile_cont(x, 0.75), 4) AS q75
FROM b GROUP BY 1
""",
)
def right_closed_bins(spark, sf_dir):
    label = rs.cut_right_closed(F.col("l_extendedprice"), [900, 20000, 40000, 60000, 80000], ["0.9-20", "20-40", "40-60", "60-80"])
    rows = table(spark, sf_dir, "lineitem").select(F.coalesce(label, F.lit("outside")).alias("bin"), "l_extendedprice")
    out = rk.distribution(rows, ["bin"], "l_extendedprice", {"median": 0.5, "q25": 0.25, "q75": 0.75})
    return rounded(out.select(F.nullif(F.col("bin"), F.lit("outside")).alias("bin"), "n", "median", "q25", "q75"), 4)


@query(
    "prefix_families",
    """
SELECT p_partkey, CASE WHEN upper(p_name) LIKE 'SM%' THEN 'size' WHEN upper(p_name) LIKE 'RED%' OR upper(p_name) LIKE 'BL%' OR upper(p_name) LIKE 'GR%' THEN 'colour' ELSE p_name END AS family FROM part
""",
)
def prefix_families(spark, sf_dir):
    from ..operators.motifs import classify_by_prefix

    rules = (("size", "SM"), ("colour", "RED BL GR"))
    return table(spark, sf_dir, "part").select("p_partkey", classify_by_prefix("p_name", rules).alias("family"))


@query(
    "set_algebra",
    """
WITH a AS (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem WHERE l_linestatus = 'O'),
b AS (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem WHERE l_linestatus = 'F')
SELECT 'shared' AS part, l_suppkey, l_returnflag, NULL::VARCHAR AS note FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'first_only', l_suppkey, l_returnflag, 'absent from second' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
""",
)
def set_algebra(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    a, b = (lines.where(F.col("l_linestatus") == k).select("l_suppkey", "l_returnflag").distinct() for k in ("O", "F"))
    shared = a.intersect(b).withColumn("part", F.lit("shared"))
    left = a.exceptAll(b).withColumn("part", F.lit("first_only")).withColumn("note", F.lit("absent from second"))
    return shared.unionByName(left, allowMissingColumns=True)


@query(
    "interval_arithmetic",
    """
WITH x AS (SELECT s_suppkey, (s_suppkey * 1009) % 200000 AS tss, CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM supplier)
SELECT s_suppkey, floor((tss - 1 - 100) / 2048.0)::BIGINT AS bin, tss // 5000 * 5000 + 2500 AS center,
       CASE WHEN strand = '-' THEN tss + 301 ELSE tss - 300 - 315 END AS placement_start,
       CASE WHEN greatest(tss + 2001, tss + 30158) - least(tss - 2000, tss - 40157) <= 100000
             AND greatest(0, least((least(tss - 2000, tss - 40157) + greatest(tss + 2001, tss + 30158)) // 2 - 50000, 200000 - 100000)) <= least(tss - 2000, tss - 40157)
             AND greatest(tss + 2001, tss + 30158) <= greatest(0, least((least(tss - 2000, tss - 40157) + greatest(tss + 2001, tss + 30158)) // 2 - 50000, 200000 - 100000)) + 100000
            THEN greatest(0, least((least(tss - 2000, tss - 40157) + greatest(tss + 2001, tss + 30158)) // 2 - 50000, 200000 - 100000)) END AS span_start
FROM x
""",
)
def interval_arithmetic(spark, sf_dir):
    x = table(spark, sf_dir, "supplier").select(
        "s_suppkey", ((F.col("s_suppkey") * 1009) % 200000).alias("tss"), F.when(F.col("s_suppkey") % 2 == 0, "+").otherwise("-").alias("strand")
    )
    starts = F.array(F.col("tss") - 40157, F.col("tss") + 30158 - 315)
    ends = F.transform(starts, lambda s: s + 315)
    return x.select(
        "s_suppkey",
        iv.bin_of_position("tss", 100, 2048).alias("bin"),
        iv.bin_center(iv.bin_start("tss", 5000), 5000).alias("center"),
        iv.upstream_placement_start("tss", "strand", 315, 300).alias("placement_start"),
        iv.shared_span_start("tss", starts, ends, 100000, 200000, 2000, 2001).alias("span_start"),
    )


@query(
    "generated_vs_golden_sides",
    """
WITH g AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1),
r AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT coalesce(g.l_partkey, r.l_partkey) AS l_partkey, g.n AS n_gen, r.n AS n_ref,
       CASE WHEN g.n IS NULL THEN 'expected_only' WHEN r.n IS NULL THEN 'generated_only' ELSE 'both' END AS side
FROM g FULL OUTER JOIN r ON g.l_partkey = r.l_partkey
""",
)
def generated_vs_golden_sides(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    g, r = (lines.where(F.col("l_returnflag") != f).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")) for f in ("A", "N"))
    return jn.compare_sides(g, r, ["l_partkey"], ["n"])


@query(
    "greedy_unequal_windows",
    """
WITH RECURSIVE w AS (SELECT p_brand, p_partkey, (p_partkey * 977) % 100000 AS s, (p_partkey * 977) % 100000 + p_size * 40 AS e,
  row_number() OVER (PARTITION BY p_brand ORDER BY -p_size, p_partkey) AS r FROM part),
g AS (
  SELECT p_brand, p_partkey, s, e, r, [{'s': s, 'e': e}] AS kept, true AS took FROM w WHERE r = 1
  UNION ALL
  SELECT w.p_brand, w.p_partkey, w.s, w.e, w.r,
         CASE WHEN len(list_filter(g.kept, lambda k: k.s <= w.e AND k.e >= w.s)) = 0 THEN list_append(g.kept, {'s': w.s, 'e': w.e}) ELSE g.kept END,
         len(list_filter(g.kept, lambda k: k.s <= w.e AND k.e >= w.s)) = 0
  FROM g JOIN w ON w.p_brand = g.p_brand AND w.r = g.r + 1)
SELECT p_brand, p_partkey, s AS start, e AS "end", (row_number() OVER (PARTITION BY p_brand ORDER BY r))::INTEGER AS pick FROM g WHERE took
""",
)
def greedy_unequal_windows(spark, sf_dir):
    """The widest windows first, without overlaps, per brand."""
    at = (F.col("p_partkey") * 977) % 100000
    windows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", at.alias("start"), (at + F.col("p_size") * 40).alias("end"), "p_size")
    return op.greedy_intervals(windows, ["p_brand"], key="p_partkey", start="start", end="end", order=[-F.col("p_size")], bin_width=256)


@query(
    "distant_positions",
    """
WITH RECURSIVE w AS (SELECT p_brand, p_partkey, (p_partkey * 977) % 100000 AS pos, row_number() OVER (PARTITION BY p_brand ORDER BY -p_size, p_partkey) AS r FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand, (p_partkey * 977) % 100000 ORDER BY -p_size, p_partkey) AS rn FROM part) WHERE rn = 1),
g AS (
  SELECT p_brand, p_partkey, pos, r, [pos] AS kept, true AS took FROM w WHERE r = 1
  UNION ALL
  SELECT w.p_brand, w.p_partkey, w.pos, w.r,
         CASE WHEN len(g.kept) < 5 AND len(list_filter(g.kept, lambda t: abs(t - w.pos) <= 499)) = 0 THEN list_append(g.kept, w.pos) ELSE g.kept END,
         len(g.kept) < 5 AND len(list_filter(g.kept, lambda t: abs(t - w.pos) <= 499)) = 0
  FROM g JOIN w ON w.p_brand = g.p_brand AND w.r = g.r + 1 WHERE len(g.kept) < 5)
SELECT p_brand, p_partkey, pos AS position, (row_number() OVER (PARTITION BY p_brand ORDER BY r))::INTEGER AS pick FROM g WHERE took
""",
)
def distant_positions(spark, sf_dir):
    """The first five positions per brand that lie at least 500 apart from one another."""
    at = (F.col("p_partkey") * 977) % 100000
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", at.alias("position"), "p_size")
    out = op.greedy_non_overlapping(
        rows, ["p_brand"], start="position", width=1, margin=499, limit=5, order=[-F.col("p_size"), F.col("p_partkey")]
    )
    return out.select("p_brand", "p_partkey", "position", "pick")
