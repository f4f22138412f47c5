import random

import pytest
from pyspark.sql import functions as F

from sitewright.operators import intervals as op


def merged_by_hand(spans):
    out = []
    for s, e in sorted(spans):
        if not out or s > out[-1][1]:
            out.append([s, e])
        else:
            out[-1][1] = max(out[-1][1], e)
    return [tuple(x) for x in out]


@pytest.mark.parametrize("tile", [4, 64, 1 << 18])
def test_merge_crosses_tiles(spark, tile):
    rng = random.Random(1)
    spans = [(a, a + rng.randrange(1, 40)) for a in (rng.randrange(0, 3000) for _ in range(250))] + [(5, 900), (7, 7)]
    df = spark.createDataFrame([("c", *x) for x in spans], "c string, a bigint, b bigint")
    got = [(r.start, r.end) for r in op.merge_intervals(df, ["c"], "a", "b", tile=tile).orderBy("start").collect()]
    assert got == merged_by_hand(spans)


def test_membership_and_pairs_match_brute_force(spark):
    rng = random.Random(2)
    a = [(i, x, x + rng.randrange(0, 30)) for i, x in enumerate(rng.randrange(0, 500) for _ in range(80))]
    b = [(i, x, x + rng.randrange(0, 60)) for i, x in enumerate(rng.randrange(0, 500) for _ in range(40))]
    left = spark.createDataFrame([("c", *x) for x in a], "c string, i int, s bigint, e bigint")
    right = spark.createDataFrame([("c", *x) for x in b], "c string, j int, s2 bigint, e2 bigint")
    pairs = op.overlap_join(left, right, ["c"], start="s", end="e", other_start="s2", other_end="e2", bin_width=16)
    got = sorted((r.i, r.j) for r in pairs.collect())
    assert got == sorted((i, j) for i, s, e in a for j, s2, e2 in b if s <= e2 and e >= s2)
    merged = op.merge_intervals(right.withColumn("e2", F.col("e2") + 1), ["c"], "s2", "e2")
    probes = left.withColumn("e", F.col("e") + 1)
    flags = {r.i: r.overlaps for r in op.flag_overlaps_merged(probes, merged, ["c"], start="s", end="e", bin_width=16).collect()}
    assert flags == {i: any(s < e2 + 1 and e + 1 > s2 for _, s2, e2 in b) for i, s, e in a}


def test_chunks_of_consecutive_positions(spark):
    positions = [1, 2, 3, 4, 5, 9, 10, 20, 63, 64, 65, 66]
    df = spark.createDataFrame([("c", p) for p in positions], "c string, p int")
    got = [(r.chunk_start, r.chunk_end) for r in op.position_chunks(df, ["c"], "p", 2, tile=8).orderBy("chunk_start").collect()]
    assert got == [(1, 3), (3, 5), (5, 6), (9, 11), (20, 21), (63, 65), (65, 67)]


def test_runs_need_both_neighbours(spark):
    df = spark.createDataFrame([("c", b, ok) for b, ok in [(0, True), (5, True), (10, True), (15, False), (20, True), (30, True)]], "c string, b bigint, ok boolean")
    got = {r.b: r.in_run for r in op.neighbour_run(df, ["c"], position="b", eligible=F.col("ok"), step=5).collect()}
    assert got == {0: False, 5: True, 10: False, 15: False, 20: False, 30: False}


def spans(seed, n, longest):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = rng.randrange(-500, 5000)
        out.append((rng.choice(["x", "y", None]), i, a, a + rng.choice([0, 3, 40, rng.randrange(longest)])))
    return out


@pytest.mark.parametrize("bin_width", [1, 16, 4096])
def test_overlap_join_of_any_length(spark, bin_width):
    rows, others = spans(1, 120, 5000), spans(2, 120, 900)
    left = spark.createDataFrame(rows, "g string, i int, s long, e long")
    right = spark.createDataFrame(others, "g string, j int, s2 long, e2 long")
    pairs = op.overlap_join(left, right, ["g"], start="s", end="e", other_start="s2", other_end="e2", bin_width=bin_width)
    got = sorted((r.i, r.j) for r in pairs.collect())
    assert got == sorted((i, j) for g, i, s, e in rows for h, j, s2, e2 in others if g == h and g and s <= e2 and e >= s2)


def test_long_intervals_make_few_rows(spark):
    df = spark.createDataFrame([(0, 10**9), (5, 5)], "s long, e long")
    assert op._nested_bins(df, "s", "e", 64, first=False).count() <= 2 * 2 * (op.LEVELS + 2)


@pytest.mark.parametrize("bin_width, limit", [(1, None), (16, 4), (1024, None)])
def test_greedy_intervals(spark, bin_width, limit):
    rows = spans(3, 200, 700)
    df = spark.createDataFrame(rows, "g string, i int, s long, e long")
    found = op.greedy_intervals(df, ["g"], key="i", start="s", end="e", order=[F.col("i") % 5], bin_width=bin_width, limit=limit)
    want = []
    for g in {r[0] for r in rows}:
        kept = []
        for _, i, s, e in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] % 5, r[1])):
            if all(s > e2 or e < s2 for _, s2, e2 in kept) and (limit is None or len(kept) < limit):
                kept.append((i, s, e))
        want += [(g, i, s, e, k + 1) for k, (i, s, e) in enumerate(kept)]
    key = lambda r: (r[0] or "", r[4])
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(want, key=key)


def test_greedy_intervals_are_dealt_over_tasks(spark, monkeypatch):
    df = spark.createDataFrame(spans(3, 60, 300)[:40], "g string, i int, s long, e long").coalesce(1)

    def run():
        found = op.greedy_intervals(df, ["g"], key="i", start="s", end="e", order=[F.col("i") % 5], bin_width=16)
        return sorted(map(str, found.collect()))

    whole, seen, dealt = run(), [], type(df).repartition
    monkeypatch.setattr(op, "CANDIDATES_PER_TASK", 15)
    monkeypatch.setattr(type(df), "repartition", lambda self, n, *by: (seen.append(n), dealt(self, n, *by))[1])
    assert run() == whole and seen[0] == -(-df.count() // 15) and min(seen) < seen[0]


def test_greedy_intervals_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g string, i int, s long, e long")
    assert op.greedy_intervals(df, ["g"], key="i", start="s", end="e", order=[F.col("i")], bin_width=8).collect() == []


@pytest.mark.parametrize("name", ["merged_intervals", "overlaps_merged_set"])
def test_the_sql_of_merged_intervals_does_not_depend_on_ties(name):
    import duckdb

    from sitewright.plans import ORACLES

    con = duckdb.connect()
    # equal intervals everywhere: each group has four islands of three distinct intervals, every one 50 times
    con.execute("CREATE TABLE orders AS SELECT i AS o_orderkey, i // 12 % 500 AS o_custkey, DATE '1995-01-01' + (i % 4 * 100 + i % 3)::INTEGER AS o_orderdate FROM range(300000) t(i)")
    con.execute("CREATE TABLE lineitem AS SELECT o_orderkey AS l_orderkey, 1 AS l_linenumber, 20.0::DOUBLE AS l_quantity FROM orders")
    con.execute("CREATE TABLE customer AS SELECT DISTINCT o_custkey AS c_custkey FROM orders")
    for _ in range(3):
        if name == "merged_intervals":
            found = con.execute(ORACLES[name]).fetchall()
            assert len(found) == 2000 and {(r[1], r[2], r[3]) for r in found} == {(100 * k, 100 * k + 23, 150) for k in range(4)}
        else:
            told = '"overlaps" <> (a % 100 < 23 AND a < 400 OR b > a // 100 * 100 + 100 AND a < 300)'
            assert con.execute(f"SELECT count(*) FROM ({ORACLES[name]}) WHERE {told}").fetchone()[0] == 0


@pytest.mark.parametrize("levels", [0, 2])
def test_overlap_join_with_fewer_levels(spark, levels):
    rows, others = spans(3, 120, 500), spans(4, 120, 300)
    left = spark.createDataFrame(rows, "g string, i int, s long, e long")
    right = spark.createDataFrame(others, "g string, j int, s2 long, e2 long")
    pairs = op.overlap_join(left, right, ["g"], start="s", end="e", other_start="s2", other_end="e2", bin_width=64, levels=levels)
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.i, r.j) for r in pairs.collect())
    assert got == sorted((i, j) for g, i, s, e in rows for h, j, s2, e2 in others if g == h and g and s <= e2 and e >= s2)
    short = spark.createDataFrame([(0, 40), (70, 75)], "s long, e long")
    assert op._nested_bins(short, "s", "e", 64, first=False, levels=levels).count() == 2 * (2 + levels)


def lifted_by_hand(pos, blocks):
    best = None
    for chain, score, s, e, t, strand in blocks:
        if s <= pos - 1 < e:
            lifted = 9000 - (t + pos - 1 - s) if strand == "-" else t + pos - s
            best = min(best or (1, 0, 0, ""), (-score, chain, lifted, strand))
    return (best[2], best[3]) if best else (None, None)


def test_lift_over_many_covering_blocks(spark):
    from sitewright.sources import readers

    rng = random.Random(5)
    blocks = []
    for i in range(300):
        s = rng.randrange(0, 900)
        blocks.append((i // 2, i % 5 + 1, s, s + rng.choice([0, 1, 7, 64, 513, 4000]), rng.randrange(3000), rng.choice("+-")))
    told = [(c, k, "x", s, e, "t", t, d, 9000) for c, k, s, e, t, d in blocks]
    table = spark.createDataFrame(told, "chain_id long, score long, source_chrom string, source_start long, source_end long, target_chrom string, target_start long, target_strand string, target_size long")
    variants = spark.createDataFrame([(i, c, p) for i, (c, p) in enumerate([(c, p) for c in ("x", "y", None) for p in [*range(1, 1500, 7), 5000, None]])], "id int, chrom string, pos long")
    found = readers.lift_positions(variants, table, chrom="chrom", pos="pos", key=["id"]).collect()
    assert len(found) == variants.count()
    for r in found:
        want = lifted_by_hand(r.pos, blocks) if r.chrom == "x" and r.pos is not None else (None, None)
        assert (r.lifted_pos, r.lifted_strand) == want
    # as many rows meet a position as there are levels, not as many as blocks cover it
    assert op.covering_nodes(table.select(F.lit(0).alias("s"), F.lit(4096).alias("e")), "s", "e").count() == 300
