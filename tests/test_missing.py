"""NULL keys form a group like any other, and missing scores come last."""

import pytest
from pyspark.sql import functions as F

from sitewright.operators import aggregates as ag
from sitewright.operators import association as ac
from sitewright.operators import intervals as op
from sitewright.operators import ranking as rk
from sitewright.operators import resampling as rs
from sitewright.sources import writers


@pytest.fixture(scope="module")
def keyed(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", None), (None, 4.0), (None, 3.0), (None, None)]
    return spark.createDataFrame(rows, "g string, v double")


@pytest.mark.parametrize("split_every", [1, 4096])
def test_ranks_keep_null_groups(keyed, split_every):
    got = {(r.g, r.v, r.n_less, r.n_total) for r in rk.value_ranks(keyed, ["g"], "v", split_every=split_every).collect()}
    assert got == {("a", 1.0, 0, 2), ("a", 2.0, 1, 2), (None, 3.0, 0, 2), (None, 4.0, 1, 2)}
    placed = rk.row_positions(keyed, ["g"], [F.coalesce("v", F.lit(9.0))], split_every=split_every)
    assert sorted((r.g or "", r.position) for r in placed.collect()) == [("", 1), ("", 2), ("", 3), ("a", 1), ("a", 2), ("a", 3)]
    ranked = rk.attach_ranks(keyed, ["g"], "v", {"r": rk.mid_rank()}, split_every=split_every).collect()
    assert {(r.g, r.v, r.r) for r in ranked} == {("a", 1.0, 1.0), ("a", 2.0, 2.0), ("a", None, None), (None, 3.0, 1.0), (None, 4.0, 2.0), (None, None, None)}


def test_summaries_keep_null_groups(keyed):
    rows = {r.g: r for r in rk.distribution(keyed, ["g"], "v", {"median": 0.5}).collect()}
    assert rows[None].n == 2 and rows[None].median == 3.5
    shares = ag.share_of_total(keyed, ["g"], "v").collect()
    assert len(shares) == 6 and {round(r.share, 6) for r in shares if r.g is None and r.v} == {round(3 / 7, 6), round(4 / 7, 6)}
    bins = rs.quantile_bins(keyed, ["g"], "v", 2).collect()
    assert {(r.g, r.v, r.quantile_bin) for r in bins if r.v} == {("a", 1.0, 1), ("a", 2.0, 2), (None, 3.0, 1), (None, 4.0, 2)}
    pairs = keyed.withColumn("w", -F.col("v"))
    assert {(r.g, round(r.spearman, 6)) for r in ac.correlation_summary(pairs, ["g"], "v", "w").collect()} == {("a", -1.0), (None, -1.0)}


def test_intervals_keep_null_groups(spark):
    rows = [("a", 1, 5), ("a", 4, 9), (None, 2, 3), (None, 3, 8), (None, 20, 30)]
    df = spark.createDataFrame(rows, "g string, s long, e long")
    got = {(r.g, r.start, r.end) for r in op.merge_intervals(df, ["g"], "s", "e", tile=2).collect()}
    assert got == {("a", 1, 9), (None, 2, 8), (None, 20, 30)}


def test_missing_scores_come_last(spark, keyed):
    assert {(r.g, r.v) for r in rk.best_row(keyed, ["g"], [-F.col("v")]).collect()} == {("a", 2.0), (None, 4.0)}
    assert {(r.g, r.v) for r in rk.top_rows(keyed, ["g"], [-F.col("v")], 1).collect()} == {("a", 2.0), (None, 4.0)}
    stamped = spark.createDataFrame([(1, None, "x"), (1, 5, "y"), (2, None, "z")], "k int, scored_at int, v string")
    assert {(r.k, r.v) for r in writers.keep_last(stamped, ["k"]).collect()} == {(1, "y"), (2, "z")}
    windows = spark.createDataFrame([(0, None), (3, 7.0), (6, 9.0)], "s long, v double")
    picks = op.greedy_non_overlapping(windows, [], start="s", width=3, order=[-F.col("v")], limit=1).collect()
    assert [p.s for p in picks] == [6]


def test_a_missing_value_is_never_the_mode(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("a", 4), ("b", None), (None, 2)], "g string, v int")
    assert {(r.g, r.v, r.support) for r in ag.modal_value(df, ["g"], "v").collect()} == {("a", 4, 1), ("b", None, 0), (None, 2, 1)}


def test_forced_member_keeps_equal_rows(spark):
    df = spark.createDataFrame([("g", "x", 9.0), ("g", "x", 9.0), ("g", "x", 9.0), ("g", "y", 1.0), (None, "y", 5.0)], "g string, m string, v double")
    rows = rk.force_member(df, ["g"], [-F.col("v")], 3, F.col("m") == "y").collect()
    assert sorted((r.g or "", r.m, r["rank"]) for r in rows) == [("", "y", 1), ("g", "x", 2), ("g", "x", 3), ("g", "y", 1)]


def test_strata_are_drawn_apart(spark):
    rows = [(band, c, c % 3 == 0) for band in ("p", "q", None) for c in range(40)]
    df = spark.createDataFrame(rows, "band string, c int, pos boolean")
    counts = rs.cluster_counts(df, ["band"], "c", F.col("pos"))
    draws = rs.cluster_draws(counts, ["band"], cluster="c", replicates=5, seed=1).collect()
    by_band = {b: sorted((r._b, r.c, r._times) for r in draws if r.band == b) for b in ("p", "q", None)}
    assert by_band["p"] != by_band["q"]
    assert all(sum(t for _, _, t in v) == 200 for v in by_band.values())
