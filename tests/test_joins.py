import pytest
from pyspark.sql import functions as F

from sitewright.operators import aggregates as ag
from sitewright.operators import joins as jn
from sitewright.operators import resampling as rs


def test_checked_join_rejects_a_repeated_key(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (1, "y")], "k int, r string")
    with pytest.raises(Exception, match="right keys are not unique"):
        jn.checked_join(left, right, ["k"]).collect()
    assert jn.checked_join(right, left, ["k"], validate="many_to_one").count() == 2
    with pytest.raises(Exception, match="left keys are not unique"):
        jn.checked_join(right, left, ["k"], validate="one_to_one").collect()


def test_null_keys_match_each_other(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("y", 20)], "k string, b int")
    assert [(r.k, r.a, r.b) for r in jn.null_matching_join(a, b, ["k"]).collect()] == [(None, 1, 10)]


def test_baseline_from_duplicate_and_null_keyed_rows(spark):
    rows = [("h1", "g", 0, 0.5), ("h1", "g", 0, 0.5), ("h2", "g", 0, 0.9), ("h1", "n", None, 0.25), ("h1", "n", None, 0.25)]
    df = spark.createDataFrame(rows, "hash string, gene string, track int, v double")
    out = jn.attach_baseline(df, ["gene", "track"], is_baseline=F.col("hash") == "h1", value="v", name="base", tolerance=1e-9)
    got = {(r.hash, r.gene): r.base for r in out.collect()}
    assert got == {("h1", "g"): 0.5, ("h2", "g"): 0.5, ("h1", "n"): 0.25}
    assert out.count() == 5


def test_disagreeing_baseline_rows_fail(spark):
    df = spark.createDataFrame([("h1", "g", 0.5), ("h1", "g", 0.9)], "hash string, gene string, v double")
    with pytest.raises(Exception, match="baseline rows disagree"):
        jn.attach_baseline(df, ["gene"], is_baseline=F.col("hash") == "h1", value="v", name="base", tolerance=1e-9).collect()


def test_paired_states_needs_both_and_rejects_repeats(spark):
    df = spark.createDataFrame([("a", "REF", 1.0), ("a", "ALT", 3.0), ("b", "REF", 1.0)], "k string, allele string, v double")
    rows = jn.paired_states(df, ["k"], state="allele", value="v").collect()
    assert [(r.k, r.delta) for r in rows] == [("a", 2.0)]
    with pytest.raises(Exception, match="state repeats"):
        jn.paired_states(df.union(df), ["k"], state="allele", value="v").collect()


def test_retention_of_a_silent_native_state_is_unknown(spark):
    df = spark.createDataFrame([("native", 1, 0.0), ("x", 1, 2.0), ("native", 2, 4.0), ("x", 2, -2.0)], "c string, seed int, delta double")
    out = {(r.c, r.seed): (r.retention, r.signed_retention) for r in jn.retention(df, ["seed"], is_native=F.col("c") == "native").collect()}
    assert out[("x", 1)] == (None, None)
    assert out[("x", 2)] == (0.5, -0.5)


def test_fallback_match_prefers_alleles_then_first_record(spark):
    v = spark.createDataFrame([(1, "A", "G", "+"), (2, "A", "G", "+"), (3, "A", "G", "+"), (4, "A", "G", "-")], "pos int, low string, high string, s string")
    r = spark.createDataFrame(
        [(1, "C", "T", 9.0, 0.1, 0), (1, "G", "A", 2.0, 0.2, 1), (2, "C", "T", 9.0, 0.3, 0), (2, "T", "C", 8.0, 0.4, 1), (4, "T", "C", 5.0, 0.5, 0)],
        "pos int, ref string, alt string, b double, se double, o int",
    )
    out = jn.fallback_match(v, r, position="pos", lowering="low", raising="high", strand="s", ref="ref", alt="alt", order=["o"], effect="b", carried=["se"])
    got = {x.pos: (x.effect, x.se, x.match_status) for x in out.collect()}
    assert got == {1: (2.0, 0.2, "allele_match"), 2: (None, 0.3, "position_only"), 3: (None, None, "absent"), 4: (-5.0, 0.5, "allele_match")}


def test_interaction_needs_every_role(spark):
    rows = [("p", r, s, v) for r, s, v in [("high", "T", 5.0), ("high", "G", 1.0), ("l1", "T", 2.0), ("l1", "G", 1.0), ("l2", "T", 1.0), ("l2", "G", 2.0), ("nat", "native", 3.0)]]
    rows += [("q", "high", "T", 1.0), ("q", "nat", "native", 1.0)]
    df = spark.createDataFrame(rows, "p string, role string, state string, v double")
    out = ag.interaction_effect(df, ["p"], role="role", state="state", value="v", high="high", lows=["l1", "l2"], treated="T", control="G", native="native").collect()
    assert [(r.p, r.high_delta, r.mean_low_delta, r.interaction) for r in out] == [("p", 4.0, 0.0, 4.0)]


def test_quantile_bins_drop_repeated_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 1, 1, 2, 3, 4, 5]], "v double")
    got = sorted((r.v, r.b) for r in rs.quantile_bins(df, [], "v", 5, name="b").collect())
    import pandas as pd

    want = pd.qcut(pd.Series([1, 1, 1, 1, 1, 1, 2, 3, 4, 5.0]), 5, labels=False, duplicates="drop") + 1
    assert [b for _, b in got] == list(want)


def test_right_closed_cut_includes_the_lowest_edge(spark):
    df = spark.createDataFrame([(v,) for v in [49.0, 50.0, 150.0, 150.1, 300.0, 301.0]], "v double")
    got = [r.b for r in df.select("v", rs.cut_right_closed(F.col("v"), [50, 150, 300]).alias("b")).orderBy("v").collect()]
    assert got == [None, 1, 1, 2, 2, None]


def test_poisson_bootstrap_agrees_with_the_multinomial_one(spark):
    df = spark.range(4000).select((F.col("id") % 200).alias("c"), ((F.col("id") * 7919) % 10 < 6).alias("p"))
    a, b = (
        rs.cluster_bootstrap(df, [], cluster="c", positive=F.col("p"), replicates=300, seed=5, method=m).collect()[0]
        for m in ("multinomial", "poisson")
    )
    assert a.fraction == b.fraction == pytest.approx(0.6)
    # 200 all-or-nothing clusters: the bounds lie about 0.07 from the point and carry resampling noise
    assert a.ci_low == pytest.approx(b.ci_low, abs=0.03) and a.ci_high == pytest.approx(b.ci_high, abs=0.03)
    assert b.ci_low < b.fraction < b.ci_high
