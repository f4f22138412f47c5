import pytest

from sitewright.operators import quality as qc


def verdict(spark, observed, expected, **tolerance):
    rows = [(float(o) if o is not None else None, float(e) if e is not None else None) for o, e in zip(observed, expected)]
    df = spark.createDataFrame(rows, "x_gen double, x_ref double")
    return qc.compare_values(df, [qc.Tolerance("x", **tolerance)]).collect()[0]


def test_close_values_pass(spark):
    assert verdict(spark, [1, 2 + 1e-7], [1, 2]).passed


def test_tolerance_and_minimum_correlation(spark):
    r = verdict(spark, [1, 2.1, 3], [1, 2, 3], rtol=0.0, atol=0.11, min_r=0.99)
    assert r.passed and r.atol == 0.11 and r.min_r == 0.99 and r.max_abs_difference == pytest.approx(0.1)


def test_missing_equals_missing_only(spark):
    nan = float("nan")
    assert verdict(spark, [1, nan, None], [1, nan, None]).passed
    assert not verdict(spark, [1, nan], [1, 2]).passed
    assert not verdict(spark, [1, 2], [1, None]).passed


def test_undefined_correlation_fails_a_requested_minimum(spark):
    assert verdict(spark, [1, 1], [1, 1]).passed
    assert not verdict(spark, [1, 1], [1, 1], min_r=0.5).passed
    assert not verdict(spark, [None], [None]).passed


def test_expected_row_count(spark):
    g = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, x double")
    rows = {r.column: r.passed for r in qc.compare_tables(g, g, ["k"], [qc.Tolerance("x")], expected_rows=3).collect()}
    assert rows == {"x": True, "rows": False}


def test_manifest_states(spark):
    m = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    f = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "path string, sha256 string")
    got = {r.path: r.state for r in qc.reconcile_manifest(m, f).collect()}
    assert got == {"a": "ok", "b": "checksum_mismatch", "c": "missing", "d": "unrecorded"}


def test_unknown_tokens_ignore_blanks(spark):
    df = spark.createDataFrame([("a; b",), ("a;;",), ("a;z",), (None,)], "t string")
    assert [r.u for r in df.select(qc.unknown_tokens("t", ["a", "b"]).alias("u")).collect()] == [False, False, True, False]


def test_overall_fails_with_any_failure(spark):
    df = spark.createDataFrame([(True,), (False,)], "passed boolean")
    assert qc.overall_pass(df).collect()[0].passed is False
    assert qc.overall_pass(df.where("passed")).collect()[0].passed is True
    assert qc.violation_summary(spark.createDataFrame([("e", "k")], "severity string, key string")).count() == 1
