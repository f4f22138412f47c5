import pytest

from sitewright.operators import prespecified as ps


def test_exact_interval_known_values(spark):
    df = spark.createDataFrame([(0, 10), (3, 10), (10, 10)], "k bigint, n bigint")
    rows = df.withColumn("ci", ps.exact_binomial_interval("k", "n")).orderBy("k").collect()
    assert [(r.ci.low, r.ci.high) for r in rows] == [
        pytest.approx((0.0, 0.3084971), abs=1e-6), pytest.approx((0.0667395, 0.6524529), abs=1e-6), pytest.approx((0.6915029, 1.0), abs=1e-6),
    ]


@pytest.mark.parametrize("every", [2, 4096])
def test_adjusted_p_values(spark, every):
    p = [0.01, 0.04, 0.03, 0.005, 0.5, 0.9, 0.04]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    got = [r.q for r in ps.adjusted_p_values(df, [], "p", split_every=every).orderBy("i").collect()]
    n, order = len(p), sorted(range(len(p)), key=lambda i: -p[i])
    want, best = [0.0] * n, 1.0
    for k, i in enumerate(order):
        best = min(best, p[i] * n / (n - k))
        want[i] = best
    # tied p-values share the value of the largest rank
    want[1] = want[6] = min(want[1], want[6])
    assert got == pytest.approx(want)


def test_controls_are_used_once(spark):
    cases = spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "k int, a int, b int")
    controls = spark.createDataFrame([(100 + i, 0, 0) for i in range(5)], "k int, a int, b int")
    rows = ps.matched_sample(cases, controls, [["a", "b"], ["b"]], key="k", seed=1).collect()
    assert len(rows) == 5 and len({r.control for r in rows}) == 5 and len({r.case for r in rows}) == 5
    assert sum(r.level == 0 for r in rows) == 3
