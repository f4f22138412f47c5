import math

import pytest
from pyspark.sql import functions as F

from sitewright.operators.association import chi2_tail, erfc


def test_erfc(spark):
    z = [0.0, 1e-8, 0.3, 1.0, 1.999, 2.0, 2.5, 4.0, 9.0, 26.0]
    df = spark.createDataFrame([(v,) for v in z], "z double")
    got = [r[0] for r in df.select(erfc(F.col("z"))).collect()]
    assert got == pytest.approx([math.erfc(v) for v in z], rel=1e-11, abs=1e-300)


def lower_series(half, shape):
    """1 - P(shape, half) by the series of the lower incomplete gamma function."""
    term = total = math.exp(shape * math.log(half) - half - math.lgamma(shape + 1))
    for n in range(1, 2000):
        term *= half / (shape + n)
        total += term
    return 1 - total


@pytest.mark.parametrize("df", [1, 2, 3, 4, 7, 10, 31, 200, 2001])
def test_chi_square_tail(spark, df):
    q = [0.01, 0.5, df * 0.6, df * 1.0, df + 3 * math.sqrt(2 * df)]
    rows = spark.createDataFrame([(v, df) for v in q], "q double, df bigint")
    got = [r[0] for r in rows.select(chi2_tail("q", "df")).collect()]
    assert got == pytest.approx([lower_series(v / 2, df / 2) for v in q], abs=1e-10)


def test_chi_square_tail_odd_values(spark):
    rows = spark.createDataFrame([(None, 3), (2.0, None), (0.0, 3), (-1.0, 2), (5.0, 0), (1e6, 3)], "q double, df bigint")
    assert [r[0] for r in rows.select(chi2_tail("q", "df")).collect()] == [None, None, 1.0, 1.0, 1.0, 0.0]
