"""Scalar column expressions: guarded ratios, fold changes, Fisher z, keyed hashing, missing values."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.96
CORRELATION_CLIP = 0.999999
SMALLEST_NORMAL = 2.2250738585072014e-308


def col(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def finite(x: str | Column) -> Column:
    """NaN and +/-inf become NULL so that aggregates skip them."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def missing_to_null(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every floating column; applied once at the scan."""
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(
        *[
            F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) if c in floats else F.col(c)
            for c in df.columns
        ]
    )


def guarded_ratio(numerator: str | Column, denominator: str | Column, floor: float = 1e-12) -> Column:
    """numerator / denominator, NULL where abs(denominator) does not exceed ``floor``."""
    d = col(denominator)
    return col(numerator) / F.when(F.abs(d) > F.lit(floor), d)


def percent_change(value: str | Column, baseline: str | Column) -> Column:
    b = col(baseline)
    return F.lit(100.0) * (col(value) - b) / F.when(b != 0, b)


def percent_from_log_change(x: str | Column) -> Column:
    """100 * (exp(x) - 1)."""
    return F.lit(100.0) * F.expm1(col(x))


def log2_fold_change(value: str | Column, baseline: str | Column) -> Column:
    """log2(value / baseline), NULL unless both are positive."""
    v, b = col(value), col(baseline)
    return F.when((v > 0) & (b > 0), F.log2(v / F.when(b > 0, b)))


def log10_with_offset(x: str | Column, offset: float) -> Column:
    return F.log10(col(x) + F.lit(offset))


def neg_log10(p: str | Column) -> Column:
    return -F.log10(F.greatest(col(p), F.lit(SMALLEST_NORMAL)))


def fisher_z(r: str | Column) -> Column:
    return F.atanh(F.least(F.greatest(col(r), F.lit(-CORRELATION_CLIP)), F.lit(CORRELATION_CLIP)))


def fisher_bound(r: str | Column, n: str | Column, side: int, z: float = Z95) -> Column:
    """Lower (side=-1) or upper (side=+1) confidence bound of a correlation over n pairs."""
    spread = F.lit(float(z)) / F.when(col(n) > 3, F.sqrt(col(n).cast("double") - 3.0))
    return F.tanh(fisher_z(r) + F.lit(float(side)) * spread)


def mean_of(columns: list[str | Column]) -> Column:
    """Row-wise mean over the present values; NULL when none is present."""
    present = [F.when(col(c).isNotNull(), F.lit(1)).otherwise(0) for c in columns]
    total = reduce(lambda a, b: a + b, [F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in columns])
    n = reduce(lambda a, b: a + b, present)
    return total / F.when(n > 0, n)


def largest_of(columns: list[str | Column]) -> Column:
    return F.greatest(*[col(c) for c in columns])


def hash_index(modulus: int | Column, *parts: object) -> Column:
    """Deterministic pseudo-random index in [0, modulus) keyed by ``parts`` (columns or literals): a 60-bit digest, so the
    remainder is even for any number of rows."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    number = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    return number % (modulus if isinstance(modulus, Column) else F.lit(int(modulus)))


def keyed_digest(*parts: object) -> Column:
    """Hex digest used as a random sort key."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def check(condition: Column, message: Column | str, value: Column) -> Column:
    """``value`` where ``condition`` holds, otherwise fail the job with ``message``."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.raise_error(text))


def with_checks(df: DataFrame, condition: Column, message: Column | str) -> DataFrame:
    """Fail the job on the first row that breaks ``condition``; rows pass through unchanged."""
    return df.where(check(condition, message, F.lit(True)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def format_general(x: str | Column, digits: int = 10) -> Column:
    """printf's %g with ``digits`` significant digits. The number's exact value is rounded, as printf does: Java's own
    formats round its shortest decimal text, which goes up where that text ends in a 5 that the value lies below."""

    @F.pandas_udf("string")
    def render(values: pd.Series) -> pd.Series:
        return pd.Series([f"%.{digits}g" % v for v in values], dtype=object)

    v = col(x).cast("double")
    return F.when(v.isNotNull(), render(v))
