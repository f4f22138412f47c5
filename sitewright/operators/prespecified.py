"""Statistics that the analysis plans specify: matched sampling, ranking quality, exact intervals, adjusted
p-values and control-adjusted effects; their bootstraps are in ``replicates``."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.expressions import guarded_ratio, keyed_digest
from .ranking import SPLIT_EVERY, exact_quantiles, join_back, row_positions, top_rows, value_ranks, with_cells


def matched_sample(
    cases: DataFrame,
    controls: DataFrame,
    levels: Sequence[Sequence[str]],
    *,
    key: str,
    seed: int,
    store: str | None = None,
    split_every: int = SPLIT_EVERY,
) -> DataFrame:
    """One control per case without replacement, drawn at random inside strata. ``levels`` lists the stratum columns
    from strict to relaxed; a case left over at one level tries the next with the controls still free.

    Each level reads the pairs of all levels before it. With ``store``, a folder that all executors share, a level's
    pairs are written there once, so the work grows with the number of levels; without it the plan repeats them."""
    strata = sorted({c for level in levels for c in level})
    free_cases, free_controls, found = cases.select(key, *strata), controls.select(key, *strata), None
    for number, level in enumerate(levels):

        def placed(df: DataFrame, side: str) -> DataFrame:
            order = [keyed_digest(seed, side, F.col(key)), F.col(key)]
            return row_positions(df, level, order, name="_place", split_every=split_every)

        pairs = (
            placed(free_cases, "case")
            .join(placed(free_controls, "control").select(*level, "_place", F.col(key).alias("control")), [*level, "_place"])
            .select(F.col(key).alias("case"), "control", F.lit(number).alias("level"))
        )
        if store is not None:
            path = f"{store}/level-{number}"
            pairs.write.parquet(path)
            pairs = pairs.sparkSession.read.schema(pairs.schema).parquet(path)
        found = pairs if found is None else found.unionByName(pairs)
        free_cases = free_cases.join(pairs.select(F.col("case").alias(key)), key, "left_anti")
        free_controls = free_controls.join(pairs.select(F.col("control").alias(key)), key, "left_anti")
    return found


def ranking_quality(df: DataFrame, by: Sequence[str], *, score: str, positive: Column, split_every: int = SPLIT_EVERY) -> DataFrame:
    """ROC AUC from mid-ranks and PR AUC as average precision, ties at one threshold taken together."""
    by = list(by)
    rows = df.where(F.col(score).isNotNull()).withColumn("_y", F.coalesce(positive.cast("int"), F.lit(0)))
    everything = value_ranks(rows, by, score, split_every=split_every)
    hits = value_ranks(rows, by, score, weight="_y", split_every=split_every).select(
        *by, score, F.col("n").alias("p"), F.col("n_less").alias("p_less"), F.col("n_total").alias("p_total")
    )
    negatives, negatives_below = F.col("n") - F.col("p"), F.col("n_less") - F.col("p_less")
    precision = (F.col("p_total") - F.col("p_less")) / (F.col("n_total") - F.col("n_less"))
    sums = join_back(everything, hits, [*by, score]).groupBy(*by).agg(
        F.max("n_total").alias("n"),
        F.max("p_total").alias("n_positive"),
        F.sum(F.col("p") * (negatives_below + F.lit(0.5) * negatives)).alias("_u"),
        F.sum(F.col("p") * precision).alias("_ap"),
    )
    pairs = F.col("n_positive") * (F.col("n") - F.col("n_positive"))
    return sums.select(
        *by, "n", "n_positive", guarded_ratio("_u", pairs, 0.0).alias("roc_auc"), guarded_ratio("_ap", "n_positive", 0.0).alias("pr_auc")
    )


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function of whole columns, by its continued fraction."""
    x = np.clip(x, 1e-300, 1 - 1e-16)
    flip = x > (a + 1.0) / (a + b + 2.0)  # the fraction converges fast on the other side
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - x, x)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    fraction, c, d = np.ones_like(x), np.ones_like(x), np.zeros_like(x)
    for i in range(400):
        m = i // 2
        if i == 0:
            term = np.ones_like(x)
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + term * d
        d = 1.0 / np.where(d == 0, 1e-300, d)
        c = 1.0 + term / c
        c = np.where(c == 0, 1e-300, c)
        fraction = fraction * c * d
        if (np.abs(c * d - 1.0) < 1e-15).all():
            break
    out = front * (fraction - 1.0)
    return np.where(flip, 1.0 - out, out)


def _beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bisection of whole columns at once."""
    low, high = np.zeros_like(a), np.ones_like(a)
    for _ in range(60):
        middle = 0.5 * (low + high)
        below = _incomplete_beta(a, b, middle) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return 0.5 * (low + high)


@F.pandas_udf(StructType([StructField("low", DoubleType()), StructField("high", DoubleType())]))
def exact_binomial_interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Exact 95% interval of a proportion; NULL where there are no trials."""
    k, n = k.to_numpy(float), n.to_numpy(float)
    known = n > 0
    a, rest = np.where(known, k, 1.0), np.where(known, n - k, 1.0)
    low = np.where(a == 0, 0.0, _beta_quantile(0.025, np.maximum(a, 1.0), rest + 1.0))
    high = np.where(rest == 0, 1.0, _beta_quantile(0.975, a + 1.0, np.maximum(rest, 1.0)))
    return pd.DataFrame({"low": np.where(known, low, np.nan), "high": np.where(known, high, np.nan)})


def adjusted_p_values(df: DataFrame, by: Sequence[str], p: str, *, name: str = "q", split_every: int = SPLIT_EVERY) -> DataFrame:
    """False-discovery-rate adjusted p-values: the smallest p * n / rank among this and all larger p."""
    by = list(by)
    raw = value_ranks(df, by, p, split_every=split_every).withColumn("_q", F.col(p) * F.col("n_total") / (F.col("n_less") + F.col("n")))
    celled = with_cells(raw.select(*by, p, "_q"), by, p, split_every=split_every)
    later = Window.partitionBy(*by).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    per_cell = celled.groupBy(*by, "_cell").agg(F.min("_q").alias("_m")).select(*by, "_cell", F.min("_m").over(later).alias("_later"))
    onwards = Window.partitionBy(*by, "_cell").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    adjusted = join_back(celled, per_cell, [*by, "_cell"]).select(
        *by, p, F.least(F.min("_q").over(onwards), F.col("_later"), F.lit(1.0)).alias(name)
    )
    return join_back(df, adjusted, [*by, p], "left")


def control_adjusted(df: DataFrame, by: Sequence[str], *, effect: str, is_control: Column, split_every: int = SPLIT_EVERY) -> DataFrame:
    """Effects of the non-control rows minus the median control effect of their key."""
    by = list(by)
    medians = exact_quantiles(df.where(is_control), by, effect, {"control_median": 0.5}, split_every=split_every)
    adjusted = join_back(df.where(~is_control), medians, by, "left")
    return adjusted.withColumn("adjusted_effect", F.col(effect) - F.col("control_median"))


def top_sign_agreement(df: DataFrame, by: Sequence[str], *, order: Sequence[Column], n: int, x: str, y: str) -> DataFrame:
    """Share of the top ``n`` rows of each key whose two effects have the same sign."""
    top = top_rows(df, by, order, n)
    return top.groupBy(*by).agg(
        F.avg((F.signum(x) == F.signum(y)).cast("double")).alias("sign_agreement"), F.count(F.lit(1)).alias("n")
    )
