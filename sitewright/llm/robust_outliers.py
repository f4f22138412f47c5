"""Quality rules: text statistics and robust multivariate outliers by minimum-covariance-determinant estimates."""

from __future__ import annotations

import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chosen_path import GOLDEN, KEPT_WORDS, SLICE_WORDS, mixed
from .common import staged, text_slices

WINDOW = 5
SYMBOLS = re.compile(r"[#*$%&|<>]")
SPACES = re.compile(r"[\x20\x09-\x0D]")
UPPER = re.compile(r"[A-ZÀ-ÖØ-ÞА-Я]")
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
#: Least standard deviation of each part of the transformed vector, so that a statistic which most texts do not show at
#: all (symbols, repeats) has a scale. A part that scatters more in a pool keeps its own scatter.
FLOORS = (0.1, 0.01, 0.04, 0.06, 0.03, 0.005)
#: Parts that are means over a text's words or letters: their error falls with the root of the text's length.
MEANS = (1, 5)
#: Relative ridge, so that parts which move together in a pool still have an inverse.
RIDGE = 1e-6
SALTS = 16


@cache
def word_codes() -> dict[bytes, int]:
    return {}


def statistics(texts: list[str]) -> list[tuple[int, ...]]:
    """Per text the values of ``STATISTICS``. Words are what the six ASCII white space characters part."""
    words = [text.encode().split() for text in texts]
    known = word_codes()
    if len(known) > KEPT_WORDS:
        known.clear()
    for word in set(chain.from_iterable(words)):
        if word not in known:
            known[word] = xxhash.xxh64_intdigest(word)
    factors = mixed(np.arange(1, WINDOW + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)
    out = []
    for text, row in zip(texts, words):
        repeated = 0
        if len(row) > WINDOW:
            codes = np.fromiter(map(known.__getitem__, row), np.uint64, len(row))
            total = np.zeros(len(codes) - WINDOW + 1, np.uint64)
            for k in range(WINDOW):
                total += codes[k : k + len(total)] * factors[k]
            ordered = np.sort(total)
            twice = ordered[1:][ordered[1:] == ordered[:-1]]
            if len(twice):
                starts = np.flatnonzero(np.isin(total, twice))
                covered = np.zeros(len(codes), bool)
                for k in range(WINDOW):
                    covered[starts + k] = True
                repeated = int(covered.sum())
        lines = [line for line in text.split("\n") if SPACES.sub("", line)] if "\n" in text else [text] if row else []
        out.append(
            (
                len(row),
                len(text) - sum(map(text.count, " \t\n\r\x0b\x0c")),
                len(SYMBOLS.findall(text)),
                len(lines) - len(set(lines)),
                repeated,
                len(lines),
                len(UPPER.findall(text)),
            )
        )
    return out


def text_statistics(docs: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """The columns ``keep`` and the statistics of every whole text; a null text is an empty one."""

    def run(batches):
        for batch in batches:
            values = [row for _, _, texts in text_slices(batch.column(len(keep)), SLICE_WORDS) for row in statistics(texts)]
            columns = list(zip(*values)) if values else [()] * len(STATISTICS)
            made = [pa.array(c, pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *made], names=[*names, *STATISTICS])

    names = [f"keep_{i}" for i in range(len(keep))]
    source = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text_column).alias(text_column))
    fields = [T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, keep)]
    found = source.mapInArrow(run, T.StructType([*fields, *(T.StructField(s, T.LongType()) for s in STATISTICS)]))
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], *STATISTICS)


def transformed() -> Column:
    """Length, word length, and the shares of symbols, repeated lines, repeated words and capitals."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return F.array(
        F.log1p(F.col("n_words").cast("double")),
        F.log(chars / words),
        F.sqrt(F.col("n_symbols") / chars),
        F.col("n_dup_lines") / lines,
        F.col("n_repeat_words") / words,
        F.col("n_upper") / chars,
    )


def robust_outliers(
    docs: DataFrame,
    least_words: int = 10,
    most_repeated_percent: int = 20,
    cutoff: float = 28.0,
    inside: float = 0.75,
    steps: int = 6,
    least_rows: int = 60,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    source_column: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: the id, the statistics, ``base_failed``, ``distance`` and ``kept``.

    Base rule: fewer than ``least_words`` words, or more than ``most_repeated_percent`` percent of words in repeated
    windows. The others are judged in pools of one language and source; sources with fewer than ``least_rows`` such
    documents share a pool of their language, languages with fewer a common one, and if that is smaller still its documents are
    kept. In each pool the location and scatter with the smallest determinant are sought by concentration steps: from
    medians and median deviations on, the ``inside`` share of rows nearest to the estimate gives the next one. A pool's own
    scatter counts; only a part that hardly varies in it is given ``FLOORS``. Distances are
    squared, and shrink so that a pool's median is at most that of a chi-square; ``kept`` is false above ``cutoff`` (about the 0.9999 quantile of that chi-square).

    Everything is estimated from all rows: each step is two grouped aggregates over the small table of statistics,
    combined before they are shuffled, and a join of rows with their pool's estimate, spread over salts.
    Null texts are empty; null languages and sources are values of their own; ties change nothing, since rows at the
    cut distance all count; an empty table gives no rows; further columns are not read."""
    stats = text_statistics(docs, [id_column, lang_column, source_column], text_column)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated_percent * F.col("n_words"))
    stats = stats.toDF("id", "lang", "source", *STATISTICS).withColumn("base_failed", failed)
    stats = stats.withColumn("v", transformed()).withColumn("salt", F.pmod(F.xxhash64("id", *STATISTICS), F.lit(SALTS)).cast("int"))
    stats = staged(stats.withColumn("lang", F.to_json(F.struct("lang"))).withColumn("source", F.to_json(F.struct("source"))), "statistics")
    rows = staged(_pooled(stats, least_rows), "pooled")
    judged = rows.filter("pool IS NOT NULL")

    p = len(FLOORS)
    middle = [F.percentile_approx(F.col("v")[i], 0.5, 2000).alias(f"m{i}") for i in range(p)]
    centre = judged.groupBy("pool").agg(*middle).select("pool", F.array(*[f"m{i}" for i in range(p)]).alias("mean"))
    away = _salted(judged, staged(centre, "centre"))
    spread = away.groupBy("pool", "mean").agg(*[F.percentile_approx(F.abs(_deviation(i)), 0.5, 2000).alias(f"s{i}") for i in range(p)])
    scale = [F.greatest(1.4826 * F.col(f"s{i}"), F.lit(FLOORS[i])) for i in range(p)]
    inverse = F.array(*[1 / (s * s) if i == j else F.lit(0.0) for i, s in enumerate(scale) for j in range(p)])
    estimate = staged(spread.select("pool", "mean", inverse.alias("inverse")), "estimate")
    for _ in range(steps):
        near = _distances(judged, estimate)
        cut = near.groupBy("pool").agg(F.percentile_approx("distance", inside, 2000).alias("cut"))
        core = _salted(judged, staged(estimate.join(cut, "pool"), "cut")).withColumn("distance", _quadratic()).filter("distance <= cut")
        sums = [F.avg(F.col("v")[i]).alias(f"a{i}") for i in range(p)]
        sums += [F.covar_pop(_deviation(i), _deviation(j)).alias(f"c{i}_{j}") for i in range(p) for j in range(i + 1)]
        estimate = staged(core.groupBy("pool").agg(*sums).mapInArrow(_inverted, "pool string, mean array<double>, inverse array<double>"), "estimate")
    near = _distances(judged, estimate)
    # the nearest share is less scattered than all rows: where half of the distances exceed the median of the chi-square
    # with as many degrees of freedom, they shrink to it
    usual = F.lit(p * (1 - 2 / (9 * p)) ** 3)
    middle = near.groupBy("pool").agg(F.greatest(F.percentile_approx("distance", 0.5, 2000), usual).alias("half"))
    final = _salted(rows, staged(estimate.join(middle, "pool"), "final"), "left")
    final = final.withColumn("distance", _quadratic() / F.col("half") * usual)
    return final.select(
        F.col("id").alias(id_column),
        *STATISTICS[:5],
        "base_failed",
        "distance",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"),
    )


def _pooled(stats: DataFrame, least: int) -> DataFrame:
    """``pool`` of each row that passed the base rule: what it is compared within, null where too few are left."""
    fine = stats.filter("NOT base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    fine = staged(fine, "sizes")
    small = fine.filter(F.col("n") < least)
    coarse = small.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    rest = coarse.filter(F.col("lang_n") < least).agg(F.coalesce(F.sum("lang_n"), F.lit(0)).alias("rest_n"))
    names = fine.join(coarse, "lang", "left").crossJoin(F.broadcast(rest))  # one row
    pool = (
        F.when(F.col("n") >= least, F.concat(F.lit("s"), "lang", "source"))
        .when(F.col("lang_n") >= least, F.concat(F.lit("l"), "lang"))
        .when(F.col("rest_n") >= least, F.lit("r"))
    )
    spread = names.select("lang", "source", pool.alias("pool"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = stats.join(spread, ["lang", "source", "salt"], "left").drop("lang", "source")
    return joined.withColumn("pool", F.when(~F.col("base_failed"), F.col("pool")))


def _salted(rows: DataFrame, pools: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with their pool's estimate; a pool that holds much of all rows is dealt over salts."""
    spread = pools.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(spread, ["pool", "salt"], how)


def _deviation(i: int) -> Column:
    """A row's deviation from its pool's location; means of texts shorter than the pool's usual one shrink by the root of
    the ratio of lengths, to the scale of a text of the usual length."""
    away = F.col("v")[i] - F.col("mean")[i]
    return away * F.least(F.lit(1.0), F.exp((F.col("v")[0] - F.col("mean")[0]) / 2)) if i in MEANS else away


def _quadratic() -> Column:
    p = len(FLOORS)
    d = [_deviation(i) for i in range(p)]
    return sum(F.col("inverse")[i * p + j] * d[i] * d[j] for i in range(p) for j in range(p))


def _distances(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    return _salted(rows, estimate).select("pool", _quadratic().alias("distance"))


def _inverted(batches):
    """Per pool the mean and the inverse of the covariance; variances below the square of their floor are raised to it."""
    p = len(FLOORS)
    for batch in batches:
        means, inverses = [], []
        for row in batch.to_pylist():
            cov = np.zeros((p, p))
            for i in range(p):
                for j in range(i + 1):
                    cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
            np.fill_diagonal(cov, np.maximum(np.diag(cov), np.square(FLOORS)) * (1 + RIDGE))
            means.append([row[f"a{i}"] for i in range(p)])
            inverses.append(np.linalg.inv(cov).ravel().tolist())
        kind = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column("pool"), pa.array(means, kind), pa.array(inverses, kind)], names=["pool", "mean", "inverse"])
