"""Golden-table comparison and dataset validation as data: specifications in, verdict rows out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import finite
from .association import pearson
from .joins import compare_sides
from .resampling import proportion_tolerance


@dataclass(frozen=True)
class Tolerance:
    column: str
    rtol: float = 1e-5
    atol: float = 1e-6
    min_r: float | None = None


def compare_values(joined: DataFrame, specs: Sequence[Tolerance]) -> DataFrame:
    """One verdict row per column of a table that carries ``<column>_gen`` and ``<column>_ref``. Missing equals
    missing, missing against a number fails, and a requested correlation that is undefined fails."""
    structs = [
        F.struct(
            F.lit(s.column).alias("column"),
            F.col(f"{s.column}_gen").cast("double").alias("v_gen"),
            F.col(f"{s.column}_ref").cast("double").alias("v_ref"),
            F.lit(s.rtol).alias("rtol"),
            F.lit(s.atol).alias("atol"),
            F.lit(s.min_r).cast("double").alias("min_r"),
        )
        for s in specs
    ]
    long = joined.select(F.explode(F.array(*structs)).alias("_s")).select("_s.*")
    g, r = F.col("v_gen"), F.col("v_ref")
    fg, fr = finite(g), finite(r)
    both = fg.isNotNull() & fr.isNotNull()
    gap = F.when(both, F.abs(fg - fr))
    gone_g, gone_r = g.isNull() | F.isnan(g), r.isNull() | F.isnan(r)
    close = ~gone_g & ~gone_r & F.coalesce((gap <= F.col("atol") + F.col("rtol") * F.abs(fr)) | (g == r), F.lit(False))
    summary = long.groupBy("column", "rtol", "atol", "min_r").agg(
        F.count(gap).alias("n"),
        F.max(gap).alias("max_abs_difference"),
        F.avg(gap).alias("mean_abs_difference"),
        pearson(F.when(both, fg), F.when(both, fr)).alias("pearson_r"),
        F.bool_and(close | (gone_g & gone_r)).alias("all_close"),
    )
    correlated = F.col("min_r").isNull() | F.coalesce(F.col("pearson_r") >= F.col("min_r"), F.lit(False))
    return summary.withColumn("passed", F.col("all_close") & (F.col("n") > 0) & correlated)


def compare_tables(
    generated: DataFrame, expected: DataFrame, keys: Sequence[str], specs: Sequence[Tolerance], *, expected_rows: int | None = None
) -> DataFrame:
    """Column verdicts plus a "rows" verdict: no one-sided keys and, if given, the expected row count."""
    joined = compare_sides(generated, expected, keys, [s.column for s in specs])
    shared = joined.where(F.col("side") == "both")
    values = compare_values(shared, specs).select("column", "n", "max_abs_difference", "pearson_r", "passed")
    counts = joined.agg(
        F.count(F.when(F.col("side") == "both", 1)).alias("n"),
        F.count(F.when(F.col("side") != "both", 1)).alias("_odd"),
    )
    right_size = F.lit(True) if expected_rows is None else F.col("n") == expected_rows
    rows = counts.select(
        F.lit("rows").alias("column"),
        "n",
        F.lit(None).cast("double").alias("max_abs_difference"),
        F.lit(None).cast("double").alias("pearson_r"),
        ((F.col("_odd") == 0) & right_size).alias("passed"),
    )
    return values.unionByName(rows)


def compare_matrices(generated: DataFrame, expected: DataFrame, row_label: str, columns: Sequence[str], spec: Tolerance) -> DataFrame:
    """Labels exact, values toleranced: both matrices are melted and compared by (row, column)."""
    def long(df: DataFrame) -> DataFrame:
        return df.unpivot([row_label], list(columns), "column_label", spec.column)

    return compare_tables(long(generated), long(expected), [row_label, "column_label"], [spec])


def set_overlap_gate(generated: DataFrame, expected: DataFrame, keys: Sequence[str], minimum: float) -> DataFrame:
    """Share of the expected keys that were generated, against a minimum."""
    g = generated.select(*keys).distinct().withColumn("_g", F.lit(1))
    e = expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    sides = g.join(e, list(keys), "full_outer")
    return sides.agg(
        F.count(F.when(F.col("_g").isNotNull() & F.col("_e").isNotNull(), 1)).alias("n_shared"),
        F.count(F.when(F.col("_e").isNull(), 1)).alias("n_generated_only"),
        F.count(F.when(F.col("_g").isNull(), 1)).alias("n_expected_only"),
        F.count("_e").alias("n_expected"),
    ).withColumn("overlap", F.col("n_shared") / F.when(F.col("n_expected") > 0, F.col("n_expected"))).withColumn(
        "passed", F.coalesce(F.col("overlap") >= minimum, F.lit(False))
    )


def rank_gate(df: DataFrame, by: Sequence[str], *, value: str, target: Column, worst_rank: int) -> DataFrame:
    """Rank of the target's absolute value in its group (ties share the best rank) against the worst accepted one:
    a count of larger values, no ranking of the group."""
    by = list(by)
    targets = df.where(target).groupBy(*by).agg(F.max(F.abs(value)).alias("_t"))
    joined = df.join(targets, by)
    return (
        joined.groupBy(*by)
        .agg((F.count(F.when(F.abs(value) > F.col("_t"), 1)) + 1).alias("target_rank"), F.count(value).alias("n"))
        .withColumn("passed", F.col("target_rank") <= worst_rank)
    )


def proportion_gate(joined: DataFrame, *, generated: str, expected: str, clusters: str, expected_clusters: str) -> DataFrame:
    """Per-row check of a proportion difference against its sampling bound."""
    return (
        joined.withColumn("difference", F.abs(F.col(generated) - F.col(expected)))
        .withColumn("tolerance", proportion_tolerance(clusters, expected_clusters))
        .withColumn("passed", F.col("difference") <= F.col("tolerance"))
    )


def reconcile_manifest(manifest: DataFrame, files: DataFrame, *, path: str = "path", digest: str = "sha256") -> DataFrame:
    """State of every path known to either side: ok, missing, checksum_mismatch or unrecorded."""
    m = manifest.select(path, F.col(digest).alias("recorded"))
    f = files.select(path, F.col(digest).alias("actual"))
    state = (
        F.when(F.col("actual").isNull(), "missing")
        .when(F.col("recorded").isNull(), "unrecorded")
        .when(F.col("actual") != F.col("recorded"), "checksum_mismatch")
        .otherwise("ok")
    )
    return m.join(f, path, "full_outer").withColumn("state", state)


@dataclass(frozen=True)
class Rule:
    """A named row rule: ``broken`` is the condition that makes the row a violation."""

    name: str
    broken: Column
    message: str
    severity: str = "error"


def blank(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column), F.lit(""))) == ""


def not_in_vocabulary(column: str, allowed: Sequence[str]) -> Column:
    return ~F.coalesce(F.col(column), F.lit("")).isin(*allowed)


def is_placeholder(column: str, prefixes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(column), F.lit("")).startswith(p) for p in prefixes])


def unknown_tokens(column: str, allowed: Sequence[str], separator: str = ";") -> Column:
    """True when a token list holds anything outside the vocabulary; blanks are ignored."""
    tokens = F.filter(F.transform(F.split(F.coalesce(F.col(column), F.lit("")), separator), lambda t: F.trim(t)), lambda t: t != "")
    return F.size(F.array_except(tokens, F.array(*[F.lit(a) for a in allowed]))) > 0


def row_violations(df: DataFrame, rules: Sequence[Rule], *, table: str, key: str) -> DataFrame:
    """All broken rules of all rows in one pass."""
    found = [
        F.when(
            F.coalesce(r.broken, F.lit(False)),
            F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message")),
        )
        for r in rules
    ]
    return df.select(
        F.lit(table).alias("table"), F.col(key).cast("string").alias("key"), F.explode(F.array_compact(F.array(*found))).alias("_v")
    ).select("table", "key", "_v.*")


def duplicate_keys(df: DataFrame, keys: Sequence[str], *, table: str, severity: str = "error") -> DataFrame:
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    return repeated.select(
        F.lit(table).alias("table"),
        F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"),
        F.lit("duplicate_key").alias("rule"),
        F.lit(severity).alias("severity"),
        F.lit("key occurs more than once").alias("message"),
    )


def size_reconciliation(files: DataFrame, *, size: str, digest: str, expected_count: int | None = None, expected_bytes: int | None = None) -> DataFrame:
    """Counts and bytes against their expectations, and digests of the wrong shape."""
    summary = files.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("total_bytes"),
        F.count(F.when(~F.coalesce(F.col(digest).rlike("^[0-9a-f]{64}$"), F.lit(False)), 1)).alias("bad_digests"),
    )
    fits = F.lit(True)
    if expected_count is not None:
        fits = fits & (F.col("n_files") == expected_count)
    if expected_bytes is not None:
        fits = fits & (F.col("total_bytes") == expected_bytes)
    return summary.withColumn("passed", fits & (F.col("bad_digests") == 0))


def marker_scan(texts: DataFrame, *, key: str, text: str, markers: Sequence[str]) -> DataFrame:
    """Texts that contain any of the forbidden markers, one row per (text, marker)."""
    hits = [F.when(F.contains(F.col(text), F.lit(m)), F.lit(m)) for m in markers]
    return texts.select(F.col(key), F.explode(F.array_compact(F.array(*hits))).alias("marker"))


def violation_summary(violations: DataFrame) -> DataFrame:
    """Violations per severity and the overall verdict: no errors."""
    return violations.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_keys"))


def overall_pass(verdicts: DataFrame, passed: str = "passed") -> DataFrame:
    return verdicts.agg(
        F.coalesce(F.bool_and(passed), F.lit(False)).alias("passed"),
        F.count(F.lit(1)).alias("n_checks"),
        F.count(F.when(~F.col(passed), 1)).alias("n_failed"),
    )
