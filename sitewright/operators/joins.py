"""Joins with contracts: checked cardinality, NULL-matching keys, unordered allele pairs, prioritised fallback,
paired states, shared baselines and chained lookups. Broadcast is left to the planner's size check."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import guarded_ratio
from ..functions.sequences import complement


def _unique_by(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Collapse to one row per key and fail the job where a key had several."""
    payload = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.first(F.struct(*payload) if payload else F.lit(1)).alias("_row")
    )
    message = F.concat(
        F.lit(f"{side} keys are not unique: "), F.to_json(F.struct(*keys)), F.lit(" x"), F.col("_n").cast("string")
    )
    kept = one.where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(message)))
    return kept.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in payload])


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], *, how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """Equi join that fails when the declared side ("one_to_one", "many_to_one", "one_to_many") repeats a key."""
    on = list(on)
    left_side, right_side = validate.split("_to_")
    if left_side == "one":
        left = _unique_by(left, on, "left")
    if right_side == "one":
        right = _unique_by(right, on, "right")
    return left.join(right, on, how)


def null_matching_join(left: DataFrame, right: DataFrame, on: Sequence[str], *, how: str = "inner") -> DataFrame:
    """Equi join in which NULL keys match each other."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])


def oriented_sign(ref: Column, alt: Column, lowering: Column, raising: Column) -> Column:
    """+1 when the alternate allele is the lowering one, -1 when the reference is, NULL on any other pair."""
    return F.when((alt == lowering) & (ref == raising), F.lit(1.0)).when(
        (ref == lowering) & (alt == raising), F.lit(-1.0)
    )


def _pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("/", F.least(a, b), F.greatest(a, b))


def allele_join(
    variants: DataFrame,
    records: DataFrame,
    on: Sequence[str],
    *,
    lowering: str,
    raising: str,
    ref: str,
    alt: str,
    strand: str | None = None,
    effect: str,
    oriented: str = "oriented_effect",
    how: str = "inner",
) -> DataFrame:
    """Match on position keys and the unordered allele pair, then orient the record's effect to the lowering
    allele. On a '-' strand variant the record's alleles are complemented first."""
    on = list(on)
    minus = F.col(strand) == "-" if strand else F.lit(False)
    # complementing the record on the minus strand equals complementing the variant's own pair for the key
    own = _pair_key(
        F.when(minus, complement(lowering)).otherwise(F.col(lowering)),
        F.when(minus, complement(raising)).otherwise(F.col(raising)),
    )
    joined = variants.withColumn("_pair", own).join(
        records.withColumn("_pair", _pair_key(F.col(ref), F.col(alt))), [*on, "_pair"], how
    )
    rec_ref = F.when(minus, complement(ref)).otherwise(F.col(ref))
    rec_alt = F.when(minus, complement(alt)).otherwise(F.col(alt))
    sign = oriented_sign(rec_ref, rec_alt, F.col(lowering), F.col(raising))
    return joined.withColumn(oriented, sign * F.col(effect)).drop("_pair")


def fallback_match(
    variants: DataFrame,
    records: DataFrame,
    *,
    position: str,
    lowering: str,
    raising: str,
    strand: str | None,
    ref: str,
    alt: str,
    order: Sequence[str],
    effect: str,
    carried: Sequence[str],
) -> DataFrame:
    """Left match in priority order: the first record with the variant's alleles gives effect and ``carried``;
    else the first record at the position gives ``carried`` with a NULL effect; else all NULL.

    Records shrink to one row per (position, allele pair) and one per position before the joins, so a crowded
    position costs one row on either side."""
    minus = F.col(strand) == "-" if strand else F.lit(False)
    pair = _pair_key(
        F.when(minus, complement(lowering)).otherwise(F.col(lowering)),
        F.when(minus, complement(raising)).otherwise(F.col(raising)),
    )
    order_key = F.struct(*[F.col(c) for c in order])
    per_pair = records.groupBy(position, _pair_key(F.col(ref), F.col(alt)).alias("_pair")).agg(
        F.min(order_key).alias("_order"),
        F.min_by(F.struct(ref, alt, effect, *carried), order_key).alias("_hit"),
    )
    per_position = per_pair.groupBy(position).agg(F.min_by("_hit", "_order").alias("_any"))
    joined = (
        variants.withColumn("_pair", pair)
        .join(per_pair.drop("_order"), [position, "_pair"], "left")
        .join(per_position, position, "left")
    )
    hit_ref = F.when(minus, complement("_hit." + ref)).otherwise(F.col("_hit." + ref))
    hit_alt = F.when(minus, complement("_hit." + alt)).otherwise(F.col("_hit." + alt))
    sign = oriented_sign(hit_ref, hit_alt, F.col(lowering), F.col(raising))
    status = (
        F.when(F.col("_hit").isNotNull(), F.lit("allele_match"))
        .when(F.col("_any").isNotNull(), F.lit("position_only"))
        .otherwise(F.lit("absent"))
    )
    return joined.select(
        *variants.columns,
        (sign * F.col("_hit." + effect)).alias("effect"),
        *[F.coalesce(F.col("_hit." + c), F.col("_any." + c)).alias(c) for c in carried],
        status.alias("match_status"),
    )


def paired_states(
    df: DataFrame, keys: Sequence[str], *, state: str, value: str, treated: str = "ALT", control: str = "REF"
) -> DataFrame:
    """Pair treated and control rows of each key in one aggregate; keys missing a state drop out and a state
    that occurs twice under a key fails the job. NULL key values pair with each other."""
    t, c = F.col(state) == treated, F.col(state) == control
    grouped = df.groupBy(*keys).agg(
        F.count(F.when(t, 1)).alias("_nt"),
        F.count(F.when(c, 1)).alias("_nc"),
        F.max(F.when(t, F.col(value))).alias(f"{value}_treated"),
        F.max(F.when(c, F.col(value))).alias(f"{value}_control"),
    )
    message = F.concat(F.lit("state repeats under one key: "), F.to_json(F.struct(*keys)))
    once = F.when((F.col("_nt") <= 1) & (F.col("_nc") <= 1), (F.col("_nt") == 1) & (F.col("_nc") == 1))
    return (
        grouped.where(once.otherwise(F.raise_error(message)))
        .withColumn("delta", F.col(f"{value}_treated") - F.col(f"{value}_control"))
        .drop("_nt", "_nc")
    )


def attach_baseline(
    df: DataFrame, keys: Sequence[str], *, is_baseline: Column, value: str, name: str, tolerance: float | None = None
) -> DataFrame:
    """Left-attach the baseline value of each key (mean over its baseline rows; NULL keys match each other).
    With ``tolerance`` the baseline rows of one key must agree within it."""
    keys = list(keys)
    return null_matching_join(df, replicate_value(df.where(is_baseline), keys, value, name, tolerance), keys, how="left")


def replicate_value(df: DataFrame, keys: Sequence[str], value: str, name: str, tolerance: float | None = None) -> DataFrame:
    """One row per key holding the mean of ``value``; with ``tolerance`` a larger spread fails the job."""
    grouped = df.groupBy(*keys).agg(
        F.avg(value).alias(name), (F.max(value) - F.min(value)).alias("_spread"), F.count(value).alias("_n")
    )
    if tolerance is not None:
        message = F.concat(
            F.lit("baseline rows disagree by "), F.col("_spread").cast("string"), F.lit(" at "), F.to_json(F.struct(*keys))
        )
        within = F.coalesce(F.col("_spread"), F.lit(0.0)) <= F.lit(tolerance)
        grouped = grouped.where(F.when(within, F.lit(True)).otherwise(F.raise_error(message)))
    return grouped.drop("_spread", "_n")


def retention(paired: DataFrame, keys: Sequence[str], *, is_native: Column, floor: float = 1e-12) -> DataFrame:
    """Absolute and signed retention of each paired delta relative to the native delta of ``keys``."""
    native = paired.where(is_native).select(*keys, F.col("delta").alias("native_delta"))
    joined = checked_join(paired, native, keys, how="inner", validate="many_to_one")
    return joined.withColumn("retention", guarded_ratio(F.abs("delta"), F.abs("native_delta"), floor)).withColumn(
        "signed_retention", guarded_ratio("delta", "native_delta", floor)
    )


def pending(candidates: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Candidates whose key is not in the finished set."""
    return candidates.join(done.select(*on), list(on), "left_anti")


def matching(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other.select(*on), list(on), "left_semi")


def same_position_same_alleles(
    left: DataFrame, right: DataFrame, on: Sequence[str], *, ref: str, alt: str, other_ref: str, other_alt: str, effect: str, oriented: str
) -> DataFrame:
    """Position join that keeps same or swapped allele pairs only and flips the effect of swapped ones."""
    joined = left.withColumn("_pair", _pair_key(F.col(ref), F.col(alt))).join(
        right.withColumn("_pair", _pair_key(F.col(other_ref), F.col(other_alt))), [*on, "_pair"]
    )
    same = (F.col(ref) == F.col(other_ref)) & (F.col(alt) == F.col(other_alt))
    return joined.withColumn(oriented, F.when(same, F.col(effect)).otherwise(-F.col(effect))).drop("_pair")


def chained_lookup(base: DataFrame, keys: Sequence[str], sources: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Left-join several sources on the same keys, taking only each one's new columns, one row per key."""
    keys = list(keys)

    def add(left: DataFrame, source: tuple[DataFrame, Sequence[str]]) -> DataFrame:
        frame, wanted = source
        new = [c for c in wanted if c not in left.columns]
        return left.join(frame.select(*keys, *new).dropDuplicates(keys), keys, "left")

    return reduce(add, sources, base)


def factor_grid(df: DataFrame, factors: dict[str, Sequence]) -> DataFrame:
    """Expand every row over the combinations of literal factor levels."""
    for name, levels in factors.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in levels])))
    return df


def compare_sides(generated: DataFrame, expected: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Full outer join with ``_gen`` / ``_ref`` columns and the side each row was found on."""
    keys = list(keys)
    g = generated.select(*keys, *[F.col(c).alias(f"{c}_gen") for c in columns], F.lit(True).alias("_in_gen"))
    e = expected.select(*keys, *[F.col(c).alias(f"{c}_ref") for c in columns], F.lit(True).alias("_in_ref"))
    side = (
        F.when(F.col("_in_gen").isNotNull() & F.col("_in_ref").isNotNull(), F.lit("both"))
        .when(F.col("_in_gen").isNotNull(), F.lit("generated_only"))
        .otherwise(F.lit("expected_only"))
    )
    return g.join(e, keys, "full_outer").withColumn("side", side).drop("_in_gen", "_in_ref")
