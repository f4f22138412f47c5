"""Grouped summaries, two-level means, weighting, pivots and completeness tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import guarded_ratio, neg_log10
from .ranking import best_row, distribution, join_back

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}
DECILES = {"q10": 0.10, "q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.90}


def sem(value: str) -> Column:
    """Standard error of the mean; NULL for a single value."""
    return F.stddev_samp(value) / F.sqrt(F.count(value).cast("double"))


def fraction(condition: Column) -> Column:
    """Share of rows with a known condition for which it holds."""
    return F.avg(condition.cast("double"))


def mean_and_size(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias(f"mean_{value}"), F.count(F.lit(1)).alias("n"))


def replicate_consensus(
    df: DataFrame, by: Sequence[str], *, value: str, p_value: str | None = None, totals: Sequence[str] = ()
) -> DataFrame:
    """Mean, sample sd (0 for one replicate), replicate count, smallest p and summed counts per key."""
    extra = [F.min(p_value).alias("min_p")] if p_value else []
    extra += [F.sum(c).alias(f"total_{c}") for c in totals]
    return df.groupBy(*by).agg(
        F.avg(value).alias("mean_effect"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd_effect"),
        F.count(F.lit(1)).alias("n_replicates"),
        *extra,
    )


def group_summary(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    *,
    unit: str | None = None,
    threshold: float | None = None,
    quantiles: dict[str, float] | None = None,
    **split: int,
) -> DataFrame:
    """Moments, sign fractions and exact quantiles of each group, with the distinct ``unit`` count if asked for."""
    by = list(by)
    summary = distribution(df, by, value, {"median": 0.5} if quantiles is None else quantiles, threshold=threshold, **split)
    if unit is None:
        return summary
    units = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count_distinct(unit).alias("n_units"))
    return summary.join(units, by)


def two_level_summary(df: DataFrame, by: Sequence[str], replicate: Sequence[str], value: str, **split: int) -> DataFrame:
    """Mean inside each replicate, then mean, SEM and median over the replicates."""
    by = list(by)
    inner = df.groupBy(*by, *replicate).agg(F.avg(value).alias("_m"))
    outer = distribution(inner, by, "_m", {"median": 0.5}, **split)
    return outer.select(
        *by, "mean", (F.col("sd") / F.sqrt(F.col("n").cast("double"))).alias("sem"), "median", F.col("n").alias("n_replicates")
    )


def joined_labels(df: DataFrame, by: Sequence[str], label: str, *, separator: str = ",", name: str = "labels") -> DataFrame:
    """Sorted distinct labels of each key as one string; duplicates vanish before anything is gathered."""
    by = list(by)
    return (
        df.where(F.col(label).isNotNull())
        .select(*by, label)
        .distinct()
        .groupBy(*by)
        .agg(F.array_join(F.sort_array(F.collect_list(F.col(label).cast("string"))), separator).alias(name))
    )


def fused_records(df: DataFrame, by: Sequence[str], *, rank: str, share: str, reads: str, order: Sequence[Column], first: Sequence[str], label: str) -> DataFrame:
    """Best rank, largest share, summed reads, the first row's fields and the joined labels of each key."""
    by = list(by)
    core = df.groupBy(*by).agg(
        F.min(rank).alias("best_rank"),
        F.max(share).alias("max_share"),
        F.sum(reads).alias("total_reads"),
        F.min_by(F.struct(*first), F.struct(*order)).alias("_first"),
    )
    return (
        core.join(joined_labels(df, by, label, name="sources"), by, "left")
        .select("*", *[F.col(f"_first.{c}").alias(c) for c in first])
        .drop("_first")
    )


def inverse_variance(df: DataFrame, by: Sequence[str], *, beta: str, variance: str, p_value: str | None = None, unit: str | None = None) -> DataFrame:
    """Inverse-variance weighted mean and its standard error; variances below 1e-12 count as 1e-12."""
    w = F.lit(1.0) / F.greatest(F.col(variance), F.lit(1e-12))
    aggregates = [
        (F.sum(F.col(beta) * w) / F.sum(w)).alias("beta_ivw"),
        F.sqrt(F.lit(1.0) / F.sum(w)).alias("se_ivw"),
    ]
    if p_value:
        aggregates += [F.min(p_value).alias("min_p"), F.max(neg_log10(p_value)).alias("max_neglog10_p")]
    if unit:
        aggregates.append(F.count_distinct(unit).alias("n_units"))
    return df.groupBy(*by).agg(*aggregates)


def modal_value(df: DataFrame, by: Sequence[str], value: str, *, preferred: Column | None = None) -> DataFrame:
    """Most frequent value of each key among preferred rows, among all rows when none is preferred.
    Ties go to the smaller value; a missing value is never the mode, so a key with nothing else has none."""
    by = list(by)
    flag = F.coalesce(preferred, F.lit(False)) if preferred is not None else F.lit(True)
    counts = df.groupBy(*by, value).agg(
        F.count(F.when(flag, 1)).alias("_preferred"), F.count(F.lit(1)).alias("_all")
    )
    known = F.col(value).isNotNull()
    best = counts.groupBy(*by).agg(
        F.min(F.when(known & (F.col("_preferred") > 0), F.struct(-F.col("_preferred"), F.col(value)))).alias("_p"),
        F.min(F.when(known, F.struct(-F.col("_all"), F.col(value)))).alias("_a"),
    )
    return best.select(
        *by,
        F.coalesce(F.col(f"_p.{value}"), F.col(f"_a.{value}")).alias(value),
        (-F.coalesce(F.col("_p.col1"), F.col("_a.col1"), F.lit(0))).alias("support"),
        F.col("_p").isNotNull().alias("from_preferred"),
    )


def share_of_total(df: DataFrame, by: Sequence[str], value: str, *, name: str = "share") -> DataFrame:
    """value / sum(value) of its key: totals are aggregated first and joined back."""
    by = list(by)
    totals = df.groupBy(*by).agg(F.sum(value).alias("_total"))
    joined = join_back(df, totals, by)
    return joined.withColumn(name, guarded_ratio(value, "_total", 0.0)).drop("_total")


def weighted_mixture(df: DataFrame, by: Sequence[str], *, share: str, value: str) -> DataFrame:
    """Sum of share * value per key with the summed shares."""
    return df.groupBy(*by).agg(
        F.sum(F.col(share) * F.col(value)).alias("mixture"),
        F.count(F.lit(1)).alias("n_parts"),
        F.sum(share).alias("share_sum"),
    )


def track_window_mean(
    df: DataFrame,
    by: Sequence[str],
    *,
    track: str,
    value: str,
    in_window: Column,
    strand_matched: Column,
) -> DataFrame:
    """Mean over window positions per track, then over tracks: all of them, the strand-matched ones, and the
    primary value that prefers the matched mean."""
    by = list(by)
    per_track = (
        df.where(in_window)
        .withColumn("_matched", strand_matched)
        .groupBy(*by, track)
        .agg(F.avg(value).alias("_m"), F.max("_matched").alias("_matched"))
    )
    return (
        per_track.groupBy(*by)
        .agg(
            F.avg("_m").alias("mean_all"),
            F.avg(F.when(F.col("_matched"), F.col("_m"))).alias("mean_matched"),
            F.count(F.lit(1)).alias("n_tracks"),
            F.count(F.when(F.col("_matched"), 1)).alias("n_matched"),
        )
        .withColumn("primary_mean", F.coalesce("mean_matched", "mean_all"))
    )


def with_composite(df: DataFrame, by: Sequence[str], *, member: str, members: Sequence[str], label: str, value: str) -> DataFrame:
    """Append a group holding the mean of a subset of groups."""
    composite = (
        df.where(F.col(member).isin(*members))
        .groupBy(*by)
        .agg(F.avg(value).alias(value))
        .withColumn(member, F.lit(label))
    )
    return df.select(*by, member, value).unionByName(composite.select(*by, member, value))


def coordinated_score(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Smallest value over the members when all of them are positive, else 0; with plain min and mean."""
    return df.groupBy(*by).agg(
        F.when(F.min(value) > 0, F.min(value)).otherwise(F.lit(0.0)).alias("score"),
        F.min(value).alias("min_delta"),
        F.avg(value).alias("mean_delta"),
    )


def best_coordinated(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Best row per position by (score, min, mean) descending, then the remaining columns ascending."""
    rest = [c for c in df.columns if c not in {*by, "score", "min_delta", "mean_delta"}]
    order = [-F.col("score"), -F.col("min_delta"), -F.col("mean_delta"), *[F.col(c) for c in rest]]
    return best_row(df, by, order)


def pivot_mean(df: DataFrame, by: Sequence[str], column: str, levels: Sequence, value: str, *, prefix: str = "") -> DataFrame:
    """Wide table over an explicit list of levels: one conditional mean per level."""
    return df.groupBy(*by).agg(
        *[F.avg(F.when(F.col(column) == level, F.col(value))).alias(f"{prefix}{level}") for level in levels]
    )


def pivot_many(df: DataFrame, by: Sequence[str], column: str, levels: Sequence, values: Sequence[str]) -> DataFrame:
    """Several values pivoted at once, columns named ``<value>_<level>``."""
    return df.groupBy(*by).agg(
        *[
            F.avg(F.when(F.col(column) == level, F.col(v))).alias(f"{v}_{level}")
            for v in values
            for level in levels
        ]
    )


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], *, variable: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(columns), variable, value)


def completeness(df: DataFrame, by: Sequence[str], member: str, expected: int) -> DataFrame:
    """Distinct members per key and whether all of them are present."""
    return (
        df.groupBy(*by)
        .agg(F.count_distinct(member).alias("n_members"), F.count(F.lit(1)).alias("n_rows"))
        .withColumn("complete", F.col("n_members") == expected)
    )


def interaction_effect(
    df: DataFrame, by: Sequence[str], *, role: str, state: str, value: str, high: str, lows: Sequence[str], treated: str, control: str, native: str
) -> DataFrame:
    """(treated - control) at the high site minus the mean of the same difference at the low sites; keys that
    lack the native row or any role/state drop out."""
    roles = [high, *lows]

    def cell(r: str, s: str) -> Column:
        return (F.col(role) == r) & (F.col(state) == s)

    aggregates = [
        F.count(F.when(F.col(state) == native, 1)).alias("_native_n"),
        F.max(F.when(F.col(state) == native, F.col(value))).alias("native_value"),
    ]
    for i, r in enumerate(roles):
        for s, tag in ((treated, "t"), (control, "c")):
            aggregates.append(F.max(F.when(cell(r, s), F.col(value))).alias(f"_{i}{tag}"))
            aggregates.append(F.count(F.when(cell(r, s), 1)).alias(f"_{i}{tag}_n"))
    wide = df.groupBy(*by).agg(*aggregates)
    complete = F.col("_native_n") == 1
    for i in range(len(roles)):
        complete = complete & (F.col(f"_{i}t_n") > 0) & (F.col(f"_{i}c_n") > 0)
    deltas = [F.col(f"_{i}t") - F.col(f"_{i}c") for i in range(len(roles))]
    low_mean = sum(deltas[1:], F.lit(0.0)) / F.lit(float(len(lows)))
    return wide.where(complete).select(
        *by,
        "native_value",
        deltas[0].alias("high_delta"),
        low_mean.alias("mean_low_delta"),
        (deltas[0] - low_mean).alias("interaction"),
    )


def scaled_by_largest(df: DataFrame, by: Sequence[str], value: str, *, name: str = "scaled") -> DataFrame:
    """value / max(abs(value)) of its group, the divisor kept above 1e-12."""
    by = list(by)
    peaks = df.groupBy(*by).agg(F.max(F.abs(value)).alias("_peak"))
    return df.join(peaks, by, "left").withColumn(name, F.col(value) / F.greatest(F.col("_peak"), F.lit(1e-12))).drop("_peak")


def boundary_surface(
    df: DataFrame,
    geometry: Sequence[str],
    *,
    condition: str,
    outside: str,
    inside: str,
    value: str,
    replicate: str,
    keep_at_least: float,
    keep_at_most: float,
    extra_criterion: Column | None = None,
    **split: int,
) -> DataFrame:
    """Both conditions of every geometry side by side with the mean and median retention criteria."""
    geometry = list(geometry)
    summary = group_summary(
        df.where(F.col(condition).isin(outside, inside)), [*geometry, condition], value, unit=replicate, threshold=keep_at_least, **split
    )
    measures = ["n_units", "mean", "median", "sd", "min", "max", "fraction_at_least"]
    sides = {outside: "outside", inside: "inside"}
    paired = summary.groupBy(*geometry).agg(
        *[
            F.max(F.when(F.col(condition) == level, F.col(m))).alias(f"{tag}_{m}")
            for level, tag in sides.items()
            for m in measures
        ],
        F.count(F.lit(1)).alias("_conditions"),
    )
    gate = F.lit(True) if extra_criterion is None else extra_criterion
    return (
        paired.where(F.col("_conditions") == 2)
        .drop("_conditions")
        .withColumn("passes_mean", (F.col("outside_mean") >= keep_at_least) & (F.col("inside_mean") <= keep_at_most) & gate)
        .withColumn("passes_median", (F.col("outside_median") >= keep_at_least) & (F.col("inside_mean") <= keep_at_most) & gate)
    )


def composition_percentages(df: DataFrame, *, total: Column, unedited: Column, modeled: Column) -> DataFrame:
    """Read totals split into unedited, modelled and other, with the edited and covered percentages."""
    sums = df.agg(F.sum(total).alias("total_reads"), F.sum(unedited).alias("unedited_reads"), F.sum(modeled).alias("modeled_reads"))
    edited = F.col("total_reads") - F.col("unedited_reads")
    return sums.select(
        "*",
        (edited - F.col("modeled_reads")).alias("other_reads"),
        guarded_ratio(F.lit(100.0) * edited, F.col("total_reads"), 0.0).alias("edited_percent"),
        guarded_ratio(F.lit(100.0) * F.col("modeled_reads"), edited, 0.0).alias("modeled_percent"),
    )
