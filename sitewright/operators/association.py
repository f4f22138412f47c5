"""Correlation, meta-analysis, linear fits and haplotype covariance."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import Z95, bound, col, finite, fisher_bound, fisher_z, guarded_ratio
from .ranking import SPLIT_EVERY, join_back, mid_rank, value_ranks


def complete_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows where both values are present and finite."""
    return df.withColumn(x, finite(x)).withColumn(y, finite(y)).where(F.col(x).isNotNull() & F.col(y).isNotNull())


def pearson(x: str | Column, y: str | Column) -> Column:
    """Correlation aggregate over complete pairs; NULL when either side is constant."""
    a, b = col(x), col(y)
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return guarded_ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b), 0.0)


def spearman(
    df: DataFrame, by: Sequence[str], x: str, y: str, *, weight: str | None = None, split_every: int = SPLIT_EVERY
) -> DataFrame:
    """Rank correlation with mid-ranks over the complete pairs of each group.

    Pairs are counted per distinct (x, y), ranked on each axis, and summed about the known mean rank."""
    by = list(by)
    pairs = (
        complete_pairs(df, x, y)
        .groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
        .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).cast("bigint").alias("_w"))
    )
    rank_x = value_ranks(pairs, by, "_x", weight="_w", split_every=split_every).select(
        *by, "_x", mid_rank().alias("_rx"), F.col("n_total").alias("_n")
    )
    rank_y = value_ranks(pairs, by, "_y", weight="_w", split_every=split_every).select(*by, "_y", mid_rank().alias("_ry"))
    center = (F.col("_n") + 1) / F.lit(2.0)
    dx, dy, w = F.col("_rx") - center, F.col("_ry") - center, F.col("_w")
    sums = (
        join_back(join_back(pairs, rank_x, [*by, "_x"]), rank_y, [*by, "_y"])
        .groupBy(*by)
        .agg(F.sum(w * dx * dy).alias("_xy"), F.sum(w * dx * dx).alias("_xx"), F.sum(w * dy * dy).alias("_yy"), F.sum(w).alias("n"))
    )
    return sums.select(*by, "n", guarded_ratio("_xy", F.sqrt(F.col("_xx") * F.col("_yy")), 0.0).alias("spearman"))


def correlation_summary(df: DataFrame, by: Sequence[str], x: str, y: str, *, split_every: int = SPLIT_EVERY) -> DataFrame:
    """Pearson, Spearman with its Fisher-z interval, sign agreement and n per group."""
    by = list(by)
    clean = complete_pairs(df, x, y)
    linear = clean.groupBy(*by).agg(
        pearson(x, y).alias("pearson"), F.avg((F.signum(x) == F.signum(y)).cast("double")).alias("direction_agreement")
    )
    ranked = spearman(df, by, x, y, split_every=split_every)
    joined = join_back(ranked, linear, by)
    return joined.withColumn("spearman_low", fisher_bound("spearman", "n", -1)).withColumn(
        "spearman_high", fisher_bound("spearman", "n", 1)
    )


def linear_fit(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    return complete_pairs(df, x, y).groupBy(*by).agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.count(F.lit(1)).alias("n"),
    )


def erfc(z: Column) -> Column:
    """Complementary error function of non-negative values: a series of positive terms below 2, a continued fraction above."""
    tiny = F.greatest(z, F.lit(1e-300))
    # erf(z) = 2 / sqrt(pi) exp(-z^2) sum of 2^n z^(2n+1) / (2n+1)!!
    start = F.struct(tiny.alias("t"), tiny.alias("s"))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        start,
        lambda acc, n: F.struct(
            (acc["t"] * 2 * tiny * tiny / (2 * n + 1)).alias("t"), (acc["s"] + acc["t"] * 2 * tiny * tiny / (2 * n + 1)).alias("s")
        ),
    )["s"]
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1)), z, lambda acc, k: z + k / 2 / acc)
    scale = F.exp(-z * z) / math.sqrt(math.pi)
    return F.when(z < 2, 1 - 2 * scale * series).otherwise(scale / fraction)


def chi2_tail(q: str | Column, df: str | Column) -> Column:
    """Upper chi-square tail: a finite sum for even degrees of freedom, for odd ones erfc and the same recurrence; terms are
    carried as logarithms. 1 without degrees of freedom, NULL where either is missing."""
    df = col(df).cast("int")

    def tail(half: Column) -> Column:
        even = df % 2 == 0
        first = F.when(even, -half).otherwise(F.log(half) / 2 - half - math.lgamma(1.5))
        steps = F.when(df >= 2, F.sequence(F.lit(1), F.floor(df / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
        # term k of 0, 2, ... or 1, 3, ...: half^(k/2) exp(-half) / gamma(k/2 + 1)
        k = lambda j: F.when(even, 2.0 * j - 2).otherwise(2.0 * j - 1)
        total = F.aggregate(
            steps,
            F.struct(first.alias("t"), F.lit(0.0).alias("s")),
            lambda acc, j: F.struct((acc["t"] + F.log(half) - F.log(k(j) / 2 + 1)).alias("t"), (acc["s"] + F.exp(acc["t"])).alias("s")),
        )["s"]
        return F.least(F.lit(1.0), F.when(even, total).otherwise(erfc(F.sqrt(half)) + total))

    value = col(q).cast("double")
    tails = F.when((value <= 0) | (df <= 0), F.lit(1.0)).otherwise(bound(F.greatest(value, F.lit(1e-300)) / 2, tail))
    return F.when(value.isNotNull() & df.isNotNull(), tails)


def random_effects(df: DataFrame, by: Sequence[str], *, r: str, n: str, with_p: bool = True) -> DataFrame:
    """Random-effects pooling of correlations on the Fisher z scale, with heterogeneity."""
    by = list(by)
    studies = df.where(F.col(r).isNotNull() & (F.col(n) > 3)).select(
        *by, fisher_z(r).alias("_z"), (F.col(n).cast("double") - 3.0).alias("_w")
    )
    fixed = studies.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("_w").alias("_sw"),
        F.sum(F.col("_w") * F.col("_w")).alias("_sw2"),
        F.sum(F.col("_w") * F.col("_z")).alias("_swz"),
        F.sum(F.col("_w") * F.col("_z") * F.col("_z")).alias("_swzz"),
    )
    # correlations are bounded, so the sum of squares about the mean may be taken from the plain sums
    about = F.greatest(F.lit(0.0), F.col("_swzz") - F.col("_swz") * F.col("_swz") / F.col("_sw"))
    spread = fixed.withColumn("q", about)
    freedom = F.col("k") - F.lit(1)
    scale = F.col("_sw") - F.col("_sw2") / F.col("_sw")
    between = spread.select(
        *by, "k", "q", F.greatest(F.lit(0.0), F.coalesce(guarded_ratio(F.col("q") - freedom, scale, 0.0), F.lit(0.0))).alias("tau2")
    )
    weighted = join_back(studies, between, by)
    w = F.lit(1.0) / (F.lit(1.0) / F.col("_w") + F.col("tau2"))
    pooled = weighted.groupBy(*by, "k", "q", "tau2").agg(
        (F.sum(w * F.col("_z")) / F.sum(w)).alias("_pz"), F.sqrt(F.lit(1.0) / F.sum(w)).alias("_se")
    )
    out = pooled.select(
        *by,
        "k",
        F.tanh("_pz").alias("pooled"),
        F.tanh(F.col("_pz") - Z95 * F.col("_se")).alias("pooled_low"),
        F.tanh(F.col("_pz") + Z95 * F.col("_se")).alias("pooled_high"),
        "tau2",
        "q",
        freedom.cast("bigint").alias("q_df"),
        F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - freedom) / F.col("q")) * 100.0)
        .otherwise(F.lit(0.0))
        .alias("i2_percent"),
    )
    return out.withColumn("q_p", chi2_tail("q", "q_df")) if with_p else out


def diploid_calls(df: DataFrame, genotype: str, name: str = "alleles") -> DataFrame:
    """Parse 'a|b' or 'a/b' into two allele numbers; any other shape or a missing call gives NULL."""
    parts = F.split(F.replace(F.col(genotype), F.lit("/"), F.lit("|")), r"\|")
    good = (F.size(parts) == 2) & F.forall(parts, lambda a: a.rlike("^[0-9]+$"))
    return df.withColumn(name, F.when(good, F.transform(parts, lambda a: a.cast("int"))))


def haplotype_covariance(
    calls: DataFrame,
    anchor: DataFrame,
    by: Sequence[str],
    *,
    sample: str,
    alleles: str,
    counted_allele: str,
    anchor_alleles: str,
    anchor_allele: str,
) -> DataFrame:
    """Covariance of each variant's counted allele with the anchor's allele, haplotype by haplotype.

    ``calls`` and ``anchor`` hold one row per (variant, sample) and per sample with two allele numbers; samples
    with a missing call on either side do not count."""
    joined = calls.join(
        anchor.select(sample, F.col(anchor_alleles).alias("_anchor"), F.col(anchor_allele).alias("_tag")), sample
    ).where(F.col(alleles).isNotNull() & F.col("_anchor").isNotNull())

    def on(side: int) -> tuple[Column, Column]:
        own = (F.get(F.col(alleles), F.lit(side)) == F.col(counted_allele)).cast("int")
        tag = (F.get(F.col("_anchor"), F.lit(side)) == F.col("_tag")).cast("int")
        return own, tag

    (own0, tag0), (own1, tag1) = on(0), on(1)
    counts = joined.groupBy(*by).agg(
        (F.count(F.lit(1)) * 2).alias("n_haplotypes"),
        F.sum(own0 + own1).alias("_s"),
        F.sum(tag0 + tag1).alias("_t"),
        F.sum(own0 * tag0 + own1 * tag1).alias("_st"),
    )
    n = F.col("n_haplotypes").cast("double")
    ps, pt, pst = F.col("_s") / n, F.col("_t") / n, F.col("_st") / n
    return counts.select(
        *by,
        "n_haplotypes",
        ps.alias("p_site"),
        pt.alias("p_anchor"),
        pst.alias("p_both"),
        F.when((ps > 0) & (ps < 1), (pst - ps * pt) / (ps * (F.lit(1.0) - ps))).alias("tagging_coefficient"),
        guarded_ratio(pst, ps, 0.0).alias("p_anchor_given_site"),
    )


def matched_records(
    variants: DataFrame, records: DataFrame, *, position: str, lowering: str, raising: str, ref: str, alts: str, order: str
) -> DataFrame:
    """The first record at each variant's position whose allele set is exactly the variant's pair, with the
    index of the lowering allele and a match status."""
    listed = F.concat(F.array(ref), F.col(alts))
    keyed = records.withColumn("_set", F.array_join(F.array_sort(F.array_distinct(listed)), "/")).withColumn("_list", listed)
    first = keyed.groupBy(position, "_set").agg(F.min_by(F.struct("_list", order), order).alias("_rec"))
    own = F.array_join(F.array_sort(F.array_distinct(F.array(lowering, raising))), "/")
    index = F.array_position(F.col("_rec._list"), F.col(lowering)) - 1
    return variants.withColumn("_set", own).join(first, [position, "_set"], "left").select(
        *variants.columns,
        F.col(f"_rec.{order}").alias(order),
        F.when(F.col("_rec").isNotNull(), index).cast("int").alias("allele_index"),
        F.when(F.col("_rec").isNotNull(), F.lit("matched")).otherwise(F.lit("missing_from_records")).alias("match_status"),
    )


def tagging_model(
    df: DataFrame, by: Sequence[str], *, is_anchor: Column, direct: str, coefficient: str, name: str = "tagged_effect"
) -> DataFrame:
    """direct + coefficient * anchor effect of the same key; the anchor keeps its own effect and a missing
    coefficient leaves the direct one."""
    by = list(by)
    anchors = df.groupBy(*by).agg(F.max(F.when(is_anchor, F.col(direct))).alias("_anchor_effect"))
    joined = join_back(df, anchors, by, "left")
    tagged = F.col(direct) + F.col(coefficient) * F.col("_anchor_effect")
    return joined.withColumn(
        name, F.when(is_anchor, F.col(direct)).otherwise(F.coalesce(tagged, F.col(direct)))
    ).drop("_anchor_effect")


