"""Start-site catalogues, site eligibility and matched-control selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..functions.intervals import shared_span_start
from ..session import staged
from .aggregates import modal_value
from .design import regions_from_tiles
from .ranking import best_row, row_positions


def start_sites(df: DataFrame, *, chrom: str, start: str, end: str, strand: str, coord_base: int = 0) -> DataFrame:
    """Strand-aware 0-based start site; ``coord_base`` says whether the start column is 0- or 1-based."""
    first = F.col(start).cast("bigint") - coord_base
    return df.withColumn("tss0", F.when(F.col(strand) == "+", first).otherwise(F.col(end).cast("bigint") - 1)).withColumn(
        "tss1", F.col("tss0") + 1
    )


def promoter_catalogue(
    genes: DataFrame,
    *,
    chrom: str,
    start: str,
    end: str,
    strand: str,
    gene_id: str,
    gene_name: str,
    half_width: int,
    chrom_length: str | Column,
) -> DataFrame:
    """Clipped promoter window, stable id and catalogue position of every gene."""
    limit = chrom_length if isinstance(chrom_length, Column) else F.col(chrom_length)
    sited = start_sites(genes, chrom=chrom, start=start, end=end, strand=strand)
    base_id = sq.strip_version(F.coalesce(F.col(gene_id), F.lit("")))
    name = F.coalesce(F.col(gene_name), F.lit(""))
    framed = (
        sited.withColumn("promoter_start0", F.greatest(F.col("tss0") - half_width, F.lit(0)))
        .withColumn("promoter_end0", F.least(F.col("tss0") + half_width, limit))
        .withColumn("gene_id_base", base_id)
        .withColumn("promoter_id", F.concat(base_id, F.lit("__"), name, F.lit("__tss"), F.col("tss1").cast("string")))
    )
    indexed = row_positions(framed, [chrom], [F.col("tss0"), F.col(gene_id), name], name="promoter_index")
    return indexed.withColumn("promoter_index", F.col("promoter_index") - 1)


def representative_transcript(df: DataFrame, by: Sequence[str], *, start: str, end: str, strand: str, kind: str, preferred: str, tie: Sequence[str]) -> DataFrame:
    """First transcript of the preferred kind by (start, end), else the first of any kind, with its start site."""
    order = [(F.col(kind) != preferred).cast("int"), F.col(start), F.col(end), *[F.col(c) for c in tie]]
    return best_row(df, by, order).withColumn(
        "candidate_tss", F.when(F.col(strand) == "+", F.col(start)).otherwise(F.col(end))
    )


def consensus_tss(df: DataFrame, by: Sequence[str], *, start: str, end: str, strand: str, kind: str, preferred: str) -> DataFrame:
    """Start site most of a gene's transcripts agree on, preferred kind first."""
    sited = df.withColumn("tss", F.when(F.col(strand) == "+", F.col(start)).otherwise(F.col(end)))
    return modal_value(sited, by, "tss", preferred=F.col(kind) == preferred)


def split_by_bounds(df: DataFrame, *, start0: Column, end0: Column, length: Column) -> DataFrame:
    """Mark rows whose window leaves the sequence with the reason; NULL reason means kept."""
    reason = F.when(start0 < 0, F.lit("window starts before the sequence")).when(
        end0 > length, F.lit("window ends after the sequence")
    ).when(length.isNull(), F.lit("unknown sequence"))
    return df.withColumn("skip_reason", reason)


def site_composition(sites: DataFrame, tiles: DataFrame, by: Sequence[str], *, center: str, eligible: Column, context: int, slot: int, length: str | Column, tile: int) -> DataFrame:
    """Composition of the slot and its flanks around every eligible centre; each distinct centre is read once.

    Adds slot_gc, flank_gc, flank_cpg and flank_ambiguous (NULL outside the sequence)."""
    by = list(by)
    limit = length if isinstance(length, Column) else F.col(length)
    start0 = F.col(center) - context // 2
    regions = (
        sites.where(eligible)
        .withColumn("_end0", start0 + context)
        .withColumn("_start0", start0)
        .where((F.col("_start0") >= 0) & (F.col("_end0") <= limit))
        .select(*by, center, "_start0", "_end0")
        .distinct()
    )
    fetched = regions_from_tiles(regions, tiles, by, region_id=center, start0="_start0", end0="_end0", tile=tile)
    slot_at = context // 2 - slot // 2
    slot_text = F.substring("sequence", slot_at + 1, slot)
    flank = F.concat(F.substring("sequence", 1, slot_at), F.substring("sequence", slot_at + slot + 1, context - slot_at - slot))
    clean_slot = (sq.canonical_count(slot_text) == slot) & (sq.canonical_count(flank) > 0)
    composed = fetched.select(
        *by,
        center,
        F.when(clean_slot, sq.gc_fraction(slot_text)).alias("slot_gc"),
        sq.gc_fraction(flank).alias("flank_gc"),
        sq.cpg_density(flank).alias("flank_cpg"),
        sq.ambiguous_fraction(flank).alias("flank_ambiguous"),
    )
    return sites.join(composed, [*by, center], "left")


#: Eligible profile rows that one task of ``matched_controls`` holds; each takes part in some thirty pools.
PROFILE_ROWS_PER_TASK = 1 << 15


def matched_controls(
    profile: DataFrame,
    by: Sequence[str],
    *,
    anchor: str,
    resolution: int,
    slot: int,
    span: int,
    bound: int | Column,
    min_smooth: float,
    min_percentile: float,
    caliper: int,
    separation: int,
    low_quantile: float,
    gc_tolerance: float,
    cpg_scale: float,
    anchor_before: int,
    anchor_after: int,
) -> DataFrame:
    """One high-contact site and the best admissible pair of low-contact controls per key.

    ``profile`` holds one row per (key, target_bin): target_center, contact, contact_smooth3, n_records,
    signed_distance, absolute_distance, flank_gc, flank_cpg, flank_ambiguous, eligible, in_run. Peaks are tried
    in order; the first whose neighbourhood maximum admits a pair wins. All groups are bounded by geometry: a key
    has at most one row per bin, a pool at most 2 * caliper / resolution + 1 bins, so pools meet through an equi
    join on bins and pairs are formed inside one row."""
    by = list(by)
    bin_, contact, smooth = F.col("target_bin"), F.col("contact"), F.col("contact_smooth3")
    # read by four branches, and counted: a key stays in one task, and tasks hold a fixed number of rows however large the
    # input is (the sizes that Spark goes by are compressed ones)
    eligible = staged(profile.where("eligible"), "eligible")
    tasks = -(-eligible.count() // PROFILE_ROWS_PER_TASK) or 1
    placed = eligible.repartition(tasks, *by, "target_bin")
    peaks = eligible.where("in_run").repartition(tasks, *by)
    tied = F.count(F.lit(1)).over(Window.partitionBy(*by, "contact_smooth3"))
    size = F.count(F.lit(1)).over(Window.partitionBy(*by))
    average_rank = F.rank().over(Window.partitionBy(*by).orderBy("contact_smooth3")) + (tied - 1) / F.lit(2.0)
    rest = [F.col("n_records").desc(), F.col("absolute_distance"), bin_]
    ranked = (
        peaks.withColumn("peak_percentile", average_rank / size)
        .where((smooth >= min_smooth) & (F.col("peak_percentile") >= min_percentile))
        .withColumn("peak_rank", F.row_number().over(Window.partitionBy(*by).orderBy(smooth.desc(), contact.desc(), *rest)))
        .select(*by, "peak_rank", "peak_percentile", F.col("target_center").alias("peak_center"), smooth.alias("peak_smooth"), F.col("target_bin").alias("_peak_bin"))
    )
    around = ranked.withColumn(
        "target_bin", F.explode(F.array(*[F.col("_peak_bin") + d for d in (-resolution, 0, resolution)]))
    ).drop("_peak_bin")
    neighbourhood = around.repartition(tasks, *by, "target_bin").join(placed, [*by, "target_bin"]).repartition(tasks, *by)
    highs = best_row(
        neighbourhood,
        [*by, "peak_rank"],
        [-contact, -smooth, -F.col("n_records"), F.col("absolute_distance"), bin_],
    )
    highs = best_row(highs, [*by, "target_bin"], [F.col("peak_rank")]).where(
        (contact > 0) & F.col("flank_gc").isNotNull() & F.col("flank_cpg").isNotNull() & (F.col("flank_ambiguous") <= 0)
    )
    carried = ["target_bin", "target_center", "contact", "contact_smooth3", "signed_distance", "absolute_distance", "flank_gc", "flank_cpg"]
    high = highs.select(
        *by, "peak_rank", "peak_percentile", "peak_center", "peak_smooth", anchor, *[F.col(c).alias(f"high_{c}") for c in carried]
    )
    reach = (caliper // resolution + 1) * resolution
    pool = (
        high.withColumn("target_bin", F.explode(F.sequence(F.col("high_target_bin") - reach, F.col("high_target_bin") + reach, F.lit(resolution).cast("bigint"))))
        .repartition(tasks, *by, "target_bin")
        .join(placed.select(*by, *carried), [*by, "target_bin"])
        .where(
            (F.signum(F.col("signed_distance").cast("double")) == F.signum(F.col("high_signed_distance").cast("double")))
            & (F.abs(F.col("absolute_distance") - F.col("high_absolute_distance")) <= caliper)
            & (F.abs(F.col("target_center") - F.col("high_target_center")) >= separation)
        )
    )
    high_columns = high.columns
    distance_gap = F.abs(F.col("absolute_distance") - F.col("high_absolute_distance")).cast("double") / max(float(caliper), 1.0)
    gc_gap = F.abs(F.col("flank_gc") - F.col("high_flank_gc"))
    score = distance_gap + gc_gap / max(gc_tolerance, 1e-6) + F.abs(F.col("flank_cpg") - F.col("high_flank_cpg")) / cpg_scale
    member = F.struct(
        score.alias("score"),
        contact.alias("contact"),
        F.col("absolute_distance").alias("distance"),
        bin_.alias("bin"),
        F.col("target_center").alias("center"),
        gc_gap.alias("gc_gap"),
    )
    # pools are bounded by the caliper, so the exact percentile and the list stay small
    gathered = pool.repartition(tasks, *by).groupBy(*high_columns).agg(
        F.percentile("contact", low_quantile).alias("_threshold"), F.array_sort(F.collect_list(member)).alias("_pool")
    ).where(F.size("_pool") >= 2)
    lows = F.filter(
        "_pool",
        lambda m: (m["contact"] <= F.col("_threshold")) & (m["contact"] < F.col("high_contact")) & (m["gc_gap"] <= gc_tolerance),
    )

    def partners(first: Column, i: Column) -> Column:
        later = F.filter(
            F.transform(F.col("_lows"), lambda m, j: F.struct(m.alias("m"), j.alias("j"))),
            lambda x: (x["j"] > i) & (F.abs(x["m"]["center"] - first["center"]) >= separation),
        )
        return F.transform(
            later,
            lambda x: F.struct(
                (first["score"] + x["m"]["score"]).alias("score_sum"),
                (first["contact"] + x["m"]["contact"]).alias("contact_sum"),
                (F.abs(first["center"]) + F.abs(x["m"]["center"])).cast("double").alias("center_sum"),
                i.alias("i"),
                x["j"].alias("j"),
                first.alias("low1"),
                x["m"].alias("low2"),
            ),
        )

    half = slot // 2

    def span_start(p: Column) -> Column:
        centers = F.array(F.col("high_target_center"), p["low1"]["center"], p["low2"]["center"])
        starts = F.transform(centers, lambda c: c - half)
        return shared_span_start(anchor, starts, F.transform(starts, lambda s: s + slot), span, bound, anchor_before, anchor_after)

    paired = (
        gathered.withColumn("_lows", lows)
        .where(F.size("_lows") >= 2)
        .withColumn("_pairs", F.flatten(F.transform("_lows", partners)))
        .withColumn("_pair", F.array_min(F.filter("_pairs", lambda p: span_start(p).isNotNull())))
        .where(F.col("_pair").isNotNull())
        .withColumn("span_start", span_start(F.col("_pair")))
    )
    flat = paired.select(
        *high_columns,
        "span_start",
        F.col("_pair.score_sum").alias("score_sum"),
        *[F.col(f"_pair.low{k}.{f}").alias(f"low{k}_{f}") for k in (1, 2) for f in ("bin", "center", "contact", "score")],
    )
    return best_row(flat, by, [F.col("peak_rank")])
