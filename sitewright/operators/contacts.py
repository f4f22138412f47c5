"""Contact-matrix statistics on sparse (i, j, value) cells. Absent cells are 0; a NULL value marks a missing cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import percent_from_log_change
from ..functions.intervals import aligned_bins, bin_center, bin_start
from .resampling import observed_in_null
from .ranking import SPLIT_EVERY


def symmetrise(coo: DataFrame, by: Sequence[str]) -> DataFrame:
    """Both triangles of a matrix stored as one."""
    mirrored = coo.where(F.col("i") != F.col("j")).select(
        *by, F.col("j").alias("i"), F.col("i").alias("j"), "value"
    )
    return coo.select(*by, "i", "j", "value").unionByName(mirrored)


def virtual_rows(full: DataFrame, by: Sequence[str]) -> DataFrame:
    """0.5 * (M[i, j] + M[j, i]) per cell of a matrix with both triangles; missing if either part is."""
    halves = full.select(*by, "i", "j", (F.col("value") * 0.5).alias("value")).unionByName(
        full.select(*by, F.col("j").alias("i"), F.col("i").alias("j"), (F.col("value") * 0.5).alias("value"))
    )
    return halves.groupBy(*by, "i", "j").agg(
        F.when(F.count("value") == F.count(F.lit(1)), F.sum("value")).alias("value")
    )


def box_means(
    full: DataFrame,
    cells: DataFrame,
    by: Sequence[str],
    *,
    n_bins: int,
    row_flank: int,
    column_flank: int,
    skip_missing: bool = True,
) -> DataFrame:
    """Mean over the box around each requested (i, j), clamped to the matrix; absent cells count as 0 and
    missing ones are skipped, or make the mean missing when ``skip_missing`` is off."""
    by = list(by)

    def around(axis: str, flank: int) -> Column:
        low = F.greatest(F.lit(0).cast("bigint"), F.col(axis) - flank)
        high = F.least(F.lit(n_bins - 1).cast("bigint"), F.col(axis) + flank)
        return F.explode(F.sequence(low, high))

    probes = (
        cells.select(*by, "i", "j")
        .distinct()
        .select("*", around("i", row_flank).alias("_ci"))
        .select("*", around("j", column_flank).alias("_cj"))
    )
    stored = full.select(
        *by, F.col("i").alias("_ci"), F.col("j").alias("_cj"), "value", F.lit(True).alias("_stored")
    )
    looked_up = probes.join(stored, [*by, "_ci", "_cj"], "left").withColumn(
        "_v", F.when(F.col("_stored"), F.col("value")).otherwise(F.lit(0.0))
    )
    mean = F.avg("_v")
    if not skip_missing:
        mean = F.when(F.count("_v") == F.count(F.lit(1)), mean)
    return looked_up.groupBy(*by, "i", "j").agg(mean.alias("box_mean"))


def same_distance_cells(targets: DataFrame, by: Sequence[str], *, n_bins: int, row_flank: int, column_flank: int) -> DataFrame:
    """All (i, i + d) cells whose box lies inside the matrix, for each distance d among the targets."""
    by = list(by)
    first = max(row_flank, 0)
    distances = targets.select(*by, F.abs(F.col("target") - F.col("anchor")).cast("bigint").alias("distance")).distinct()
    low = F.greatest(F.lit(first).cast("bigint"), F.lit(column_flank).cast("bigint") - F.col("distance"))
    high = F.lit(n_bins - 1 - column_flank).cast("bigint") - F.col("distance")
    return (
        distances.where(low <= high)
        .withColumn("i", F.explode(F.sequence(low, high)))
        .withColumn("j", F.col("i") + F.col("distance"))
    )


def same_distance_null(
    full: DataFrame,
    targets: DataFrame,
    by: Sequence[str],
    *,
    n_bins: int,
    flank: int = 1,
    axis: str = "box",
    skip_missing: bool = True,
    split_every: int = SPLIT_EVERY,
) -> DataFrame:
    """Contact at each (anchor, target) against all cells at the same distance.

    axis="box" averages a square of half-width ``flank`` (flank=0 is the single bin); axis="row" averages
    ``2 * flank + 1`` target bins of the anchor's virtual row. The three same-distance statistics in use are
    box with skipped missing cells, row, and box with a plain mean."""
    by = list(by)
    matrix = virtual_rows(full, by) if axis == "row" else full
    row_flank = 0 if axis == "row" else flank
    shape = {"n_bins": n_bins, "row_flank": row_flank, "column_flank": flank}
    background = same_distance_cells(targets, by, **shape)
    asked = targets.select(*by, F.col("anchor").alias("i"), F.col("target").alias("j"))
    means = box_means(
        matrix, background.select(*by, "i", "j").unionByName(asked), by, skip_missing=skip_missing, **shape
    )
    null = background.join(means, [*by, "i", "j"]).where(F.col("box_mean").isNotNull()).select(
        *by, "distance", F.col("box_mean").alias("contact")
    )
    observed = (
        targets.withColumn("distance", F.abs(F.col("target") - F.col("anchor")).cast("bigint"))
        .join(means.select(*by, F.col("i").alias("anchor"), F.col("j").alias("target"), F.col("box_mean").alias("contact")), [*by, "anchor", "target"])
    )
    return observed_in_null(observed, null, [*by, "distance"], value="contact", split_every=split_every)


def offset_submatrix(coo: DataFrame, *, anchor: int | Column, low: int, high: int) -> DataFrame:
    """Cells whose both bins lie within [anchor + low, anchor + high], with offsets from the anchor."""
    a = anchor if isinstance(anchor, Column) else F.lit(anchor)
    return (
        coo.withColumn("row_offset", F.col("i") - a)
        .withColumn("column_offset", F.col("j") - a)
        .where(F.col("row_offset").between(low, high) & F.col("column_offset").between(low, high))
    )


def smooth_three(df: DataFrame, by: Sequence[str], position: str, value: str, *, name: str) -> DataFrame:
    """(previous + own + next) / 3 along consecutive integer positions; beyond the ends counts as 0."""
    by = list(by)
    shares = df.select(*by, F.col(position).alias("_p"), F.col(value).alias("_v")).withColumn(
        "_o", F.explode(F.array(*[F.lit(d).cast("bigint") for d in (-1, 0, 1)]))
    )
    sums = shares.groupBy(*by, (F.col("_p") + F.col("_o")).alias(position)).agg((F.sum("_v") / 3.0).alias(name))
    return df.join(sums, [*by, position], "left")


def virtual_profile(full: DataFrame, anchors: DataFrame, by: Sequence[str], *, n_bins: int, anchor_flank: int) -> DataFrame:
    """Profile of each anchor over all bins: mean of its flanking rows and columns, then a zero-padded
    three-point mean."""
    by = list(by)
    wide = anchors.select(*by, "anchor").distinct()
    near = F.explode(
        F.sequence(
            F.greatest(F.lit(0).cast("bigint"), F.col("anchor") - anchor_flank),
            F.least(F.lit(n_bins - 1).cast("bigint"), F.col("anchor") + anchor_flank),
        )
    )
    probes = wide.select("*", near.alias("i")).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_bins - 1).cast("bigint"))).alias("j"))
    stored = full.select(*by, "i", "j", "value", F.lit(True).alias("_stored"))
    swapped = full.select(*by, F.col("j").alias("i"), F.col("i").alias("j"), "value", F.lit(True).alias("_stored"))

    def side(cells: DataFrame, name: str) -> DataFrame:
        v = F.when(F.col("_stored"), F.col("value")).otherwise(F.lit(0.0))
        return probes.join(cells, [*by, "i", "j"], "left").groupBy(*by, "anchor", "j").agg(F.avg(v).alias(name))

    both = side(stored, "_rows").join(side(swapped, "_columns"), [*by, "anchor", "j"])
    profile = both.select(*by, "anchor", F.col("j").alias("bin"), ((F.col("_rows") + F.col("_columns")) * 0.5).alias("contact"))
    return smooth_three(profile, [*by, "anchor"], "bin", "contact", name="smoothed")


#: Profile rows that one task smooths.
PROFILE_ROWS_PER_TASK = 1 << 17


def anchored_profile(
    records: DataFrame,
    anchors: DataFrame,
    by: Sequence[str],
    *,
    anchor_id: str,
    position: str,
    resolution: int,
    min_distance: int,
    max_distance: int,
    length: int | Column,
) -> DataFrame:
    """Dense distance-limited contact profile of every anchor position.

    ``records`` are sparse (bin_x, bin_y, value) cells in bin starts, one triangle, repeats summed. Bins without
    a record are 0; the three-bin mean is taken before the distance filter and is zero-padded."""
    by = list(by)
    limit = length if isinstance(length, Column) else F.lit(int(length)).cast("bigint")
    pos = F.col(position).cast("bigint")
    bins = (
        anchors.withColumn("_anchor_bin", bin_start(pos, resolution))
        .withColumn(
            "target_bin",
            F.explode(
                aligned_bins(
                    F.greatest(F.lit(0).cast("bigint"), pos - max_distance - resolution),
                    F.least(limit, pos + max_distance + resolution + 1),
                    resolution,
                )
            ),
        )
    )
    one_way = records.where(F.col("value").isNotNull() & (F.col("bin_x") != F.col("bin_y"))).groupBy(*by, "bin_x", "bin_y").agg(
        F.sum("value").alias("_v"), F.count(F.lit(1)).alias("_n")
    )
    mirrored = one_way.select(*by, F.col("bin_x").alias("_anchor_bin"), F.col("bin_y").alias("target_bin"), "_v", "_n").unionByName(
        one_way.select(*by, F.col("bin_y").alias("_anchor_bin"), F.col("bin_x").alias("target_bin"), "_v", "_n")
    )
    summed = mirrored.groupBy(*by, "_anchor_bin", "target_bin").agg(F.sum("_v").alias("_v"), F.sum("_n").alias("_n"))
    dense = bins.join(summed, [*by, "_anchor_bin", "target_bin"], "left").withColumn(
        "contact", F.coalesce("_v", F.lit(0.0))
    )
    # an anchor has at most 2 * max_distance / resolution + 4 bins, so its window is small by construction
    # ... and tasks hold a fixed number of them: Spark sizes tasks by compressed bytes, and profiles shrink to a few
    tasks = -(-anchors.count() * (2 * max_distance // resolution + 4) // PROFILE_ROWS_PER_TASK) or 1
    dense = dense.repartition(tasks, *by, anchor_id)
    along = Window.partitionBy(*by, anchor_id).orderBy("target_bin")
    smooth = (
        F.coalesce(F.lag("contact").over(along), F.lit(0.0)) + F.col("contact") + F.coalesce(F.lead("contact").over(along), F.lit(0.0))
    ) / 3.0
    center = bin_center("target_bin", resolution)
    return (
        dense.withColumn("contact_smooth3", smooth)
        .withColumn("n_records", F.coalesce(F.col("_n"), F.lit(0)).cast("bigint"))
        .withColumn("target_center", center)
        .withColumn("signed_distance", center - pos)
        .withColumn("absolute_distance", F.abs(center - pos))
        .where(
            F.col("absolute_distance").between(min_distance, max_distance)
            & (F.col("target_bin") >= 0)
            & (F.col("target_bin") + resolution <= limit)
        )
        .drop("_anchor_bin", "_v", "_n")
    )


def delta_map(alt: DataFrame, ref: DataFrame, by: Sequence[str]) -> DataFrame:
    """ALT - REF per cell over the union of stored cells, with the implied percent change."""
    keys = [*by, "i", "j"]
    both = alt.select(*keys, F.col("value").alias("_a")).join(ref.select(*keys, F.col("value").alias("_r")), keys, "full_outer")
    return both.select(
        *keys, (F.coalesce("_a", F.lit(0.0)) - F.coalesce("_r", F.lit(0.0))).alias("value")
    ).withColumn("percent_change", percent_from_log_change("value"))


def mean_over_tracks(cells: DataFrame, context: Sequence[str]) -> DataFrame:
    return cells.groupBy(*context, "i", "j").agg(F.avg("value").alias("value"))


def signal_by_position(df: DataFrame, by: Sequence[str], *, values: str, keep: Column | None = None) -> DataFrame:
    """Mean across the selected tracks at every position of array-valued signals."""
    rows = df if keep is None else df.where(keep)
    return (
        rows.select(*by, F.posexplode(values).alias("position", "_v"))
        .groupBy(*by, "position")
        .agg(F.avg(F.col("_v").cast("double")).alias("signal"), F.count("_v").alias("n_tracks"))
    )
