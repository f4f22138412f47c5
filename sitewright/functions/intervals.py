"""Coordinate arithmetic. Positions are 1-based, intervals 0-based half-open unless a name says inclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import col


def overlap_length(start: str | Column, end: str | Column, other_start: str | Column, other_end: str | Column) -> Column:
    """Shared length of two inclusive intervals."""
    return F.greatest(
        F.lit(0), F.least(col(end), col(other_end)) - F.greatest(col(start), col(other_start)) + F.lit(1)
    )


def overlap_fraction(start: str | Column, end: str | Column, other_start: str | Column, other_end: str | Column) -> Column:
    """Shared length divided by the length of the first interval."""
    own = F.greatest(F.lit(1), col(end) - col(start) + F.lit(1))
    return overlap_length(start, end, other_start, other_end) / own


def overlaps_half_open(start: str | Column, end: str | Column, other_start: str | Column, other_end: str | Column) -> Column:
    return (col(start) < col(other_end)) & (col(end) > col(other_start))


def bin_of_position(position: str | Column, region_start0: int | Column, resolution: int) -> Column:
    """Bin index of a 1-based position."""
    origin = region_start0 if isinstance(region_start0, Column) else F.lit(int(region_start0))
    return F.floor((col(position) - F.lit(1) - origin) / F.lit(int(resolution))).cast("bigint")


def bin_start(x: str | Column, resolution: int) -> Column:
    return (F.floor(col(x) / F.lit(int(resolution))) * F.lit(int(resolution))).cast("bigint")


def bin_center(start: str | Column, resolution: int) -> Column:
    return col(start) + F.lit(int(resolution) // 2)


def aligned_bins(start0: str | Column, end0: str | Column, resolution: int) -> Column:
    """Array of bin starts that touch [start0, end0)."""
    return F.sequence(
        bin_start(start0, resolution), bin_start(col(end0) - F.lit(1), resolution), F.lit(int(resolution)).cast("bigint")
    )


def shared_span_start(
    anchor: str | Column, starts: Column, ends: Column, span: int, bound: int | Column, before: int, after: int
) -> Column:
    """Start of one fixed-length span, clamped to [0, bound), that holds the anchor's
    neighbourhood [anchor-before, anchor+after) and every [start, end) of the arrays; NULL if none exists."""
    need_start = F.least(col(anchor) - F.lit(before), F.array_min(starts))
    need_end = F.greatest(col(anchor) + F.lit(after), F.array_max(ends))
    limit = bound if isinstance(bound, Column) else F.lit(int(bound))
    middle = F.floor((need_start + need_end) / F.lit(2)).cast("bigint")
    start = F.greatest(F.lit(0), F.least(middle - F.lit(span // 2), limit - F.lit(span)))
    fits = (need_end - need_start <= F.lit(span)) & (start <= need_start) & (need_end <= start + F.lit(span))
    return F.when(fits, start)


def upstream_placement_start(tss: str | Column, strand: str | Column, length: int | Column, distance: int | Column) -> Column:
    """1-based first base of a segment that leaves ``distance`` bases between it and the start site, by strand."""
    n = length if isinstance(length, Column) else F.lit(int(length))
    d = distance if isinstance(distance, Column) else F.lit(int(distance))
    return F.when(col(strand) == "-", col(tss) + d + F.lit(1)).otherwise(col(tss) - d - n)
