"""Genome intervals (0-based, half-open): lengths and overlap joins."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN, LEVEL = "__bin", "__bin_level"
STEP, LEVELS = 8, 11


def to_zero_based(df: DataFrame, start: str = "start") -> DataFrame:
    """1-based start to 0-based start."""
    return df.withColumn(start, F.col(start) - 1)


def panel_length(intervals: DataFrame, panel: str = "panel") -> DataFrame:
    """Megabases per panel; overlapping intervals count twice."""
    megabases = F.sum(F.col("iend") - F.col("istart")) / F.lit(1e6)
    return intervals.groupBy(panel).agg(megabases.alias("panel_mb"))


def pick_bin_width(intervals: DataFrame) -> int:
    """Smallest power of two that is at least four mean interval lengths.

    An interval of length L falls into at most L / width + 2 bins of the lowest level, so all intervals together give at
    most 2.25 rows each on average; longer ones go to a higher level.
    """
    mean = intervals.agg(F.avg(F.col("iend") - F.col("istart"))).first()[0]
    return 2 ** math.ceil(math.log2(max(16.0, 4.0 * float(mean or 0.0))))


def overlap_join(variants: DataFrame, intervals: DataFrame, bin_width: int | None = None) -> DataFrame:
    """Inner join on ``chr`` and overlap: a variant appears once per overlapped interval.

    ``variants`` has chr, start, end; ``intervals`` has chr, istart, iend and any other columns. Each row has a level by its
    length: bins of a level are ``STEP`` times as wide as those of the level below, and a row has at most ``STEP + 1`` bins of
    its own level. A pair meets on the coarser of its two levels, where both sides are listed under every bin they touch, by
    an equality on (chr, level, bin). So no interval of a chromosome is compared with every variant of it, and a row over a
    whole chromosome on either side costs a few rows. A row is listed on its own level and on the higher levels that occur on
    the other side, of which there are a handful. A row of no length matches what it lies strictly inside; reversed rows match
    nothing. A pair that shares several bins is kept in the bin of its first common base.
    No hint is given: Spark broadcasts the interval side while it is below its size threshold, and otherwise
    shuffles both sides and splits a hot bin by adaptive skew handling.
    """
    width = bin_width or pick_bin_width(intervals)
    left = variants.where(F.col("start") <= F.col("end")).withColumn(LEVEL, _level("start", "end", width))
    right = intervals.where(F.col("istart") <= F.col("iend")).withColumn(LEVEL, _level("istart", "iend", width))
    found = left.select(F.lit(0).alias("side"), LEVEL).unionByName(right.select(F.lit(1).alias("side"), LEVEL))
    levels = {(r["side"], r[LEVEL]) for r in found.distinct().collect()}  # at most 2 x 11 rows
    left = _listed(left, "start", "end", width, sorted(x for side, x in levels if side == 1), "__level_a")
    right = _listed(right, "istart", "iend", width, sorted(x for side, x in levels if side == 0), "__level_b")
    overlap = (F.col("start") < F.col("iend")) & (F.col("end") > F.col("istart"))
    coarser = F.col(LEVEL) == F.greatest("__level_a", "__level_b")
    first_common = _bin_of(F.greatest("start", "istart"), _width(width, F.col(LEVEL)))
    return left.join(right, ["chr", LEVEL, BIN]).where(overlap & coarser & (F.col(BIN) == first_common)).drop(
        BIN, LEVEL, "__level_a", "__level_b"
    )


def overlap_join_by_chromosome(variants: DataFrame, intervals: DataFrame) -> DataFrame:
    """The same join with the chromosome as the only key: for a handful of intervals per chromosome."""
    overlap = (F.col("start") < F.col("iend")) & (F.col("end") > F.col("istart"))
    valid = (F.col("start") <= F.col("end")) & (F.col("istart") <= F.col("iend"))
    return variants.join(intervals, "chr").where(overlap & valid)


def overlap_or(variants: DataFrame, intervals: DataFrame, mode: str = "error") -> DataFrame:
    """Overlap join with a policy for an empty result: ``error``, ``warn`` or ``silent``."""
    if mode not in ("error", "warn", "silent"):
        raise ValueError("mode is 'error', 'warn' or 'silent'")
    joined = overlap_join(variants, intervals)
    if mode != "silent" and joined.isEmpty():
        if mode == "error":
            raise ValueError("no variant overlaps an interval")
        warnings.warn("no variant overlaps an interval", stacklevel=2)
    return joined


def _width(width: int, level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(width * STEP**k).cast("long") for k in range(LEVELS)]), level + 1)


def _bin_of(position, width: Column):
    return F.floor(position / width).cast("long")


def _level(start: str, end: str, width: int) -> Column:
    """The lowest level whose bins are long enough for a row to touch at most ``STEP + 1`` of them."""
    length = F.col(end) - F.col(start)
    level = F.lit(0)
    for k in range(1, LEVELS):
        level = F.when(length > F.lit(width * STEP**k), F.lit(k)).otherwise(level)
    return level


def _listed(df: DataFrame, start: str, end: str, width: int, others: list[int], own: str) -> DataFrame:
    """Rows on their own level and the higher ones of the other side, under every bin that they touch there."""
    higher = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda x: x > F.col(LEVEL))
    listed = df.withColumn(own, F.col(LEVEL)).withColumn(LEVEL, F.explode(F.concat(F.array(LEVEL), higher)))
    last = F.greatest(F.col(start), F.col(end) - 1)  # a row of no length lies in the bin of its start
    return listed.withColumn(BIN, F.explode(F.sequence(*(_bin_of(x, _width(width, F.col(LEVEL))) for x in (F.col(start), last)))))


def _bins(start: str, end: str, width: int) -> Column:
    """The bins of a row on its own level alone."""
    wide = _width(width, _level(start, end, width))
    last = F.greatest(F.col(start), F.col(end) - 1)
    return F.explode(F.sequence(_bin_of(F.col(start), wide), _bin_of(last, wide)))
