"""Global row numbers, systematic sampling and seeded splits."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutascale.session import materialize


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[part.cast("string") for part in parts]))


def uniform_hash(*parts: Column) -> Column:
    """A 32-bit number from the MD5 of the parts: the same on every engine, partitioning and retry."""
    return F.conv(F.substring(_digest(*parts), 1, 8), 16, 10).cast("long")


def hash_below(bound: int, *parts: Column) -> Column:
    """Whether ``uniform_hash`` is below a bound; compares the digits as text, which are in the order of the numbers."""
    digits = "g" if bound >= 2**32 else f"{max(bound, 0):08x}"  # every digest is below "g"
    return _digest(*parts) < F.lit(digits)


def with_ordinal(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """0-based position of each row in the given order, without a one-task window.

    The rows are range-sorted once and checkpointed, so their places cannot move on a retry. Only one count per
    partition goes to the driver. The order columns should identify a row; then hot values also spread.
    """
    placed = materialize(df.orderBy(*order)).withColumn("__at", F.monotonically_increasing_id())
    placed = placed.withColumn("__part", F.shiftright("__at", 33).cast("int"))
    counts = sorted((r["__part"], r["count"]) for r in placed.groupBy("__part").count().collect())
    before = [0, *accumulate(n for _, n in counts)][: len(counts)]
    offsets = df.sparkSession.createDataFrame(
        [(part, offset) for (part, _), offset in zip(counts, before)], "__part int, __offset long"
    )
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__offset") + within)
        .drop("__part", "__at", "__offset")
    )


def systematic_sample(df: DataFrame, order: list[str], block: int = 9, seed: int = 0) -> DataFrame:
    """One random pick in each block of consecutive rows, as a ``picked`` column; the last block gives none."""
    placed = with_ordinal(df, order).withColumn("block", F.floor(F.col("ordinal") / block))
    total = placed.agg(F.max("block")).first()[0]
    offset = F.pmod(uniform_hash(F.lit(seed), F.col("block")), F.lit(block))
    last = F.lit(-1 if total is None else total)
    picked = (F.col("ordinal") % block == offset) & (F.col("block") < last)
    return placed.withColumn("picked", picked)


def hash_split(df: DataFrame, keys: list[str], test_share: float = 0.2, seed: int = 41) -> DataFrame:
    """Mark about ``test_share`` of the keys as test rows; narrow, no shuffle, the same rows for every target."""
    bound = int(test_share * 2**32)
    return df.withColumn("is_test", hash_below(bound, F.lit(seed), *[F.col(k) for k in keys]))


def exact_split(df: DataFrame, keys: list[str], test_share: float = 0.2, seed: int = 41) -> DataFrame:
    """Mark exactly ceil(share x rows) rows as test: those with the smallest hashes, ties in the order of the keys.

    The hash at the limit is selected by two counts, over its upper and lower 16 bits, so the table is neither sorted nor
    written. Only the rows with this very hash are ranked. ``df`` is read several times and must give the same rows.
    """
    draw = uniform_hash(F.lit(seed), *[F.col(k) for k in keys])
    upper = _histogram(df.select(F.shiftright(draw, 16).alias("bucket")))
    total = sum(n for _, n in upper)
    if not total:
        return df.withColumn("is_test", F.lit(False))
    high, left = _bucket_at(upper, min(math.ceil(test_share * total), total))
    inside = df.select(draw.alias("draw")).where(F.shiftright("draw", 16) == high)
    lower = _histogram(inside.select(F.col("draw").bitwiseAND(F.lit(0xFFFF)).alias("bucket")))
    low, left = _bucket_at(lower, left)
    limit = (high << 16) | low
    if left in (0, dict(lower)[low]):  # the hash at the limit goes whole
        return df.withColumn("is_test", draw < F.lit(limit + (left > 0)))
    tied = with_ordinal(df.where(draw == limit), keys, "__place")
    tied = tied.withColumn("is_test", F.col("__place") < left).drop("__place")
    return df.where(draw != limit).withColumn("is_test", draw < limit).unionByName(tied)


def _histogram(buckets: DataFrame) -> list[tuple[int, int]]:
    """Rows per bucket in order; at most 65,536 rows by the width of the buckets."""
    return sorted((r["bucket"], r["n"]) for r in buckets.groupBy("bucket").agg(F.count("*").alias("n")).collect())


def _bucket_at(histogram: list[tuple[int, int]], size: int) -> tuple[int, int]:
    """The bucket in which the first ``size`` rows end, and how many of its rows they take."""
    for bucket, n in histogram:
        if size <= n:
            return bucket, size
        size -= n
    raise ValueError("more rows than there are")
