"""Encodings of a category column by what its group looks like."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mutascale.operators.lookups import attach_by_key
from mutascale.session import materialize

KEY = "__key"


def frequency_encode(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Replace (or add as ``name``) a category by its number of rows; missing is a category of its own."""
    keyed = df.withColumn(KEY, F.coalesce(F.col(column).cast("string"), F.lit("\0")))
    counts = keyed.groupBy(KEY).agg(F.count(F.lit(1)).alias("__n"))
    attached = attach_by_key(keyed, counts, [KEY], ["__n"])
    return attached.withColumn(name or column, F.col("__n")).drop(KEY, "__n")


def group_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """Exact interpolated median per key, with the key's row count.

    Equal values of a key are counted before they are sorted. The counts are range-partitioned by (key, value), so a
    hot key covers several partitions; each partition ranks its own part of a key, and the sums of the parts give
    the rank at which a part begins. The partitions are checkpointed, so their parts cannot move on a retry.
    """
    known = df.select(key, value).where(F.col(value).isNotNull() & F.col(key).isNotNull())
    counts = known.groupBy(key, value).agg(F.count(F.lit(1)).alias("m"))
    placed = materialize(counts.repartitionByRange(key, value).withColumn("__part", F.spark_partition_id()))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(key, "__part").agg(F.sum("m").alias("size")).withColumns({
        "before": F.coalesce(F.sum("size").over(before), F.lit(0)), "n_rows": F.sum("size").over(Window.partitionBy(key)),
    })
    lower, upper = F.floor((F.col("n_rows") - 1) / 2), F.floor(F.col("n_rows") / 2)
    # only the parts that hold a middle rank are ranked
    middle = parts.where((F.col("before") <= upper) & (F.col("before") + F.col("size") > lower))
    within = Window.partitionBy(key, "__part").orderBy(value)
    ranked = placed.join(middle.drop("size"), [key, "__part"]).withColumn("upto", F.col("before") + F.sum("m").over(within))

    def at(rank):
        return F.min(F.when(F.col("upto") > rank, F.col(value)))

    return ranked.groupBy(key, "n_rows").agg(((at(lower) + at(upper)) / 2).cast("double").alias("median"))


def target_median_encode(df: DataFrame, column: str, target: str, name: str | None = None) -> DataFrame:
    """Replace (or add as ``name``) a category by the median target of its rows."""
    keyed = df.withColumn(KEY, F.col(column))
    counts = keyed.groupBy(KEY).agg(F.count(F.lit(1)).alias("__n"))
    medians = group_median(keyed, KEY, target).select(KEY, F.col("median").alias("__median"))
    profile = counts.join(medians, KEY, "left")
    attached = attach_by_key(keyed, profile, [KEY], ["__median"])
    return attached.withColumn(name or column, F.col("__median")).drop(KEY, "__median")
