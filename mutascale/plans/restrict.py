"""Restricting variants to panels, and the input of the sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutascale.functions.scalar import decode_number
from mutascale.operators.intervals import overlap_join, to_zero_based
from mutascale.plans.sweep import is_hot


def decode_sentinels(df: DataFrame) -> DataFrame:
    """Text ``.`` to missing: null for max_maf and purity, 0 for cosmic96_coding."""
    return df.withColumns({
        "max_maf": decode_number(F.col("max_maf").cast("string")),
        "purity": decode_number(F.col("purity").cast("string")),
        "cosmic96_coding": decode_number(F.col("cosmic96_coding").cast("string"), default=0.0),
    })


def restrict_to_panels(variants: DataFrame, intervals: DataFrame, bin_width: int | None = None) -> DataFrame:
    """Variants (1-based start) inside each panel, once per overlapped interval, sentinels decoded."""
    placed = overlap_join(decode_sentinels(to_zero_based(variants)), intervals, bin_width)
    return placed.drop("istart", "iend")


def sweep_input(train: DataFrame, test: DataFrame, intervals: DataFrame, bin_width: int | None = None) -> DataFrame:
    """Overlapped training and test variants in the shape ``sweep`` takes: one range join for all panels."""
    both = train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))
    placed = restrict_to_panels(both, intervals, bin_width)
    return placed.select(
        "panel", F.col("Tumor_Sample_Barcode").alias("sample"), "is_test", "type", "vaf", is_hot().alias("hot"),
        "wesTMB", "rate",
    )
