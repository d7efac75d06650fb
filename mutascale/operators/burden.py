"""Tumour mutational burden per sample and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutascale.operators.lookups import attach_by_key
from mutascale.operators.qc import QcRules


def sample_burden(df: DataFrame, rules: QcRules) -> DataFrame:
    """Counted variants per sample divided by the exome size. Samples without one are absent."""
    counted = df.where(rules.counts_for_burden())
    return (
        counted.groupBy(rules.sample)
        .agg(F.count(F.lit(1)).alias("n_burden"))
        .withColumn("wesTMB", F.col("n_burden") / F.lit(rules.exome_mb))
    )


def attach_burden(df: DataFrame, rules: QcRules) -> DataFrame:
    """Left join of the rows with their sample's burden; no counted variant gives null."""
    burden = F.count_if(rules.counts_for_burden())
    profile = df.groupBy(rules.sample).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.when(burden > 0, burden / F.lit(rules.exome_mb)).alias("wesTMB"),
    )
    return attach_by_key(df, profile, [rules.sample], ["wesTMB"])


def burden_flag(burden: Column, rules: QcRules, null_rate: bool = True) -> Column:
    """High-burden flag; an unknown burden gives ``null_rate`` (high by default)."""
    return F.when(burden.isNull(), F.lit(null_rate)).otherwise(burden >= rules.high_burden)


def rank_by_burden(df: DataFrame, sample: str, burden: str, within: list[str]) -> DataFrame:
    """Rows ordered by their sample's burden, sample by sample; rows without a sample are dropped.

    One range-partitioned sort. The columns in ``within`` continue the sort key, so a hot sample spreads.
    """
    return df.where(F.col(sample).isNotNull()).orderBy(F.asc_nulls_first(burden), sample, *within)


def one_row_per_sample(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per key; meant for columns that are constant within it."""
    return df.dropDuplicates(columns)
