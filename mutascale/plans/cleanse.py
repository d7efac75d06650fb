"""From a raw variant table to the published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutascale.functions.scalar import cast_columns, columns_first, quoted, row_key
from mutascale.operators.burden import burden_flag, rank_by_burden
from mutascale.operators.lookups import left_lookup, verified_lookup
from mutascale.operators.qc import QcRules, clean_variants, drop_constant_columns, with_study, with_vaf
from mutascale.session import materialize
from mutascale.sources import schemas


def clean(
    variants: DataFrame,
    clinical: DataFrame,
    purity: DataFrame,
    rules: QcRules | None = None,
    protect: list[str] | None = None,
) -> DataFrame:
    """Quality control, exome burden and flag, purity and row key.

    Constant columns are dropped after quality control, as far as they are not protected. That choice needs one
    aggregate over the cleaned rows, so these are checkpointed first instead of being computed twice. By default the columns of the published tables are protected.
    """
    rules = rules or QcRules()
    protect = schemas.COMPLETE_COLUMNS if protect is None else protect
    typed = cast_columns(variants, schemas.INTEGER_COLUMNS)
    cleaned = materialize(clean_variants(with_vaf(with_study(typed, clinical, rules), rules), rules))
    kept = drop_constant_columns(cleaned, [*protect, *schemas.KEY_COLUMNS, "array", "wesTMB"])
    return (
        left_lookup(kept, purity, "array", ["purity"])
        .drop("array")
        .withColumn("rate", burden_flag(F.col("wesTMB"), rules))
        .withColumn("hash", row_key(schemas.KEY_COLUMNS))
    )


def ordered(cleaned: DataFrame, rules: QcRules | None = None) -> DataFrame:
    """Rows by their sample's burden; sort just before a sink."""
    rules = rules or QcRules()
    return rank_by_burden(cleaned, rules.sample, "wesTMB", ["Chromosome", "Start_Position"])


def hash_collisions(df: DataFrame, keys: list[str]) -> DataFrame:
    """Row hashes shared by different keys; the annotation join is sound where this is empty.

    Pre-aggregating to distinct keys keeps a group of copies from piling up.
    """
    distinct = df.select(*keys).distinct().withColumn("hash", row_key(keys))
    return distinct.groupBy("hash").agg(F.count(F.lit(1)).alias("n_keys")).where(F.col("n_keys") > 1)


def annotate(cleaned: DataFrame, annotation: DataFrame, verify: list[str] | None = None) -> DataFrame:
    """Join the annotator's output on the row hash and give its columns their published names.

    A synonymous consequence overrides the variant class. ``verify`` names key columns that the annotator returned
    (``read_annotation`` with ``keys``); they are compared too, so rows that share a hash keep their own annotation.
    """
    verify = verify or []
    added = [c for c in annotation.columns if c not in ("hash", *verify)]
    joined = verified_lookup(cleaned.withColumn("hash", F.col("hash").cast("string")), annotation, "hash", verify, added)
    renamed = joined.withColumnsRenamed(schemas.ANNOTATION_RENAMES)
    synonymous = F.col("Consequence") == "synonymous_variant"
    return renamed.withColumn(
        "Variant_Classification",
        F.when(synonymous, F.lit("Synonymous_Mutation")).otherwise(F.col("Variant_Classification")),
    )


def published(annotated: DataFrame) -> DataFrame:
    """The complete published table: its columns only, the leading ones in front."""
    table = annotated.select(*[quoted(c) for c in schemas.COMPLETE_COLUMNS])
    return columns_first(table, schemas.LEADING_COLUMNS)
