"""Sample- and site-level quality control of a variant table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutascale.functions.scalar import matches_any, quoted, ratio
from mutascale.operators.lookups import attach_by_key, keep_keys

# The studies kept, the tags that condemn a sample, the artefact labels, the variant classes.
STUDIES = [
    "BLCA", "COAD", "HNSC", "LUAD", "LUSC", "SKCM", "STAD", "UCEC", "ACC", "BRCA", "CESC", "ESCA",
    "GBM", "KIRC", "LGG", "LIHC", "PRAD", "PEAD", "SARC", "DLBC", "OV", "UCS",
]
SAMPLE_TAGS = ["native_wga_mix", "wga", "nonpreferredpair", "gapfiller"]
ARTEFACT_LABELS = ["StrandBias", "common_in_exac", "oxog"]
SITE_CLASSES = [
    "Frame_Shift_Del", "Frame_Shift_Ins", "In_Frame_Del", "In_Frame_Ins", "Missense_Mutation",
    "Nonsense_Mutation", "Nonstop_Mutation", "Splice_Site", "Translation_Start_Site", "Silent",
]
BURDEN_CLASSES = [
    "Missense_Mutation", "Nonsense_Mutation", "In_Frame_Ins", "In_Frame_Del", "Frame_Shift_Del", "Frame_Shift_Ins",
]


@dataclass(frozen=True)
class QcRules:
    """Column names and thresholds of the quality-control chain."""

    sample: str = "Tumor_Sample_Barcode"
    study: str = "Study_Abbreviation"
    label: str = "FILTER"
    variant_class: str = "Variant_Classification"
    depth: str = "t_depth"
    alt_count: str = "t_alt_count"
    vaf: str = "VAF"
    studies: list[str] = field(default_factory=lambda: list(STUDIES))
    sample_tags: list[str] = field(default_factory=lambda: list(SAMPLE_TAGS))
    artefact_labels: list[str] = field(default_factory=lambda: list(ARTEFACT_LABELS))
    site_classes: list[str] = field(default_factory=lambda: list(SITE_CLASSES))
    burden_classes: list[str] = field(default_factory=lambda: list(BURDEN_CLASSES))
    min_max_vaf: float = 0.1
    max_failed: float = 0.5
    min_depth: int = 25
    min_alt: int = 3
    burden_vaf: float = 0.05
    exome_mb: float = 34.0
    high_burden: float = 10.0

    def site_passes(self) -> Column:
        """Row-level rule: known class, enough depth, enough supporting reads."""
        return (
            F.col(self.variant_class).isin(self.site_classes)
            & (F.col(self.depth) >= self.min_depth)
            & (F.col(self.alt_count) >= self.min_alt)
        )

    def label_passes(self) -> Column:
        """Row-level rule: no artefact label; a missing label fails."""
        return ~matches_any(F.col(self.label), self.artefact_labels)

    def counts_for_burden(self) -> Column:
        """Row-level rule: the variant counts towards the exome burden."""
        return (F.col(self.vaf) >= self.burden_vaf) & F.col(self.variant_class).isin(self.burden_classes)

    def sample_passes(self) -> Column:
        """Rule over a sample profile: untagged, strong enough signal, few artefacts."""
        return (
            (F.col("n_tagged") == 0)
            & (F.col("max_vaf") > self.min_max_vaf)
            & (F.col("failed_proportion") < self.max_failed)
        )


def with_vaf(df: DataFrame, rules: QcRules) -> DataFrame:
    """Add the variant allele fraction; depth 0 gives null."""
    return df.withColumn(rules.vaf, ratio(F.col(rules.alt_count), F.col(rules.depth)))


def with_study(df: DataFrame, clinical: DataFrame, rules: QcRules) -> DataFrame:
    """Attach the study of each sample and keep the listed studies.

    The clinical table is joined by size: Spark broadcasts it below its threshold and shuffles it beyond. The
    filter on its column turns the left join into an inner one.
    """
    joined = df.join(clinical.select(rules.sample, rules.study), rules.sample, "left")
    return joined.where(F.col(rules.study).isin(rules.studies))


def sample_profile(df: DataFrame, rules: QcRules) -> DataFrame:
    """Everything the chain asks about a sample, in one aggregate over the rows.

    The rules remove whole samples, so no rule changes what another one sees of a surviving sample: the tag count,
    the maximum VAF, the artefact share and the burden count can be taken together. The shuffle carries one
    partial row per sample and task, whatever the size of the sample.
    """
    failed = F.count_if(matches_any(F.col(rules.label), rules.artefact_labels))
    rows = F.count(F.lit(1))
    survives = rules.label_passes() & rules.site_passes()
    return df.groupBy(rules.sample).agg(
        rows.alias("n_rows"),
        F.count_if(matches_any(F.col(rules.label), rules.sample_tags)).alias("n_tagged"),
        F.max(rules.vaf).alias("max_vaf"),
        failed.alias("n_failed"),
        (failed / rows).alias("failed_proportion"),
        F.count_if(survives).alias("n_sites"),
        F.count_if(survives & rules.counts_for_burden()).alias("n_burden"),
    )


def drop_tagged_samples(df: DataFrame, rules: QcRules) -> DataFrame:
    """Anti-join: drop every row of a sample that has a tagged row."""
    flagged = df.groupBy(rules.sample).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(matches_any(F.col(rules.label), rules.sample_tags)).alias("n_tagged"),
    )
    attached = attach_by_key(df, flagged, [rules.sample], ["n_tagged"])
    return attached.where(F.coalesce(F.col("n_tagged"), F.lit(0)) == 0).drop("n_tagged")


def keep_strong_samples(df: DataFrame, rules: QcRules) -> DataFrame:
    """Semi-join: keep samples whose largest VAF is above the threshold."""
    peaks = df.groupBy(rules.sample).agg(F.count(F.lit(1)).alias("n_rows"), F.max(rules.vaf).alias("max_vaf"))
    strong = F.col("max_vaf") > rules.min_max_vaf
    return keep_keys(df, peaks, [rules.sample], strong)


def failed_proportion(df: DataFrame, rules: QcRules) -> DataFrame:
    """Share of artefact-labelled rows per sample, without a pivot. Rows without a label count as not failed."""
    failed = F.count_if(matches_any(F.col(rules.label), rules.artefact_labels))
    rows = F.count(F.lit(1))
    return df.groupBy(rules.sample).agg(
        rows.alias("n_rows"), failed.alias("n_failed"), (failed / rows).alias("failed_proportion")
    )


def label_pivot(df: DataFrame, sample: str, label: str) -> DataFrame:
    """Rows per sample and label as one column per label that occurs, 0 where absent; a missing label is ``null``.

    The labels become columns, so their number is bounded by Spark's own limit for pivots, which raises beyond it;
    ``label_counts`` has no limit.
    """
    named = df.withColumn(label, F.coalesce(F.col(label), F.lit("null")))
    return named.groupBy(sample).pivot(label).agg(F.count(F.lit(1))).na.fill(0)


def label_counts(df: DataFrame, sample: str, label: str) -> DataFrame:
    """The counts that are not zero in long form, ``sample, label, n``: one aggregate, for any number of labels."""
    named = df.select(sample, F.coalesce(F.col(label), F.lit("null")).alias("label"))
    return named.groupBy(sample, "label").agg(F.count(F.lit(1)).alias("n"))


def drop_artefacts(df: DataFrame, rules: QcRules) -> DataFrame:
    """Drop samples with too many artefacts, then the remaining artefact rows."""
    shares = failed_proportion(df, rules)
    few = F.col("failed_proportion") < rules.max_failed
    return keep_keys(df, shares, [rules.sample], few).where(rules.label_passes())


def site_filter(df: DataFrame, rules: QcRules) -> DataFrame:
    """Row filters on class, depth and support, plus the 15-character array key."""
    return df.where(rules.site_passes()).withColumn("array", F.substring(F.col(rules.sample), 1, 15))


def clean_variants(df: DataFrame, rules: QcRules) -> DataFrame:
    """The whole chain as one aggregate and one join; adds the sample's exome burden.

    Row filters stand before the join so that they reach the scan.
    """
    profile = sample_profile(df, rules).withColumn("wesTMB", exome_burden(rules))
    rows = df.where(rules.label_passes()).transform(lambda d: site_filter(d, rules))
    return attach_by_key(rows, profile, [rules.sample], ["wesTMB"], keep=rules.sample_passes())


def exome_burden(rules: QcRules) -> Column:
    """Mutations per megabase from a profile; a sample without counted variants has none (null)."""
    return F.when(F.col("n_burden") > 0, F.col("n_burden") / F.lit(rules.exome_mb))


def constant_columns(df: DataFrame) -> list[str]:
    """Columns holding exactly one distinct value, null counted as a value. One pass, no distinct shuffle."""
    checks = []
    for i, name in enumerate(df.columns):
        value = quoted(name)
        same = (F.count(value) == F.count(F.lit(1))) & (F.min(value) == F.max(value))
        checks.append(((F.count(value) == 0) | same).alias(f"c{i}"))
    verdict = df.agg(F.count(F.lit(1)).alias("n"), *checks).first()
    if verdict["n"] == 0:
        return []
    return [name for i, name in enumerate(df.columns) if verdict[f"c{i}"]]


def drop_constant_columns(df: DataFrame, protect: list[str] | None = None) -> DataFrame:
    """Drop the constant columns except the protected ones."""
    kept = set(protect or [])
    return df.drop(*[c for c in constant_columns(df) if c not in kept])
