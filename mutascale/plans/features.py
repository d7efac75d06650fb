"""Features for modelling panel performance, from results or from panel parameter sheets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutascale.functions.scalar import (
    error_balance,
    map_fractions,
    map_values,
    membership_flags,
    not_equal_or_null,
    panel_number,
    quoted,
    ratio,
    strip_panel_suffix,
)
from mutascale.operators.encode import frequency_encode, target_median_encode

# Vocabularies, codes and column labels of the parameter sheets.
CALLERS = {
    "Delly": "Caller: Delly",
    "Freebayes": "Caller: Freebayes",
    "GATK HaplotypeCaller": "Caller: HaplotypeCaller",
    "GATK Mutect2": "Caller: Mutect2",
    "Lofreq": "Caller: Lofreq",
    "Manta": "Caller: Manta",
    "Provided by Manufacturer": "Caller: OEM",
    "Samtools": "Caller: Samtools",
    "TNscope": "Caller: TNscope",
    "VarDict": "Caller: VarDict",
    "VarScan2": "Caller: VarScan2",
    "VariDict": "Caller: VariDict",
    "other": "Caller: other",
    "self-developed": "Caller: in lab",
}
VARIANT_TYPES = {
    "Other": "Involved: Other",
    "Missense": "Involved: Missense",
    "Nonstop": "Involved: Nonstop",
    "Indel": "Involved: Indel",
    "Splicing Site": "Involved: Splicing Site",
    "Synonymous": "Involved: Synonymous",
    "Nonsense": "Involved: Nonsense",
}
FILTER_RULES = {
    "Other": "Filter: Other",
    "SNP": "Filter: SNP",
    "Driver": "Filter: Driver",
    "Known": "Filter: Known",
    "Hotspot": "Filter: Hotspot",
}
GENOME_CODES = {"hg19": 0, "GRCh37": 0, "hs37d5": 2, "b37": 1, "humanG1Kv37": 1}
VAF_CODES = {0.01: 0.0, 0.015: 0.5, 0.02: 1.0, 0.025: 1.5, 0.03: 2.0, 0.05: 4.0, 0.1: 9.0}
GERMLINE_CODES = {"tumor-normal": True, "tumor-only": False}
RESULT_LABELS = {
    "panel_id": "panel ID",
    "method": "Method",
    "exonic_size": "Exonic Size",
    "nonsense": "Involved: Nonsense",
    "nonstop": "Involved: Nonstop",
    "synonymous": "Involved: Synonymous",
    "silent": "Involved: Silent",
    "splice_site": "Involved: Splice site",
    "translation_start_site": "Involved: Translation Start Site",
    "hotspot": "Filter: Hotspot",
    "vaf_cutoff": "TMB VAF cut-off",
    "r2": "R2",
    "rmsle": "RMSLE",
    "ccc": "Concordance Correlation Coefficient",
    "acc": "Discrete Accuracy",
}
MODEL_FEATURES = [
    "Exonic Size", "Gene Count per Mb", "rgbrp", "TMB VAF cut-off", "Involved: Nonsense", "Involved: Nonstop",
    "Involved: Synonymous", "Involved: Silent", "Involved: Splice site", "Involved: Translation Start Site",
    "Filter: Hotspot",
]
MODEL_TARGETS = ["R2", "RMSLE", "Discrete Accuracy"]


def label_results(results: DataFrame, gene_counts: DataFrame | None = None) -> DataFrame:
    """Sweep results under their report labels, with the panel's gene count (panel ID, Gene Count) where given."""
    labelled = results.withColumnsRenamed(RESULT_LABELS)
    if "Involved: Slient" in labelled.columns:
        labelled = labelled.withColumnRenamed("Involved: Slient", "Involved: Silent")
    return labelled if gene_counts is None else labelled.join(gene_counts, "panel ID", "left")


@dataclass(frozen=True)
class Step:
    """One derivation: taken where all of ``needs`` exist; ``adds`` are columns, ``whole`` changes the table."""

    needs: tuple[str, ...]
    adds: dict[str, Column] = field(default_factory=dict)
    drops: tuple[str, ...] = ()
    whole: Callable[[DataFrame], DataFrame] | None = None


def _platform_effect(df: DataFrame) -> DataFrame:
    target = next((t for t in ("rgbrp", "RMSLE") if t in df.columns), None)
    if target is None:
        raise ValueError("no target column for the sequencing platform")
    return target_median_encode(df, "Sequencing Platform", target)


def _per_unit(column: str, unit: int) -> Step:
    return Step((column,), {f"{column} / {unit}": quoted(column) / F.lit(float(unit))}, (column,))


def _flags(column: str, labels: dict[str, str]) -> Step:
    return Step((column,), membership_flags(quoted(column), labels), (column,))


def _coded(column: str, value: Column) -> Step:
    return Step((column,), {column: value})


def preparation(remove_prefix: bool) -> list[Step]:
    """What is derived from the parameter columns. Only the platform's effect reads what another step adds."""
    panel = quoted("panel ID")
    density = ratio(quoted("Gene Count"), quoted("Exonic Size"))
    return [
        Step((), {"Method": panel_number(panel) if remove_prefix else strip_panel_suffix(panel)}),
        Step(("recall", "precision"), {"rgbrp": F.abs(error_balance(F.col("recall"), F.col("precision")))}),
        Step(("Sequencing Platform",), whole=_platform_effect),
        Step(("DNA shearing",), whole=lambda df: frequency_encode(df, "DNA shearing")),
        Step(("Exonic Size", "Gene Count"), {"Gene Count per Mb": density}, ("Gene Count",)),
        _coded("UMI", not_equal_or_null(quoted("UMI"), "No")),
        _coded("Reference Genome", map_values(quoted("Reference Genome"), GENOME_CODES)),
        _coded("Germline Strategy", map_values(quoted("Germline Strategy"), GERMLINE_CODES)),
        *[_coded(c, map_fractions(quoted(c), VAF_CODES)) for c in ("somatic VAF cut-off", "TMB VAF cut-off")],
        *[_per_unit(c, unit) for c, unit in (("Reads Length", 50), ("Sequencing Depth", 100))],
        *[_flags(c, v) for c, v in (("Callers", CALLERS), ("Involved Variants", VARIANT_TYPES), ("Filter Rules", FILTER_RULES))],
    ]


def prepare_features(df: DataFrame, remove_prefix: bool) -> DataFrame:
    """Turn parameter columns into numbers and flags by the steps whose columns exist."""
    steps = [s for s in preparation(remove_prefix) if set(s.needs) <= set(df.columns)]
    for step in steps:
        df = step.whole(df) if step.whole else df.withColumns(step.adds)
    return df.drop(*[c for s in steps for c in s.drops])
