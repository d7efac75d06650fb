"""Declared schemas and column lists of the library's tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names, in the order the tables are published.
INTEGER_COLUMNS = [
    "Start_Position", "End_Position", "t_depth", "t_ref_count", "t_alt_count", "n_depth", "n_ref_count", "n_alt_count",
]
KEY_COLUMNS = ["Chromosome", "Start_Position", "Reference_Allele", "Tumor_Seq_Allele2", "Tumor_Sample_Barcode"]
ANNOTATOR_INPUT = [
    "Chromosome", "Start_Position", "End_Position", "Reference_Allele", "Tumor_Seq_Allele2", "hash",
]
ANNOTATION_FREQUENCIES = [
    "ALL.sites.2015_08", "AFR.sites.2015_08", "AMR.sites.2015_08", "EAS.sites.2015_08", "EUR.sites.2015_08",
    "SAS.sites.2015_08", "ExAC_ALL", "ExAC_AFR", "ExAC_AMR", "ExAC_EAS", "ExAC_FIN", "ExAC_NFE", "ExAC_OTH",
    "ExAC_SAS", "AF", "AF_popmax", "AF_male", "AF_female", "AF_raw", "AF_afr", "AF_sas", "AF_amr", "AF_eas",
    "AF_nfe", "AF_fin", "AF_asj", "AF_oth", "non_topmed_AF_popmax", "non_neuro_AF_popmax", "non_cancer_AF_popmax",
    "controls_AF_popmax",
]
ANNOTATION_RENAMES = {
    "ALL.sites.2015_08": "GMAF", "AFR.sites.2015_08": "AFR_MAF", "AMR.sites.2015_08": "AMR_MAF",
    "EAS.sites.2015_08": "EAS_MAF", "EUR.sites.2015_08": "EUR_MAF", "SAS.sites.2015_08": "SAS_MAF",
    "AF": "gnomad", "AF_popmax": "gnomad_popmax", "AF_male": "gnomad_male", "AF_female": "gnomad_female",
    "AF_raw": "gnomad_raw", "AF_afr": "gnomad_afr", "AF_sas": "gnomad_sas", "AF_amr": "gnomad_amr",
    "AF_eas": "gnomad_eas", "AF_nfe": "gnomad_nfe", "AF_fin": "gnomad_fin", "AF_asj": "gnomad_asj",
    "AF_oth": "gnomad_oth",
}
LEADING_COLUMNS = ["Hugo_Symbol", "Chromosome", "Start_Position", "End_Position", "Variant_Classification"]
COMPLETE_COLUMNS = [
    *LEADING_COLUMNS, "Variant_Type", "Reference_Allele", "Tumor_Seq_Allele1", "Tumor_Seq_Allele2", "dbSNP_RS",
    "Tumor_Sample_Barcode", "Matched_Norm_Sample_Barcode", "Match_Norm_Seq_Allele1", "Match_Norm_Seq_Allele2",
    "HGVSc", "HGVSp", "HGVSp_Short", "Transcript_ID", "Exon_Number", "t_depth", "t_ref_count", "t_alt_count",
    "n_depth", "n_ref_count", "n_alt_count", "all_effects", "Allele", "Gene", "Feature", "Consequence",
    "cDNA_position", "CDS_position", "Protein_position", "Amino_acids", "Codons", "Existing_variation", "STRAND",
    "SYMBOL", "SYMBOL_SOURCE", "HGNC_ID", "BIOTYPE", "CANONICAL", "CCDS", "ENSP", "SWISSPROT", "TREMBL", "UNIPARC",
    "SIFT", "PolyPhen", "EXON", "INTRON", "DOMAINS", "GMAF", "AFR_MAF", "AMR_MAF", "EAS_MAF", "EUR_MAF", "SAS_MAF",
    "AA_MAF", "EA_MAF", "ExAC_ALL", "ExAC_AFR", "ExAC_AMR", "ExAC_EAS", "ExAC_FIN", "ExAC_NFE", "ExAC_OTH",
    "ExAC_SAS", "gnomad", "gnomad_popmax", "gnomad_male", "gnomad_female", "gnomad_raw", "gnomad_afr", "gnomad_sas",
    "gnomad_amr", "gnomad_eas", "gnomad_nfe", "gnomad_fin", "gnomad_asj", "gnomad_oth", "non_topmed_AF_popmax",
    "non_neuro_AF_popmax", "non_cancer_AF_popmax", "controls_AF_popmax", "cosmic96_coding", "CLIN_SIG", "SOMATIC",
    "PUBMED", "IMPACT", "VARIANT_CLASS", "HGVS_OFFSET", "PHENO", "GENE_PHENO", "COSMIC", "CENTERS", "CONTEXT",
    "DBVS", "NCALLERS", "Study_Abbreviation", "VAF", "purity", "wesTMB", "rate", "hash",
]
CONCISE_COLUMNS = [
    *LEADING_COLUMNS, "Variant_Type", "Reference_Allele", "Tumor_Seq_Allele1", "Tumor_Seq_Allele2",
    "Tumor_Sample_Barcode", "Matched_Norm_Sample_Barcode", "Match_Norm_Seq_Allele1", "Match_Norm_Seq_Allele2",
    "HGVSc", "HGVSp", "HGVSp_Short", "Transcript_ID", "Exon_Number", "t_depth", "t_ref_count", "t_alt_count",
    "n_depth", "n_ref_count", "n_alt_count", "Allele", "Consequence", "cDNA_position", "CDS_position",
    "Protein_position", "STRAND", "CCDS", "EXON", "INTRON", "GMAF", "AFR_MAF", "AMR_MAF", "EAS_MAF", "EUR_MAF",
    "SAS_MAF", "AA_MAF", "EA_MAF", "ExAC_ALL", "ExAC_AFR", "ExAC_AMR", "ExAC_EAS", "ExAC_FIN", "ExAC_NFE",
    "ExAC_OTH", "ExAC_SAS", "gnomad", "gnomad_popmax", "gnomad_male", "gnomad_female", "gnomad_raw", "gnomad_afr",
    "gnomad_sas", "gnomad_amr", "gnomad_eas", "gnomad_nfe", "gnomad_fin", "gnomad_asj", "gnomad_oth",
    "non_topmed_AF_popmax", "non_neuro_AF_popmax", "non_cancer_AF_popmax", "controls_AF_popmax", "cosmic96_coding",
    "CLIN_SIG", "VARIANT_CLASS", "CONTEXT", "Study_Abbreviation", "purity", "VAF", "wesTMB", "rate", "hash",
]
MINIMAL_COLUMNS = [
    "Chromosome", "Start_Position", "End_Position", "Consequence", "Variant_Classification", "Tumor_Sample_Barcode",
    "purity", "VAF", "wesTMB", "rate", "hash",
]

CLINICAL = T.StructType([
    T.StructField("Tumor_Sample_Barcode", T.StringType()),
    T.StructField("Study_Abbreviation", T.StringType()),
])
PURITY = T.StructType([T.StructField("array", T.StringType()), T.StructField("purity", T.DoubleType())])
INTERVALS = T.StructType([
    T.StructField("chr", T.StringType()),
    T.StructField("istart", T.IntegerType()),
    T.StructField("iend", T.IntegerType()),
])
OBSERVATIONS = T.StructType([
    T.StructField("sample", T.StringType()),
    T.StructField("panel_id", T.StringType()),
    T.StructField("product", T.StringType()),
    T.StructField("group", T.StringType()),
    T.StructField("wesTMB", T.DoubleType()),
])
SWEEP_VARIANTS = T.StructType([
    T.StructField("chr", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("Tumor_Sample_Barcode", T.StringType()),
    T.StructField("purity", T.DoubleType()),
    T.StructField("vaf", T.DoubleType()),
    T.StructField("wesTMB", T.DoubleType()),
    T.StructField("rate", T.BooleanType()),
    T.StructField("max_maf", T.DoubleType()),
    T.StructField("cosmic96_coding", T.DoubleType()),
    T.StructField("cancerhotspot", T.BooleanType()),
    T.StructField("civic", T.BooleanType()),
    T.StructField("Hugo_Symbol", T.StringType()),
])
ACCURACY_SHEET = T.StructType([
    T.StructField("panel ID", T.StringType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("RMSLE", T.DoubleType()),
])
PARAMETER_SHEET = T.StructType([
    T.StructField("panel ID", T.StringType()),
    T.StructField("Exonic Size", T.DoubleType()),
    T.StructField("Gene Count", T.IntegerType()),
    T.StructField("DNA shearing", T.StringType()),
    T.StructField("UMI", T.StringType()),
    T.StructField("Reads Length", T.IntegerType()),
    T.StructField("Sequencing Depth", T.IntegerType()),
    T.StructField("Sequencing Platform", T.StringType()),
    T.StructField("Reference Genome", T.StringType()),
    T.StructField("Callers", T.StringType()),
    T.StructField("somatic VAF cut-off", T.DoubleType()),
    T.StructField("TMB VAF cut-off", T.DoubleType()),
    T.StructField("Involved Variants", T.StringType()),
    T.StructField("Filter Rules", T.StringType()),
    T.StructField("Germline Strategy", T.StringType()),
])
PANEL_IDS = T.StructType([T.StructField("panel", T.StringType()), T.StructField("newID", T.StringType())])
SCENARIOS = T.StructType([
    T.StructField("scenario_id", T.LongType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("hotspot", T.BooleanType()),
    T.StructField("vaf_cutoff", T.DoubleType()),
])
