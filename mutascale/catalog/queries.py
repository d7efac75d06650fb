"""The registered queries: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mutascale.catalog.bindings import (
    ROW_ID,
    RULES,
    clinical,
    intervals,
    panel_variants,
    table,
    variants,
)
from mutascale.functions import scalar
from mutascale.operators import anova, attribution, collinearity, encode, lookups, metrics, qc, sampling, trees
from mutascale.operators.burden import attach_burden, burden_flag, one_row_per_sample, rank_by_burden, sample_burden
from mutascale.operators.intervals import overlap_join, overlap_or, panel_length, to_zero_based
from mutascale.plans import cleanse, features, restrict, sweep
from mutascale.session import scratch_path, shuffle_width
from mutascale.sources import readers, schemas, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


def _studied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.with_study(variants(spark, sf_dir), clinical(spark, sf_dir), RULES)


# Quality control of samples and sites.


@query
def study_filter(spark, sf_dir):
    text = variants(spark, sf_dir, kind=False).withColumns({
        c: F.col(c).cast("string") for c in ("t_depth", "t_alt")
    })
    typed = scalar.cast_columns(text, ["t_depth", "t_alt"])
    studied = qc.with_study(typed, clinical(spark, sf_dir), RULES)
    return studied.select("sample", "study", "chr", "start", "t_depth", "t_alt", "label")


@query
def drop_tagged_samples(spark, sf_dir):
    rows = variants(spark, sf_dir, kind=False).select("sample", "chr", "start", "label")
    return qc.drop_tagged_samples(rows, RULES)


@query
def max_vaf_samples(spark, sf_dir):
    rows = variants(spark, sf_dir, kind=False).select("sample", "chr", "start", "vaf")
    return rounded(qc.keep_strong_samples(rows, RULES), 6, "vaf")


@query
def label_pivot(spark, sf_dir):
    return qc.label_pivot(variants(spark, sf_dir, kind=False), "sample", "label")


@query
def label_counts(spark, sf_dir):
    """The counts of the pivot in long form."""
    return qc.label_counts(variants(spark, sf_dir, kind=False), "sample", "label")


@query
def label_pivot_cells(spark, sf_dir):
    """The cells of the pivot by sample and label."""
    pivoted = qc.label_pivot(variants(spark, sf_dir, kind=False), "sample", "label")
    labels = pivoted.columns[1:]
    return pivoted.unpivot(["sample"], [f"`{c}`" for c in labels], "label", "n")


@query
def failed_proportion(spark, sf_dir):
    shares = qc.failed_proportion(variants(spark, sf_dir, kind=False), RULES)
    pivoted = qc.label_pivot(variants(spark, sf_dir, kind=False), "sample", "label")
    labels = pivoted.columns[1:]
    failed = [c for c in labels if any(a in c for a in RULES.artefact_labels)]
    summed = pivoted.select(
        "sample",
        scalar.row_sum([F.col(f"`{c}`") for c in failed]).alias("pivot_failed"),
        scalar.row_sum([F.col(f"`{c}`") for c in labels]).alias("pivot_rows"),
    )
    return rounded(shares.join(summed, "sample"), 6, "failed_proportion")


@query
def artefact_filter(spark, sf_dir):
    rows = variants(spark, sf_dir, kind=False).select("sample", "chr", "start", "label")
    return qc.drop_artefacts(rows, RULES)


def _barcode(sample: Column) -> Column:
    return F.format_string("S-%010d-01A-11D", sample)


@query
def site_filter(spark, sf_dir):
    rows = variants(spark, sf_dir).withColumn("sample", _barcode(F.col("sample")))
    return qc.site_filter(rows, RULES).select("sample", "array", "chr", "start", "type", "t_depth", "t_alt")


@query
def drop_constant_cols(spark, sf_dir):
    rows = variants(spark, sf_dir, sample=False, kind=False).select("l_orderkey", "chr", "start", "label", "vaf")
    flat = rows.withColumns({
        "build": F.lit("hg19"),
        "blank": F.lit(None).cast("string"),
        "partly": F.when(F.col("vaf") > 0.25, F.lit("x")),
    })
    return rounded(qc.drop_constant_columns(flat), 6, "vaf")


@query
def clean_rows(spark, sf_dir):
    cleaned = qc.clean_variants(_studied(spark, sf_dir), RULES)
    flagged = cleaned.withColumn("rate", burden_flag(F.col("wesTMB"), RULES))
    kept = flagged.select("sample", "study", "chr", "start", "type", "label", "vaf", "wesTMB", "rate")
    return rounded(kept, 6, "vaf", "wesTMB")


@query
def sample_tmb(spark, sf_dir):
    """Per surviving sample: sites, counted variants, burden and flag, from one aggregate."""
    profile = qc.sample_profile(_studied(spark, sf_dir), RULES).where(RULES.sample_passes())
    rated = profile.withColumn("wesTMB", qc.exome_burden(RULES))
    flagged = rated.withColumn("rate", burden_flag(F.col("wesTMB"), RULES))
    columns = ["sample", "n_rows", "max_vaf", "failed_proportion", "n_sites", "n_burden", "wesTMB", "rate"]
    return rounded(flagged.select(*columns), 6, "max_vaf", "failed_proportion", "wesTMB")


@query
def burden_left_join(spark, sf_dir):
    rows = variants(spark, sf_dir).select("sample", "chr", "start", "type", "vaf")
    joined = attach_burden(rows, RULES).withColumn("rate", burden_flag(F.col("wesTMB"), RULES))
    return rounded(joined, 6, "vaf", "wesTMB")


@query
def sample_burden_table(spark, sf_dir):
    return rounded(sample_burden(variants(spark, sf_dir), RULES), 6, "wesTMB")


def _burden_rows(spark, sf_dir) -> DataFrame:
    return attach_burden(variants(spark, sf_dir).select("sample", "chr", "start", "type", "vaf"), RULES)


@query
def tmb_rank_order(spark, sf_dir):
    """Every row with its position in the order by sample burden."""
    rows = _burden_rows(spark, sf_dir).where(F.col("sample").isNotNull())
    order = ["wesTMB", "sample", "chr", "start", "type", "vaf"]
    return rounded(sampling.with_ordinal(rows, order, "position"), 6, "vaf", "wesTMB")


@query
def head_rows(spark, sf_dir):
    """The first rows of that order: a top-k report."""
    ranked = rank_by_burden(_burden_rows(spark, sf_dir), "sample", "wesTMB", ["chr", "start", "type", "vaf"])
    return rounded(ranked.limit(500), 6, "vaf", "wesTMB")


# Lookups.


@query
def left_lookup_purity(spark, sf_dir):
    rows = variants(spark, sf_dir, kind=False).select(_barcode(F.col("sample")).alias("sample"), "chr", "start")
    keyed = rows.withColumn("array", F.substring("sample", 1, 15))
    accounts = table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0)
    purity = accounts.select(
        F.substring(_barcode(F.col("c_custkey")), 1, 15).alias("array"),
        F.round(F.col("c_acctbal") / 10000.0, 6).alias("purity"),
    )
    return lookups.left_lookup(keyed, purity, "array", ["purity"]).drop("array")


KEY = ["chr", "start", "l_returnflag", "l_linestatus", "sample"]


def _keyed(spark, sf_dir):
    rows = variants(spark, sf_dir).select(*KEY, "type", "l_tax", "l_discount")
    return rows.withColumn("hash", scalar.row_key(KEY).cast("string"))


@query
def row_key_annotate(spark, sf_dir):
    rows = _keyed(spark, sf_dir)
    annotation = (
        rows.where(F.col("l_discount") > 0.05).groupBy("hash").agg(F.max("l_tax").alias("AF"), F.count("*").cast("double").alias("AF_raw"))
    )
    joined = rows.drop("l_tax", "l_discount").join(annotation, "hash", "left").drop("hash")
    renamed = joined.withColumnsRenamed({"AF": "gnomad", "AF_raw": "gnomad_raw"})
    changed = renamed.withColumn(
        "type", F.when(F.col("gnomad") >= 0.04, F.lit("Synonymous_Mutation")).otherwise(F.col("type"))
    )
    return scalar.columns_first(changed, ["type", "gnomad"])


@query
def row_key_collisions(spark, sf_dir):
    """No two keys share a hash."""
    collided = cleanse.hash_collisions(variants(spark, sf_dir, kind=False), KEY)
    return collided.agg(F.count("*").alias("n_collisions"))


@query
def row_digests(spark, sf_dir):
    """The 128-bit key of every row."""
    rows = variants(spark, sf_dir, kind=False).select(*ROW_ID[:4], *KEY)
    return rows.withColumn("digest", scalar.row_digest(KEY)).select(*ROW_ID[:4], "digest")


@query
def verified_annotation(spark, sf_dir):
    """Annotations by a hash of only 256 values, so that all of them collide: the compared keys tell them apart."""
    rows = variants(spark, sf_dir, kind=False).select(*ROW_ID[:4], *KEY, "l_discount", "l_tax")
    hashed = rows.withColumn("hash", F.substring(scalar.row_digest(KEY), 1, 2))
    annotation = hashed.where(F.col("l_discount") > 0.05).groupBy("hash", *KEY).agg(F.max("l_tax").alias("AF"))
    return lookups.verified_lookup(hashed.drop("l_discount", "l_tax"), annotation, "hash", KEY, ["AF"])


@query
def one_to_one_join(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 45)
    stats = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count("*").cast("double").alias("n"), F.max("l_quantity").alias("top_quantity")
    )
    return lookups.join_one_to_one(parts, stats, ["p_partkey"])


@query
def dedupe_sample(spark, sf_dir):
    rows = _studied(spark, sf_dir).select("sample", "study", "label")
    returned = rows.where(F.col("label").startswith("R"))
    others = rows.where(~F.col("label").startswith("R"))
    return one_row_per_sample(returned.unionByName(others).drop("label"), ["sample", "study"])


# Intervals.


@query
def panel_size(spark, sf_dir):
    return rounded(panel_length(intervals(spark, sf_dir)), 6, "panel_mb")


@query
def interval_overlap(spark, sf_dir):
    """1-based calls, shifted, inside each panel; bin width from the interval lengths."""
    calls = variants(spark, sf_dir, sample=False, kind=False).select(
        *ROW_ID, "chr", (F.col("start") + 1).alias("start"), F.col("start").cast("bigint").alias("end0")
    )
    shifted = to_zero_based(calls).withColumn("end", F.col("end0") + 1).drop("end0")
    placed = overlap_join(shifted, intervals(spark, sf_dir))
    return placed.select("panel", *ROW_ID, "chr", "start", "end", "istart", "iend")


@query
def interval_overlap_counts(spark, sf_dir):
    """Overlapped rows and covered positions per panel, joined with a fixed bin width."""
    calls = variants(spark, sf_dir, sample=False, kind=False).select("chr", "start", "end")
    placed = overlap_join(calls, intervals(spark, sf_dir), bin_width=32)
    return placed.groupBy("panel", "chr").agg(F.count("*").alias("n_rows"), F.sum("start").alias("sum_start"))


@query
def panel_sample_count(spark, sf_dir):
    placed, lengths = panel_variants(spark, sf_dir)
    rows = placed.select("panel", "sample", "type", "vaf")
    counted = lookups.group_count(rows, ["panel", "sample"], width=shuffle_width(rows))
    burden = counted.join(lengths, "panel").withColumn("psTMB", F.col("n") / F.col("panel_mb"))
    return rounded(burden.drop("panel_mb"), 4, "psTMB", "vaf")


# Sampling and splits.


@query
def systematic_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*ROW_ID)
    return sampling.systematic_sample(rows, ROW_ID, 9, 0).select(*ROW_ID, "ordinal", "block", "picked")


@query
def train_test_split(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*ROW_ID[:4])
    return sampling.hash_split(rows, ROW_ID[:4], 0.2, 41)


@query
def exact_test_split(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return sampling.exact_split(rows, ["o_orderkey"], 0.2, 41)


# Scenarios.


@query
def scenario_grid(spark, sf_dir):
    """Every panel with every distinct scenario and its number of repeats."""
    panels = panel_length(intervals(spark, sf_dir)).select("panel")
    grid = sweep.with_scenarios(panels, sweep.Grid())
    flags = [sweep.class_in_mask(i).alias(name) for i, name in enumerate(sweep.OPTIONAL_CLASSES)]
    return grid.select(
        "panel", "recall", "precision", "multiplicity", "hotspot", "vaf_cutoff",
        F.size("classes").alias("n_classes"), *flags,
    )


@query
def scenario_filter_counts(spark, sf_dir):
    """Rows each filter of the grid keeps, over all variants reduced to (class, VAF, hotspot) cells."""
    cells = variants(spark, sf_dir, sample=False).groupBy("type", "vaf", "hot").agg(F.count("*").alias("m"))
    grid = sweep.with_scenarios(cells, sweep.Grid(somatic_accuracy=False))
    kept = grid.where(sweep.scenario_filter(F.col("type"), F.col("vaf"), F.col("hot")))
    return kept.groupBy("mask", "hotspot", "vaf_cutoff").agg(F.sum("m").alias("n_rows"))


def _sweep(spark, sf_dir, grid):
    placed, lengths = panel_variants(spark, sf_dir)
    return sweep.sweep(placed, lengths, grid)


@query
def scenario_sweep(spark, sf_dir):
    """The full grid: 18,900 distinct scenarios per panel."""
    scored = _sweep(spark, sf_dir, sweep.Grid())
    return rounded(scored, 4, "exonic_size", "coef", "intercept", "r2", "rmsle", "ccc", "acc")


@query
def scenario_sweep_default(spark, sf_dir):
    """All dimensions off: one scenario per panel."""
    grid = sweep.Grid(somatic_accuracy=False, gene_content=False, hotspot_filter=False, vaf_cutoff=False)
    return rounded(_sweep(spark, sf_dir, grid), 4, "exonic_size", "coef", "intercept", "r2", "rmsle", "ccc", "acc")


@query
def scenario_sweep_zip(spark, sf_dir):
    """Paired recall and precision without crossing, over class lists."""
    grid = sweep.Grid(hotspot_filter=False, vaf_cutoff=False, pairing="zip")
    return rounded(_sweep(spark, sf_dir, grid), 4, "exonic_size", "coef", "intercept", "r2", "rmsle", "ccc", "acc")


@query
def panel_files(spark, sf_dir):
    """Intervals written as one file per panel, found by file name and read back, with the panels chosen by their first letters."""
    named = intervals(spark, sf_dir).withColumn("panel", F.concat(F.lit("panel"), F.regexp_extract("panel", r"(\d+)$", 1)))
    folder = scratch_path(spark, "panels")
    writers.write_panels(named, folder)
    return readers.read_panels(spark, folder, [f"panel{i}{j}" for i in range(1, 5) for j in range(1, 6)])


@query
def unique_panels(spark, sf_dir):
    """The panel id list, written and read as comma-separated text, without the repeats of a panel."""
    number = F.col("p_partkey").cast("string")
    letter = F.element_at(F.array(*map(F.lit, "abcdef")), (F.col("p_size") % 6 + 1).cast("int"))
    ids = table(spark, sf_dir, "part").select(
        "p_brand", F.concat(F.lit("panel"), number).alias("panel"), F.concat(F.lit("p"), number, letter).alias("newID")
    )
    path = scratch_path(spark, "ids")
    writers.write_text_table(ids, path, separator=",")
    return readers.read_unique_panels(spark, path)


@query
def sheet_folder(spark, sf_dir):
    """Parts exported as sheets of two head lines each; the head lines of every file are skipped."""
    cells = table(spark, sf_dir, "part").select(
        "p_brand", F.col("p_partkey").alias("at"),
        F.concat_ws(",", F.concat(F.lit("p"), "p_partkey"), F.col("p_size") / 50.0, F.lit("x"), F.col("p_retailprice")).alias("value"),
    )
    heads = cells.select("p_brand").distinct().select(
        "p_brand", F.explode(F.array(F.lit(-2).cast("long"), F.lit(-1).cast("long"))).alias("at"), F.concat(F.lit("head,of,"), "p_brand").alias("value")
    )
    lines = cells.withColumn("at", F.col("at").cast("long")).unionByName(heads)
    path = scratch_path(spark, "sheets")
    ordered = lines.repartition("p_brand").sortWithinPartitions("p_brand", "at")
    ordered.select("p_brand", "value").write.partitionBy("p_brand").text(path)
    return readers.read_sheet(spark, path, schemas.T.StructType(schemas.ACCURACY_SHEET.fields[:3]), [0, 1, 3], skip_rows=2)


@query
def typed_scan(spark, sf_dir):
    """Measured burdens written as text with a further column, read with their types."""
    rows = variants(spark, sf_dir, kind=False).select(
        _barcode(F.col("sample")).alias("sample"), F.col("chr").cast("string").alias("panel_id"), F.col("l_linestatus").alias("extra"),
        F.col("l_returnflag").alias("product"), F.when(F.col("hot"), F.lit("other")).alias("group"), F.col("vaf").alias("wesTMB"),
    )
    path = scratch_path(spark, "typed")
    writers.write_text_table(rows, path)
    return rounded(readers.read_typed_table(spark, path, schemas.OBSERVATIONS), 6, "wesTMB")


@query
def overlap_policy(spark, sf_dir):
    """Counts per panel of the join that fails when nothing overlaps, and of the silent one where nothing does."""
    calls = variants(spark, sf_dir, sample=False, kind=False).select("chr", "start", "end")
    away = calls.withColumns({c: F.col(c) - F.lit(1 << 40) for c in ("start", "end")})
    sides = {"near": (calls, "error"), "away": (away, "silent")}
    joined = [
        overlap_or(df, intervals(spark, sf_dir), mode).select(F.lit(side).alias("side"), "panel") for side, (df, mode) in sides.items()
    ]
    return joined[0].unionByName(joined[1]).groupBy("side", "panel").agg(F.count("*").alias("n_rows"))


@query
def stored_scenarios(spark, sf_dir):
    """A stored list of unrelated scenarios, one for each nation."""
    k = F.col("n_nationkey")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by + 1).cast("int"))
    mask = (k * 7 % 64).cast("int")
    chosen = F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i)) > 0, F.lit(c)) for i, c in enumerate(sweep.OPTIONAL_CLASSES.values())])
    listed = table(spark, sf_dir, "nation").select(
        pick(sweep.ACCURACY_SCALE, k % 6).alias("recall"), pick(sweep.ACCURACY_SCALE, k % 4).alias("precision"),
        F.concat(F.array(*map(F.lit, sweep.BASE_CLASSES)), F.array_compact(chosen)).alias("classes"),
        (k % 2 == 0).alias("hotspot"), pick(sweep.VAF_CUTOFFS, k % 5).alias("vaf_cutoff"),
    )
    placed, lengths = panel_variants(spark, sf_dir)
    scored = sweep.sweep_scenarios(placed, lengths, listed)
    return rounded(scored, 4, "exonic_size", "coef", "intercept", "r2", "rmsle", "ccc", "acc")


# Calibration and scores per panel.


def _panel_samples(spark, sf_dir) -> DataFrame:
    """Counted variants per panel and sample, with panel burden."""
    placed, lengths = panel_variants(spark, sf_dir)
    kept = placed.where((F.col("wesTMB") <= sweep.MAX_BURDEN) & (F.col("vaf") >= 0.05))
    counts = kept.repartition(shuffle_width(kept), "panel", "sample").groupBy("panel", "sample", "is_test").agg(
        F.count("*").alias("n"), F.max("wesTMB").alias("wesTMB"), F.bool_or("rate").alias("rate")
    )
    return counts.join(lengths, "panel").withColumn("psTMB", F.col("n") / F.col("panel_mb")).drop("panel_mb")


def _predictions(spark, sf_dir) -> DataFrame:
    samples = _panel_samples(spark, sf_dir)
    fits = samples.where(~F.col("is_test")).groupBy("panel").agg(
        metrics.ols_slope(F.col("wesTMB"), F.col("psTMB")).alias("coef"),
        metrics.ols_intercept(F.col("wesTMB"), F.col("psTMB")).alias("intercept"),
    )
    raw = F.col("psTMB") * F.col("coef") + F.col("intercept")
    scored = samples.where("is_test").join(fits, "panel").withColumn("raw", raw)
    return scored.withColumn("fTMB", scalar.clip_at_zero(F.col("raw"))).withColumn("frate", F.col("fTMB") >= 10.0)


@query
def linear_calibration(spark, sf_dir):
    """Slope and intercept per panel, one observation per variant row."""
    placed, lengths = panel_variants(spark, sf_dir)
    train = placed.where((F.col("wesTMB") <= sweep.MAX_BURDEN) & (F.col("vaf") >= 0.05) & ~F.col("is_test"))
    dealt = train.repartition(shuffle_width(train), "panel", "sample")
    counted = dealt.groupBy("panel", "sample").agg(F.count("*").alias("n"), F.first("wesTMB").alias("wesTMB"))
    sized = counted.join(lengths, "panel").withColumn("x", F.col("n") / F.col("panel_mb"))
    fits = metrics.weighted_line(sized, "panel", "wesTMB", "x", "n").withColumnRenamed("weight", "n_rows")
    return rounded(fits, 6, "coef", "intercept")


@query
def confusion_accuracy(spark, sf_dir):
    cells = metrics.confusion(F.col("rate"), F.col("frate"), F.col("n"))
    table_ = _predictions(spark, sf_dir).groupBy("panel").agg(*[c.alias(k) for k, c in cells.items()])
    scored = table_.withColumn("acc", metrics.accuracy(*[F.col(k) for k in cells]))
    return rounded(scored, 6, "acc")


@query
def r_squared(spark, sf_dir):
    score = metrics.r_squared(F.col("wesTMB"), F.col("raw")).alias("r2")
    return rounded(_predictions(spark, sf_dir).groupBy("panel").agg(score), 6, "r2")


def _gaps(spark, sf_dir) -> DataFrame:
    """Predictions of which some are missing, and some true values as well."""
    rows = _predictions(spark, sf_dir)
    draw = sampling.uniform_hash(F.lit("gap"), F.col("sample"))
    return rows.select(
        "panel", F.when(draw % 5 != 0, F.col("wesTMB")).alias("y"), F.when(draw % 7 != 0, F.col("fTMB")).alias("p")
    )


@query
def r_squared_gaps(spark, sf_dir):
    """Only rows with both sides count."""
    score = metrics.r_squared(F.col("y"), F.col("p")).alias("r2")
    return rounded(_gaps(spark, sf_dir).groupBy("panel").agg(score), 6, "r2")


@query
def concordance_gaps(spark, sf_dir):
    """Only rows with both sides count."""
    score = metrics.concordance(F.col("y"), F.col("p")).alias("ccc")
    return rounded(_gaps(spark, sf_dir).groupBy("panel").agg(score), 6, "ccc")


@query
def rmsle(spark, sf_dir):
    score = metrics.rmsle(F.col("wesTMB"), F.col("fTMB")).alias("rmsle")
    return rounded(_predictions(spark, sf_dir).groupBy("panel").agg(score), 6, "rmsle")


@query
def rmse(spark, sf_dir):
    score = metrics.rmse(F.col("wesTMB"), F.col("fTMB")).alias("rmse")
    return rounded(_predictions(spark, sf_dir).groupBy("panel").agg(score), 6, "rmse")


@query
def concordance(spark, sf_dir):
    pairs = _predictions(spark, sf_dir).dropDuplicates(["panel", "fTMB", "wesTMB"])
    score = metrics.concordance(F.col("wesTMB"), F.col("fTMB")).alias("ccc")
    return rounded(pairs.groupBy("panel").agg(score), 6, "ccc")


# Features.

NUMERIC = ["l_quantity", "l_discount", "l_tax", "l_extendedprice", "t_alt", "hot"]


@query
def corr_matrix(spark, sf_dir):
    rows = variants(spark, sf_dir, sample=False, kind=False)
    return rounded(collinearity.correlation_matrix(rows, NUMERIC), 6, "r")


@query
def vif(spark, sf_dir):
    rows = variants(spark, sf_dir, sample=False, kind=False)
    return rounded(collinearity.variance_inflation(rows, ["l_quantity", "t_alt", "hot"]), 6, "vif")


@query
def frequency_encode(spark, sf_dir):
    rows = variants(spark, sf_dir, sample=False).select(*ROW_ID[:4], "type")
    return encode.frequency_encode(rows, "type", "type_count")


@query
def target_median_encode(spark, sf_dir):
    rows = variants(spark, sf_dir, sample=False).select(*ROW_ID[:4], "type", "l_extendedprice")
    return rounded(encode.target_median_encode(rows, "type", "l_extendedprice", "type_price"), 4, "type_price")


@query
def membership_flags(spark, sf_dir):
    words = {"red": "has_red", "ring": "has_ring", "Red": "has_capital_red", "old": "has_old"}
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    flagged = parts.withColumns(scalar.membership_flags(F.col("p_name"), words))
    return flagged.withColumn("red_number", scalar.as_flag(F.col("has_red")))


@query
def value_maps(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*ROW_ID[:4], "l_discount", "l_returnflag", "l_linestatus")
    return lines.withColumns({
        "cutoff_code": scalar.map_fractions(F.col("l_discount"), features.VAF_CODES),
        "flag_code": scalar.map_values(F.col("l_returnflag"), {"A": 0.0, "N": 1.0}),
        "is_filled": scalar.not_equal_or_null(F.col("l_linestatus"), "O"),
        "decoded": scalar.decode_number(
            F.when(F.col("l_discount") > 0.03, F.col("l_discount").cast("string")).otherwise(F.lit(".")), default=0.0
        ),
    }).drop("l_discount", "l_returnflag", "l_linestatus")


@query
def unit_scale(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("panel", F.concat(F.lit("p"), "p_partkey", F.lit("a")))
    scaled = parts.select(
        "p_partkey",
        scalar.panel_number(F.col("panel")).alias("number"),
        scalar.strip_panel_suffix(F.col("panel")).alias("method"),
        scalar.ratio(F.col("p_retailprice"), F.col("p_size")).alias("price_per_size"),
        (F.col("p_size") / 50.0).alias("size_50"),
        F.abs(scalar.error_balance(F.col("p_size") / 50.0, F.lit(0.5))).alias("balance"),
    )
    return rounded(scaled, 6, "price_per_size", "size_50", "balance")


def _sheet(spark, sf_dir) -> DataFrame:
    """Parts as a panel parameter sheet, with every column the feature preparation knows."""
    size = F.col("p_size")

    def pick(place: Column, *values) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (place + 1).cast("int"))

    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), "p_partkey", F.lit("a")).alias("panel ID"),
        (0.5 + size / 100.0).alias("recall"),
        (1.0 - size / 200.0).alias("precision"),
        (size / 10.0).alias("Exonic Size"),
        (size * 3).alias("Gene Count"),
        F.col("p_type").alias("DNA shearing"),
        pick(size % 2, "No", "Yes").alias("UMI"),
        (size * 2).alias("Reads Length"),
        (size * 10).alias("Sequencing Depth"),
        F.col("p_brand").alias("Sequencing Platform"),
        pick(size % 4, "hg19", "b37", "hs37d5", "hg38").alias("Reference Genome"),
        F.concat_ws(", ", pick(size % 3, "VarDict", "Delly", "Manta"), F.lit("GATK Mutect2")).alias("Callers"),
        pick(size % 3, 0.01, 0.05, 0.07).alias("TMB VAF cut-off"),
        pick(size % 3, "Missense", "Missense, Indel", "Other").alias("Involved Variants"),
        pick(size % 2, "SNP, Known", "Hotspot").alias("Filter Rules"),
        pick(size % 2, "tumor-normal", "tumor-only").alias("Germline Strategy"),
    )


@query
def prepare_features(spark, sf_dir):
    ready = features.prepare_features(_sheet(spark, sf_dir), remove_prefix=True)
    kept = ready.select(
        F.col("panel ID").alias("panel_id"),
        F.col("Method").alias("method"),
        F.col("Gene Count per Mb").alias("genes_per_mb"),
        "rgbrp",
        F.col("DNA shearing").alias("shearing"),
        F.col("UMI").alias("umi"),
        F.col("Reads Length / 50").alias("reads"),
        F.col("Sequencing Depth / 100").alias("depth"),
        F.col("Sequencing Platform").alias("platform"),
        F.col("Reference Genome").cast("double").alias("genome"),
        F.col("Caller: VarDict").alias("vardict"),
        F.col("Caller: Mutect2").alias("mutect2"),
        F.col("TMB VAF cut-off").alias("cutoff"),
        F.col("Involved: Indel").alias("indel"),
        F.col("Filter: Known").alias("known"),
        F.col("Germline Strategy").alias("germline"),
    )
    return rounded(kept, 6, "genes_per_mb", "rgbrp", "reads", "depth", "platform")


# Linear models.

ANOVA_MODEL = anova.LinearModel("t_alt", ("type",), ("t_depth",), (("type",), ("t_depth",)))


def _anova(spark, sf_dir, typ):
    rows = variants(spark, sf_dir, sample=False).select("t_alt", "type", "t_depth")
    shown = anova.anova_table(rows, ANOVA_MODEL, typ).select("factor", "sum_sq", "df", F.col("F").alias("f_value"), "eta_sq")
    return rounded(shown, 4, "sum_sq", "f_value", "eta_sq")


@query
def anova_type2(spark, sf_dir):
    return _anova(spark, sf_dir, 2)


@query
def anova_type3(spark, sf_dir):
    return _anova(spark, sf_dir, 3)


WIDE_MODEL = anova.LinearModel("t_alt", ("l_orderkey",), ("t_depth",), (("l_orderkey",), ("t_depth",)))


@query
def anova_wide(spark, sf_dir):
    """A factor with a level for every order, beside a covariate."""
    rows = variants(spark, sf_dir, sample=False).select("t_alt", "l_orderkey", "t_depth")
    shown = anova.anova_table(rows, WIDE_MODEL, 2).select("factor", "sum_sq", "df", F.col("F").alias("f_value"), "eta_sq")
    return rounded(shown, 4, "sum_sq", "f_value", "eta_sq")


@query
def anova_wide_effects(spark, sf_dir):
    """The estimate of every level of the wide factor and of the covariate."""
    rows = variants(spark, sf_dir, sample=False).select("t_alt", "l_orderkey", "t_depth")
    shown = anova.coefficient_table(rows, WIDE_MODEL).select("coefficient", "estimate", "std_error")
    return rounded(shown, 4, "estimate", "std_error")


@query
def ols_coefficients(spark, sf_dir):
    rows = variants(spark, sf_dir, sample=False).select("t_alt", "type", "t_depth")
    shown = anova.coefficient_table(rows, ANOVA_MODEL).select("coefficient", "estimate", "std_error", "t")
    return rounded(shown, 4, "estimate", "std_error", "t")


@query
def anova_crossed(spark, sf_dir):
    """Two crossed factors, one more factor and a covariate; both types in long form."""
    rows = variants(spark, sf_dir, sample=False).select("t_alt", "l_linestatus", "chr", "l_returnflag", "t_depth")
    terms = (("chr",), ("l_returnflag",), ("chr", "l_returnflag"), ("l_linestatus",), ("t_depth",))
    model = anova.LinearModel("t_alt", ("chr", "l_returnflag", "l_linestatus"), ("t_depth",), terms)
    result = anova.fit(rows, model)
    second, third = (
        anova.anova_table(rows, model, typ, result).withColumn("typ", F.lit(typ)) for typ in (2, 3)
    )
    return rounded(second.unionByName(third).drop("term_order"), 6, "sum_sq", "F", "p_value", "eta_sq")


@query
def panel_restrict(spark, sf_dir):
    """The sweep's input from 1-based variants with ``.`` for missing numbers and the three-part hotspot rule."""
    rows = variants(spark, sf_dir).withColumns({
        "start": F.col("start") + 1,
        "max_maf": F.when(F.col("l_tax") > 0, F.col("l_tax").cast("string")).otherwise("."),
        "purity": F.when(F.col("l_discount") > 0.02, F.col("l_discount").cast("string")).otherwise("."),
        "cosmic96_coding": F.when(F.col("l_quantity") > 10, F.col("t_depth").cast("string")).otherwise("."),
        "cancerhotspot": F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "R"),
        "civic": F.col("l_tax") >= 0.07,
    })
    rated = attach_burden(rows, RULES).withColumn("rate", burden_flag(F.col("wesTMB"), RULES))
    marked = sampling.hash_split(rated.withColumnRenamed("sample", "Tumor_Sample_Barcode"), ["Tumor_Sample_Barcode"])
    train, test = marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")
    return rounded(restrict.sweep_input(train, test, intervals(spark, sf_dir)), 6, "vaf", "wesTMB")


# Trees.

TREE_FEATURES = ["l_quantity", "l_discount", "l_tax", "chr", "hot"]


def _tree_rows(spark, sf_dir) -> DataFrame:
    rows = variants(spark, sf_dir, sample=False, kind=False).select(
        *[c for c in ROW_ID if c not in ("l_quantity",)], *TREE_FEATURES, F.col("t_alt").cast("double").alias("t_alt")
    )
    return sampling.hash_split(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


def _fitted(spark, sf_dir):
    rows = _tree_rows(spark, sf_dir)
    train = sampling.hash_split(rows.where(~F.col("is_test")).drop("is_test"), ["l_orderkey"], 0.2, 42)
    params = trees.TreeParams(eta=0.3, max_depth=4, subsample=0.8, min_child_weight=5)
    marked = train.withColumnRenamed("is_test", "is_validation")
    model = trees.fit_boosted(marked, TREE_FEATURES, "t_alt", params, rounds=10, validation="is_validation")
    return model, rows.where("is_test")


@query
def gbt_predict(spark, sf_dir):
    model, test = _fitted(spark, sf_dir)
    scored = trees.predict(model, test, TREE_FEATURES, "t_alt")
    known = (F.col("prediction").isNotNull() & ~F.isnan("prediction")).alias("known")
    return scored.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "t_alt", known)


@query
def tune_gbt(spark, sf_dir):
    """One row per trial; a trial is sound when its error is finite and the best beats a constant prediction."""
    train = _tree_rows(spark, sf_dir).where(~F.col("is_test"))
    found = trees.search(train, TREE_FEATURES, "t_alt", trees.draw_params(3, 7), rounds=3, parallelism=3)
    constant, best = train.agg(F.stddev_pop("t_alt")).first()[0], found.agg(F.min("rmse")).first()[0]
    finite = F.col("rmse").isNotNull() & ~F.isnan("rmse") & (F.col("rmse") < float("inf"))
    return found.select("trial", (finite & F.lit(best <= constant)).alias("sound"))


@query
def tree_attribution(spark, sf_dir):
    """Rows explained, and whether the attributions of each add up to its prediction."""
    model, test = _fitted(spark, sf_dir)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = test.select(*keys, *TREE_FEATURES, "t_alt")
    explained = attribution.attribute(model, rows, [*TREE_FEATURES], "t_alt", [], interactions=True)
    pairs = F.transform("interactions", lambda row: F.aggregate(row, F.lit(0.0), lambda acc, v: acc + v))
    off = F.array_max(F.zip_with(pairs, F.col("phi"), lambda total, phi: F.abs(total - phi)))
    checked = explained.select("phi", (F.abs("gap") < 1e-6).alias("adds_up"), (off < 1e-6).alias("pairs_add_up"))
    sums = checked.agg(
        F.count("*").alias("n_rows"), F.every("adds_up").alias("adds_up"), F.every("pairs_add_up").alias("pairs_add_up"),
        *[F.avg(F.abs(F.col("phi")[i])).alias(f"m{i}") for i in range(len(TREE_FEATURES))],
    )
    cells = F.array(*[
        F.struct(F.lit(f).alias("feature"), (F.col(f"m{i}") >= 0).alias("finite")) for i, f in enumerate(TREE_FEATURES)
    ])
    return sums.select("n_rows", "adds_up", "pairs_add_up", F.inline(cells))


def _step_rows(spark, sf_dir) -> DataFrame:
    """One 0/1 feature, a training fifth for validation, and held-out rows."""
    rows = _tree_rows(spark, sf_dir).withColumn("hot", F.col("hot").cast("double"))
    return sampling.hash_split(rows.withColumnRenamed("is_test", "held"), ["l_orderkey"], 0.2, 42).withColumnRenamed("is_test", "validation")


def _step_model(spark, sf_dir, **options):
    rows = _step_rows(spark, sf_dir)
    params = trees.TreeParams(eta=0.3, max_depth=1)
    return rows, trees.fit_patient(rows.where("NOT held"), ["hot"], "t_alt", "validation", params, **options)


@query
def gbt_step(spark, sf_dir):
    """Predictions of a boosted model of depth 1 on one 0/1 feature: the means of the two groups."""
    rows, fitted = _step_model(spark, sf_dir, rounds=3, patience=2)
    scored = trees.predict(fitted.model, rows.where("held"), ["hot"], "t_alt")
    return rounded(scored.select(*ROW_ID[:1], "l_linenumber", "l_partkey", "l_suppkey", "prediction"), 6, "prediction")


@query
def gbt_patience(spark, sf_dir):
    """Validation error of every prefix of the ensemble that was tried, and the round that is kept."""
    _, fitted = _step_model(spark, sf_dir, rounds=8, patience=2)
    rows = [(i + 1, float(e), fitted.best == i + 1) for i, e in enumerate(fitted.errors)]
    return rounded(spark.createDataFrame(rows, "round int, mse double, kept boolean"), 6, "mse")


@query
def step_attribution(spark, sf_dir):
    """Attributions of the same model: group mean less overall mean of the training rows."""
    rows, fitted = _step_model(spark, sf_dir, rounds=3, patience=2)
    explained = attribution.attribute(fitted.model, rows.where("held"), ["hot"], "t_alt", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    shown = explained.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("phi")[0].alias("phi"), "base")
    return rounded(shown, 6, "phi", "base")


def _step_explained(spark, sf_dir) -> DataFrame:
    rows, fitted = _step_model(spark, sf_dir, rounds=3, patience=2)
    return attribution.attribute(fitted.model, rows.where("held"), ["hot"], "t_alt", ["l_orderkey"])


@query
def step_importance(spark, sf_dir):
    """Mean absolute attribution of the same model."""
    return rounded(attribution.mean_attribution(_step_explained(spark, sf_dir), ["hot"]), 6, "mean_abs_phi")


@query
def step_dependence(spark, sf_dir):
    """Attribution against value, counted per point."""
    points = rounded(attribution.dependence(_step_explained(spark, sf_dir), ["hot"], "hot", "hot"), 6, "phi")
    return points.groupBy("value", "phi", "colour").agg(F.count("*").alias("n"))


@query
def step_score(spark, sf_dir):
    """Refit with given parameters, and the error on the held-out rows: the spread within the two groups."""
    rows = _step_rows(spark, sf_dir)
    params = trees.TreeParams(eta=0.3, max_depth=1)
    model = trees.fit_boosted(rows.where("NOT held"), ["hot"], "t_alt", params, rounds=2, validation="validation")
    held = rows.where("held")
    error = trees.held_out_rmse(model, held, ["hot"], "t_alt")
    return held.agg(F.count("*").alias("n_rows"), F.round(F.lit(error), 6).alias("rmse"))


@query
def gaussian_model(spark, sf_dir):
    rows = variants(spark, sf_dir, sample=False, kind=False)
    table_ = trees.gaussian_model(rows, ["l_quantity", "l_discount"], "t_alt")
    return rounded(table_.select("coefficient", "estimate", "std_error"), 4, "estimate", "std_error")


# Sinks and round trips.


@query
def publish_minimal(spark, sf_dir):
    """Cleaned rows written as lz4 parquet and as a headerless text table, then read back and joined."""
    cleaned = qc.clean_variants(_studied(spark, sf_dir), RULES)
    kept = cleaned.select(*ROW_ID[:4], "sample", "study", "chr", "start", "type", "wesTMB")
    path = scratch_path(spark, "minimal")
    writers.write_parquet(kept, path, "lz4_raw")
    stored = readers.read_parquet(spark, path)
    keys = scratch_path(spark, "keys")
    writers.write_text_table(stored.select("sample", "study").distinct(), keys)
    named = readers.read_text_table(spark, keys, ["sample"]).withColumn("sample", F.col("sample").cast("bigint"))
    return rounded(scalar.columns_first(stored.join(named, "sample"), ["type", "sample"]), 6, "wesTMB")


def _published_rows(spark, sf_dir) -> DataFrame:
    """Cleaned variants under the names of the published tables, before annotation."""
    cleaned = qc.clean_variants(_studied(spark, sf_dir), RULES)
    given = {
        "Hugo_Symbol": F.col("label"), "Chromosome": F.col("chr").cast("string"), "Start_Position": F.col("start").cast("int"),
        "End_Position": F.col("end").cast("int"), "Variant_Classification": F.col("type"), "Reference_Allele": F.col("l_returnflag"),
        "Tumor_Seq_Allele2": F.col("l_linestatus"), "Tumor_Sample_Barcode": _barcode(F.col("sample")),
        "Study_Abbreviation": F.col("study"), "t_depth": F.col("t_depth"), "t_alt_count": F.col("t_alt"), "VAF": F.col("vaf"),
        "wesTMB": F.col("wesTMB"), "rate": burden_flag(F.col("wesTMB"), RULES),
        "Consequence": F.when(F.col("hot"), F.lit("synonymous_variant")).otherwise(F.lit("missense_variant")),
    }
    annotated = {*schemas.ANNOTATION_FREQUENCIES, *schemas.ANNOTATION_RENAMES.values(), "cosmic96_coding"}
    blank = [c for c in schemas.COMPLETE_COLUMNS if c not in annotated and c not in given and c != "hash"]
    named = cleaned.select(*[v.alias(c) for c, v in given.items()], *[F.lit(None).cast("string").alias(c) for c in blank])
    return named.withColumn("hash", scalar.row_digest(schemas.KEY_COLUMNS))


@query
def publish_tables(spark, sf_dir):
    """Cleaned rows to the annotator's input, its output by verified keys, and the three tables as one published set.

    The annotator is stood in for by a rule on the position; its output passes through text like the real one.
    """
    rows = _published_rows(spark, sf_dir)
    writers.write_annotator_input(rows, given := scratch_path(spark, "annotator"))
    keys = ["Chromosome", "Start_Position", "Reference_Allele", "Tumor_Seq_Allele2"]
    start = F.col("Start_Position").cast("int")
    known = F.when(start % 3 == 0, (start % 100 / 1000).cast("string")).otherwise(F.lit("."))
    returned = readers.read_annotator_input(spark, given).select("hash", *keys).distinct().select(
        "hash", *keys, *[(known if c == "AF" else F.lit(".")).alias(c) for c in schemas.ANNOTATION_FREQUENCIES],
        (start % 7).cast("string").alias("cosmic96_coding"),
    )
    writers.write_text_table(returned, path := scratch_path(spark, "annotated"))
    annotation = readers.read_annotation(spark, path, keys)
    folder = scratch_path(spark, "published")
    writers.publish_set(cleanse.published(cleanse.annotate(rows, annotation, keys)), folder)
    shown = []
    for name in ("complete", "concise", "minimal"):
        stored = readers.read_publication(spark, folder, name)
        extra = [F.col(c) if c in stored.columns else F.lit(None).cast(t).alias(c) for c, t in (("gnomad", "double"), ("cosmic96_coding", "string"))]
        shown.append(stored.select(
            F.lit(name).alias("table_name"), F.lit(len(stored.columns)).alias("n_columns"), *schemas.MINIMAL_COLUMNS, *extra
        ))
    return rounded(shown[0].unionByName(shown[1]).unionByName(shown[2]), 6, "VAF", "wesTMB", "gnomad")


@query
def results_by_panel(spark, sf_dir):
    """Sweep results written one folder per panel and read back with their report labels."""
    path = scratch_path(spark, "results")
    grid = sweep.Grid(gene_content=False, hotspot_filter=False)
    writers.write_by_panel(_sweep(spark, sf_dir, grid), path)
    labelled = features.label_results(readers.read_results(spark, path))
    counted = labelled.groupBy(F.col("panel ID").alias("panel_id"), F.col("TMB VAF cut-off").alias("vaf_cutoff")).agg(
        F.count("*").alias("n_scenarios"), F.sum("whfh").alias("whfh"), F.avg("R2").alias("mean_r2")
    )
    return rounded(counted.withColumn("panel_id", F.col("panel_id").cast("string")), 4, "mean_r2")
