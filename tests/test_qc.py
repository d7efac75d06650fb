import pytest
from pyspark.sql import functions as F

from mutascale.functions import scalar
from mutascale.operators import burden, qc
from mutascale.operators.qc import QcRules

RULES = QcRules(studies=["COAD"])
SCHEMA = "Tumor_Sample_Barcode string, FILTER string, t_depth int, t_alt_count int, Variant_Classification string"


def table(spark, rows):
    return qc.with_vaf(spark.createDataFrame(rows, SCHEMA), RULES)


def samples(df):
    return sorted({r.Tumor_Sample_Barcode for r in df.collect()})


def test_tagged_sample_goes_whole(spark):
    rules = QcRules()
    df = table(spark, [
        ("a", "PASS", 30, 10, "Silent"), ("a", "xx-wga", 30, 10, "Silent"),
        ("b", "PASS", 30, 10, "Silent"), ("b", None, 30, 10, "Silent"),
    ])
    kept = qc.drop_tagged_samples(df, rules)
    assert samples(kept) == ["b"] and kept.count() == 2


def test_max_vaf_is_strict(spark):
    rules = QcRules()
    df = table(spark, [("a", "PASS", 100, 10, "Silent"), ("a", "PASS", 100, 5, "Silent"), ("b", "PASS", 100, 11, "Silent")])
    assert samples(qc.keep_strong_samples(df, rules)) == ["b"]


def test_depth_zero_gives_null(spark):
    assert table(spark, [("a", "PASS", 0, 3, "Silent")]).first().VAF is None


def test_half_failed_drops_sample(spark):
    rules = QcRules()
    df = table(spark, [
        ("half", "StrandBias", 30, 10, "Silent"), ("half", "PASS", 30, 10, "Silent"),
        ("third", "StrandBias", 30, 10, "Silent"), ("third", "PASS", 30, 10, "Silent"), ("third", "PASS", 30, 10, "Silent"),
        ("unknown", None, 30, 10, "Silent"), ("unknown", "PASS", 30, 10, "Silent"),
    ])
    kept = qc.drop_artefacts(df, rules).groupBy("Tumor_Sample_Barcode").count()
    assert {tuple(r) for r in kept.collect()} == {("third", 2), ("unknown", 1)}


def test_failed_proportion_golden(spark):
    df = table(spark, [("a", x, 30, 10, "Silent") for x in ("PASS", "PASS", "oxog", "StrandBias")])
    assert qc.failed_proportion(df, RULES).first().failed_proportion == 0.5
    assert qc.drop_artefacts(df, RULES).count() == 0


def test_site_thresholds(spark):
    df = table(spark, [
        ("a", "PASS", 24, 10, "Silent"), ("a", "PASS", 25, 3, "Silent"), ("a", "PASS", 25, 2, "Silent"),
        ("a", "PASS", 25, 3, "Intron"),
    ])
    kept = qc.site_filter(df, RULES).collect()
    assert len(kept) == 1 and kept[0].array == "a"


def test_missing_study_drops(spark):
    df = table(spark, [("a", "PASS", 30, 10, "Silent"), ("b", "PASS", 30, 10, "Silent")])
    clinical = spark.createDataFrame([("a", "COAD"), ("c", "COAD")], "Tumor_Sample_Barcode string, Study_Abbreviation string")
    assert samples(qc.with_study(df, clinical, RULES)) == ["a"]


def test_chain_equals_its_steps(spark):
    rules = QcRules()
    base = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    rows = base.select(
        F.concat(F.lit("s"), F.col("l_suppkey") % 37).alias("Tumor_Sample_Barcode"),
        F.when(F.col("l_returnflag") == "R", "oxog").when(F.col("l_extendedprice") > 104500, "wga").otherwise("PASS").alias("FILTER"),
        F.col("l_quantity").cast("int").alias("t_depth"),
        F.floor(F.col("l_quantity") * F.col("l_discount") * 3).cast("int").alias("t_alt_count"),
        F.when(F.col("l_tax") > 0.03, "Missense_Mutation").otherwise("Silent").alias("Variant_Classification"),
    )
    df = qc.with_vaf(rows, rules)
    steps = qc.site_filter(
        qc.drop_artefacts(qc.keep_strong_samples(qc.drop_tagged_samples(df, rules), rules), rules), rules
    )
    expected = burden.attach_burden(steps, rules)
    fused = qc.clean_variants(df, rules)
    assert 0 < fused.count() < df.count()
    assert fused.exceptAll(expected.select(*fused.columns)).count() == 0
    assert expected.select(*fused.columns).exceptAll(fused).count() == 0


def test_silent_only_sample_has_null_burden_and_high_flag(spark):
    df = table(spark, [("a", "PASS", 30, 10, "Silent"), ("b", "PASS", 30, 10, "Missense_Mutation")])
    rated = burden.attach_burden(df, RULES).withColumn("rate", burden.burden_flag(F.col("wesTMB"), RULES))
    assert {(r.Tumor_Sample_Barcode, r.wesTMB, r.rate) for r in rated.collect()} == {("a", None, True), ("b", 1 / 34, False)}
    low = rated.withColumn("rate", burden.burden_flag(F.col("wesTMB"), RULES, null_rate=False))
    assert not any(r.rate for r in low.collect())


def test_constant_columns(spark):
    df = spark.createDataFrame(
        [(None, 1, 1, 1, "a.b"), (None, 1, None, 2, "a.b")],
        "blank string, constant int, partly int, varied int, `dotted.name` string",
    )
    assert qc.constant_columns(df) == ["blank", "constant", "dotted.name"]
    assert qc.drop_constant_columns(df, ["constant"]).columns == ["constant", "partly", "varied"]
    assert qc.constant_columns(df.limit(0)) == []


def test_pivot_fills_zero(spark):
    df = table(spark, [("a", "x", 1, 1, "Silent"), ("b", "y", 1, 1, "Silent"), ("b", "y", 1, 1, "Silent")])
    rows = qc.label_pivot(df, "Tumor_Sample_Barcode", "FILTER").collect()
    assert {tuple(r) for r in rows} == {("a", 1, 0), ("b", 0, 2)}


def test_pivot_counts_every_label(spark):
    df = table(spark, [("a", label, 1, 1, "Silent") for label in ("AF", "ZZ", None, "AF")])
    row = qc.label_pivot(df, "Tumor_Sample_Barcode", "FILTER").first()
    assert (row["AF"], row["ZZ"], row["null"]) == (2, 1, 1)


def test_rank_order_drops_unknown_sample(spark):
    df = spark.createDataFrame([("b", 2.0, 1), ("a", 3.0, 1), (None, 1.0, 1), ("c", None, 1)], "s string, tmb double, at int")
    assert [r.s for r in burden.rank_by_burden(df, "s", "tmb", ["at"]).collect()] == ["c", "b", "a"]


def test_casts(spark):
    df = spark.createDataFrame([("1",), ("x",)], "v string")
    assert [r.v for r in scalar.cast_columns(df, ["v"], on_error="null").collect()] == [1, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        scalar.cast_columns(df, ["v"]).collect()


def test_no_python_in_the_chain(spark, plan):
    df = table(spark, [("a", "PASS", 30, 10, "Silent")])
    text = plan(qc.clean_variants(df, RULES))
    assert "Python" not in text and "Pandas" not in text and "NestedLoop" not in text
