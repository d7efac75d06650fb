import random

import pytest
from pyspark.sql import functions as F

from mutascale.operators import intervals as iv
from mutascale.plans.restrict import restrict_to_panels


def variants(spark, rows):
    return spark.createDataFrame(rows, "chr string, start int, end int, id int")


def panels(spark, rows):
    return spark.createDataFrame(rows, "panel string, chr string, istart int, iend int")


@pytest.mark.parametrize("width", [None, 1, 7, 64])
def test_equals_brute_force(spark, width):
    rng = random.Random(3)
    v = [(f"c{rng.randint(1, 3)}", s, s + rng.choice([0, 1, 1, 2, 40]), i) for i in range(300) for s in [rng.randint(0, 500)]]
    p = [(f"p{rng.randint(1, 4)}", f"c{rng.randint(2, 4)}", s, s + rng.choice([0, 1, 5, 30, 300])) for _ in range(80) for s in [rng.randint(0, 500)]]
    expected = sorted(
        (x[3], y[0], y[2], y[3]) for x in v for y in p
        if x[0] == y[1] and x[1] <= x[2] and y[2] <= y[3] and x[1] < y[3] and x[2] > y[2]
    )
    joined = iv.overlap_join(variants(spark, v), panels(spark, p), width)
    assert sorted(map(tuple, joined.select("id", "panel", "istart", "iend").collect())) == expected
    plain = iv.overlap_join_by_chromosome(variants(spark, v), panels(spark, p))
    assert sorted(map(tuple, plain.select("id", "panel", "istart", "iend").collect())) == expected


def test_touching_and_spanning(spark):
    p = panels(spark, [("p", "c", 10, 20), ("p", "c", 20, 30)])
    v = variants(spark, [("c", 9, 10, 1), ("c", 30, 31, 2), ("c", 18, 22, 3)])
    assert [r.id for r in iv.overlap_join(v, p).collect()] == [3, 3]


def test_length_counts_overlaps_twice(spark):
    p = panels(spark, [("p", "c", 0, 500000), ("p", "c", 250000, 750000)])
    assert iv.panel_length(p).first().panel_mb == 1.0


def test_empty_policy(spark):
    p, v = panels(spark, [("p", "c", 0, 5)]), variants(spark, [("d", 0, 1, 1)])
    with pytest.raises(ValueError, match="overlaps"):
        iv.overlap_or(v, p, "error")
    with pytest.warns(UserWarning):
        assert iv.overlap_or(v, p, "warn").count() == 0
    assert iv.overlap_or(v, p, "silent").count() == 0
    with pytest.raises(ValueError, match="mode"):
        iv.overlap_or(v, p, "other")


def test_bins_bound_the_interval_side(spark):
    rows = [("p", "c", i, i + 1) for i in range(999)] + [("p", "c", 0, 10_000_000)]
    p = panels(spark, rows)
    width = iv.pick_bin_width(p)
    listed = p.withColumn("b", iv._bins("istart", "iend", width)).count()
    assert listed <= 2.25 * p.count()


def test_equality_join_without_broadcast(spark, plan):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        p, v = panels(spark, [("p", "c", 0, 5)]), variants(spark, [("c", 0, 1, 1)])
        text = plan(iv.overlap_join(v, p, 16))
        assert "SortMergeJoin" in text and "NestedLoop" not in text and "Cartesian" not in text
        assert iv.overlap_join(v, p, 16).count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_skewed_bin_is_split(spark):
    """A bin with most of the rows is split by adaptive execution when both sides are shuffled."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        ids = spark.range(0, 60000, 1, 8)
        place = F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise((F.col("id") * 37) % 100000).cast("int")
        v = ids.select(F.lit("c").alias("chr"), place.alias("start"), (place + 1).alias("end"), F.col("id").cast("int").alias("id"))
        p = spark.range(0, 20000, 1, 8).select(
            F.lit("p").alias("panel"), F.lit("c").alias("chr"), (F.col("id") * 5).cast("int").alias("istart"),
            (F.col("id") * 5 + 5).cast("int").alias("iend"),
        )
        joined = iv.overlap_join(v, p, 16)
        assert joined.count() == 60000
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_restrict_decodes_sentinels(spark):
    v = spark.createDataFrame(
        [("c", 1, 1, ".", ".", "."), ("c", 6, 6, "0.1", "7", "0.5"), ("c", 9, 9, "0", "0", "0")],
        "chr string, start int, end int, max_maf string, cosmic96_coding string, purity string",
    )
    p = panels(spark, [("p", "c", 0, 6)])
    rows = restrict_to_panels(v, p).orderBy("start").select("start", "max_maf", "cosmic96_coding", "purity").collect()
    assert [tuple(r) for r in rows] == [(0, None, 0.0, None), (5, 0.1, 7.0, 0.5)]


def test_rows_of_no_length(spark):
    """They match what they lie strictly inside, on either side; reversed rows match nothing."""
    v = spark.createDataFrame(
        [("c", 5, 5, 1), ("c", 0, 0, 2), ("c", 10, 10, 3), ("c", 9, 4, 4), ("c", 0, 40, 5), ("c", 30, 30, 6)],
        "chr string, start int, end int, id int",
    )
    p = spark.createDataFrame([("p", "c", 0, 10), ("q", "c", 20, 20), ("r", "c", 30, 30)], "panel string, chr string, istart int, iend int")
    expected = {(1, "p"), (5, "p"), (5, "q"), (5, "r")}
    for width in (1, 4, 64):
        assert {(r.id, r.panel) for r in iv.overlap_join(v, p, width).collect()} == expected
    assert {(r.id, r.panel) for r in iv.overlap_join_by_chromosome(v, p).collect()} == expected


def test_long_rows_cost_a_few_rows(spark):
    from mutascale.operators import intervals as iv

    exons = spark.range(2000).selectExpr("'1' AS chr", "id * 1000 AS istart", "id * 1000 + 100 AS iend", "id")
    long_ones = [("1", 0, 2_000_000, "whole"), ("1", 500, 700_000, "large"), ("1", 50, 51, "point"), ("1", 1_999_050, 3_000_000_000, "far")]
    calls = spark.createDataFrame(long_ones, "chr string, start long, end long, name string")
    found = iv.overlap_join(calls, exons).groupBy("name").count().collect()
    assert {r["name"]: r["count"] for r in found} == {"whole": 2000, "large": 699, "point": 1, "far": 1}
    width = iv.pick_bin_width(exons)
    levelled = calls.withColumn(iv.LEVEL, iv._level("start", "end", width))
    assert iv._listed(levelled, "start", "end", width, [0], "own").count() <= 4 * (iv.STEP + 2)
    whole = spark.createDataFrame([("1", 0, 2_000_000, 7), ("1", 10, 20, 8)], "chr string, istart long, iend long, id int")
    assert iv.overlap_join(calls, whole).where("name = 'point'").select("id").collect()[0][0] == 7
