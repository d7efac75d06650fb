import pytest
from pyspark.sql import functions as F

from mutascale.functions import scalar
from mutascale.operators import lookups


@pytest.fixture(scope="module")
def rows(spark):
    """One key with a third of the rows, many of them identical copies, some rows without a key."""
    return spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None)
        .otherwise(F.concat(F.lit("k"), F.col("id") % 200)).alias("k"),
        (F.col("id") % 2).alias("v"),
    )


def test_counts_with_hot_key(rows):
    result = lookups.group_count(rows, ["k"])
    plain = rows.groupBy("k").agg(F.count("*").alias("n")).where("k is not null")
    expected = rows.join(plain, "k", "left").select("k", "v", "n")
    assert result.count() == 3000
    assert result.exceptAll(expected).count() == 0


def test_keep_keys_with_hot_key(rows):
    profile = rows.groupBy("k").agg(F.count("*").alias("n"))
    kept = lookups.keep_keys(rows, profile, ["k"], F.col("n") > 12)
    big = [r.k for r in profile.where("n > 12 and k is not null").collect()]
    expected = rows.where(F.col("k").isin(big))
    assert "hot" in big and kept.count() == expected.count() and kept.exceptAll(expected).count() == 0


def test_hot_key_is_split(spark, plan):
    """Two thirds of the rows have one key; Spark splits its partition in the one join there is."""
    ids = spark.range(0, 60000, 1, 16)
    skewed = ids.select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        F.sha2(F.col("id").cast("string"), 256).alias("v"),
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        result = lookups.group_count(skewed, ["k"])
        parts = result.groupBy(F.spark_partition_id()).agg(F.count("v").alias("c"), F.max("v"), F.sum("n")).collect()
        sizes = [r.c for r in parts]
        assert sum(sizes) == 60000 and max(sizes) < 60000 * 0.3
        result.collect()
        assert "skew=true" in plan(result) and "NestedLoop" not in plan(result)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_one_to_one(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, l string")
    right = spark.createDataFrame([(1, "x")], "k int, r string")
    assert {tuple(r) for r in lookups.join_one_to_one(left, right, ["k"]).collect()} == {(1, "a", "x"), (2, "b", None)}
    with pytest.raises(ValueError, match="right"):
        lookups.join_one_to_one(left, right.union(right), ["k"])


def test_row_key_separates_nulls(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", None)], "x string, y string")
    keys = [r.h for r in df.select(scalar.row_key(["x", "y"]).alias("h")).collect()]
    assert keys[0] == keys[2] != keys[1]


def test_value_maps(spark):
    df = spark.createDataFrame([("hg19", 0.03), ("x", 0.1 + 0.2 - 0.27), (None, 0.04)], "g string, v double")
    out = df.select(scalar.map_values(F.col("g"), {"hg19": 0}), scalar.map_fractions(F.col("v"), {0.03: 2.0})).collect()
    assert [tuple(r) for r in out] == [(0, 2.0), (None, 2.0), (None, None)]


def test_small_scalars(spark):
    df = spark.createDataFrame([("p12a", ".", -1.0, "No"), ("p3", "0.5", None, None)], "p string, t string, x double, u string")
    out = df.select(
        scalar.panel_number(F.col("p")), scalar.strip_panel_suffix(F.col("p")), scalar.decode_number(F.col("t")),
        scalar.decode_number(F.col("t"), default=0.0), scalar.clip_at_zero(F.col("x")),
        scalar.not_equal_or_null(F.col("u"), "No"), scalar.as_flag(F.col("x") < 0),
    ).collect()
    assert [tuple(r) for r in out] == [(12, "p12", None, 0.0, 0.0, False, 1), (3, "p3", 0.5, 0.5, None, True, 0)]
    signed = df.select(scalar.error_balance(F.lit(1.0), F.lit(0.5))).first()[0]
    assert signed == -1.0


def test_verified_lookup_tells_colliding_keys_apart(spark):
    rows = spark.createDataFrame([(1, "h", "a", None), (2, "h", "a", 1), (3, "h", "b", 1), (4, "g", "a", 1)], "id int, d string, x string, y int")
    known = spark.createDataFrame([("h", "a", None, 10), ("h", "a", 1, 20), ("h", "c", 1, 30)], "d string, x string, y int, v int")
    found = lookups.verified_lookup(rows, known, "d", ["x", "y"], ["v"])
    assert found.columns == ["id", "d", "x", "y", "v"]
    assert {r.id: r.v for r in found.collect()} == {1: 10, 2: 20, 3: None, 4: None}


def test_row_digest_tells_null_empty_and_borders_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, ""), ("", None), (None, None), ("1:", "-"), ("-", "1:")], "x string, y string")
    assert df.select(scalar.row_digest(["x", "y"]).alias("d")).distinct().count() == 7


def test_counts_in_dealt_tasks(spark, rows, plan):
    """With a width the rows are computed and shuffled once, and the counts are those of the join."""
    result = lookups.group_count(rows, ["k"], width=13)
    expected = lookups.group_count(rows, ["k"])
    assert result.count() == 3000 and result.exceptAll(expected).count() == 0 and expected.exceptAll(result).count() == 0
    text = plan(lookups.group_count(rows, ["k"], width=13))
    assert "Join" not in text and text.count("Range (") == 1 and "13), REPARTITION_BY_NUM" in text
