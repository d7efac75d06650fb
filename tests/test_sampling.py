import hashlib
import math

from pyspark.sql import functions as F

from mutascale.operators import sampling


def draw(*parts):
    return int(hashlib.md5(":".join(str(p) for p in parts).encode()).hexdigest()[:8], 16)


def test_ordinal_over_many_partitions(spark):
    df = spark.range(0, 5000, 1, 16).select(((F.col("id") * 7919) % 5003).alias("v"))
    placed = sampling.with_ordinal(df.repartition(16), ["v"]).collect()
    assert [r.ordinal for r in sorted(placed, key=lambda r: r.v)] == list(range(5000))


def test_ordinal_with_hot_value(spark):
    df = spark.range(0, 900, 1, 8).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("v"))
    placed = sampling.with_ordinal(df, ["v"]).collect()
    assert sorted(r.ordinal for r in placed) == list(range(900))
    assert [r.v for r in sorted(placed, key=lambda r: r.ordinal)] == sorted(r.v for r in placed)


def test_systematic_sample(spark):
    for total in (0, 5, 9, 10, 100):
        df = spark.range(total).select(F.col("id").alias("v"))
        picked = {r.v for r in sampling.systematic_sample(df, ["v"], 9, 4).where("picked").collect()}
        blocks = math.ceil(total / 9)
        assert picked == {b * 9 + draw(4, b) % 9 for b in range(blocks - 1)}


def test_hash_split_is_stable(spark):
    df = spark.range(0, 2000)
    once = {r.id for r in sampling.hash_split(df, ["id"]).where("is_test").collect()}
    again = {r.id for r in sampling.hash_split(df.repartition(7), ["id"]).where("is_test").collect()}
    assert once == again == {i for i in range(2000) if draw(41, i) < int(0.2 * 2**32)}


def test_exact_split(spark):
    df = spark.range(0, 501)
    chosen = [r.id for r in sampling.exact_split(df, ["id"]).where("is_test").collect()]
    assert sorted(chosen) == sorted(sorted(range(501), key=lambda i: (draw(41, i), i))[:101])


def test_exact_split_cuts_a_tie(spark, plan):
    df = spark.range(0, 900, 1, 8).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"))
    total = {7: 600, **{i: 1 for i in range(0, 900, 3)}}
    for share in (0.0, 0.1, 0.5, 0.9, 1.0):
        marked = sampling.exact_split(df, ["k"], share)
        rows = marked.collect()
        chosen = [r.k for r in rows if r.is_test]
        assert len(rows) == 900 and len(chosen) == math.ceil(share * 900)
        order = sorted((k for k, n in total.items() for _ in range(n)), key=lambda k: (draw(41, k), k))
        assert sorted(chosen) == sorted(order[: len(chosen)])
    assert sampling.exact_split(df.limit(0), ["k"]).count() == 0
    assert "Exchange" not in plan(sampling.exact_split(spark.range(501), ["id"]))


def test_hash_below_equals_the_number(spark):
    df = spark.range(500).withColumn("k", F.when(F.col("id") % 3 > 0, F.col("id")))
    for bound in (-1, 0, 1, int(0.2 * 2**32), 2**31 + 12345, 2**32 - 1, 2**32):
        same = sampling.hash_below(bound, F.lit(41), F.col("k"), F.col("id")) == (sampling.uniform_hash(F.lit(41), F.col("k"), F.col("id")) < bound)
        assert df.where(~same).count() == 0 and df.where(same).count() == 500
