import numpy as np
import pytest
from pyspark.sql import functions as F

from mutascale.operators import collinearity, encode, metrics

def columns():
    return F.col("y"), F.col("p")


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 4.0)], "y double, p double")


def test_goldens(golden):
    y, p = columns()
    row = golden.agg(metrics.concordance(y, p), metrics.r_squared(y, p), metrics.rmsle(y, p), metrics.rmse(y, p)).first()
    assert row[0] == pytest.approx(6 / 7)
    assert row[1] == pytest.approx(0.5)
    assert row[2] == pytest.approx(0.128832, abs=1e-6)
    assert row[3] == pytest.approx(np.sqrt(1 / 3))


def test_constant_inputs(spark):
    y, p = columns()
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "y double, p double")
    row = df.agg(
        metrics.concordance(y, p), metrics.r_squared(y, p), metrics.ols_slope(p, y), metrics.ols_intercept(p, y)
    ).first()
    assert tuple(row) == (None, None, 0.0, 2.0)


def test_confusion_weights(spark):
    df = spark.createDataFrame([(True, True, 3), (True, False, 2), (False, False, 4)], "a boolean, b boolean, n bigint")
    cells = metrics.confusion(F.col("a"), F.col("b"), F.col("n"))
    row = df.agg(*[c.alias(k) for k, c in cells.items()]).first()
    assert row.asDict() == {"whfh": 3, "wlfl": 4, "whfl": 2, "wlfh": 0}


def test_correlation_skips_null_pairs(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, True, 1), (2.0, None, False, 1), (3.0, 1.0, True, 1), (4.0, 9.0, False, 1)],
        "a double, b double, c boolean, k int",
    )
    rows = {(r.f1, r.f2): r.r for r in collinearity.correlation_matrix(df, ["a", "b", "c", "k"]).collect()}
    assert rows["b", "a"] == pytest.approx(np.corrcoef([1, 3, 4], [2, 1, 9])[0, 1])
    assert rows["c", "a"] == pytest.approx(np.corrcoef([1, 2, 3, 4], [1, 0, 1, 0])[0, 1])
    assert rows["k", "a"] is None


def test_vif_matches_regressions(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(3, 1, (200, 3))
    x[:, 2] += 0.8 * x[:, 0]
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    result = {r.feature: r.vif for r in collinearity.variance_inflation(df, ["a", "b", "c"]).collect()}
    for i, name in enumerate("abc"):
        others = np.delete(x, i, axis=1)
        left = x[:, i] - others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        assert result[name] == pytest.approx((x[:, i] @ x[:, i]) / (left @ left))


def test_vif_of_a_determined_feature(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "a double, b double")
    assert all(r.vif == float("inf") for r in collinearity.variance_inflation(df, ["a", "b"]).collect())


@pytest.mark.parametrize("partitions", ["1", "8", "40"])
def test_group_median_is_exact(spark, partitions):
    rng = np.random.default_rng(1)
    values = {
        "big": rng.normal(0, 1, 701), "even": rng.integers(0, 9, 300), "same": np.full(120, 4.0), "one": np.array([7.0]),
        "two": np.array([1.0, 2.0]), "skewed": np.concatenate([np.full(200, 1.0), rng.exponential(5, 190)]),
    }
    rows = [(k, float(x)) for k, xs in values.items() for x in xs] + [("big", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        result = {r.k: (r.n_rows, r["median"]) for r in encode.group_median(df, "k", "v").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert result == {k: (len(xs), pytest.approx(float(np.median(xs)))) for k, xs in values.items()}


def test_encodings(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 7.0), (None, 9.0), (None, 8.0)], "k string, t double")
    counts = encode.frequency_encode(df, "k").orderBy("t").collect()
    assert [r.k for r in counts] == [2, 2, 1, 2, 2]
    medians = encode.target_median_encode(df, "k", "t", "m").orderBy("t").collect()
    assert [r.m for r in medians] == [2.5, 2.5, 7.0, None, None]


def test_scores_read_paired_rows_only(spark):
    """A row without a prediction, and one without a value, change nothing."""
    paired = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 4.0)], "y double, p double")
    gaps = paired.unionByName(spark.createDataFrame([(50.0, None), (None, 9.0)], "y double, p double"))
    for score, expected in ((metrics.r_squared, 0.5), (metrics.concordance, 6 / 7)):
        for df in (paired, gaps):
            assert df.agg(score(F.col("y"), F.col("p")).alias("s")).first().s == pytest.approx(expected)


def test_weighted_line_equals_repeated_rows(spark):
    rows = [("a", 1.0e6 + x, 3.0 * x + 1, n) for x, n in ((0.0, 1), (1.0, 5), (2.0, 2), (4.0, 3))] + [("b", 2.0, 5.0, 4), ("b", 2.0, 8.0, 2)]
    df = spark.createDataFrame(rows, "g string, x double, y double, n int")
    lines = {r.g: (r.coef, r.intercept, r.weight) for r in metrics.weighted_line(df, "g", "y", "x", "n").collect()}
    assert lines["a"] == (pytest.approx(3.0), pytest.approx(1 - 3.0e6), 11)
    assert lines["b"] == (0.0, pytest.approx(6.0), 6)


def test_correlations_of_many_features(spark):
    rng = np.random.default_rng(2)
    x = 1e6 + rng.normal(0, 1, (300, 40)) @ rng.normal(0, 1, (40, 40))
    x[rng.random(x.shape) < 0.1] = np.nan
    names = [f"f.{i}" for i in range(40)]
    rows = [[None if np.isnan(v) else float(v) for v in row] for row in x]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(5)
    got = {(r.f1, r.f2): r.r for r in collinearity.correlation_matrix(df, names).collect()}
    assert len(got) == 780
    for i in range(40):
        for j in range(i):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert got[names[i], names[j]] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)


def test_correlation_of_constants_and_no_rows(spark):
    df = spark.createDataFrame([(0.1, 1.0), (0.1, 2.0), (0.1, 5.0), (0.1, None)], "a double, b double")
    assert [tuple(r) for r in collinearity.correlation_matrix(df, ["a", "b"]).collect()] == [("b", "a", None)]
    assert [tuple(r) for r in collinearity.correlation_matrix(df.limit(0), ["a", "b"]).collect()] in ([], [("b", "a", None)])


def test_vif_drops_incomplete_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(3, 1, (80, 2))
    whole = spark.createDataFrame(x.tolist(), "a double, b double")
    gaps = whole.unionByName(spark.createDataFrame([(99.0, None), (None, -50.0)], "a double, b double"))
    left, right = ({r.feature: r.vif for r in collinearity.variance_inflation(df, ["a", "b"]).collect()} for df in (whole, gaps))
    assert left == pytest.approx(right)
