import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from mutascale.operators import boosting, trees

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    values = [F.pmod(F.xxhash64(F.lit(name), "id"), F.lit(m)).cast("double") for name, m in zip(NAMES, (500, 9, 2))]
    x = spark.range(1500).select("id", *[v.alias(name) for v, name in zip(values, NAMES)])
    noise = F.pmod(F.xxhash64(F.lit("e"), "id"), F.lit(7)) / 5
    return x.withColumns({"y": F.sin(F.col("a") / 80) * F.col("b") + F.col("c") * 3 + noise, "check": F.col("id") % 4 == 0}).cache()


def spark_model(rows, params, rounds, validation=None):
    """The trees of Spark ML on the rows themselves."""
    regressor = GBTRegressor(
        featuresCol="x", labelCol="y", maxIter=rounds, stepSize=params.eta, maxDepth=params.max_depth,
        minInfoGain=2 * params.gamma / rows.count(), minInstancesPerNode=params.min_child_weight, seed=1,
    )
    if validation:
        regressor.setValidationIndicatorCol(validation)
    return Pipeline(stages=[VectorAssembler(inputCols=NAMES, outputCol="x"), regressor]).fit(rows)


@pytest.mark.parametrize("params, rounds, validation", [
    (trees.TreeParams(0.2, 4, 1.0, 0.0, 5), 5, None),
    (trees.TreeParams(0.4, 7, 1.0, 1.0, 1), 2, None),
    (trees.TreeParams(0.1, 2, 1.0, 0.0, 1), 18, "check"),
])
def test_trees_are_those_of_spark(rows, monkeypatch, params, rounds, validation):
    """Same trees, counts, gains and end as Spark ML, also after scores were stored and with more than 64 leaves."""
    monkeypatch.setattr(boosting, "STRETCH", 2)
    expected, found = spark_model(rows, params, rounds, validation), trees.fit_boosted(rows, NAMES, "y", params, rounds, 1, validation)
    a, b = expected.stages[-1], found.stages[-1]
    assert len(a.trees) == len(b.trees) and a.treeWeights == b.treeWeights
    assert a.totalNumNodes == b.totalNumNodes and b.numFeatures == 3 and b.getMaxDepth() == params.max_depth
    assert a.featureImportances.toArray() == pytest.approx(b.featureImportances.toArray(), abs=1e-6)
    both = expected.transform(rows).select("id", F.col("prediction").alias("p")).join(found.transform(rows), "id")
    assert both.agg(F.max(F.abs(F.col("p") - F.col("prediction")))).first()[0] < 1e-6


def test_equal_bins_are_one_row(spark):
    """A pass reads a row per combination of bins and label, though no two rows are equal."""
    df = spark.range(20_000).select((F.col("id") / 7).alias("x"), (F.rand(3) * 5).alias("z"), (F.col("id") % 2).alias("y"))
    table, n, fitted = trees._binned(df, ["x", "z"], "y", None)
    with table:
        stored = spark.read.parquet(table.path).select(F.length("label") / 8, F.length("bins")).collect()
    assert n == fitted == 20_000 and sum(r[0] for r in stored) <= 32 * 32 * 2
    assert sum(r[1] for r in stored) == 2 * sum(r[0] for r in stored)


def test_draws():
    """Copies are drawn one by one in distribution, the same again, and others for another salt."""
    rng = np.random.default_rng(0)
    draw = rng.integers(0, 2**63, 30_000).astype(np.uint64) * np.uint64(2)
    for copies in (1, 3, 40, 100_000):
        got = boosting.drawn(draw, np.full(len(draw), copies), 0.3, 5)
        assert got.min() >= 0 and got.max() <= copies
        assert got.mean() == pytest.approx(0.3 * copies, abs=4 * np.sqrt(0.21 * copies / len(draw)))
        assert got.var() == pytest.approx(0.21 * copies, rel=0.05)
        assert (got == boosting.drawn(draw, np.full(len(draw), copies), 0.3, 5)).all()
        assert (got != boosting.drawn(draw, np.full(len(draw), copies), 0.3, 6)).any()
    mixed = rng.integers(0, 50, 30_000)
    assert (boosting.drawn(draw, mixed, 0.3, 5) <= mixed).all() and boosting.drawn(draw, mixed, 1.0, 5) is mixed


def test_fractions_add_up():
    """Copies for growing, for the early stop and for the error are all copies."""
    batch = pa.RecordBatch.from_pydict({"draw": [1, -5, 9], "copies": [10, 20, 1], "flag": [True, False, False]})
    _, copies, parts = boosting._parts(batch, 0.8)
    assert (sum(parts.values()) == copies).all() and parts["train"][0] == 0 and parts["valid"][1] == 0


def test_thresholds():
    assert boosting.thresholds(np.array([3.0, 1.0, 1.0]), np.array([1, 1, 1]), 31).tolist() == [2.0]
    assert boosting.thresholds(np.arange(100.0), np.ones(100), 3).tolist() == [24.5, 49.5, 74.5]
    assert boosting.thresholds(np.array([5.0]), np.array([7]), 31).tolist() == []


def test_trials_grow_side_by_side(rows, monkeypatch):
    """Trials that share passes have the errors that they have alone, each on a fifth that it was not grown on."""
    monkeypatch.setattr(boosting, "STRETCH", 1)
    draws = trees.draw_params(3, 7)
    alone = trees.search(rows, NAMES, "y", draws, rounds=2, parallelism=1).collect()
    shared = trees.search(rows, NAMES, "y", draws, rounds=2, parallelism=3).collect()
    assert [r.trial for r in alone] == [r.trial for r in shared]
    assert [r.rmse for r in alone] == pytest.approx([r.rmse for r in shared])
    spread = rows.agg(F.stddev_pop("y")).first()[0]
    assert all(0 < r.rmse < spread for r in shared)


def test_rows_of_an_unknown_mark_and_no_rows(spark):
    df = spark.createDataFrame([(float(i % 2), float(i % 2), None if i < 5 else False) for i in range(40)], "x double, y double, v boolean")
    model = trees.fit_boosted(df, ["x"], "y", trees.TreeParams(0.5, 1), 1, validation="v")
    assert model.stages[-1].trees[0]._java_obj.rootNode().impurityStats().rawCount() == 35
    with pytest.raises(ValueError):
        trees.fit_boosted(df.where("x > 5"), ["x"], "y", rounds=1)
