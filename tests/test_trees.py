import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mutascale.operators import attribution, trees
from mutascale.plans.importance import explain_targets

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    x = spark.range(0, 1200).select(
        "id", *[(F.pmod(F.xxhash64(F.lit(name), "id"), F.lit(997)) / 997.0).alias(name) for name in FEATURES]
    )
    noise = F.pmod(F.xxhash64(F.lit("e"), "id"), F.lit(100)) / 1000.0
    flagged = x.withColumn("d", F.col("d") > 0.5)
    return flagged.withColumn("y", F.col("a") * 3 + F.col("b") * F.col("c") * 2 + F.col("d").cast("int") + noise)


@pytest.fixture(scope="module")
def model(rows):
    return trees.fit_boosted(rows, FEATURES, "y", trees.TreeParams(0.3, 3, 0.9, 0.0, 2), rounds=4)


def expectation(leaves, x, known):
    """Expected prediction when only some features are known."""
    total = 0.0
    for leaf in leaves:
        weight = leaf.value
        for f, low, high, share in zip(leaf.features, leaf.low, leaf.high, leaf.share):
            weight *= float(low < x[f] <= high) if f in known else share
        total += weight
    return total


def brute_force(leaves, x):
    n = len(x)
    phi = np.zeros(n)
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for size in range(n):
            weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
            for part in combinations(others, size):
                phi[i] += weight * (expectation(leaves, x, {*part, i}) - expectation(leaves, x, set(part)))
    return phi


def brute_force_pair(leaves, x, i, j):
    n = len(x)
    others = [k for k in range(n) if k not in (i, j)]
    total = 0.0
    for size in range(n - 1):
        weight = math.factorial(size) * math.factorial(n - size - 2) / (2 * math.factorial(n - 1))
        for part in combinations(others, size):
            s = set(part)
            total += weight * (
                expectation(leaves, x, s | {i, j}) - expectation(leaves, x, s | {i}) - expectation(leaves, x, s | {j})
                + expectation(leaves, x, s)
            )
    return total


def test_attributions_equal_the_definition(rows, model):
    explained = attribution.attribute(model, rows, FEATURES, "y", ["id"], interactions=True)
    leaves = attribution.read_leaves(model, rows)
    assert attribution.largest_gap(explained).first().max_gap < 1e-9
    for r in explained.orderBy("id").limit(15).collect():
        x = [r[f] for f in FEATURES]
        assert r.phi == pytest.approx(list(brute_force(leaves, x)), abs=1e-9)
        matrix = np.array(r.interactions)
        assert matrix.sum(axis=1) == pytest.approx(r.phi, abs=1e-9) and np.allclose(matrix, matrix.T)
        for i, j in combinations(range(4), 2):
            assert matrix[i, j] == pytest.approx(brute_force_pair(leaves, x, i, j), abs=1e-9)


def test_attributions_cover_every_row_and_add_up(rows, model):
    explained = attribution.attribute(model, rows, FEATURES, "y", ["id"])
    assert explained.count() == 1200
    total = F.aggregate("phi", F.lit(0.0), lambda s, v: s + v) + F.col("base")
    worst = explained.agg(F.max(F.abs(total - F.col("prediction")))).first()[0]
    assert worst < 1e-9
    ranking = attribution.mean_attribution(explained, FEATURES).collect()
    assert ranking[0].feature == "a" and len(ranking) == 4
    tall = attribution.tall_attributions(explained, FEATURES, ["id"])
    assert tall.where("id = 7").count() == 4 and tall.count() == 4800
    shown = attribution.dependence(explained, FEATURES, "b", "c")
    assert shown.columns == ["value", "phi", "colour"]


def test_leaves_of_equal_conditions_share_a_table():
    make = lambda value, high, share: attribution.Leaf(value, [0, 2], [-np.inf, 0.5], [high, np.inf], share)
    leaves = [make(1.0, 0.3, [0.2, 0.6]), make(2.0, 0.4, [0.3, 0.6]), make(-4.0, 0.3, [0.25, 0.5])]
    groups = attribution.merged(leaves)
    assert [[leaf.value for leaf in group] for group in groups] == [[1.0, -4.0], [2.0]]


def test_search_draws_and_ranks(rows):
    draws = trees.draw_params(50, 3)
    assert draws == trees.draw_params(50, 3) and draws != trees.draw_params(50, 4)
    assert all(0.1 <= d.eta <= 0.9 and 4 <= d.max_depth <= 7 and 0.01 <= d.gamma <= 10 for d in draws)
    trials = trees.search(rows, FEATURES, "y", [trees.TreeParams(0.1, 1, 1.0, 0.0, 1), trees.TreeParams(0.5, 5, 1.0, 0.0, 1)], rounds=3)
    ranked = trials.collect()
    assert [r.trial for r in ranked] == [1, 0] and trees.best_params(trials).max_depth == 5


def test_early_stop_and_error(rows):
    marked = rows.withColumn("check", F.col("id") % 5 == 0)
    model = trees.fit_boosted(marked, FEATURES, "y", trees.TreeParams(0.9, 5, 1.0), rounds=60, validation="check")
    assert len(model.stages[-1].trees) < 60
    assert trees.held_out_rmse(model, rows, FEATURES, "y") < 0.3


def test_gaussian_model(rows):
    table = {r.coefficient: r for r in trees.gaussian_model(rows, ["a", "b"], "y").collect()}
    assert table["a"].estimate == pytest.approx(3.0, abs=0.2) and table["a"].p_value < 1e-6 and "Intercept" in table


def test_importance_plan(rows):
    outcome = explain_targets(rows, ["id"], FEATURES, ["y"], n_trials=2, search_rounds=3, final_rounds=3, parallelism=2)[0]
    assert outcome.rmse < 1.0 and outcome.max_gap.first().max_gap < 1e-9
    assert outcome.ranking.first().feature == "a" and outcome.trials.count() == 2
    assert 150 < outcome.attributions.count() < 330


def test_gain_bound_is_per_row(spark):
    """The largest bound of the search still lets a clean 0/1 step split."""
    df = spark.createDataFrame([(float(i % 2), float(i % 2)) for i in range(400)], "x double, y double")
    model = trees.fit_boosted(df, ["x"], "y", trees.TreeParams(eta=0.5, gamma=10.0), rounds=3)
    assert trees.held_out_rmse(model, df, ["x"], "y") < 0.3


def test_model_does_not_depend_on_partitions(spark):
    base = spark.range(600).selectExpr("cast(id % 37 as double) as x", "cast(id % 11 as double) as z", "cast(id % 37 + id % 5 as double) as y")
    params = trees.TreeParams(eta=0.3, max_depth=3, subsample=0.6)
    sums = set()
    for n in (2, 5):
        model = trees.fit_boosted(base.repartition(n), ["x", "z"], "y", params, rounds=3)
        sums.add(round(trees.predict(model, base, ["x", "z"], "y").agg(F.sum("prediction")).first()[0], 6))
    assert len(sums) == 1


def test_patience_rule():
    assert trees.patient_round([5, 4, 4, 4.5, 3], 2) == (2, 4)
    assert trees.patient_round([5, 4, 4, 4.5, 3], 3) == (5, 5)
    assert trees.patient_round([1.0], 5) == (1, 1)
    assert trees.patient_round([3.0, 3.0 * (1 - 1e-15), 2.0], 5) == (3, 3)


def test_patient_fit_keeps_the_best_prefix(rows):
    marked = rows.withColumn("check", F.pmod("id", F.lit(4)) == 0)
    params = trees.TreeParams(0.9, 5, 0.7, 0.0, 1)
    found = trees.fit_patient(marked, FEATURES, "y", "check", params, rounds=12, patience=3)
    held = marked.where("check")
    assert found.best == trees.patient_round(found.errors, 3)[0] <= len(found.errors) <= 12
    assert len(found.model.stages[-1].trees) == found.best
    assert trees.held_out_rmse(found.model, held, FEATURES, "y") ** 2 == pytest.approx(found.errors[found.best - 1])
    whole = trees.fit_patient(marked, FEATURES, "y", "check", params, rounds=4, patience=100)
    assert whole.errors == pytest.approx(found.errors[:4])  # stretches agree on their common prefix


def test_equal_rows_cover_several_partitions(spark, monkeypatch):
    """A content that most rows share is dealt to more than one task, and no row is lost."""
    monkeypatch.setattr(trees, "PARTITION_ROWS", 500)
    monkeypatch.setattr(trees, "LOT_ROWS", 100)
    df = spark.createDataFrame([(0.0, 1.0)] * 4050 + [(1.0, float(i)) for i in range(30)], f"x double, {trees.LABEL} double")
    ready, n = trees._balanced(df, ["x"], None)
    sizes = [len(part) for part in ready.rdd.glom().collect()]
    assert n == sum(sizes) == 4080 and max(sizes) < 2000
    assert sorted(map(tuple, ready.collect())) == sorted(map(tuple, df.collect()))


def test_no_rows_are_dealt(spark):
    empty = spark.createDataFrame([], f"x double, {trees.LABEL} double")
    ready, n = trees._balanced(empty, ["x"], None)
    assert n == 0 and ready.count() == 0


def test_cells_give_the_attributions_of_single_leaves(rows, model, monkeypatch):
    """Shared tables and one table per leaf agree, with batches that are cut as well."""
    shared = attribution.attribute(model, rows, FEATURES, "y", ["id"], interactions=True).orderBy("id").collect()
    leaves = attribution.merged(attribution.read_leaves(model, rows))
    assert len(attribution.blocks(leaves, True)) < len(leaves)
    monkeypatch.setattr(attribution, "GRID_BYTES", 0)
    monkeypatch.setattr(attribution, "BATCH_VALUES", 1000)
    assert len(attribution.blocks(leaves, True)) == len(leaves)
    alone = attribution.attribute(model, rows, FEATURES, "y", ["id"], interactions=True).orderBy("id").collect()
    assert len(shared) == len(alone) == 1200
    for a, b in zip(shared, alone):
        assert a.phi == pytest.approx(b.phi, abs=1e-9) and a.base == b.base and abs(b.gap) < 1e-9
        assert np.array(a.interactions) == pytest.approx(np.array(b.interactions), abs=1e-9)


def test_attributions_of_a_model_without_splits(spark):
    df = spark.createDataFrame([(float(i), 2.0) for i in range(20)], "x double, y double")
    flat = trees.fit_boosted(df, ["x"], "y", rounds=1)
    row = attribution.attribute(flat, df, ["x"], "y", [], interactions=True).first()
    assert row.phi == [0.0] and row.base == row.prediction == 2.0 and row.interactions == [[0.0]]
