"""Boosted-tree regression: fit, search and final model, as models of Spark ML."""

from __future__ import annotations

import math
import random
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutascale.functions.scalar import quoted
from mutascale.operators.boosting import Binned, Grower, Node, boost, lasting, plain
from mutascale.session import materialize, remove_path, scratch_path

PARTITION_ROWS = 50_000
LOT_ROWS = 1_000
COPIES, LOT = "__copies", "__lot"
VECTOR = "__features"
LABEL = "__label"


@dataclass(frozen=True)
class TreeParams:
    """Parameters of one boosted model; ``gamma`` is the smallest loss reduction of a split, summed over its rows."""

    eta: float = 0.1
    max_depth: int = 5
    subsample: float = 1.0
    gamma: float = 0.0
    min_child_weight: int = 1


def draw_params(n: int, seed: int = 41) -> list[TreeParams]:
    """Seeded random draws over the search space."""
    rng = random.Random(seed)
    # The bounds of the search space.
    return [
        TreeParams(
            eta=rng.uniform(0.1, 0.9),
            max_depth=rng.randint(4, 7),
            subsample=rng.uniform(0.5, 1.0),
            gamma=math.exp(rng.uniform(math.log(1e-2), math.log(10.0))),
            min_child_weight=rng.randint(1, 10),
        )
        for _ in range(n)
    ]


def as_model_input(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Rows with a known target and features, all as doubles; booleans become 0/1."""
    numbers = {name: quoted(name).cast("double") for name in features}
    ready = df.withColumns(numbers).withColumn(LABEL, quoted(target).cast("double"))
    return ready.dropna(subset=[LABEL, *[f"`{f}`" if "." in f else f for f in features]])


def _least_gain(params: TreeParams, rows: int) -> float:
    """The same bound as a drop of the variance per row, which Spark measures."""
    return 2 * params.gamma / max(rows, 1)


def _grower(params: TreeParams, rows: int) -> Grower:
    return Grower(params.eta, params.max_depth, params.subsample, params.min_child_weight, _least_gain(params, rows))


def _binned(
    df: DataFrame, features: list[str], target: str, validation: str | None, share: float = 1.0
) -> tuple[Binned, int, int]:
    """The binned table of the rows that can be fitted, the number of all rows and of those outside ``validation``.

    Equal rows are counted once and stored, as the thresholds and the bins both read them.
    """
    ready = as_model_input(df, features, target)
    counted = _counted(ready, [*features, LABEL, *([validation] if validation else [])])
    flag = quoted(validation).cast("boolean") if validation else F.lit(False)
    named = [quoted(name).alias(f"f{i}") for i, name in enumerate(features)]
    path = scratch_path(df.sparkSession, "counted")
    try:
        counted.select(*named, F.col(LABEL).alias("label"), flag.alias("flag"), F.col(COPIES).alias("copies")).write.parquet(path)
        stored = df.sparkSession.read.parquet(path)
        total = stored.agg(F.sum("copies"), F.sum(F.when(~F.col("flag"), F.col("copies")))).first()
        return Binned(stored.where("flag IS NOT NULL"), len(features), share), total[0] or 0, total[1] or 0
    finally:
        remove_path(df.sparkSession, path)


def _model(
    spark: SparkSession, table: Binned, grower: Grower, features: list[str], params: TreeParams, rounds: int, rows: int,
    seed: int, validation: str | None,
) -> PipelineModel:
    """The best prefix of an ensemble as a model of Spark ML, with the parameters of its estimator."""
    regressor = GBTRegressor(
        featuresCol=VECTOR, labelCol=LABEL, maxIter=rounds, stepSize=params.eta, maxDepth=params.max_depth,
        subsamplingRate=params.subsample, minInfoGain=_least_gain(params, rows), minInstancesPerNode=params.min_child_weight,
        seed=seed,
    )
    if validation:
        regressor.setValidationIndicatorCol(validation)
    regressor._transfer_params_to_java()
    gateway, ml = spark.sparkContext._gateway, spark._jvm.org.apache.spark.ml
    impurity, numbers = spark._jvm.org.apache.spark.mllib.tree.impurity, spark._jvm.org.apache.spark.mllib.linalg.Vectors

    def java(node: Node):
        sums = numbers.parse("[" + ",".join(map(repr, map(float, node.sums))) + "]").toArray()
        stats = impurity.VarianceCalculator(sums, int(node.sums[0]))
        if node.left is None:
            return ml.tree.LeafNode(node.prediction, node.impurity, stats)
        split = ml.tree.ContinuousSplit(node.feature, float(table.cuts[node.feature][node.cut]))
        return ml.tree.InternalNode(node.prediction, node.impurity, node.gain, java(node.left), java(node.right), split, stats)

    kept = gateway.new_array(ml.regression.DecisionTreeRegressionModel, grower.best)
    shares = gateway.new_array(gateway.jvm.double, grower.best)
    for i, tree in enumerate(grower.trees[: grower.best]):
        kept[i], shares[i] = ml.regression.DecisionTreeRegressionModel(java(plain(tree)), len(features)), grower.weight(i)
    boosted = ml.regression.GBTRegressionModel(regressor.uid, kept, shares, len(features))
    regressor._java_obj.copyValues(boosted, ml.param.ParamMap())
    model = GBTRegressionModel(boosted)
    model._resetUid(regressor.uid)
    return PipelineModel([VectorAssembler(inputCols=features, outputCol=VECTOR), regressor._copyValues(model)])


def fit_boosted(
    train: DataFrame,
    features: list[str],
    target: str,
    params: TreeParams | None = None,
    rounds: int = 500,
    seed: int = 41,
    validation: str | None = None,
) -> PipelineModel:
    """Fit a boosted model; with ``validation`` (a boolean column) boosting stops once those rows stop improving."""
    params = params or TreeParams()
    table, n, _ = _binned(train, features, target, validation)
    with table:
        grower = _grower(params, n)
        boost(table, [grower], rounds, seed, lasting if validation else None)
    return _model(train.sparkSession, table, grower, features, params, rounds, n, seed, validation)


@dataclass(frozen=True)
class PatientFit:
    """A boosted model cut at its best round, the validation error (mean squared) after every round tried, and that round."""

    model: PipelineModel
    errors: list[float]
    best: int


def patient_round(errors: list[float], patience: int, least: float = 1e-12) -> tuple[int, int]:
    """Best round and number of rounds tried: boosting ends when ``patience`` rounds in a row are not below the best.

    An error counts as below when it is so by the share ``least``, so that rounding does not decide.
    """
    best, tried = 1, len(errors)
    for at, error in enumerate(errors, 1):
        if error < errors[best - 1] * (1 - least):
            best = at
        elif at - best >= patience:
            tried = at
            break
    return best, tried


def fit_patient(
    train: DataFrame,
    features: list[str],
    target: str,
    validation: str,
    params: TreeParams | None = None,
    rounds: int = 500,
    patience: int = 200,
    seed: int = 41,
) -> PatientFit:
    """Boost on the rows outside ``validation`` until its error has not improved for ``patience`` rounds; keep the best round.

    Trees are added one after the other, each on what the ones before left, so every prefix of the ensemble is a model of its
    own; the pass that starts a round also takes the error of the rounds before it.
    """
    params = params or TreeParams()
    table, _, n = _binned(train, features, target, validation)

    def rule(errors: list[float]) -> tuple[int, bool]:
        best, tried = patient_round(errors, patience)
        return best, tried < len(errors) or len(errors) - best >= patience

    with table:
        grower = _grower(params, n)
        boost(table, [grower], rounds, seed, rule)
    best, tried = patient_round(grower.valid, patience)
    model = _model(train.sparkSession, table, grower, features, params, rounds, n, seed, None)
    return PatientFit(model, grower.valid[:tried], best)


def _counted(ready: DataFrame, names: list[str]) -> DataFrame:
    """Only the named columns, equal rows once with their number."""
    return ready.groupBy(*[quoted(c) for c in names]).agg(F.count(F.lit(1)).alias(COPIES))


def _balanced(ready: DataFrame, features: list[str], validation: str | None) -> tuple[DataFrame, int]:
    """Only the training columns, dealt by content and sorted, and their number of rows.

    Spark samples rows by partition and position. Their number of partitions follows from the rows and their order from
    the content, so an estimator of Spark that takes no counts does not depend on the cluster. Equal rows are counted and
    dealt in lots of ``LOT_ROWS``, so a content that many rows share covers several partitions. The counts are stored.
    """
    names = [*features, LABEL, *([validation] if validation else [])]
    columns = [quoted(c) for c in names]
    counted = materialize(_counted(ready, names))
    n = counted.agg(F.sum(COPIES)).first()[0] or 0
    lots = F.sequence(F.lit(0).cast("long"), F.floor((F.col(COPIES) - 1) / LOT_ROWS))
    dealt = counted.withColumn(LOT, F.explode(lots)).repartition(-(-max(n, 1) // PARTITION_ROWS), *columns, LOT)
    rest = F.col(COPIES) - F.col(LOT) * LOT_ROWS
    copies = F.array_repeat(F.lit(True), F.least(F.lit(LOT_ROWS), rest).cast("int"))
    return dealt.sortWithinPartitions(*columns, LOT).withColumn(LOT, F.explode(copies)).select(*columns), n


def predict(model: PipelineModel, df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Rows with their prediction."""
    scored = model.transform(as_model_input(df, features, target))
    return scored.drop(VECTOR, LABEL)


def held_out_rmse(model: PipelineModel, test: DataFrame, features: list[str], target: str) -> float:
    """Root mean squared error on held-out rows."""
    scored = model.transform(as_model_input(test, features, target))
    return RegressionEvaluator(labelCol=LABEL, predictionCol="prediction", metricName="rmse").evaluate(scored)


def search(
    train: DataFrame,
    features: list[str],
    target: str,
    trials: list[TreeParams],
    rounds: int = 100,
    parallelism: int = 8,
    seed: int = 41,
    validation: str | None = None,
) -> DataFrame:
    """Root mean squared error of each trial on a held-out fifth of the training rows, best first.

    ``parallelism`` trials grow side by side on the same passes over the rows.
    """
    table, n, _ = _binned(train, features, target, validation, 0.8)
    growers = [_grower(t, n) for t in trials]
    with table:
        for start in range(0, len(growers), parallelism):
            boost(table, growers[start : start + parallelism], rounds, seed, lasting if validation else None)
    errors = [math.sqrt(g.held[g.best - 1]) for g in growers]
    rows = [(i, *asdict(t).values(), e) for i, (t, e) in enumerate(zip(trials, errors))]
    schema = (
        "trial int, eta double, max_depth int, subsample double, gamma double, min_child_weight int, rmse double"
    )
    return train.sparkSession.createDataFrame(rows, schema).orderBy("rmse", "trial")


def best_params(trials: DataFrame) -> TreeParams:
    """Parameters of the best trial."""
    row = trials.orderBy("rmse", "trial").first().asDict()
    return TreeParams(**{name: row[name] for name in TreeParams.__dataclass_fields__})


def gaussian_model(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Gaussian linear model with p-values, as a table of coefficients."""
    ready = VectorAssembler(inputCols=features, outputCol=VECTOR).transform(as_model_input(df, features, target))
    model = GeneralizedLinearRegression(family="gaussian", featuresCol=VECTOR, labelCol=LABEL).fit(ready)
    summary = model.summary
    names = [*features, "Intercept"]
    estimates = [*model.coefficients.toArray().tolist(), float(model.intercept)]
    rows = list(zip(names, estimates, summary.coefficientStandardErrors, summary.tValues, summary.pValues))
    return df.sparkSession.createDataFrame(rows, "coefficient string, estimate double, std_error double, t double, p_value double")
