"""What drives panel performance: collinearity, boosted models per target, and their attributions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutascale.operators.attribution import attribute, largest_gap, mean_attribution
from mutascale.operators.collinearity import correlation_matrix, variance_inflation
from mutascale.operators.sampling import hash_split
from mutascale.operators.trees import TreeParams, best_params, draw_params, fit_boosted, search, held_out_rmse
from mutascale.plans.features import MODEL_FEATURES, MODEL_TARGETS


@dataclass
class Importance:
    """Outcome for one target."""

    target: str
    params: TreeParams
    trials: DataFrame
    model: PipelineModel
    rmse: float
    attributions: DataFrame
    ranking: DataFrame
    max_gap: DataFrame


def collinearity(prepared: DataFrame, features: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Correlations and variance inflation factors of the model features."""
    features = features or MODEL_FEATURES
    return correlation_matrix(prepared, features), variance_inflation(prepared, features)


def explain_targets(
    prepared: DataFrame,
    keys: list[str],
    features: list[str] | None = None,
    targets: list[str] | None = None,
    n_trials: int = 1000,
    search_rounds: int = 100,
    final_rounds: int = 500,
    parallelism: int = 8,
    seed: int = 41,
) -> list[Importance]:
    """Search, refit and explain one boosted model per target on the same hash-based 80/20 split of the keys.

    Trials stop early on a fixed part of the training rows and are ranked on a held-out fifth of them; the test rows
    are only used for the final error and the attributions.
    """
    features = features or MODEL_FEATURES
    split = hash_split(prepared, keys, 0.2, seed)
    train = hash_split(split.where(~F.col("is_test")).drop("is_test"), keys, 0.2, seed + 1).withColumnRenamed(
        "is_test", "is_validation"
    )
    test = split.where(F.col("is_test"))
    outcomes = []
    for target in targets or MODEL_TARGETS:
        trials = search(
            train, features, target, draw_params(n_trials, seed), search_rounds, parallelism, seed, "is_validation"
        )
        params = best_params(trials)
        model = fit_boosted(train, features, target, params, final_rounds, seed)
        explained = attribute(model, test, features, target, keys)
        outcomes.append(Importance(
            target, params, trials, model, held_out_rmse(model, test, features, target), explained,
            mean_attribution(explained, features), largest_gap(explained),
        ))
    return outcomes
