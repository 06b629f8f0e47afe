"""Model names, defaults and the one entry point for training."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..operators.metrics import metric_bundle
from ..session import local_table
from . import bayes, boosting, calibration, linear, neighbors, network, trees
from .base import ModelSpec, TabularModel

Trainer = Callable[..., TabularModel]

CLASSIFICATION: dict[str, Trainer] = {
    "Be_naive_bayes": bayes.train_bernoulli,
    "Ga_naive_bayes": bayes.train_gaussian,
    "Mu_naive_bayes": bayes.train_multinomial,
    "adaboost": boosting.train_adaboost,
    "decision_tree": trees.train_decision_tree,
    "gboost": trees.train_gradient_boosting,
    "knn": neighbors.train_neighbors,
    "lightgbm": trees.train_lightgbm_style,
    "logistic_regression": linear.train_logistic_regression,
    "mlp": network.train_network,
    "random_forest": trees.train_random_forest,
    "svm": calibration.train_svm_with_probability,
    "xgboost": trees.train_xgboost_style,
}

REGRESSION: dict[str, Trainer] = {
    "LR": linear.train_linear_regression,
    "adaboost": boosting.train_adaboost,
    "decision_tree": trees.train_decision_tree,
    "gboost": trees.train_gradient_boosting,
    "knn": neighbors.train_neighbors,
    "lasso": linear.train_lasso,
    "lightgbm": trees.train_lightgbm_style,
    "mlp": network.train_network,
    "random_forest": trees.train_random_forest,
    "svm": calibration.train_svm_with_probability,
    "xgboost": trees.train_xgboost_style,
}

# Parameters used where the caller gives none.
_NETWORK = {"hidden_layer_sizes": (64, 32), "activation": "relu", "alpha": 0.0001, "learning_rate_init": 0.001}
_BOOSTED = {"n_estimators": 100, "learning_rate": 0.1}
DEFAULTS: dict[str, dict[str, dict[str, Any]]] = {
    "classification": {
        "adaboost": {"n_estimators": 50, "learning_rate": 1.0},
        "decision_tree": {"max_depth": 3, "criterion": "gini"},
        "gboost": {**_BOOSTED, "max_depth": 3},
        "knn": {"n_neighbors": 5, "weights": "uniform", "p": 2, "metric": "minkowski"},
        "lightgbm": dict(_BOOSTED),
        "logistic_regression": {"max_iter": 1000, "penalty": "l2", "C": 1.0},
        "mlp": {**_NETWORK, "max_iter": 300, "early_stopping": False},
        "random_forest": {"n_estimators": 100, "max_depth": 3},
        "svm": {"kernel": "rbf", "gamma": "scale", "probability": False},
        "xgboost": dict(_BOOSTED),
    },
    "regression": {
        "adaboost": {"n_estimators": 50, "learning_rate": 1.0, "loss": "linear"},
        "decision_tree": {"max_depth": None, "min_samples_leaf": 1},
        "gboost": {**_BOOSTED, "max_depth": 3, "subsample": 1.0},
        "knn": {"n_neighbors": 5, "weights": "uniform", "p": 2},
        "lasso": {"alpha": 3.0, "max_iter": 1000},
        "lightgbm": {**_BOOSTED, "max_depth": -1, "num_leaves": 31},
        "mlp": {**_NETWORK, "max_iter": 1000, "early_stopping": True},
        "random_forest": {"n_estimators": 100, "max_depth": None},
        "svm": {"kernel": "rbf", "gamma": "scale"},
        "xgboost": {**_BOOSTED, "max_depth": 3, "subsample": 1.0, "colsample_bytree": 1.0},
    },
}


def final_params(problem_type: str, model_type: str, params: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """Defaults overlaid with the caller's parameters."""
    return {**DEFAULTS[problem_type].get(model_type, {}), **(params or {})}


def train(
    df: DataFrame,
    problem_type: str,
    model_type: str,
    features: Sequence[str],
    label: str,
    params: Mapping[str, Any] | None = None,
    weight: str | None = None,
    **options: Any,
) -> TabularModel:
    """Fit a model by name on numeric feature columns; classes are coded 0..k-1."""
    trainers = {"classification": CLASSIFICATION, "regression": REGRESSION}.get(problem_type)
    if trainers is None:
        raise ValueError(f"unknown problem type {problem_type!r}")
    if model_type not in trainers:
        raise ValueError(f"unknown {problem_type} model {model_type!r}; choose one of {sorted(trainers)}")
    if not features:
        raise ValueError("no feature columns")
    spec = ModelSpec(
        problem_type, model_type, list(features), label, final_params(problem_type, model_type, params)
    )
    return trainers[model_type](df, spec, weight, **options)


def importance_table(df_session, model: TabularModel, top: int | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """``(feature, importance)`` rounded to 4, largest first.

    Names of the wrong number are replaced by ``feature_1``, ``feature_2`` and so on.
    """
    values = model.importances()
    if values is None:
        raise ValueError(f"{model.spec.model_type} has no feature importances")
    names = list(names if names is not None else model.spec.features)
    if len(names) != len(values):
        names = [f"feature_{i + 1}" for i in range(len(values))]
    rows = [(n, round(v, 4)) for n, v in zip(names, values)]
    table = local_table(df_session, rows, "feature string, importance double")
    ordered = table.orderBy(F.col("importance").desc(), "feature")
    return ordered if top is None else ordered.limit(top)


@dataclass
class TrainingRun:
    """A model with its scores per split and how the run went."""

    model: TabularModel
    metrics: DataFrame
    summary: DataFrame


def train_and_score(
    splits: DataFrame,
    problem_type: str,
    model_type: str,
    features: Sequence[str],
    label: str,
    params: Mapping[str, Any] | None = None,
    split: str = "split",
    weight: str | None = None,
    **options: Any,
) -> TrainingRun:
    """Fit on the train part, score every part, and report start, end, duration and shapes."""
    begun = datetime.now(timezone.utc)
    clock = time.monotonic()
    model = train(splits.where(F.col(split) == "train"), problem_type, model_type, features, label, params, weight, **options)
    seconds = time.monotonic() - clock
    metrics = metric_bundle(model.transform(splits), label, "prediction", problem_type, split)
    sizes = {r[split]: r["n"] for r in splits.groupBy(split).agg(F.count(F.lit(1)).alias("n")).collect()}
    summary = local_table(
        splits.sparkSession,
        [(
            model_type, problem_type, begun.isoformat(timespec="seconds"),
            datetime.now(timezone.utc).isoformat(timespec="seconds"), seconds, len(features),
            sizes.get("train", 0), sizes.get("val", 0), sizes.get("test", 0), repr(sorted(model.spec.params.items(), key=str)),
        )],
        "model_type string, problem_type string, started string, ended string, seconds double, "
        "features int, train_rows bigint, val_rows bigint, test_rows bigint, params string",
    )
    return TrainingRun(model, metrics, summary)
