"""Decision trees, forests and first-order boosting on ``pyspark.ml``; second-order boosting by name.

Regression trees of more than SHALLOW levels that look at all features are grown by ``grown``: the
trees of ``pyspark.ml`` without its dense sums of every small node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from typing import Any

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from .base import VECTOR, ModelSpec, SparkModel, assembled, class_count, reject_unknown
from .boosted import BoostedTrees, Growth, train_boosted_trees
from .grown import GrownTrees, grow_trees

DEEPEST = 30  # the deepest tree Spark grows; stands for "no limit"
SHALLOW = 8
BINS = 128
PARALLEL = 4
#: Most bytes of training rows in a partition, and what one takes beside its draws and features.
TASK_BYTES, ROW_BYTES = 384 << 20, 104
COLUMNS = {"featuresCol": VECTOR, "labelCol": "__label", "predictionCol": "__prediction"}
CLASS_COLUMNS = {"rawPredictionCol": "__raw", "probabilityCol": "__probability"}

# Parameters that select an engine's internals or name the only choice there
# is; accepted and without effect, but for n_jobs with more than two boosted classes.
ENGINE_PARAMETERS = ["splitter", "loss", "objective", "metric", "n_jobs", "verbose"]


def _depth(value: Any) -> int:
    return DEEPEST if value is None or value < 0 else min(int(value), DEEPEST)


def _tree_options(params: Mapping[str, Any]) -> dict[str, Any]:
    if params.get("min_samples_split", 2) > 2:
        raise ValueError("min_samples_split above 2 has no counterpart; use min_samples_leaf")
    options: dict[str, Any] = {
        "maxDepth": _depth(params.get("max_depth")),
        "minInstancesPerNode": int(params.get("min_samples_leaf", 1)),
        "maxBins": int(params.get("max_bins", BINS)),
        "seed": int(params.get("random_state", 42)),
    }
    return options


TREE_PARAMETERS = [
    "max_depth", "min_samples_split", "min_samples_leaf", "max_bins", "random_state", "criterion",
    *ENGINE_PARAMETERS,
]


def _impurity(params: Mapping[str, Any]) -> str:
    name = params.get("criterion", "gini")
    if name not in ("gini", "entropy", "log_loss"):
        raise ValueError(f"unknown criterion {name!r}")
    return "gini" if name == "gini" else "entropy"


def _strategy(value: Any, default: str) -> str:
    if value is None:
        return default
    return str(value) if isinstance(value, (str, int)) or value < 1 else "all"


def _weighted(weight: str | None) -> dict[str, str]:
    return {} if weight is None else {"weightCol": "__weight"}


def _jobs(value: Any) -> int:
    """Boosters trained side by side; anything below 1 stands for the default."""
    return int(value) if value is not None and int(value) >= 1 else PARALLEL


@contextmanager
def kept_in_shares(data: DataFrame, features: int, trees: int = 1) -> Iterator[DataFrame]:
    """A kept copy for training: trees read the rows once for classes, bins and bagging each.

    Spark keeps how often each tree draws a row beside the row, in the rows' own partitions. Where
    one would hold more than TASK_BYTES of that, the rows are dealt out evenly to more of them.
    """
    data = data.persist()
    kept = [data]
    try:
        sizes = data.groupBy(F.spark_partition_id()).count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
        most = max(1, TASK_BYTES // (ROW_BYTES + 4 * trees + 8 * features))
        if (sizes.most or 0) > most:
            kept.append(data.repartition(math.ceil(sizes.n / most)).persist())
        yield kept[-1]
    finally:
        for copy in reversed(kept):
            copy.unpersist()


def _fit(estimator, data: DataFrame, features: int, trees: int = 1):
    with kept_in_shares(data, features, trees) as rows:
        return estimator.fit(rows)


def _grown(data: DataFrame, spec: ModelSpec, options: Mapping[str, Any], trees: int, drawn: bool) -> GrownTrees:
    with kept_in_shares(data, len(spec.features), trees) as rows:
        return grow_trees(rows, spec, trees, drawn, options["maxDepth"], options["minInstancesPerNode"], options["maxBins"], options["seed"])


def train_decision_tree(df: DataFrame, spec: ModelSpec, weight: str | None = None) -> SparkModel | GrownTrees:
    reject_unknown(spec.params, TREE_PARAMETERS, spec.model_type)
    data = assembled(df, spec.features, spec.label, weight)
    options = _tree_options(spec.params) | COLUMNS | _weighted(weight)
    if spec.problem_type == "classification":
        tree = DecisionTreeClassifier(impurity=_impurity(spec.params), **options, **CLASS_COLUMNS)
    elif options["maxDepth"] > SHALLOW and weight is None:
        return _grown(data, spec, options, 1, False)
    else:
        tree = DecisionTreeRegressor(**options)
    return SparkModel(spec, _fit(tree, data, len(spec.features)))


def train_random_forest(df: DataFrame, spec: ModelSpec, weight: str | None = None) -> SparkModel | GrownTrees:
    reject_unknown(spec.params, [*TREE_PARAMETERS, "n_estimators", "max_features", "bootstrap"], spec.model_type)
    data = assembled(df, spec.features, spec.label, weight)
    options = _tree_options(spec.params) | COLUMNS | _weighted(weight)
    options["numTrees"] = int(spec.params.get("n_estimators", 100))
    options["bootstrap"] = bool(spec.params.get("bootstrap", True))
    wanted = spec.params.get("max_features")
    if spec.problem_type == "classification":
        forest = RandomForestClassifier(
            impurity=_impurity(spec.params), featureSubsetStrategy=_strategy(wanted, "sqrt"),
            **options, **CLASS_COLUMNS,
        )
    elif options["maxDepth"] > SHALLOW and weight is None and _strategy(wanted, "all") == "all":
        return _grown(data, spec, options, options["numTrees"], options["bootstrap"])
    else:
        forest = RandomForestRegressor(featureSubsetStrategy=_strategy(wanted, "all"), **options)
    return SparkModel(spec, _fit(forest, data, len(spec.features), options["numTrees"]))


def _train_boosted(
    df: DataFrame, spec: ModelSpec, weight: str | None, depth: int, bins: int
) -> SparkModel:
    data = assembled(df, spec.features, spec.label, weight)
    options = {
        "maxIter": int(spec.params.get("n_estimators", 100)),
        "stepSize": float(spec.params.get("learning_rate", 0.1)),
        "maxDepth": depth,
        "maxBins": int(spec.params.get("max_bins", bins)),
        "subsamplingRate": float(spec.params.get("subsample", 1.0)),
        "featureSubsetStrategy": _strategy(spec.params.get("colsample_bytree"), "all"),
        "minInstancesPerNode": int(spec.params.get("min_samples_leaf", 1)),
        "seed": int(spec.params.get("random_state", 42)),
    }
    if spec.params.get("colsample_bytree") == 1.0:
        options["featureSubsetStrategy"] = "all"
    if spec.problem_type == "regression":
        return SparkModel(spec, _fit(GBTRegressor(**options, **COLUMNS, **_weighted(weight)), data, len(spec.features)))
    with kept_in_shares(data, len(spec.features)) as rows:
        if class_count(rows, "__label") <= 2:
            booster = GBTClassifier(**options, **COLUMNS, **CLASS_COLUMNS, **_weighted(weight))
            return SparkModel(spec, booster.fit(rows))
        rest = OneVsRest(
            classifier=GBTClassifier(**options), parallelism=_jobs(spec.params.get("n_jobs")),
            **COLUMNS, **_weighted(weight),
        )
        return SparkModel(spec, *rest.fit(rows).models, margin_scale=2.0)


def train_gradient_boosting(df: DataFrame, spec: ModelSpec, weight: str | None = None) -> SparkModel:
    """Boosted trees; more than two classes are handled one against the rest."""
    reject_unknown(spec.params, [*TREE_PARAMETERS, "n_estimators", "learning_rate", "subsample"], spec.model_type)
    _tree_options(spec.params)
    return _train_boosted(df, spec, weight, _depth(spec.params.get("max_depth", 3)), BINS)


def train_xgboost_style(df: DataFrame, spec: ModelSpec, weight: str | None = None) -> BoostedTrees:
    """Second-order boosted trees grown level by level, with leaf and split penalties."""
    known = [
        "n_estimators", "learning_rate", "max_depth", "subsample", "colsample_bytree", "gamma", "min_child_weight",
        "reg_alpha", "reg_lambda", "random_state", "max_bins", *ENGINE_PARAMETERS,
    ]
    reject_unknown(spec.params, known, spec.model_type)
    given = spec.params.get
    growth = Growth(
        rounds=int(given("n_estimators", 100)), rate=float(given("learning_rate", 0.1)),
        depth=_limit(given("max_depth", 6)), l1=float(given("reg_alpha", 0)), l2=float(given("reg_lambda", 1)),
        penalty=float(given("gamma", 0)), least_hessian=float(given("min_child_weight", 1)),
        row_share=float(given("subsample", 1.0)), feature_share=float(given("colsample_bytree", 1.0)),
        bins=int(given("max_bins", 256)), seed=int(given("random_state", 42)),
    )
    return train_boosted_trees(df, spec, growth, weight)


def train_lightgbm_style(df: DataFrame, spec: ModelSpec, weight: str | None = None) -> BoostedTrees:
    """Second-order boosted trees grown best-first to a number of leaves."""
    known = [
        "n_estimators", "learning_rate", "max_depth", "num_leaves", "subsample", "colsample_bytree", "min_child_samples",
        "min_child_weight", "min_split_gain", "reg_alpha", "reg_lambda", "random_state", "max_bins", *ENGINE_PARAMETERS,
    ]
    reject_unknown(spec.params, known, spec.model_type)
    given = spec.params.get
    growth = Growth(
        rounds=int(given("n_estimators", 100)), rate=float(given("learning_rate", 0.1)),
        depth=_limit(given("max_depth", -1)), leaves=int(given("num_leaves", 31)), l1=float(given("reg_alpha", 0)),
        l2=float(given("reg_lambda", 0)), penalty=float(given("min_split_gain", 0)),
        least_hessian=float(given("min_child_weight", 1e-3)), least_rows=int(given("min_child_samples", 20)),
        row_share=float(given("subsample", 1.0)), feature_share=float(given("colsample_bytree", 1.0)),
        bins=int(given("max_bins", 255)), seed=int(given("random_state", 42)), softmax_factor=None,
    )
    return train_boosted_trees(df, spec, growth, weight)


def _limit(depth: Any) -> int | None:
    """A depth, or None where there is no limit."""
    return None if depth is None or depth <= 0 else int(depth)
