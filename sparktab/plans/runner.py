"""A whole run from one configuration: read, clean, split, encode, train, score, save."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import is_numeric, require_columns
from ..functions.dictionary import Dictionary
from ..models.clustering import ClusterModel, fit_kmeans
from ..models.registry import TrainingRun, train_and_score
from ..models.weights import add_class_weights
from ..operators.cleaning import ColumnPlan, clean_columns, clean_uniform
from ..operators.duplicates import drop_duplicates_by
from ..operators.encoding import FeatureTransformer
from ..operators.labels import encode_label, fit_label_codes, split_label_kind
from ..operators.scoring import Scorer
from ..operators.splitting import split_summary, split_table
from ..sources.readers import load_table
from ..session import cut_lineage
from ..sources.workspace import Workspace

# Flat configuration keys and the setting each stands for.
FLAT_KEYS = {
    "ALGORITHM": "model.params.algorithm",
    "ALPHA": "model.params.alpha",
    "BATCH_SIZE": "model.params.batch_size",
    "BINARIZE": "model.params.binarize",
    "BOSTON_DATA_PATH": "path",
    "BOSTON_FEATURE_COLS": "features",
    "BOSTON_LABEL_COL": "label",
    "C": "model.params.C",
    "CLASS_PRIOR": "model.params.class_prior",
    "COLUMNS": "nulls.columns",
    "CRITERIA": "model.params.criterion",
    "CRITERION": "model.params.criterion",
    "DEGREE": "model.params.degree",
    "DROPOUT_RATE": "model.params.dropout",
    "EPOCHS": "model.params.max_iter",
    "FILL_PROCESS": "nulls.fill_value",
    "FILL_VALUE": "outliers.fill_value",
    "FINAL_K": "model.params.n_clusters",
    "FIT_PRIOR": "model.params.fit_prior",
    "GAMMA": "model.params.gamma",
    "HIDDEN_LAYERS": "model.params.hidden_layer_sizes",
    "INIT": "model.params.init",
    "IRIS_DATA_PATH": "path",
    "IRIS_FEATURE_COL": "features",
    "IRIS_FEATURE_COLS": "features",
    "IRIS_LABEL_COL": "label",
    "ISNULL_PROCESS": "nulls.style",
    "KEEP": "duplicates.keep",
    "KERNEL": "model.params.kernel",
    "LEAF_SIZE": "model.params.leaf_size",
    "LEARNING_RATE": "model.params.learning_rate_init",
    "MAX_DEPTH": "model.params.max_depth",
    "MAX_ITER": "model.params.max_iter",
    "METHOD": "outliers.method",
    "METRIC": "model.params.metric",
    "METRIC_PARAMS": "model.params.metric_params",
    "MIN_SAMPLES_LEAF": "model.params.min_samples_leaf",
    "MIN_SAMPLES_SPLIT": "model.params.min_samples_split",
    "MODEL": "model.type",
    "MULTI_CLASS": "model.params.multi_class",
    "N_ESTIMATORS": "model.params.n_estimators",
    "N_INIT": "model.params.n_init",
    "N_NEIGHBORS": "model.params.n_neighbors",
    "ONEHOT_ENCODE_COLS": "onehot",
    "ORDINAL_ENCODE_COLS": "ordinal",
    "P": "model.params.p",
    "PENALTY": "model.params.penalty",
    "PROBABILITY": "model.params.probability",
    "PROCESE_OUTLIERS_METHOD": "outliers.treatment",
    "RANDOM_SEED": "split.seed",
    "RANDOM_STATE": "model.params.random_state",
    "SOLVER": "model.params.solver",
    "SPLITTER": "model.params.splitter",
    "SUBSET": "duplicates.subset",
    "TEST_SIZE": "split.test_size",
    "THRESHOLD": "outliers.threshold",
    "USE_STRATIFIED": "split.stratified",
    "VALID_COLS": "outliers.columns",
    "VAL_SIZE": "split.val_size",
    "WEIGHTS": "model.params.weights",
}


# Model names of configurations, and the parameters each of them takes.
BAYES_NAMES = {
    "GaussianNB": ("Ga_naive_bayes", ()),
    "MultinomialNB": ("Mu_naive_bayes", ("alpha", "fit_prior", "class_prior")),
    "BernoulliNB": ("Be_naive_bayes", ("alpha", "fit_prior", "class_prior", "binarize")),
}


def from_flat(config: Mapping[str, Any], model_type: str | None = None) -> dict[str, Any]:
    """Nested settings from flat upper-case keys; unknown keys are refused.

    ``model_type`` names the model where the configuration does not. A naive Bayes
    configuration lists the parameters of all its variants; those of the variant it names
    are kept. Without a label and with a number of clusters it is a clustering. A value that
    only repeats the setting's name (``MAX_ITER: max_iter``) stands for the default.
    """
    nested: dict[str, Any] = {}
    unknown = [key for key in config if key.upper() not in FLAT_KEYS]
    if unknown:
        raise ValueError(f"unknown settings: {unknown}")
    for key, value in config.items():
        target = FLAT_KEYS[key.upper()]
        *folders, name = target.split(".")
        spot = nested
        for folder in folders:
            spot = spot.setdefault(folder, {})
        if value != name:
            spot[name] = None if value == "None" else value
    if isinstance(nested.get("features"), str):
        nested["features"] = [nested["features"]]
    model = nested.get("model", {})
    if model_type is not None:
        model = nested.setdefault("model", {})
        model.setdefault("type", model_type)
    if model.get("type") in BAYES_NAMES:
        model["type"], taken = BAYES_NAMES[model["type"]]
        model["params"] = {k: v for k, v in model.get("params", {}).items() if k in taken and v is not None}
    if "label" not in nested and "n_clusters" in model.get("params", {}):
        model.setdefault("type", "kmeans")
    return nested


def read_config(path: str, model_type: str | None = None) -> dict[str, Any]:
    """A YAML configuration, nested or flat; see ``from_flat`` for ``model_type``."""
    import yaml

    with open(path, encoding="utf-8") as file:
        config = yaml.safe_load(file)
    return from_flat(config, model_type) if any(k.isupper() for k in config) else config


@dataclass
class RunResult:
    """What each step produced; tables stay lazy. A clustering has no splits and no training run."""

    data: DataFrame
    splits: DataFrame | None
    summary: DataFrame
    training: TrainingRun | None = None
    scorer: Scorer | None = None
    ids: dict[str, str] = field(default_factory=dict)
    clusters: ClusterModel | None = None


def _cluster(spark: SparkSession, config: Mapping[str, Any], df: DataFrame, space: Workspace | None) -> RunResult:
    """K-means on the features; ``data`` gets the cluster of every row, ``summary`` their sizes."""
    params = dict(config["model"].get("params", {}))
    if params.pop("init", "k-means++") != "k-means++":
        raise ValueError("only k-means++ starts are available")
    k, starts = int(params.pop("n_clusters", 5)), int(params.pop("n_init", 10))
    seed = int(params.pop("random_state", 42))
    if params:
        raise ValueError(f"kmeans has no parameters {sorted(params)}")
    model = fit_kmeans(df, config["features"], k, starts, seed, bool(config.get("standardise", True)))
    found = model.transform(df)
    result = RunResult(found, None, found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), clusters=model)
    if space is not None:
        dataset_id = config.get("dataset_id", "table")
        result.ids["model"] = model.save(spark, f"{space.root}/models/{dataset_id}_kmeans")
    return result


def run_config(
    spark: SparkSession, config: Mapping[str, Any], data: DataFrame | None = None
) -> RunResult:
    """Compose the operators a configuration names; absent sections are skipped.

    Sections: ``path``, ``label``, ``features``, ``onehot``, ``ordinal``, ``standardise``,
    ``fit_on`` (train or all), ``class_weight``, ``duplicates``, ``nulls``, ``outliers``,
    ``split``, ``model`` (``type``, ``problem_type``, ``params``), ``output`` and
    ``dataset_id``. A subset of columns to deduplicate by without ``order_by`` is ordered by
    the other columns. A model of type ``kmeans`` needs no label: the cleaned table is
    clustered.
    """
    df = load_table(spark, config["path"]) if data is None else data
    label, features = config.get("label"), list(config["features"])
    model = config.get("model")
    if model and not model.get("type"):
        raise ValueError("the configuration has model parameters but no model type")
    clustering = bool(model) and model["type"] == "kmeans"
    if label is None and not clustering:
        raise ValueError("the configuration names no label")
    require_columns(df, [*([label] if label else []), *features])
    if dup := config.get("duplicates"):
        subset, order_by = dup.get("subset"), dup.get("order_by")
        if subset and not order_by:
            order_by = [c for c in df.columns if c not in subset]
        df = drop_duplicates_by(df, subset, dup.get("keep", "first"), order_by)
    if null := config.get("nulls"):
        df = clean_uniform(
            df, [c for c in null.get("columns") or features if c in df.columns],
            null_style=null["style"], null_fill=null.get("fill_value"),
        ).data
    if out := config.get("outliers"):
        df = clean_columns(
            df,
            [
                ColumnPlan(
                    c, "keep", None, out.get("method", "iqr"), out.get("threshold", 1.5),
                    out["treatment"], out.get("fill_value"),
                )
                for c in out.get("columns") or features
                if is_numeric(df, c)
            ],
        ).data

    ids: dict[str, str] = {}
    dataset_id = config.get("dataset_id", "table")
    space = Workspace(spark, config["output"]) if config.get("output") else None
    if space is not None:
        ids["processed"] = space.write_processed(df, dataset_id)
        df = space.read_processed(dataset_id, ids["processed"])
    elif any(config.get(step) for step in ("duplicates", "nulls", "outliers")):
        df = cut_lineage(df)  # once, not for every pass of the later steps
    if clustering:
        return _cluster(spark, config, df, space)

    is_class = split_label_kind(df, label) == "class"
    codes: Dictionary | None = None
    if is_class:
        codes = fit_label_codes(df, label)
        df = encode_label(df, label, codes)
    else:
        df = df.where(F.col(label).isNotNull())
    split = config.get("split", {})
    parts = split_table(
        df, label if is_class else None,
        test_size=split.get("test_size", 0.2), val_size=split.get("val_size", 0.2),
        stratified=bool(split.get("stratified", True)) and is_class,
        seed=split.get("seed", 42), key=split.get("key"), dedup=split.get("dedup", True),
    )
    if space is None:
        parts = cut_lineage(parts)
    fit_on = parts if config.get("fit_on", "train") == "all" else parts.where("split = 'train'")
    encoder = FeatureTransformer.fit(
        fit_on, features, config.get("onehot", ()), config.get("ordinal", ()),
        config.get("standardise", False),
    )
    encoded = encoder.transform(parts)
    summary = split_summary(parts, label if is_class else None)
    result = RunResult(df, encoded, summary, ids=ids)
    if space is not None:
        ids["split"] = space.write_splits(encoded, dataset_id)
        encoded = space.read_splits(ids["split"])
        space.write_metadata(ids["split"], {
            "dataset_id": dataset_id, "label": label, "features": features,
            "encoded_columns": encoder.output_columns,
            "classes": None if codes is None else codes.values,
            "settings": {k: v for k, v in config.items() if k != "path"},
        })
    if model:
        problem_type = model.get("problem_type") or ("classification" if is_class else "regression")
        weight = None
        if is_class and config.get("class_weight") not in (None, "none"):
            encoded = add_class_weights(encoded, label, config["class_weight"], "__class_weight")
            weight = "__class_weight"
        result.training = train_and_score(
            encoded, problem_type, model["type"], encoder.output_columns, label,
            model.get("params"), weight=weight,
        )
        result.scorer = Scorer(result.training.model, encoder, codes)
        if space is not None:
            path = f"{space.root}/models/{ids['split']}_{model['type']}"
            ids["model"] = result.scorer.save(spark, path)
            scores = {r["split"]: r.asDict() for r in result.training.metrics.collect()}
            space.log_run(
                dataset_id, ids["split"], model["type"], result.training.model.spec.params, scores, path
            )
    return result

