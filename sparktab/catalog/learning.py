"""Queries on models, their scores and predictions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from ..models import clustering, linear, network, registry, search, weights
from ..models.base import ModelSpec, load_model
from ..operators import labels, splitting
from ..operators.encoding import FeatureTransformer
from ..operators.scoring import Scorer
from ..plans.runner import run_config
from ..session import cut_lineage
from ..sources.workspace import Workspace
from .registry import query, rounded, scratch, table

DIMS = 64
VECTOR_COLUMNS = [f"e{i}" for i in range(DIMS)]
LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey"]


def wide_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column per embedding dimension."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", *[F.get("embedding", i).cast("double").alias(f"e{i}") for i in range(DIMS)]
    )


def vector_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_table(
        wide_vectors(spark, sf_dir), "label", key=["vec_id"], dedup=False, portable_keys=True
    )


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with both flags as class codes."""
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_suppkey", *LINE_COLUMNS, "l_returnflag", "l_linestatus")
    coded = labels.encode_label(lines, "l_returnflag", labels.fit_label_codes(lines, "l_returnflag"), "flag")
    return labels.encode_label(coded, "l_linestatus", labels.fit_label_codes(lines, "l_linestatus"), "status")


def line_splits(spark: SparkSession, sf_dir: str, label: str | None = None) -> DataFrame:
    rows = line_rows(spark, sf_dir)
    return splitting.split_table(
        rows, label, stratified=label is not None, key=[*LINE_KEY, "l_suppkey", "l_extendedprice"], dedup=False
    )


LETTERS = ["a", "e", "i", "n", "o", "r", "s", "t", "u", "é", "ñ", "ü"]
SHARES = [f"share_{i}" for i in range(len(LETTERS))]
COUNTS = [f"count_{i}" for i in range(len(LETTERS))]


@arrow_udf(T.ArrayType(T.DoubleType()))
def letter_counts(text: pa.Array) -> pa.Array:
    """How often each of the letters occurs; null for a null text."""
    found = np.stack([pc.count_substring(text, c).to_numpy(zero_copy_only=False) for c in LETTERS], axis=1)
    ends = pa.array(np.arange(len(text) + 1) * len(LETTERS), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(found.ravel(), pa.float64()), mask=pc.is_null(text))


def letter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its language code, length, and counts and shares of some letters.

    Written once: what trains on these rows reads them many times, and the texts but once.
    """
    docs = table(spark, sf_dir, "documents")
    found = docs.select(
        "doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"), F.length("text").alias("size"),
        letter_counts("text").alias("__counts"),
    )
    counted = found.select(
        "doc_id", "lang", "n_chars", "size", *[F.get("__counts", i).alias(n) for i, n in enumerate(COUNTS)]
    )
    shared = counted.withColumns(
        {s: F.coalesce(100 * F.try_divide(F.col(n), F.col("size")), F.lit(0.0)) for s, n in zip(SHARES, COUNTS)}
    )
    return cut_lineage(labels.encode_label(shared, "lang", labels.fit_label_codes(docs, "lang")))


def letter_splits(spark: SparkSession, sf_dir: str, label: str | None = "lang") -> DataFrame:
    """Documents split by class, or at random for a continuous label."""
    return splitting.split_table(
        letter_rows(spark, sf_dir), label, stratified=label is not None, key=["doc_id"], dedup=False
    )


def scored(parts: DataFrame, problem_type: str, model_type: str, features, label: str, **params) -> DataFrame:
    run = registry.train_and_score(parts, problem_type, model_type, features, label, params)
    return run.metrics.withColumn("model", F.lit(model_type))


# ---------------------------------------------------------------- linear


@query(
    "simple_regression",
    """
    SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
           round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
           round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem
    """,
)
def simple_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = linear.simple_regression(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return fitted.select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


@query(
    "linear_regression",
    """
    WITH m AS (SELECT var_pop(l_quantity) AS s11, var_pop(l_discount) AS s22, covar_pop(l_quantity, l_discount) AS s12,
      covar_pop(l_extendedprice, l_quantity) AS s1y, covar_pop(l_extendedprice, l_discount) AS s2y,
      avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2 FROM lineitem),
    b AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
                 (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2, my, m1, m2 FROM m)
    SELECT 'l_quantity' AS term, round(b1, 3) AS coefficient FROM b
    UNION ALL SELECT 'l_discount', round(b2, 3) FROM b UNION ALL SELECT '(intercept)', round(my - b1 * m1 - b2 * m2, 3) FROM b
    """,
)
def linear_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    model = registry.train(lines, "regression", "LR", ["l_quantity", "l_discount"], "l_extendedprice")
    return rounded(linear.coefficient_table(spark, model), 3)


@query(
    "lasso",
    """
    WITH m AS (SELECT var_pop(l_quantity) AS v, covar_pop(l_extendedprice, l_quantity) AS c,
                      avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM lineitem),
    b AS (SELECT sign(c) * greatest(abs(c) - 3.0, 0) / v AS w, my, mx FROM m)
    SELECT 'l_quantity' AS term, round(w, 2) AS coefficient FROM b
    UNION ALL SELECT '(intercept)', round(my - w * mx, 2) FROM b
    """,
)
def lasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = registry.train(table(spark, sf_dir, "lineitem"), "regression", "lasso", ["l_quantity"], "l_extendedprice")
    return rounded(linear.coefficient_table(spark, model), 2)


@query("lasso_many_features")
def lasso_many_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(letter_splits(spark, sf_dir, None), "regression", "lasso", COUNTS, "n_chars")


@query("linear_regression_scores")
def linear_regression_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(letter_splits(spark, sf_dir, None), "regression", "LR", COUNTS, "n_chars")


@query("logistic_regression")
def logistic_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(letter_splits(spark, sf_dir), "classification", "logistic_regression", SHARES, "lang")


# ---------------------------------------------------------------- trees


@query("random_forest_classifier")
def random_forest_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(letter_splits(spark, sf_dir), "classification", "random_forest", SHARES, "lang", max_depth=6)


@query("random_forest_regressor")
def random_forest_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(
        letter_splits(spark, sf_dir, None), "regression", "random_forest", COUNTS, "n_chars"
    )


@query("decision_tree_classifier")
def decision_tree_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(letter_splits(spark, sf_dir), "classification", "decision_tree", SHARES, "lang")


@query("decision_tree_regressor")
def decision_tree_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(letter_splits(spark, sf_dir, None), "regression", "decision_tree", COUNTS, "n_chars")


@query("gradient_boosting_classifier")
def gradient_boosting_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(
        letter_splits(spark, sf_dir), "classification", "gboost", SHARES, "lang"
    )


@query("gradient_boosting_regressor")
def gradient_boosting_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(letter_splits(spark, sf_dir, None), "regression", "gboost", COUNTS, "n_chars")


@query("xgboost_style_classifier")
def xgboost_style_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(
        letter_splits(spark, sf_dir), "classification", "xgboost", SHARES, "lang"
    )


@query("xgboost_style_regressor")
def xgboost_style_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(letter_splits(spark, sf_dir, None), "regression", "xgboost", COUNTS, "n_chars")


@query("lightgbm_style_classifier")
def lightgbm_style_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(
        letter_splits(spark, sf_dir), "classification", "lightgbm", SHARES, "lang"
    )


@query("lightgbm_style_regressor")
def lightgbm_style_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(letter_splits(spark, sf_dir, None), "regression", "lightgbm", COUNTS, "n_chars")


@query("adaboost_classifier")
def adaboost_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(
        letter_splits(spark, sf_dir), "classification", "adaboost", SHARES, "lang"
    )


@query("adaboost_regressor")
def adaboost_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(letter_splits(spark, sf_dir, None), "regression", "adaboost", COUNTS, "n_chars")


@query("feature_importance")
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = registry.train(
        letter_rows(spark, sf_dir), "regression", "decision_tree", COUNTS, "n_chars"
    )
    return registry.importance_table(spark, model)


@query("top_feature_importance")
def top_feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = registry.train(
        letter_rows(spark, sf_dir), "classification", "random_forest", SHARES, "lang", {}
    )
    return registry.importance_table(spark, model, top=20)


# ---------------------------------------------------------------- neighbours

_VECTOR_PARTS = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (ORDER BY
    CAST('0x' || substr(md5('42|' || CAST(vec_id AS VARCHAR)), 1, 15) AS BIGINT)) AS rn, count(*) OVER () AS n FROM embeddings),
q AS (SELECT * FROM e WHERE rn <= ceil(0.2 * n)), t AS (SELECT * FROM e WHERE rn > ceil(0.2 * n)),
near AS (SELECT q.vec_id, t.vec_id AS tid, t.label, list_distance(q.v, t.v) AS d FROM q CROSS JOIN t),
top AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, tid) AS spot FROM near)
"""


def _known_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts = splitting.split_table(
        wide_vectors(spark, sf_dir), stratified=False, key=["vec_id"], dedup=False, portable_keys=True
    )
    return parts.where("split <> 'test'"), parts.where("split = 'test'")


@query(
    "knn_classifier",
    _VECTOR_PARTS + """, votes AS (SELECT vec_id, label, count(*) AS c FROM top WHERE spot <= 5 GROUP BY 1, 2),
    best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) AS r FROM votes)
    SELECT vec_id, CAST(label AS DOUBLE) AS prediction FROM best WHERE r = 1
    """,
)
def knn_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, new = _known_and_new(spark, sf_dir)
    model = registry.train(known, "classification", "knn", VECTOR_COLUMNS, "label", {"id_column": "vec_id"})
    return model.transform(new, key="vec_id").select("vec_id", "prediction")


@query(
    "knn_classifier_distance_weights",
    _VECTOR_PARTS + """, votes AS (SELECT vec_id, label, sum(1 / d) AS c FROM top WHERE spot <= 7 GROUP BY 1, 2),
    best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) AS r FROM votes)
    SELECT vec_id, CAST(label AS DOUBLE) AS prediction FROM best WHERE r = 1
    """,
)
def knn_classifier_distance_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shuffled form: both sides cut into blocks, as if neither fitted a broadcast."""
    known, new = _known_and_new(spark, sf_dir)
    model = registry.train(
        known, "classification", "knn", VECTOR_COLUMNS, "label",
        {"id_column": "vec_id", "weights": "distance", "n_neighbors": 7},
    )
    blocked = model.transform(new, key="vec_id", broadcast_bytes=0, block_rows=200)
    return blocked.select("vec_id", "prediction")


@query(
    "knn_regressor",
    _VECTOR_PARTS + "SELECT vec_id, round(avg(label), 6) AS prediction FROM top WHERE spot <= 5 GROUP BY 1",
)
def knn_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, new = _known_and_new(spark, sf_dir)
    model = registry.train(known, "regression", "knn", VECTOR_COLUMNS, "label", {"id_column": "vec_id"})
    return rounded(model.transform(new, key="vec_id").select("vec_id", "prediction"), 6)


# ---------------------------------------------------------------- naive Bayes


def _flag_codes_sql(extra: str) -> str:
    return f"""
    WITH r AS (SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
      l_discount, l_tax, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS k FROM lineitem){extra}
    """


def _gaussian_sql() -> str:
    moments = ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in LINE_COLUMNS)
    widest = "greatest(" + ", ".join(f"var_pop({c})" for c in LINE_COLUMNS) + ")"
    score = " ".join(
        f"- 0.5 * ln(2 * pi() * (v_{c} + w)) - 0.5 * (r.{c} - m_{c}) * (r.{c} - m_{c}) / (v_{c} + w)" for c in LINE_COLUMNS
    )
    return _flag_codes_sql(f""",
    f AS (SELECT 1e-9 * {widest} AS w, count(*) AS n FROM r),
    p AS (SELECT k, count(*) AS c, {moments} FROM r GROUP BY k),
    s AS (SELECT rid, l_orderkey, l_linenumber, l_partkey, l_suppkey, p.k, ln(c / n) {score} AS score FROM r, p, f),
    b AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, k) AS spot FROM s)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(k AS DOUBLE) AS prediction FROM b WHERE spot = 1""")


@query("gaussian_naive_bayes", _gaussian_sql())
def gaussian_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_rows(spark, sf_dir)
    model = registry.train(rows, "classification", "Ga_naive_bayes", LINE_COLUMNS, "flag")
    return model.transform(rows).select(*LINE_KEY, "l_suppkey", "prediction")


_BINARY = {"l_quantity": 25, "l_discount": 0.05, "l_tax": 0.04}


def _bernoulli_sql() -> str:
    flags = ", ".join(f"CASE WHEN {c} - {cut} > 0 THEN 1 ELSE 0 END AS b_{c}" for c, cut in _BINARY.items())
    sums = ", ".join(f"(sum(b_{c}) + 1) / (count(*) + 2.0) AS p_{c}" for c in _BINARY)
    score = " ".join(f"+ CASE WHEN b_{c} = 1 THEN ln(p_{c}) ELSE ln(1 - p_{c}) END" for c in _BINARY)
    return _flag_codes_sql(f""",
    x AS (SELECT *, {flags} FROM r),
    p AS (SELECT k, count(*) AS c, {sums} FROM x GROUP BY k),
    s AS (SELECT rid, l_orderkey, l_linenumber, l_partkey, l_suppkey, p.k, ln(c / (SELECT count(*) FROM r)) {score} AS score FROM x, p),
    b AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, k) AS spot FROM s)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(k AS DOUBLE) AS prediction FROM b WHERE spot = 1""")


@query("bernoulli_naive_bayes", _bernoulli_sql())
def bernoulli_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_rows(spark, sf_dir).withColumns(
        {f"above_{c}": F.col(c) - F.lit(cut) for c, cut in _BINARY.items()}
    )
    model = registry.train(rows, "classification", "Be_naive_bayes", [f"above_{c}" for c in _BINARY], "flag")
    return model.transform(rows).select(*LINE_KEY, "l_suppkey", "prediction")


_LETTERS = LETTERS


def _multinomial_sql() -> str:
    counts = ", ".join(f"length(text) - length(replace(text, '{c}', '')) AS n_{c}" for c in _LETTERS)
    sums = ", ".join(f"sum(n_{c}) + 1.0 AS s_{c}" for c in _LETTERS)
    whole = " + ".join(f"s_{c}" for c in _LETTERS)
    score = " ".join(f"+ n_{c} * ln(s_{c} / ({whole}))" for c in _LETTERS)
    return f"""
    WITH d AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang) - 1 AS k, {counts} FROM documents),
    p AS (SELECT k, count(*) AS c, {sums} FROM d GROUP BY k),
    s AS (SELECT doc_id, p.k, ln(c / (SELECT count(*) FROM d)) {score} AS score FROM d, p),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) AS spot FROM s)
    SELECT doc_id, CAST(k AS DOUBLE) AS prediction FROM b WHERE spot = 1
    """


@query("multinomial_naive_bayes", _multinomial_sql())
def multinomial_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = docs.select(
        "doc_id", "lang",
        *[(F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).alias(f"n_{c}") for c in _LETTERS],
    )
    coded = labels.encode_label(counted, "lang", labels.fit_label_codes(counted, "lang"))
    model = registry.train(coded, "classification", "Mu_naive_bayes", [f"n_{c}" for c in _LETTERS], "lang")
    return model.transform(coded).select("doc_id", "prediction")


# ---------------------------------------------------------------- kernels and networks


@query("svm_linear_classifier")
def svm_linear_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(
        letter_splits(spark, sf_dir), "classification", "svm", SHARES, "lang", kernel="linear"
    )


@query("svm_kernel_classifier")
def svm_kernel_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(
        letter_splits(spark, sf_dir), "classification", "svm", SHARES, "lang"
    )


@query("svm_kernel_regressor")
def svm_kernel_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = [c for c in SHARES if c != "share_1"]
    parts = letter_splits(spark, sf_dir, None)
    encoder = FeatureTransformer.fit(parts.where("split = 'train'"), others, standardise=True)
    return scored(encoder.transform(parts), "regression", "svm", encoder.output_columns, "share_1")


@query("network_classifier")
def network_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(letter_splits(spark, sf_dir), "classification", "mlp", SHARES, "lang", batch_size=16)


@query("network_epoch_history")
def network_epoch_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = letter_splits(spark, sf_dir)
    spec = ModelSpec(
        "classification", "mlp", SHARES, "lang",
        {"max_iter": 300, "batch_size": 16, "dropout": 0.2, "decay_every": 10, "decay_factor": 0.9},
    )
    model = network.train_network(parts.where("split = 'train'"), spec, validation=parts.where("split = 'val'"))
    return model.history_table(spark)


@query("network_regressor")
def network_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = [c for c in SHARES if c != "share_6"]
    return scored(letter_splits(spark, sf_dir, None), "regression", "mlp", others, "share_6", batch_size=16)


# ---------------------------------------------------------------- clusters


@query("kmeans_clusters")
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = wide_vectors(spark, sf_dir)
    model = clustering.fit_kmeans(vectors, VECTOR_COLUMNS, 10)
    found = model.transform(vectors).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("label").alias("labels")
    )
    return found.join(model.centers(spark).select("cluster", "e0", "e1"), "cluster")


@query("elbow")
def elbow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.elbow_table(wide_vectors(spark, sf_dir), VECTOR_COLUMNS)


@query(
    "silhouette",
    """
    WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    s AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v)) AS d, count(*) AS n
          FROM e a CROSS JOIN e b GROUP BY 1, 2, 3),
    m AS (SELECT vec_id, max(CASE WHEN own = other THEN d / (n - 1) END) AS inside,
                 min(CASE WHEN own <> other THEN d / n END) AS outside FROM s GROUP BY 1)
    SELECT count(*) AS rows, CAST((SELECT count(DISTINCT label) FROM e) AS INTEGER) AS clusters,
           round(avg((outside - inside) / greatest(inside, outside)), 6) AS silhouette FROM m
    """,
)
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clustering.silhouette(wide_vectors(spark, sf_dir), VECTOR_COLUMNS, "label", "vec_id"), 6)


# ---------------------------------------------------------------- search, weights


@query("grid_search")
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = search.grid_search(
        letter_rows(spark, sf_dir), "classification", "decision_tree", SHARES, "lang",
        {"max_depth": [3, 6], "criterion": ["gini", "entropy"]}, folds=5, key=["doc_id"],
    )
    return search.top_candidates(result)


@query(
    "class_weights",
    """
    WITH c AS (SELECT toxic AS label, count(*) AS n FROM labels GROUP BY 1)
    SELECT label, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c
    """,
)
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(weights.class_weight_table(table(spark, sf_dir, "labels"), "toxic"), 6)


@query(
    "class_weighted_rows",
    """
    WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1),
    w AS (SELECT toxic, (SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n) AS weight FROM c)
    SELECT doc_id, toxic, round(weight, 6) AS weight FROM labels JOIN w USING (toxic)
    """,
)
def class_weighted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return rounded(weights.add_class_weights(rows, "toxic"), 6)


# ---------------------------------------------------------------- scoring


@query(
    "predictions_with_labels",
    _gaussian_sql().replace(
        "CAST(k AS DOUBLE) AS prediction FROM b WHERE spot = 1",
        "CAST(k AS DOUBLE) AS predict_result, flag AS predict_label FROM b JOIN (SELECT flag, row_number() OVER (ORDER BY flag) - 1 "
        "AS code FROM (SELECT DISTINCT l_returnflag AS flag FROM lineitem)) ON code = k WHERE spot = 1",
    ),
)
def predictions_with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved, reloaded, applied to raw rows: codes and the labels behind them."""
    lines = table(spark, sf_dir, "lineitem")
    codes = labels.fit_label_codes(lines, "l_returnflag")
    encoder = FeatureTransformer.fit(lines, LINE_COLUMNS)
    coded = labels.encode_label(lines, "l_returnflag", codes)
    model = registry.train(
        encoder.transform(coded), "classification", "Ga_naive_bayes", encoder.output_columns, "l_returnflag"
    )
    path = Scorer(model, encoder, codes).save(spark, f"{scratch(spark)}/scorer")
    done = Scorer.load(spark, path).score(lines.drop("l_returnflag"))
    return done.select(*LINE_KEY, "l_suppkey", "predict_result", "predict_label")


@query("predictions_written")
def predictions_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = letter_splits(spark, sf_dir)
    model = registry.train(
        parts.where("split = 'train'"), "classification", "random_forest", SHARES, "lang"
    )
    space = Workspace(spark, scratch(spark))
    done = Scorer(load_model(spark, model.save(spark, f"{space.root}/model"))).score(
        parts.where("split = 'test'").select("doc_id", *SHARES)
    )
    path = space.write_predictions(done.select("doc_id", "predict_result", "predict_proba"), "documents")
    return spark.read.csv(path, header=True, escape='"')


@query(
    "training_summary",
    """
    WITH z AS (SELECT count(*) AS n, CAST(ceil(0.2 * count(*)) AS BIGINT) AS t FROM lineitem),
    v AS (SELECT n, t, CAST(ceil((n - t) * (0.2 / (1 - 0.2))) AS BIGINT) AS v FROM z)
    SELECT 'Ga_naive_bayes' AS model_type, 'classification' AS problem_type, 4 AS features, n - t - v AS train_rows,
           v AS val_rows, t AS test_rows, '[]' AS params FROM v
    """,
)
def training_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = registry.train_and_score(
        line_splits(spark, sf_dir, "flag"), "classification", "Ga_naive_bayes", LINE_COLUMNS, "flag"
    )
    return run.summary.drop("started", "ended", "seconds")


@query("lineitem_forest_chain")
def lineitem_forest_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, split by class, encode, train a forest, score every part."""
    lines = table(spark, sf_dir, "lineitem").select(
        *LINE_KEY, "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_linestatus", "l_returnflag",
        F.expr("CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_extendedprice END").alias("l_extendedprice"),
    )
    result = run_config(
        spark,
        {
            "label": "l_returnflag",
            "features": [*LINE_COLUMNS, "l_linestatus"],
            "onehot": ["l_linestatus"],
            "standardise": True,
            "nulls": {"style": "median_cols"},
            "outliers": {"columns": ["l_extendedprice"], "treatment": "fill_outlier"},
            "split": {"key": [*LINE_KEY, "l_suppkey", "l_extendedprice"], "dedup": False},
            "model": {"type": "random_forest", "params": {}},
        },
        lines,
    )
    return result.training.metrics


@query("configured_run_log")
def configured_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that writes its cleaned table, splits, metadata, model and log."""
    root = scratch(spark)
    run_config(
        spark,
        {
            "label": "event_type", "features": ["value", "user_id"], "standardise": True,
            "outliers": {"columns": ["value"], "method": "iqr", "threshold": 1.5, "treatment": "del_outlier"},
            "duplicates": {"subset": ["event_id"], "keep": "first", "order_by": "event_id"},
            "split": {"test_size": 0.15, "val_size": 0.15},
            "class_weight": "balanced",
            "model": {"type": "decision_tree", "params": {"max_depth": 3}},
            "output": root, "dataset_id": "events",
        },
        table(spark, sf_dir, "events").select("event_id", "event_type", "value", "user_id"),
    )
    return Workspace(spark, root).runs("events").select("dataset_id", "model_type", "params", "metrics")

