"""Queries on searches, boosted trees, probabilities and pruned neighbours, and their SQL twins."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..models import clustering, registry, search, weights
from ..models.base import load_model
from ..models.neighbors import neighbor_search
from ..operators import encoding, splitting
from ..operators.scoring import Scorer
from ..operators.sparse_encoding import SparseOneHot
from ..operators.strata import folds_in_classes
from ..plans.runner import from_flat, run_config
from ..session import local_table
from ..sources.workspace import Workspace
from .learning import (
    LINE_COLUMNS,
    LINE_KEY,
    SHARES,
    VECTOR_COLUMNS,
    _gaussian_sql,
    letter_rows,
    letter_splits,
    line_rows,
    wide_vectors,
)
from .registry import query, rounded, scratch, table

# The settings that a search over support vector machines goes through.
SVM_GRID = {
    "C": [0.1, 1, 10, 100, 200],
    "kernel": ["linear", "rbf", "poly", "sigmoid"],
    "gamma": ["scale", "auto", 0.0001, 0.001, 0.01, 0.1],
    "degree": [2, 3, 4],
    "max_iter": [-1, 100, 200, 500],
}
SEARCH_LANDMARKS = 48


# ---------------------------------------------------------------- search


@query("svm_grid_search")
def svm_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of 1,440 settings by five folds."""
    result = search.grid_search(
        letter_rows(spark, sf_dir), "classification", "svm", SHARES, "lang",
        {**SVM_GRID, "landmarks": [SEARCH_LANDMARKS]}, folds=5, key=["doc_id"],
    )
    return search.top_candidates(result).select(
        "rank", "candidate", "params", F.round("mean_score", 6).alias("mean_score"), F.round("std_score", 6).alias("std_score")
    )


@query(
    "grid_fold_sizes",
    """
    WITH c AS (SELECT lang, count(*) AS n, dense_rank() OVER (ORDER BY lang) - 1 AS code FROM documents GROUP BY lang),
    f AS (SELECT code, n, unnest(range(5)) AS fold FROM c)
    SELECT CAST(code AS BIGINT) AS lang, fold, CAST(n // 5 + CASE WHEN (fold - code + 5) % 5 < n % 5 THEN 1 ELSE 0 END AS BIGINT) AS n FROM f
    """,
)
def grid_fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per class and fold of the search's folds."""
    folds = search.assign_folds(letter_rows(spark, sf_dir), 5, "lang", ["doc_id"])
    return folds.groupBy(F.col("lang").cast("bigint").alias("lang"), F.col("fold").cast("bigint").alias("fold")).agg(F.count(F.lit(1)).alias("n"))


@query("svm_probabilities")
def svm_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class probabilities of a linear machine for every document of the test part."""
    parts = letter_splits(spark, sf_dir)
    model = registry.train(
        parts.where("split = 'train'"), "classification", "svm", SHARES, "lang", {"kernel": "linear", "probability": True}
    )
    found = model.transform(parts.where("split = 'test'"))
    return found.select("doc_id", "lang", "prediction", F.transform("probability", lambda p: F.round(p, 4)).alias("probability"))


# ---------------------------------------------------------------- boosted trees


def _stump_sql(label: str, prior: str, g: str, h: str, l1: float, l2: float, least: float, features: list[str]) -> str:
    """One round of one split from sums per value: the best of all features, thresholds between values."""
    soft = lambda s: f"(sign({s}) * greatest(abs({s}) - {l1}, 0))"
    values = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {i} AS place, CAST({c} AS DOUBLE) AS x, sum({g}) AS g, sum({h}) AS h FROM r GROUP BY {c}"
        for i, c in enumerate(features)
    )
    return f"""
    WITH y AS (SELECT *, CAST({label} AS DOUBLE) AS y FROM lineitem),
    m AS (SELECT avg(y) AS mean FROM y),
    r AS (SELECT y.*, {prior} AS p FROM y, m),
    v AS ({values}),
    c AS (
      SELECT *, lead(x) OVER w AS following, sum(g) OVER w AS gl, sum(h) OVER w AS hl,
             sum(g) OVER (PARTITION BY feature) AS gs, sum(h) OVER (PARTITION BY feature) AS hs
      FROM v WINDOW w AS (PARTITION BY feature ORDER BY x)),
    s AS (
      SELECT feature, place, (x + following) / 2 AS threshold, gl, hl, gs - gl AS gr, hs - hl AS hr,
             0.5 * (pow({soft("gl")}, 2) / (hl + {l2}) + pow({soft("(gs - gl)")}, 2) / (hs - hl + {l2}) - pow({soft("gs")}, 2) / (hs + {l2})) AS gain
      FROM c WHERE following IS NOT NULL AND hl >= {least} AND hs - hl >= {least}),
    b AS (SELECT * FROM s ORDER BY gain DESC, place, threshold LIMIT 1)
    SELECT feature, round(threshold, 6) AS threshold, round(gain, 4) AS gain,
           round(-{soft("gl")} / (hl + {l2}), 6) AS left_value, round(-{soft("gr")} / (hr + {l2}), 6) AS right_value FROM b
    """


def _stump(model) -> list[tuple]:
    """The root's split and its leaves' values."""
    nodes = {r[2]: r for r in model.split_table()}
    root = nodes.pop(0)
    return [(root[3], root[4], root[6], nodes[1][7], nodes[2][7])]


STUMP = "feature string, threshold double, gain double, left_value double, right_value double"
FEW_VALUED = ["l_quantity", "l_discount", "l_tax"]


def _stump_rows(spark: SparkSession, model) -> DataFrame:
    found = local_table(spark, _stump(model), STUMP)
    return found.select(
        "feature", F.round("threshold", 6).alias("threshold"), F.round("gain", 4).alias("gain"),
        F.round("left_value", 6).alias("left_value"), F.round("right_value", 6).alias("right_value"),
    )


@query(
    "boosted_stump_regressor",
    _stump_sql("l_extendedprice / 10000", "mean", "p - y", "1.0", 5.0, 2.0, 1.0, FEW_VALUED),
)
def boosted_stump_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first split of second-order boosting with leaf penalties."""
    rows = table(spark, sf_dir, "lineitem").select(*FEW_VALUED, (F.col("l_extendedprice") / 10000).alias("y"))
    model = registry.train(
        rows, "regression", "xgboost", FEW_VALUED, "y", {"n_estimators": 1, "max_depth": 1, "reg_alpha": 5, "reg_lambda": 2}
    )
    return _stump_rows(spark, model)


@query(
    "boosted_stump_classifier",
    _stump_sql("l_returnflag = 'R'", "mean", "p - y", "p * (1 - p)", 0.5, 1.0, 300.0, FEW_VALUED),
)
def boosted_stump_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for two classes: gradients and hessians of the log loss."""
    rows = table(spark, sf_dir, "lineitem").select(*FEW_VALUED, (F.col("l_returnflag") == "R").cast("int").alias("y"))
    model = registry.train(
        rows, "classification", "xgboost", FEW_VALUED, "y",
        {"n_estimators": 1, "max_depth": 1, "reg_alpha": 0.5, "min_child_weight": 300},
    )
    return _stump_rows(spark, model)


@query(
    "boosted_one_leaf_scores",
    """
    WITH m AS (SELECT avg(l_extendedprice / 10000) AS mean, count(*) AS n, sum(l_extendedprice / 10000) AS s FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(mean, 4) AS prediction FROM lineitem, m
    """,
)
def boosted_one_leaf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split penalty above every gain leaves one leaf, and so the mean, in every round."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf_dir, "lineitem").select(*key, *LINE_COLUMNS, (F.col("l_extendedprice") / 10000).alias("y"))
    model = registry.train(rows, "regression", "xgboost", FEW_VALUED, "y", {"n_estimators": 3, "gamma": 1e12})
    return rounded(model.transform(rows).select(*key, "prediction"))


@query("boosted_leaf_table")
def boosted_leaf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of ten best-first trees per class, grown with penalties on leaves and splits."""
    model = registry.train(
        letter_rows(spark, sf_dir), "classification", "lightgbm", SHARES, "lang",
        {"n_estimators": 10, "num_leaves": 15, "reg_alpha": 0.1, "reg_lambda": 1.0, "min_split_gain": 0.01},
    )
    names = "round int, tree int, node int, feature string, threshold double, missing_left boolean, gain double, value double"
    return rounded(local_table(spark, model.split_table(), names), 5)


# ---------------------------------------------------------------- neighbours


@query("knn_pairs_compared")
def knn_pairs_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of documents' letter shares the cells leave to compare, of all pairs."""
    rows = letter_rows(spark, sf_dir)
    queries = rows.withColumn("__q", F.col("doc_id"))
    points = rows.withColumns({"__id": F.col("doc_id"), "__label": F.col("lang").cast("double")})
    found = neighbor_search(queries, points, SHARES, 5, broadcast_bytes=0)
    lists = found.lists.agg(F.count(F.lit(1)).alias("queries"), F.sum(F.size("neighbors")).alias("neighbors"))
    return lists.withColumns({"pairs": F.lit(found.pairs), "compared": F.lit(found.compared)})


# ---------------------------------------------------------------- clusters


@query(
    "elbow_one_cluster",
    """
    WITH v AS (SELECT unnest(range(1, 65)) AS i, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    d AS (SELECT i, var_pop(e[i]) * count(*) AS squares FROM v GROUP BY i)
    SELECT 1 AS k, round(sum(squares), 6) AS inertia FROM d
    """,
)
def elbow_one_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elbow's first point, before and after which nothing can move: squares around the mean."""
    table_of_k = clustering.elbow_table(wide_vectors(spark, sf_dir), VECTOR_COLUMNS, largest=1, starts=2, standardise=False)
    return table_of_k.select("k", F.round("inertia", 6).alias("inertia"))


# ---------------------------------------------------------------- very many classes


def _shared_sql(size: str, total: str, out: str, source: str) -> str:
    """One sharing by largest remainder, as SQL."""
    return f"""
    SELECT *, floored + CASE WHEN nth <= {total} - sum(floored) OVER () THEN 1 ELSE 0 END AS {out}
    FROM (SELECT *, row_number() OVER (ORDER BY rest DESC, label) AS nth FROM (
      SELECT * EXCLUDE (floored, rest, nth), {size} * {total} // sum({size}) OVER () AS floored, {size} * {total} % sum({size}) OVER () AS rest
      FROM {source}))"""


@query(
    "many_class_split",
    f"""
    WITH c AS (SELECT l_orderkey AS label, count(*) AS n, 0 AS floored, 0 AS rest, 0 AS nth FROM lineitem GROUP BY 1),
    t AS (SELECT sum(n) AS whole, CAST(ceil(0.2 * sum(n)) AS BIGINT) AS test FROM c),
    v AS (SELECT *, CAST(ceil((whole - test) * (0.1 / (1 - 0.2))) AS BIGINT) AS val FROM t),
    k AS ({_shared_sql("n", "(SELECT whole - test FROM v)", "kept", "c")}),
    r AS ({_shared_sql("kept", "(SELECT whole - test - val FROM v)", "train", "k")})
    SELECT label AS l_orderkey, CAST(n - kept AS BIGINT) AS test, CAST(kept - train AS BIGINT) AS val, CAST(train AS BIGINT) AS train FROM r
    """,
)
def many_class_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per part of every order, stratified by order: over 10,000 classes from a scale of 0.01 on."""
    parts = splitting.split_table(
        table(spark, sf_dir, "lineitem"), "l_orderkey", 0.2, 0.1, key=["l_orderkey", "l_linenumber"], dedup=False, min_class_rows=1
    )
    counted = [F.count(F.when(F.col("split") == p, 1)).alias(p) for p in ("test", "val", "train")]
    return parts.groupBy("l_orderkey").agg(*counted)


@query(
    "many_class_fold_sizes",
    """
    WITH c AS (SELECT l_orderkey, count(*) AS n, row_number() OVER (ORDER BY l_orderkey) - 1 AS code FROM lineitem GROUP BY 1),
    f AS (SELECT *, unnest(range(5)) AS fold FROM c)
    SELECT * FROM (SELECT l_orderkey, CAST(fold AS INTEGER) AS fold, CAST(n // 5 + CASE WHEN (fold - code % 5 + 5) % 5 < n % 5 THEN 1 ELSE 0 END AS BIGINT) AS n FROM f)
    WHERE n > 0
    """,
)
def many_class_fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per order and fold, each order spread evenly."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    ordered = rows.withColumns({"__k1": F.col("l_linenumber").cast("bigint"), "__k2": F.lit(0).cast("bigint")})
    folds = folds_in_classes(ordered, "l_orderkey", 5, "__k1", "__k2", "fold")
    return folds.groupBy("l_orderkey", "fold").agg(F.count(F.lit(1)).alias("n"))


@query(
    "many_class_weights",
    """
    WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM lineitem JOIN c USING (l_orderkey)
    """,
)
def many_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A balanced weight for every line, each order being a class."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return rounded(weights.add_class_weights(rows, "l_orderkey"), 6)


@query(
    "onehot_positions",
    """
    WITH o AS (SELECT l_orderkey, dense_rank() OVER (ORDER BY l_orderkey) - 1 AS a, l_linenumber, l_partkey, l_suppkey,
                      dense_rank() OVER (ORDER BY l_returnflag) - 1 AS b, dense_rank() OVER (ORDER BY l_partkey) - 1 AS c FROM lineitem),
    s AS (SELECT count(DISTINCT l_orderkey) - 1 AS a, count(DISTINCT l_returnflag) - 1 AS b FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           array_to_string([x FOR x IN [CASE WHEN o.a >= 1 THEN o.a - 1 END, CASE WHEN o.b >= 1 THEN s.a + o.b - 1 END,
                                        CASE WHEN o.c >= 1 THEN s.a + s.b + o.c - 1 END] IF x IS NOT NULL], ',') AS positions
    FROM o, s
    """,
)
def onehot_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-zero positions of three columns, one of them with over 10,000 categories from a scale of 0.01 on."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    encoder = SparseOneHot.fit(rows, ["l_orderkey", "l_returnflag", "l_partkey"])
    found = encoder.positions(rows)
    text = F.array_join(F.col("positions").cast("array<string>"), ",")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("positions"))


# ---------------------------------------------------------------- results that SQL can repeat


@query("bayes_predictions_written", _gaussian_sql())
def bayes_predictions_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions written as CSV by the workspace and read again."""
    rows = line_rows(spark, sf_dir)
    model = registry.train(rows, "classification", "Ga_naive_bayes", LINE_COLUMNS, "flag")
    key = [*LINE_KEY, "l_suppkey"]
    space = Workspace(spark, scratch(spark))
    done = Scorer(load_model(spark, model.save(spark, f"{space.root}/model"))).score(rows.select(*key, *LINE_COLUMNS))
    path = space.write_predictions(done.select(*key, "predict_result"), "lines")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in key)
    return spark.read.csv(path, header=True, schema=f"{kinds}, predict_result double").withColumnRenamed("predict_result", "prediction")


@query(
    "principal_component_variance",
    """
    WITH v AS (SELECT unnest(range(1, 65)) AS i, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
    SELECT 64 AS components, round(sum(s), 6) AS total_variance FROM (SELECT var_pop(e[i]) AS s FROM v GROUP BY i)
    """,
)
def principal_component_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components together hold the whole variance."""
    fitted = encoding.fit_pca(wide_vectors(spark, sf_dir), VECTOR_COLUMNS, 64)
    parts = fitted.transform(wide_vectors(spark, sf_dir)).select(F.posexplode(vector_to_array("pca")).alias("i", "x"))
    spread = parts.groupBy("i").agg(F.var_pop("x").alias("s"))
    return spread.agg(F.count(F.lit(1)).cast("int").alias("components"), F.round(F.sum("s"), 6).alias("total_variance"))


@query(
    "configured_one_cluster",
    """
    WITH v AS (SELECT unnest(range(1, 65)) AS i, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
    SELECT CAST(i - 1 AS INTEGER) AS dimension, round(avg(e[i]), 6) AS centre, count(*) AS rows FROM v GROUP BY i
    """,
)
def configured_one_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clustering configuration with one cluster: its centre is the mean, on the original scale."""
    vectors = wide_vectors(spark, sf_dir).select(*VECTOR_COLUMNS)
    config = {"IRIS_FEATURE_COLS": vectors.columns, "FINAL_K": 1, "INIT": "k-means++", "N_INIT": 2, "RANDOM_STATE": 42}
    result = run_config(spark, from_flat(config), vectors)
    centre = result.clusters.centers(spark).select(F.posexplode(F.array(*VECTOR_COLUMNS)).alias("dimension", "centre"))
    sizes = result.summary.agg(F.sum("n").alias("rows"))
    return centre.select("dimension", F.round("centre", 6).alias("centre")).crossJoin(F.broadcast(sizes))


def _adaboost_sql() -> str:
    """One weighted round: the stump's error is the weight of the vote."""
    return """
    WITH r AS (SELECT l_quantity, l_discount, l_tax, CASE WHEN l_quantity * l_extendedprice > 1000000 THEN 1 ELSE 0 END AS y FROM lineitem),
    v AS (SELECT l_quantity AS x, sum(y) AS s, count(*) AS n FROM r GROUP BY 1),
    c AS (SELECT x, lead(x) OVER w AS following, sum(s) OVER w AS sl, sum(n) OVER w AS nl, sum(s) OVER () AS sa, sum(n) OVER () AS na
          FROM v WINDOW w AS (ORDER BY x)),
    g AS (SELECT *, 2.0 * sl * (nl - sl) / nl + 2.0 * (sa - sl) * (na - nl - sa + sl) / (na - nl) AS impurity FROM c WHERE following IS NOT NULL),
    b AS (SELECT least(sl, nl - sl) + least(sa - sl, na - nl - sa + sl) AS missed, na FROM g ORDER BY impurity LIMIT 1)
    SELECT round(ln((na - missed) / missed), 6) AS vote, CAST(missed AS BIGINT) AS missed FROM b
    """


@query("adaboost_first_round", _adaboost_sql())
def adaboost_first_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of AdaBoost on two classes: log of the odds of its stump, and rows it gets wrong."""
    lines = table(spark, sf_dir, "lineitem").withColumn("dear", F.expr("CAST(l_quantity * l_extendedprice > 1000000 AS INT)"))
    model = registry.train(lines, "classification", "adaboost", ["l_quantity"], "dear", {"n_estimators": 1})
    missed = model.transform(lines).where(F.col("prediction") != F.col("dear")).agg(F.count(F.lit(1)).alias("missed"))
    return missed.select(F.round(F.lit(float(model.says[0])), 6).alias("vote"), "missed")


@query("svm_landmark_error")
def svm_landmark_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What more landmarks buy: the share of the kernel that they miss, and the error of the regression."""
    rows = letter_rows(spark, sf_dir)
    others = [c for c in SHARES if c != "share_1"]
    encoder = encoding.FeatureTransformer.fit(rows, others, standardise=True)
    data = encoder.transform(rows, keep_raw=True)
    found = []
    for landmarks in (10, 40, 160):
        model = registry.train(data, "regression", "svm", encoder.output_columns, "share_1", {"landmarks": landmarks})
        error = model.transform(data).agg(F.avg(F.abs(F.col("prediction") - F.col("share_1")))).first()[0]
        found.append((landmarks, round(model.landmark_error, 4), round(error, 4)))
    return local_table(spark, found, "landmarks int, landmark_error double, mean_absolute_error double")
