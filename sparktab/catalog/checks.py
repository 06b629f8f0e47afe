"""Queries on schemas, guards, configured runs, and small models that SQL can repeat."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dictionary import fit_dictionaries
from ..models import registry
from ..operators import encoding, labels, outliers, profile, splitting
from ..operators.scoring import Scorer
from ..plans.runner import from_flat, run_config
from ..session import local_table
from ..sources import readers
from .learning import COUNTS, LINE_COLUMNS, LINE_KEY, VECTOR_COLUMNS, _gaussian_sql, letter_rows, wide_vectors
from .registry import query, rounded, scratch, table

#: Type names of the SQL engine and Spark's for the same columns.
SCHEMA_SQL = """
WITH s AS (SELECT table_name, ordinal_position - 1 AS position, column_name,
  CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string'
    WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' ELSE data_type END AS dtype
  FROM information_schema.columns)
"""


# ---------------------------------------------------------------- schemas and guards


@query(
    "column_list",
    SCHEMA_SQL + """SELECT table_name AS "table", position, column_name AS "column", dtype FROM s
    WHERE table_name IN ('orders', 'lineitem', 'documents')""",
)
def column_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["orders", "lineitem", "documents"]
    found = [readers.column_table(table(spark, sf_dir, n)).withColumn("table", F.lit(n)) for n in names]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    "repeated_column_names",
    SCHEMA_SQL + """SELECT column_name AS "column" FROM s WHERE table_name IN ('documents', 'labels', 'benchmark')
    GROUP BY 1 HAVING count(*) > 1""",
)
def repeated_column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [c for n in ("documents", "labels", "benchmark") for c in table(spark, sf_dir, n).columns]
    return local_table(spark, [(c,) for c in profile.duplicate_column_names(names)], "column string")


@query(
    "validated_columns",
    SCHEMA_SQL + """, w AS (SELECT unnest([' o_orderkey', 'o_custkey ', 'o_nothing', 'o_orderdate']) AS asked)
    SELECT trim(asked) AS "column", column_name IS NOT NULL AS known
    FROM w LEFT JOIN s ON column_name = trim(asked) AND table_name = 'orders'""",
)
def validated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = [" o_orderkey", "o_custkey ", "o_nothing", "o_orderdate"]
    known, unknown = profile.validate_columns(table(spark, sf_dir, "orders"), asked)
    return local_table(spark, [(c, True) for c in known] + [(c, False) for c in unknown], "column string, known boolean")


@query(
    "columns_by_type",
    SCHEMA_SQL + """SELECT column_name AS "column", CASE WHEN dtype = 'string' THEN 'text' ELSE 'numeric' END AS kind
    FROM s WHERE table_name = 'lineitem' AND dtype IN ('bigint', 'int', 'double', 'string')""",
)
def columns_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    numeric, text = profile.split_columns_by_type(table(spark, sf_dir, "lineitem"))
    return local_table(spark, [(c, "numeric") for c in numeric] + [(c, "text") for c in text], "column string, kind string")


@query(
    "feature_column_order",
    SCHEMA_SQL + """, w AS (SELECT unnest(['l_tax', 'l_nothing', 'l_quantity', 'l_discount']) AS asked, unnest(range(4)) AS nth)
    SELECT row_number() OVER (ORDER BY nth) - 1 AS position, asked AS "column"
    FROM w JOIN s ON column_name = asked AND table_name = 'lineitem'""",
)
def feature_column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = ["l_tax", "l_nothing", "l_quantity", "l_discount"]
    found = labels.feature_columns(table(spark, sf_dir, "lineitem"), asked)
    return local_table(spark, list(enumerate(found)), "position bigint, column string")


@query(
    "column_roles",
    SCHEMA_SQL + """SELECT column_name AS "column", CASE WHEN column_name = 'o_orderpriority' THEN 'ordinal'
      WHEN column_name = 'o_orderstatus' THEN 'onehot' WHEN dtype = 'string' THEN 'text' ELSE 'numeric' END AS role
    FROM s WHERE table_name = 'orders' AND column_name <> 'o_orderdate'""",
)
def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    features = [c for c in orders.columns if c != "o_orderdate"]
    roles = encoding.classify_columns(orders, features, ["o_orderstatus", "o_orderpriority"], ["o_orderpriority"])
    rows = [(c, role) for role in ("onehot", "ordinal", "numeric", "text") for c in getattr(roles, role)]
    return local_table(spark, rows, "column string, role string")


@query(
    "outlier_bounds_guarded",
    """
    WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
    SELECT 'value' AS "column", round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper FROM q
    """,
)
def outlier_bounds_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown, text and all-null columns have no bounds."""
    events = table(spark, sf_dir, "events").withColumn("empty", F.lit(None).cast("double"))
    found = outliers.fit_bounds(events, ["value", "event_type", "empty", "nothing"])
    rows = [(c, float(b.lower), float(b.upper)) for c, b in found.items()]
    return rounded(local_table(spark, rows, "column string, lower double, upper double"), 6)


@query(
    "ratio_checks",
    """
    WITH t AS (SELECT l_returnflag AS part, count(*) / (SELECT count(*) FROM lineitem) AS share FROM lineitem GROUP BY 1),
    v AS (SELECT o_orderpriority AS part, count(*) / (SELECT count(*) FROM orders) AS share FROM orders GROUP BY 1)
    SELECT t.part AS test_part, v.part AS val_part, l.name AS limits,
      t.share BETWEEN l.a AND l.b AND v.share BETWEEN l.c AND l.d AND t.share + v.share < 0.9 AS accepted
    FROM t, v, (VALUES ('table', 0.1, 0.3, 0.1, 0.5), ('script', 0.1, 0.3, 0.1, 0.3), ('request', 0.1, 0.5, 0.0, 0.4)) AS l(name, a, b, c, d)
    """,
)
def ratio_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of return flags and order priorities, tried as test and validation ratios."""
    def shares(name: str, column: str) -> list:
        counts = {r[column]: r["count"] for r in table(spark, sf_dir, name).groupBy(column).count().collect()}
        return [(part, n / sum(counts.values())) for part, n in counts.items()]

    rows = []
    for test_part, test in shares("lineitem", "l_returnflag"):
        for val_part, val in shares("orders", "o_orderpriority"):
            for limits in splitting.RATIO_LIMITS:
                try:
                    splitting.check_ratios(test, val, limits)
                    accepted = True
                except ValueError:
                    accepted = False
                rows.append((test_part, val_part, limits, accepted))
    return local_table(spark, rows, "test_part string, val_part string, limits string, accepted boolean")


@query(
    "read_json_array",
    "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice FROM orders",
)
def read_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of JSON arrays, one written by each task, read back."""
    rows = table(spark, sf_dir, "orders").select(F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_totalprice")).alias("value"))
    path = f"{scratch(spark)}/orders.json"
    rows.mapInArrow(_array_lines, "value string").write.text(path)
    return rounded(readers.read_json(spark, path).select("o_orderkey", "o_orderstatus", "o_totalprice"))


def _array_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of one JSON array; a task without rows writes none."""
    opened = False
    for batch in batches:
        rows = batch.column(0).to_pylist()
        if rows:
            first = ("," if opened else "[") + rows[0]
            yield pa.RecordBatch.from_arrays([pa.array([first, *("," + row for row in rows[1:])])], names=["value"])
            opened = True
    if opened:
        yield pa.RecordBatch.from_arrays([pa.array(["]"])], names=["value"])


# ---------------------------------------------------------------- splits and dictionaries


@query(
    "split_on_repeated_key",
    """
    WITH z AS (SELECT count(*) AS n, CAST(ceil(0.2 * count(*)) AS BIGINT) AS t FROM orders),
    v AS (SELECT n, t, CAST(ceil((n - t) * (0.2 / (1 - 0.2))) AS BIGINT) AS v FROM z)
    SELECT 'test' AS split, t AS n FROM v UNION ALL SELECT 'val', v FROM v UNION ALL SELECT 'train', n - t - v FROM v
    """,
)
def split_on_repeated_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three values of the key, a third of all rows each."""
    parts = splitting.split_table(table(spark, sf_dir, "orders"), None, 0.2, 0.2, key=["o_orderstatus"])
    return splitting.split_summary(parts).select("split", "n")


@query(
    "label_codes_mostly_null",
    """
    WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CASE WHEN l_orderkey % 10 = 0 THEN concat('part ', CAST(l_partkey AS VARCHAR)) END AS part FROM lineitem),
    d AS (SELECT part, row_number() OVER (ORDER BY part) - 1 AS code FROM (SELECT DISTINCT part FROM r WHERE part IS NOT NULL))
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, code FROM r LEFT JOIN d USING (part)
    """,
)
def label_codes_mostly_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary's shuffled form on a column of nine nulls in ten."""
    rows = table(spark, sf_dir, "lineitem").select(
        *LINE_KEY, "l_suppkey", F.expr("CASE WHEN l_orderkey % 10 = 0 THEN concat('part ', l_partkey) END").alias("part")
    )
    return fit_dictionaries(rows, ["part"], limit=50)["part"].encode(rows, "code").drop("part")


# ---------------------------------------------------------------- small trees


def _stump_sql(target: str, features: list[str], leaf: str) -> str:
    """The best cut of one feature by the sum of squares, and a result over its two sides."""
    cuts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c} AS cut, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM r GROUP BY 2" for c in features
    )
    side = " ".join(f"WHEN feature = '{c}' THEN {c}" for c in features)
    return f"""
    WITH r AS (SELECT *, CAST({target} AS DOUBLE) AS y FROM lineitem), g AS ({cuts}),
    c AS (SELECT feature, cut, sum(n) OVER w AS n1, sum(s) OVER w AS s1, sum(n) OVER (PARTITION BY feature) AS n,
            sum(s) OVER (PARTITION BY feature) AS s FROM g WINDOW w AS (PARTITION BY feature ORDER BY cut)),
    b AS (SELECT feature, cut FROM c WHERE n1 < n ORDER BY s1 * s1 / n1 + (s - s1) * (s - s1) / (n - n1) DESC LIMIT 1)
    {leaf.format(side=side)}
    """


_FEW_VALUED = ["l_quantity", "l_discount", "l_tax"]


@query(
    "stump_regressor",
    _stump_sql(
        "l_extendedprice", _FEW_VALUED,
        "SELECT round(avg(y), 2) AS prediction, count(*) AS n FROM r, b GROUP BY CASE {side} END <= cut",
    ),
)
def stump_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regression tree of depth 1: its two predictions and their rows."""
    lines = table(spark, sf_dir, "lineitem")
    model = registry.train(lines, "regression", "decision_tree", _FEW_VALUED, "l_extendedprice", {"max_depth": 1})
    scored = model.transform(lines).select(F.round("prediction", 2).alias("prediction"))
    return scored.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stump_importance",
    _stump_sql(
        "l_extendedprice", _FEW_VALUED,
        "SELECT f AS feature, CASE WHEN f = b.feature THEN 1.0 ELSE 0.0 END AS importance "
        "FROM b, (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS f)",
    ),
)
def stump_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    model = registry.train(lines, "regression", "decision_tree", _FEW_VALUED, "l_extendedprice", {"max_depth": 1})
    return registry.importance_table(spark, model)


@query(
    "stump_classifier",
    _stump_sql(
        "CASE WHEN l_quantity * l_extendedprice > 1000000 THEN 1 ELSE 0 END", _FEW_VALUED,
        "SELECT CAST(CASE WHEN avg(y) > 0.5 THEN 1 ELSE 0 END AS DOUBLE) AS prediction, round(avg(y), 4) AS share, "
        "count(*) AS n FROM r, b GROUP BY CASE {side} END <= cut",
    ),
)
def stump_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class tree of depth 1 on two classes, where Gini and squares choose the same cut."""
    lines = table(spark, sf_dir, "lineitem").withColumn("dear", F.expr("CAST(l_quantity * l_extendedprice > 1000000 AS INT)"))
    model = registry.train(lines, "classification", "decision_tree", _FEW_VALUED, "dear", {"max_depth": 1})
    share = F.round(F.get("probability", 1), 4).alias("share")
    return model.transform(lines).select("prediction", share).groupBy("prediction", "share").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- scoring and configured runs


@query("score_given_rows", _gaussian_sql())
def score_given_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines handed over as JSON requests, one per order, as the callers of a service would."""
    lines = table(spark, sf_dir, "lineitem")
    coded = labels.encode_label(lines, "l_returnflag", labels.fit_label_codes(lines, "l_returnflag"))
    model = registry.train(coded, "classification", "Ga_naive_bayes", LINE_COLUMNS, "l_returnflag")
    given = lines.select(*LINE_KEY, "l_suppkey", *LINE_COLUMNS)
    requests = given.groupBy(F.col("l_orderkey").alias("request")).agg(
        F.to_json(F.collect_list(F.struct(*given.columns))).alias("body")
    )
    done = Scorer(model).score_requests(requests, "body", given.schema, keep=["request"])
    return done.select(*LINE_KEY, "l_suppkey", F.col("predict_result").alias("prediction"))


def _sizes_sql(rows: str, test: float, val: float) -> str:
    return f"""
    WITH z AS (SELECT count(*) AS n, CAST(ceil({test} * count(*)) AS BIGINT) AS t FROM ({rows})),
    v AS (SELECT n, t, CAST(ceil((n - t) * ({val} / (1 - {test}))) AS BIGINT) AS v FROM z)
    SELECT 'test' AS split, t AS rows FROM v UNION ALL SELECT 'val', v FROM v UNION ALL SELECT 'train', n - t - v FROM v
    """


def _flat_run(spark: SparkSession, config: dict, data: DataFrame, model_type: str | None = None) -> DataFrame:
    return run_config(spark, from_flat(config, model_type), data).training.metrics.select("split", "rows")


_FLAT = {"TEST_SIZE": 0.15, "VAL_SIZE": 0.15, "USE_STRATIFIED": True, "RANDOM_SEED": 42}


@query("configured_naive_bayes", _sizes_sql("SELECT DISTINCT lang, text, doc_id FROM documents", 0.15, 0.15))
def configured_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys of a naive Bayes configuration; rows of every scored part."""
    config = _FLAT | {
        "IRIS_FEATURE_COLS": COUNTS, "IRIS_LABEL_COL": "lang", "MODEL": "GaussianNB", "ALPHA": 1, "FIT_PRIOR": True,
        "CLASS_PRIOR": None, "BINARIZE": None,
    }
    return _flat_run(spark, config, letter_rows(spark, sf_dir))


@query("configured_forest", _sizes_sql("SELECT doc_id FROM documents", 0.15, 0.15))
def configured_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = _FLAT | {"IRIS_FEATURE_COLS": COUNTS, "IRIS_LABEL_COL": "lang", "N_ESTIMATORS": 100, "MAX_DEPTH": 6}
    return _flat_run(spark, config, letter_rows(spark, sf_dir), "random_forest")


@query(
    "configured_cleaning",
    _sizes_sql(
        """SELECT DISTINCT event_type, user_id, value FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
        FROM (SELECT DISTINCT event_type, user_id, value FROM events)) WHERE value BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1)""",
        0.15, 0.15,
    ),
)
def configured_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean fill, wide outliers dropped, and a subset to deduplicate by without an order."""
    config = _FLAT | {
        "IRIS_FEATURE_COLS": ["value", "user_id"], "IRIS_LABEL_COL": "event_type", "ISNULL_PROCESS": "mean_cols",
        "FILL_PROCESS": "None", "COLUMNS": ["value", "user_id"], "VALID_COLS": ["value"], "THRESHOLD": 3, "METHOD": "iqr",
        "PROCESE_OUTLIERS_METHOD": "del_outlier", "FILL_VALUE": "None", "SUBSET": ["event_type", "user_id", "value"], "KEEP": "first",
    }
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    return _flat_run(spark, config, events, "decision_tree")


@query(
    "configured_clustering",
    """
    SELECT 5 AS clusters, count(*) AS rows FROM embeddings
    """,
)
def configured_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clustering configuration: number of clusters that hold rows, and all rows."""
    vectors = wide_vectors(spark, sf_dir).select(*VECTOR_COLUMNS)
    config = {"IRIS_FEATURE_COLS": vectors.columns, "FINAL_K": 5, "INIT": "k-means++", "N_INIT": 10, "RANDOM_STATE": 42}
    sizes = run_config(spark, from_flat(config), vectors).summary
    return sizes.agg(F.count(F.lit(1)).cast("int").alias("clusters"), F.sum("n").alias("rows"))


