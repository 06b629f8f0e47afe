"""Queries on labels, encoding, splits and metrics."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import encoding, labels, metrics, splitting
from ..sources.workspace import Workspace
from .registry import query, rounded, scratch, table

# ---------------------------------------------------------------- labels


@query(
    "problem_types",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS label, count({c}) AS non_null, count(DISTINCT {c}) AS distinct_values,
        {rule} AS problem_type FROM lineitem"""
        for c, rule in (
            ("l_returnflag", "'classification'"),
            ("l_linenumber", "CASE WHEN count(DISTINCT l_linenumber) > 10 THEN 'regression' ELSE 'classification' END"),
            ("l_quantity", "CASE WHEN count(DISTINCT l_quantity) > 10 THEN 'regression' ELSE 'classification' END"),
            ("l_shipdate", "'unknown'"),
        )
    ),
)
def problem_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.problem_types(
        table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber", "l_quantity", "l_shipdate"]
    )


def _split_kind_sql(c: str) -> str:
    return f"""SELECT '{c}' AS label, CASE WHEN count(DISTINCT {c}) / count(*) < 0.1
      AND count(*) FILTER (WHERE {c} % 1 <> 0) = 0 THEN 'class' ELSE 'continuous' END AS kind FROM lineitem"""


@query(
    "split_label_kinds",
    "SELECT 'l_returnflag' AS label, 'class' AS kind UNION ALL "
    + " UNION ALL ".join(_split_kind_sql(c) for c in ("l_quantity", "l_extendedprice", "l_linenumber")),
)
def split_label_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.split_label_kinds(
        table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_quantity", "l_extendedprice", "l_linenumber"]
    )


@query(
    "label_facts",
    """
    SELECT 'quality' AS label_column, 'classification' AS problem_type, 'int' AS label_dtype,
           count(*) AS total_samples, count(quality) AS non_null_samples,
           count(*) - count(quality) AS null_samples, count(DISTINCT quality) AS unique_values
    FROM documents LEFT JOIN labels USING (doc_id)
    """,
)
def label_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return labels.validate_label(docs, "quality")


@query(
    "label_value_distribution",
    "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1",
)
def label_value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.value_distribution(table(spark, sf_dir, "events"), "event_type")


@query("suggested_feature_columns", "SELECT p_name, p_brand, p_type, p_size FROM part")
def suggested_feature_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "part_id")
    return part.select(*labels.suggest_features(part, "p_retailprice"))


@query(
    "datetime_columns",
    """
    SELECT 'o_orderdate' AS "column", true AS is_datetime
    UNION ALL SELECT 'day', avg(CASE WHEN regexp_matches(strftime(o_orderdate, '%Y-%m-%d'),
      '^\\d{4}[-/.年]\\d{1,2}[-/.月]\\d{1,2}(日)?$|^\\d{8}$') THEN 1.0 ELSE 0.0 END) > 0.5 FROM orders
    UNION ALL SELECT 'o_orderpriority', avg(CASE WHEN regexp_matches(o_orderpriority, '^\\d{1,2}:\\d{1,2}(:\\d{1,2})?$')
      THEN 1.0 ELSE 0.0 END) > 0.5 FROM orders
    UNION ALL SELECT 'o_totalprice', false
    """,
)
def datetime_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return labels.datetime_columns(orders, ["o_orderdate", "day", "o_orderpriority", "o_totalprice"])


@query(
    "feature_kinds",
    """
    SELECT 'doc' AS "column", CASE WHEN count(DISTINCT doc_id) > greatest(50, count(*) * 0.1) THEN 'numeric' ELSE 'numeric' END AS kind FROM documents
    UNION ALL SELECT 'text', CASE WHEN count(DISTINCT text) > greatest(50, count(*) * 0.1) THEN 'text' ELSE 'categorical' END FROM documents
    UNION ALL SELECT 'source', CASE WHEN count(DISTINCT source) > greatest(50, count(*) * 0.1) THEN 'text' ELSE 'categorical' END FROM documents
    UNION ALL SELECT 'n_chars', 'numeric'
    """,
)
def feature_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "doc")
    return labels.feature_kinds(docs, "lang")


@query(
    "label_codes",
    """
    SELECT o_orderkey, o_orderpriority, (SELECT count(DISTINCT p.o_orderpriority) FROM orders p
      WHERE p.o_orderpriority < orders.o_orderpriority) AS code FROM orders
    """.replace(
        "(SELECT count(DISTINCT p.o_orderpriority) FROM orders p\n      WHERE p.o_orderpriority < orders.o_orderpriority)",
        "CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT)",
    ),
)
def label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return labels.encode_label(orders, "o_orderpriority", labels.fit_label_codes(orders, "o_orderpriority"), "code")


@query(
    "label_codes_numeric_order",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
           CAST(dense_rank() OVER (ORDER BY l_quantity) - 1 AS BIGINT) AS code FROM lineitem
    """,
)
def label_codes_numeric_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return labels.encode_label(lines, "l_quantity", labels.fit_label_codes(lines, "l_quantity"), "code")


@query(
    "label_codes_many_values",
    "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_totalprice) - 1 AS BIGINT) AS code FROM orders",
)
def label_codes_many_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More values than a broadcast dictionary may hold: ranked and joined on the executors."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    codes = labels.Dictionary.fit(orders, "o_totalprice", limit=1000)
    return codes.encode(orders, "code").select("o_orderkey", "code")


@query(
    "label_decoded",
    """
    WITH d AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) AS code
               FROM (SELECT DISTINCT event_type FROM events)),
    p AS (SELECT event_id, CAST(user_id % 7 AS BIGINT) AS code FROM events)
    SELECT event_id, p.code, coalesce(event_type, CAST(p.code AS VARCHAR)) AS decoded FROM p LEFT JOIN d USING (code)
    """,
)
def label_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    codes = labels.fit_label_codes(events, "event_type")
    guessed = events.select("event_id", (F.col("user_id") % 7).alias("code"))
    return labels.decode_label(guessed, "code", codes, "decoded")


@query(
    "label_distribution",
    """
    SELECT CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS VARCHAR) || '(' || event_type || ')' AS name, n
    FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
    """,
)
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type")
    codes = labels.fit_label_codes(events, "event_type")
    return labels.label_distribution(labels.encode_label(events, "event_type", codes), "event_type", codes)


@query(
    "continuous_label_summary",
    """
    SELECT 'l_extendedprice' AS label, round(avg(l_extendedprice), 4) AS mean,
           round(quantile_cont(l_extendedprice, 0.5), 4) AS median, min(l_extendedprice) AS min,
           max(l_extendedprice) AS max FROM lineitem
    """,
)
def continuous_label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(labels.continuous_label_summary(table(spark, sf_dir, "lineitem"), "l_extendedprice"))


@query(
    "binary_label",
    "SELECT event_id, CAST(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 0 ELSE 1 END AS INTEGER) AS binary_label FROM events",
)
def binary_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    codes = labels.fit_label_codes(events, "event_type")
    coded = labels.encode_label(events, "event_type", codes, "code")
    return labels.collapse_to_binary(coded, "code", "binary_label").select("event_id", "binary_label")


# ---------------------------------------------------------------- encoding

_SEGMENTS = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "onehot_columns",
    "SELECT c_custkey, "
    + ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1.0 ELSE 0.0 END::DOUBLE AS \"onehot__c_mktsegment_{s}\"" for s in _SEGMENTS)
    + " FROM customer",
)
def onehot_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return encoding.FeatureTransformer.fit(customer, ["c_mktsegment"], onehot=["c_mktsegment"]).transform(customer)


@query(
    "onehot_null_category",
    """
    SELECT doc_id, CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS onehot__quality_1,
           CASE WHEN quality IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS onehot__quality_nan
    FROM documents LEFT JOIN labels USING (doc_id)
    """,
)
def onehot_null_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = (
        table(spark, sf_dir, "documents").select("doc_id")
        .join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    )
    return encoding.FeatureTransformer.fit(docs, ["quality"], onehot=["quality"]).transform(docs)


@query(
    "ordinal_columns",
    """
    SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand) - 1)::DOUBLE AS ordinal__p_brand,
           (dense_rank() OVER (ORDER BY p_type) - 1)::DOUBLE AS ordinal__p_type FROM part
    """,
)
def ordinal_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    columns = ["p_brand", "p_type"]
    return encoding.FeatureTransformer.fit(part, columns, ordinal=columns).transform(part)


@query(
    "ordinal_unseen_category",
    """
    WITH known AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code
                   FROM (SELECT DISTINCT event_type FROM events WHERE event_type <> 'purchase'))
    SELECT event_id, coalesce(code, -1)::DOUBLE AS ordinal__event_type FROM events LEFT JOIN known USING (event_type)
    """,
)
def ordinal_unseen_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    fitted = encoding.FeatureTransformer.fit(
        events.where("event_type <> 'purchase'"), ["event_type"], ordinal=["event_type"]
    )
    return fitted.transform(events)


_LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "standardised_columns",
    "SELECT l_orderkey, l_linenumber, l_partkey, "
    + ", ".join(
        f"round((l.{c} - s.m_{c}) / s.s_{c}, 5) AS \"numeric__{c}\"" for c in _LINE_NUMBERS
    )
    + " FROM lineitem l, (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _LINE_NUMBERS)
    + " FROM lineitem) s",
)
def standardised_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *_LINE_NUMBERS)
    return rounded(encoding.FeatureTransformer.fit(lines, _LINE_NUMBERS, standardise=True).transform(lines), 5)


@query(
    "passthrough_columns",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS numeric_passthrough__l_quantity,
           l_tax AS numeric_passthrough__l_tax FROM lineitem
    """,
)
def passthrough_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax")
    return encoding.FeatureTransformer.fit(lines, ["l_quantity", "l_tax"]).transform(lines)


@query(
    "encoded_table",
    """
    WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM orders)
    SELECT o_orderkey, o_custkey,
           CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS onehot__o_orderstatus_O,
           CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END::DOUBLE AS onehot__o_orderstatus_P,
           (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::DOUBLE AS ordinal__o_orderpriority,
           round((o_totalprice - m) / d, 5) AS numeric__o_totalprice
    FROM orders, s
    """,
)
def encoded_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").drop("o_orderdate")
    fitted = encoding.FeatureTransformer.fit(
        orders, ["o_orderstatus", "o_orderpriority", "o_totalprice"],
        onehot=["o_orderstatus"], ordinal=["o_orderpriority"], standardise=True,
    )
    return rounded(fitted.transform(orders), 5)


@query(
    "encoding_map",
    """
    SELECT 'o_orderstatus' AS "column", s AS category, 'onehot__o_orderstatus_' || s AS target
    FROM (SELECT DISTINCT o_orderstatus AS s FROM orders) WHERE s <> (SELECT min(o_orderstatus) FROM orders)
    UNION ALL SELECT 'o_orderpriority', p, CAST(row_number() OVER (ORDER BY p) - 1 AS VARCHAR)
    FROM (SELECT DISTINCT o_orderpriority AS p FROM orders)
    UNION ALL SELECT 'o_orderpriority', 'UNKNOWN', '-1'
    UNION ALL SELECT 'o_totalprice', NULL, 'passthrough'
    """,
)
def encoding_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = encoding.FeatureTransformer.fit(
        table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority", "o_totalprice"],
        onehot=["o_orderstatus"], ordinal=["o_orderpriority"],
    )
    return fitted.encoding_map(spark)


_CUT = "CAST('0x' || substr(md5('42|' || CAST(o_orderkey AS VARCHAR)), 1, 15) AS BIGINT)"

RANDOM_SPLIT_SQL = f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY {_CUT}) AS rn, count(*) OVER () AS n FROM orders),
s AS (SELECT *, CAST(ceil(0.2 * n) AS BIGINT) AS t FROM r),
split AS (SELECT *, CASE WHEN rn <= t THEN 'test'
                 WHEN rn <= t + CAST(ceil((n - t) * (0.2 / (1 - 0.2))) AS BIGINT) THEN 'val' ELSE 'train' END AS split
          FROM s)
"""


def _quota_sql(label: str) -> str:
    """Largest-remainder sizes per class, test first, validation from the rest."""
    return f"""
WITH c AS (SELECT {label} AS g, count(*) AS n FROM orders GROUP BY 1),
z AS (SELECT CAST(sum(n) AS BIGINT) AS tot, CAST(ceil(0.2 * sum(n)) AS BIGINT) AS test FROM c),
z2 AS (SELECT *, CAST(ceil((tot - test) * (0.2 / (1 - 0.2))) AS BIGINT) AS val FROM z),
k0 AS (SELECT g, n, (n * (tot - test)) // tot AS low, (n * (tot - test)) % tot AS rest, tot, test, val FROM c, z2),
k1 AS (SELECT *, row_number() OVER (ORDER BY rest DESC, g) AS spot,
              (tot - test) - CAST(sum(low) OVER () AS BIGINT) AS extra FROM k0),
kept AS (SELECT g, n, tot, test, val, low + CASE WHEN spot <= extra THEN 1 ELSE 0 END AS kept FROM k1),
t0 AS (SELECT g, n, kept, (kept * (tot - test - val)) // (tot - test) AS low, (kept * (tot - test - val)) % (tot - test) AS rest,
              tot - test - val AS total FROM kept),
t1 AS (SELECT *, row_number() OVER (ORDER BY rest DESC, g) AS spot, total - CAST(sum(low) OVER () AS BIGINT) AS extra FROM t0),
quota AS (SELECT g, n - kept AS test_n, kept - (low + CASE WHEN spot <= extra THEN 1 ELSE 0 END) AS val_n FROM t1),
r AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {_CUT}) AS rn FROM orders),
split AS (SELECT r.*, CASE WHEN rn <= test_n THEN 'test' WHEN rn <= test_n + val_n THEN 'val' ELSE 'train' END AS split
          FROM r JOIN quota ON r.{label} = quota.g)
"""


def _random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_table(
        table(spark, sf_dir, "orders"), stratified=False, key=["o_orderkey"], dedup=False, portable_keys=True
    )


def _stratified_split(spark: SparkSession, sf_dir: str, label: str = "o_orderpriority") -> DataFrame:
    return splitting.split_table(
        table(spark, sf_dir, "orders"), label, key=["o_orderkey"], dedup=False, portable_keys=True
    )


@query(
    "fitted_on_train_only",
    RANDOM_SPLIT_SQL + """, s2 AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM split WHERE split = 'train')
    SELECT o_orderkey, split, round((o_totalprice - m) / d, 5) AS numeric__o_totalprice FROM split, s2
    """,
)
def fitted_on_train_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _random_split(spark, sf_dir).select("o_orderkey", "split", "o_totalprice")
    fitted = encoding.FeatureTransformer.fit(parts.where("split = 'train'"), ["o_totalprice"], standardise=True)
    return rounded(fitted.transform(parts), 5)


@query(
    "feature_vectors",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, 4 AS dims, round(l_quantity + l_extendedprice + l_discount + l_tax, 4) AS total
    FROM lineitem
    """,
)
def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = encoding.assemble(table(spark, sf_dir, "lineitem"), _LINE_NUMBERS)
    values = vector_to_array("features")
    return vectors.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.size(values).alias("dims"),
        F.round(F.aggregate(values, F.lit(0.0), lambda a, b: a + b), 4).alias("total"),
    )


@query("principal_components")
def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    wide = vectors.select(
        "vec_id", "label", *[F.get("embedding", i).cast("double").alias(f"e{i}") for i in range(64)]
    )
    fitted = encoding.fit_pca(wide, [f"e{i}" for i in range(64)], 3)
    parts = vector_to_array("pca")
    return rounded(
        fitted.transform(wide).select("vec_id", "label", *[parts[i].alias(f"pc{i + 1}") for i in range(3)]), 6
    )


# ---------------------------------------------------------------- splits


@query("random_split", RANDOM_SPLIT_SQL + "SELECT o_orderkey, split FROM split")
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _random_split(spark, sf_dir).select("o_orderkey", "split")


@query("stratified_split", _quota_sql("o_orderpriority") + "SELECT o_orderkey, o_orderpriority, split FROM split")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stratified_split(spark, sf_dir).select("o_orderkey", "o_orderpriority", "split")


@query(
    "stratify_check",
    """
    SELECT count(*) AS classes, min(n) AS smallest_class, count(*) > 1 AND min(n) >= 5 AS eligible
    FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
    """,
)
def stratify_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.stratify_check(table(spark, sf_dir, "embeddings"), "label")


@query(
    "split_after_dedup",
    """
    WITH d AS (SELECT DISTINCT text, lang FROM documents),
    z AS (SELECT count(*) AS n, CAST(ceil(0.2 * count(*)) AS BIGINT) AS t FROM d),
    v AS (SELECT n, t, CAST(ceil((n - t) * (0.1 / (1 - 0.2))) AS BIGINT) AS v FROM z)
    SELECT 'test' AS split, t AS n FROM v UNION ALL SELECT 'val', v FROM v UNION ALL SELECT 'train', n - t - v FROM v
    """,
)
def split_after_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text", "lang")
    return splitting.split_summary(splitting.split_table(docs, stratified=False, val_size=0.1)).select("split", "n")


@query(
    "whole_split_after_dedup",
    """
    WITH d AS (SELECT DISTINCT doc_id, text, lang, source, n_chars FROM documents),
    z AS (SELECT count(*) AS n, CAST(ceil(0.2 * count(*)) AS BIGINT) AS t FROM d),
    v AS (SELECT n, t, CAST(ceil((n - t) * (0.1 / (1 - 0.2))) AS BIGINT) AS v FROM z)
    SELECT 'test' AS split, t AS n FROM v UNION ALL SELECT 'val', v FROM v UNION ALL SELECT 'train', n - t - v FROM v
    """,
)
def whole_split_after_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return splitting.split_summary(splitting.split_table(docs, stratified=False, val_size=0.1)).select("split", "n")


@query(
    "repaired_split",
    """
    WITH p AS (SELECT count(*) AS n FROM orders), a AS (SELECT n, CAST(ceil(n * 0.1) AS BIGINT) AS t FROM p),
    b AS (SELECT n, t, CAST(ceil((n - t) * 0.2) AS BIGINT) AS v FROM a)
    SELECT 'test' AS split, t AS n FROM b UNION ALL SELECT 'val', v FROM b UNION ALL SELECT 'train', n - t - v FROM b
    """,
)
def repaired_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    lopsided = orders.withColumn("split", F.when(F.col("o_orderkey") % 3 == 0, "val").otherwise("train"))
    fixed = splitting.repair_splits(lopsided, "o_orderpriority", key=["o_orderkey"])
    return splitting.split_summary(fixed).select("split", "n")


@query(
    "split_summary",
    _quota_sql("o_orderpriority")
    + """SELECT split, o_orderpriority AS label, count(*) AS n,
         round(count(*) / (SELECT count(*) FROM orders), 6) AS ratio FROM split GROUP BY 1, 2""",
)
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(splitting.split_summary(_stratified_split(spark, sf_dir), "o_orderpriority"), 6)


@query(
    "splits_written_and_read",
    _quota_sql("o_orderstatus") + "SELECT o_orderkey, o_orderstatus FROM split WHERE split = 'train'",
)
def splits_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, scratch(spark))
    parts = _stratified_split(spark, sf_dir, "o_orderstatus").select("o_orderkey", "o_orderstatus", "split")
    return space.read_splits(space.write_splits(parts, "orders"), "train").drop("split")


# ---------------------------------------------------------------- metrics

_GUESS = """CASE WHEN l_quantity > 34 AND l_discount > 0.05 THEN 'R' WHEN l_quantity > 20 THEN 'N'
  WHEN l_tax > 0.07 THEN 'X' ELSE 'A' END"""
_PAIRS_SQL = f"WITH p AS (SELECT l_returnflag AS label, {_GUESS} AS prediction, l_linestatus AS part FROM lineitem)\n"


def _guessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("label"),
        F.expr(_GUESS).alias("prediction"), F.col("l_linestatus").alias("part"),
    )


@query(
    "confusion_matrix",
    _PAIRS_SQL + """, k AS (SELECT label AS c FROM p UNION SELECT prediction FROM p)
    SELECT a.c AS label, b.c AS prediction, count(p.label) AS n FROM k a CROSS JOIN k b
    LEFT JOIN p ON p.label = a.c AND p.prediction = b.c GROUP BY 1, 2
    """,
)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_matrix(_guessed(spark, sf_dir), "label", "prediction")


@query(
    "accuracy",
    _PAIRS_SQL + "SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM p",
)
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy(_guessed(spark, sf_dir), "label", "prediction")


def _per_class_sql(part: str) -> str:
    return _PAIRS_SQL + f""", k AS (SELECT DISTINCT {part} AS part, label AS c FROM p UNION SELECT DISTINCT {part}, prediction FROM p),
    s AS (SELECT k.part, k.c, count(*) FILTER (WHERE label = c AND prediction = c) AS hits,
      count(*) FILTER (WHERE label = c) AS support, count(*) FILTER (WHERE prediction = c) AS predicted
      FROM k JOIN p ON {part.replace("part", "p.part")} = k.part GROUP BY 1, 2),
    m AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS pr,
      CASE WHEN support = 0 THEN 0 ELSE hits / support END AS re, 2 * hits / (predicted + support) AS f FROM s)
    """


_WEIGHTED = """round(sum(hits) / sum(support), 4) AS accuracy, round(sum(pr * support) / sum(support), 4) AS "precision",
      round(sum(re * support) / sum(support), 4) AS recall, round(sum(f * support) / sum(support), 4) AS f1,
      CAST(sum(support) AS BIGINT) AS rows"""


@query("weighted_metrics", _per_class_sql("'all'") + f"SELECT {_WEIGHTED} FROM m")
def weighted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.classification_metrics(_guessed(spark, sf_dir), "label", "prediction")


@query("metrics_per_split", _per_class_sql("part") + f"SELECT part, {_WEIGHTED} FROM m GROUP BY part")
def metrics_per_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metric_bundle(_guessed(spark, sf_dir), "label", "prediction", "classification", "part")


@query(
    "classification_report",
    _per_class_sql("'all'")
    + """SELECT c AS class, round(pr, 4) AS "precision", round(re, 4) AS recall, round(f, 4) AS f1, support FROM m
    UNION ALL SELECT 'macro avg', round(avg(pr), 4), round(avg(re), 4), round(avg(f), 4), CAST(sum(support) AS BIGINT) FROM m
    UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 4), round(sum(re * support) / sum(support), 4),
      round(sum(f * support) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM m""",
)
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.classification_report(_guessed(spark, sf_dir), "label", "prediction")


_PRICE_GUESS = "l_quantity * 1500 + 100"


def _regression_sql(group: str, shown: str) -> str:
    return f"""
    WITH p AS (SELECT l_linestatus AS part, l_extendedprice AS y, {_PRICE_GUESS} AS yhat FROM lineitem),
    a AS (SELECT {group} AS part, avg(abs(y - yhat)) AS mae, avg((y - yhat) * (y - yhat)) AS mse, var_pop(y) AS v, count(*) AS n FROM p GROUP BY 1)
    SELECT {shown} round(mae, 4) AS mae, round(mse, 4) AS mse, round(sqrt(round(mse, 4)), 4) AS rmse,
           round(1 - mse / v, 4) AS r2, n AS rows FROM a
    """


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", "l_extendedprice", F.expr(_PRICE_GUESS).alias("guess")
    )


@query("regression_metrics", _regression_sql("'all'", ""))
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.regression_metrics(_priced(spark, sf_dir), "l_extendedprice", "guess")


@query("regression_metrics_per_split", _regression_sql("part", "part,"))
def regression_metrics_per_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = _priced(spark, sf_dir).withColumnRenamed("l_linestatus", "part")
    return metrics.metric_bundle(priced, "l_extendedprice", "guess", "regression", "part")


@query(
    "undefined_ratios_are_zero",
    """
    SELECT 'de' AS lang, 0.0::DOUBLE AS accuracy, 0.0::DOUBLE AS "precision", 0.0::DOUBLE AS recall, 0.0::DOUBLE AS f1,
           count(*) AS rows FROM documents WHERE lang = 'de'
    UNION ALL SELECT lang, 0.0, 0.0, 0.0, 0.0, count(*) FROM documents WHERE lang <> 'de' GROUP BY lang
    """,
)
def undefined_ratios_are_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "source", F.lit("never seen").alias("prediction"))
    return metrics.classification_metrics(docs, "source", "prediction", by="lang")


_SCORED_SQL = """
WITH e AS (SELECT value AS score, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y FROM events),
g AS (SELECT score AS threshold, CAST(sum(y) AS BIGINT) AS p, CAST(count(*) - sum(y) AS BIGINT) AS q FROM e GROUP BY 1),
c AS (SELECT *, sum(p) OVER (ORDER BY threshold DESC) AS tp, sum(q) OVER (ORDER BY threshold DESC) AS fp,
             sum(p) OVER () AS ap, sum(q) OVER () AS aq FROM g)
"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("value").alias("score"), (F.col("event_type") == "error").cast("int").alias("y")
    )


@query("roc_curve", _SCORED_SQL + "SELECT threshold, round(fp / aq, 6) AS fpr, round(tp / ap, 6) AS tpr FROM c")
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.roc_curve(_scored(spark, sf_dir), "y", "score"), 6)


@query("roc_auc", _SCORED_SQL + "SELECT round(sum(q * (tp - p + p / 2)) / (max(ap) * max(aq)), 6) AS auc FROM c")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.roc_auc(_scored(spark, sf_dir), "y", "score"), 6)


@query(
    "precision_recall_curve",
    _SCORED_SQL + 'SELECT threshold, round(tp / (tp + fp), 6) AS "precision", round(tp / ap, 6) AS recall FROM c',
)
def precision_recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.precision_recall_curve(_scored(spark, sf_dir), "y", "score"), 6)


@query("average_precision", _SCORED_SQL + "SELECT round(sum(p * tp / (tp + fp)) / max(ap), 6) AS average_precision FROM c")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.average_precision(_scored(spark, sf_dir), "y", "score"), 6)


@query(
    "actual_vs_predicted",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS label, {_PRICE_GUESS} AS prediction,
        round(l_extendedprice - ({_PRICE_GUESS}), 4) AS residual FROM lineitem""",
)
def actual_vs_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["l_orderkey", "l_linenumber", "l_partkey"]
    return rounded(metrics.actual_vs_predicted(_priced(spark, sf_dir), key, "l_extendedprice", "guess"))
