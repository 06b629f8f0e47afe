"""Queries on reading, profiling, cleaning and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import cleaning, duplicates, nulls, outliers, profile
from ..sources import readers
from ..sources.workspace import Workspace
from .registry import query, rounded, scratch, table


def documents_with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their labels; most documents have none, so quality is often null."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


def lineitem_with_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with planted nulls in price (1 in 7) and return flag (1 in 5)."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.expr("CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_extendedprice END").alias("l_extendedprice"),
        F.expr("CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_returnflag END").alias("l_returnflag"),
        F.expr("CASE WHEN l_orderkey % 3 < 2 THEN NULL ELSE l_tax END").alias("l_tax"),
    )


HOLES = """
WITH holes AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
         CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
         CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
         CASE WHEN l_orderkey % 3 < 2 THEN NULL ELSE l_tax END AS l_tax
  FROM lineitem)
"""

EVENT_BOUNDS = """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
"""

# ---------------------------------------------------------------- sources


@query(
    "read_csv_inferred",
    """
    SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_name END AS s_name,
           s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS s_acctbal
    FROM supplier
    """,
)
def read_csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.expr("CASE WHEN s_suppkey % 4 = 0 THEN 'N/A' ELSE s_name END").alias("s_name"),
        "s_nationkey",
        F.expr("CASE WHEN s_suppkey % 3 = 0 THEN 'NaN' ELSE CAST(s_acctbal AS STRING) END").alias("s_acctbal"),
    )
    path = f"{scratch(spark)}/supplier.csv"
    texts.write.csv(path, header=True, escape='"')
    return readers.load_table(spark, path).select(
        "s_suppkey", "s_name", F.col("s_nationkey").cast("int").alias("s_nationkey"), "s_acctbal"
    )


@query("read_json_lines", "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
def read_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/customer.json"
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal").write.json(path)
    return readers.load_table(spark, path).select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")


@query("processed_table_by_id", "SELECT event_id, event_type, value FROM events")
def processed_table_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, scratch(spark))
    name = space.write_processed(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "events")
    return space.read_processed("events", name)


# ---------------------------------------------------------------- profiles


@query(
    "table_profile",
    """
    SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(2 AS BIGINT) AS total_columns,
           CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS BIGINT)
             AS duplicate_rows
    FROM documents
    """,
)
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.table_profile(table(spark, sf_dir, "documents").select("text", "lang"))


@query(
    "whole_table_profile",
    """
    SELECT CAST(count(*) AS BIGINT) AS total_rows,
           CAST((SELECT count(*) FROM information_schema.columns WHERE table_name = 'documents') AS BIGINT) AS total_columns,
           CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT doc_id, text, lang, source, n_chars FROM documents)) AS BIGINT)
             AS duplicate_rows
    FROM documents
    """,
)
def whole_table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.table_profile(table(spark, sf_dir, "documents"))


def _numeric_profile_sql(name: str, expr: str, source: str, dtype: str) -> str:
    return f"""
    SELECT '{name}' AS "column", '{dtype}' AS dtype, count({expr}) AS non_null_count,
           count(*) - count({expr}) AS null_count, count(DISTINCT {expr}) AS unique_values,
           CAST(NULL AS DOUBLE) AS unique_ratio, round(avg({expr}), 4) AS mean,
           round(quantile_cont({expr}, 0.5), 6) AS median, round(CAST(min({expr}) AS DOUBLE), 6) AS min,
           round(CAST(max({expr}) AS DOUBLE), 6) AS max,
           (SELECT count(*) FROM {source} s2, (SELECT quantile_cont({expr}, 0.25) q1, quantile_cont({expr}, 0.75) q3 FROM {source}) q
             WHERE {expr} < q1 - 1.5 * (q3 - q1) OR {expr} > q3 + 1.5 * (q3 - q1)) AS outliers_count,
           round(quantile_cont({expr}, 0.25) - 1.5 * (quantile_cont({expr}, 0.75) - quantile_cont({expr}, 0.25)), 6) AS outlier_lower,
           round(quantile_cont({expr}, 0.75) + 1.5 * (quantile_cont({expr}, 0.75) - quantile_cont({expr}, 0.25)), 6) AS outlier_upper
    FROM {source}
    """


def _text_profile_sql(name: str, source: str) -> str:
    return f"""
    SELECT '{name}' AS "column", 'string' AS dtype, count({name}) AS non_null_count,
           count(*) - count({name}) AS null_count, count(DISTINCT {name}) AS unique_values,
           round(count(DISTINCT {name}) / count({name}), 6) AS unique_ratio, NULL AS mean, NULL AS median,
           NULL AS min, NULL AS max, 0 AS outliers_count, NULL AS outlier_lower, NULL AS outlier_upper
    FROM {source}
    """


def _shown(df: DataFrame) -> DataFrame:
    """Six digits, so that quartile bounds never fall on a rounding tie; four for the mean."""
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, 4 if c == "mean" else 6) for c in doubles})


@query(
    "column_profile_numeric",
    " UNION ALL ".join(
        _numeric_profile_sql(c, c, "lineitem", "double")
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
)
def column_profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return _shown(profile.column_profile(table(spark, sf_dir, "lineitem"), columns=columns))


@query(
    "column_profile_mixed",
    _numeric_profile_sql("value", "value", "events", "double")
    + " UNION ALL " + _numeric_profile_sql("user_id", "user_id", "events", "bigint")
    + " UNION ALL " + _text_profile_sql("event_type", "events")
    + " UNION ALL " + _text_profile_sql("props", "events"),
)
def column_profile_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["value", "user_id", "event_type", "props"]
    return _shown(profile.column_profile(table(spark, sf_dir, "events"), columns=columns))


@query("sample_values", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 5")
def sample_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.sample_values(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey")


@query(
    "missing_summary",
    """
    WITH d AS (SELECT documents.*, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
    SELECT * FROM (
      SELECT 'quality' AS "column", count(*) - count(quality) AS null_count FROM d
      UNION ALL SELECT 'toxic', count(*) - count(toxic) FROM d
      UNION ALL SELECT 'lang', count(*) - count(lang) FROM d
      UNION ALL SELECT 'n_chars', count(*) - count(n_chars) FROM d) WHERE null_count > 0
    """,
)
def missing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.missing_summary(documents_with_labels(spark, sf_dir))


@query(
    "profile_before_after",
    EVENT_BOUNDS
    + """, k AS (SELECT value FROM events, b WHERE NOT (value < lo OR value > hi))
    SELECT 'value' AS "column", (SELECT count(value) FROM events) AS non_null_count_before,
           (SELECT count(value) FROM k) AS non_null_count_after,
           (SELECT round(avg(value), 4) FROM events) AS mean_before, (SELECT round(avg(value), 4) FROM k) AS mean_after,
           (SELECT max(value) FROM events) AS max_before, (SELECT max(value) FROM k) AS max_after,
           (SELECT round(quantile_cont(value, 0.5), 4) FROM events) AS median_before,
           (SELECT round(quantile_cont(value, 0.5), 4) FROM k) AS median_after
    """,
)
def profile_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("value")
    kept = outliers.treat_outliers(events, outliers.fit_bounds(events, ["value"]), "del_outlier")
    both = profile.compare_profiles(profile.column_profile(events), profile.column_profile(kept))
    return rounded(
        both.select(
            "column", "non_null_count_before", "non_null_count_after", "mean_before", "mean_after",
            "max_before", "max_after", "median_before", "median_after",
        )
    )


@query(
    "box_plot_summary",
    """
    WITH q AS (SELECT quantile_cont(value, 0.25) q1, quantile_cont(value, 0.5) q2, quantile_cont(value, 0.75) q3 FROM events)
    SELECT 'value' AS "column", round(q1, 4) AS q1, round(q2, 4) AS median, round(q3, 4) AS q3,
           round(least(q1, (SELECT min(value) FROM events WHERE value >= q1 - 3 * (q3 - q1))), 4) AS whisker_low,
           round(greatest(q3, (SELECT max(value) FROM events WHERE value <= q3 + 3 * (q3 - q1))), 4) AS whisker_high,
           (SELECT count(*) FROM events WHERE value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1)) AS fliers
    FROM q
    """,
)
def box_plot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.box_plot_summary(table(spark, sf_dir, "events"), ["value"]))


# ---------------------------------------------------------------- nulls


@query(
    "null_rows_dropped",
    HOLES + "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM holes WHERE l_extendedprice IS NOT NULL",
)
def null_rows_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = nulls.handle_nulls(lineitem_with_holes(spark, sf_dir), ["l_extendedprice"], "missing_all_cols")
    return done.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query(
    "null_columns_dropped",
    HOLES + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag FROM holes",
)
def null_columns_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_tax", "l_extendedprice", "l_returnflag"]
    return nulls.handle_nulls(lineitem_with_holes(spark, sf_dir), columns, "missing_50%_cols")


@query(
    "null_filled_mean",
    HOLES + """SELECT l_orderkey, l_linenumber, l_partkey,
    round(coalesce(l_extendedprice, (SELECT avg(l_extendedprice) FROM holes)), 4) AS l_extendedprice, l_returnflag FROM holes""",
)
def null_filled_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = nulls.handle_nulls(lineitem_with_holes(spark, sf_dir), ["l_extendedprice", "l_returnflag"], "mean_cols")
    return rounded(done.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag"))


@query(
    "null_filled_mode",
    HOLES + """, m AS (SELECT l_returnflag AS flag FROM holes WHERE l_returnflag IS NOT NULL
      GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    t AS (SELECT l_tax AS tax FROM holes WHERE l_tax IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT l_orderkey, l_linenumber, l_partkey, coalesce(l_returnflag, (SELECT flag FROM m)) AS l_returnflag,
           coalesce(l_tax, (SELECT tax FROM t)) AS l_tax FROM holes""",
)
def null_filled_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = nulls.handle_nulls(lineitem_with_holes(spark, sf_dir), ["l_returnflag", "l_tax"], "mode_cols")
    return done.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_tax")


@query(
    "null_filled_median",
    HOLES + """SELECT l_orderkey, l_linenumber, l_partkey,
    round(coalesce(l_extendedprice, (SELECT quantile_cont(l_extendedprice, 0.5) FROM holes)), 4) AS l_extendedprice FROM holes""",
)
def null_filled_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = nulls.handle_nulls(lineitem_with_holes(spark, sf_dir), ["l_extendedprice"], "median_cols")
    return rounded(done.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))


@query(
    "null_filled_constant",
    """
    SELECT doc_id, coalesce(CAST(quality AS DOUBLE), -1.0) AS quality, coalesce(CAST(toxic AS DOUBLE), -1.0) AS toxic
    FROM documents LEFT JOIN labels USING (doc_id)
    """,
)
def null_filled_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = nulls.handle_nulls(documents_with_labels(spark, sf_dir), ["quality", "toxic"], "fill_cols", -1)
    return done.select("doc_id", "quality", "toxic")


@query(
    "null_filled_many_columns",
    HOLES + """SELECT l_orderkey, l_linenumber, l_partkey,
      round(coalesce(l_extendedprice, (SELECT quantile_cont(l_extendedprice, 0.5) FROM holes)), 4) AS l_extendedprice,
      round(coalesce(l_tax, (SELECT quantile_cont(l_tax, 0.5) FROM holes)), 4) AS l_tax, l_returnflag FROM holes""",
)
def null_filled_many_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_extendedprice", "l_tax", "l_returnflag", "l_quantity"]
    done = nulls.handle_nulls(lineitem_with_holes(spark, sf_dir), columns, "median_cols")
    return rounded(done.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_tax", "l_returnflag"))


@query(
    "null_report",
    HOLES + """
    SELECT 'l_extendedprice' AS "column", count(*) - count(l_extendedprice) AS null_before, CAST(0 AS BIGINT) AS null_after,
           count(*) - count(l_extendedprice) AS null_handled, 'mean_cols' AS style, CAST(NULL AS VARCHAR) AS fill_value,
           false AS dropped FROM holes
    UNION ALL SELECT 'l_returnflag', count(*) - count(l_returnflag), count(*) - count(l_returnflag), 0, 'mean_cols', NULL, false FROM holes
    """,
)
def null_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = lineitem_with_holes(spark, sf_dir)
    columns = ["l_extendedprice", "l_returnflag"]
    after = nulls.handle_nulls(before, columns, "mean_cols")
    return nulls.null_report(before, after, columns, "mean_cols")


# ---------------------------------------------------------------- outliers


@query(
    "outlier_bounds_iqr",
    EVENT_BOUNDS + """
    SELECT 'value' AS "column", (SELECT count(*) FROM events, b WHERE value < lo OR value > hi) AS outlier_count,
           round((SELECT count(*) FROM events, b WHERE value < lo OR value > hi) / (SELECT count(*) FROM events), 6) AS outlier_ratio,
           round(lo, 6) AS lower, round(hi, 6) AS upper, 'iqr' AS method, 1.5::DOUBLE AS threshold FROM b
    """,
)
def outlier_bounds_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return rounded(outliers.outlier_info(events, outliers.fit_bounds(events, ["value"], "iqr", 1.5)), 6)


def _std_info_sql(method: str) -> str:
    test = (
        "abs((n_chars - m) / s) > 3" if method == "z_score" else "n_chars < m - 3 * s OR n_chars > m + 3 * s"
    )
    return f"""
    WITH k AS (SELECT avg(n_chars) AS m, stddev_samp(n_chars) AS s FROM documents)
    SELECT 'n_chars' AS "column", (SELECT count(*) FROM documents, k WHERE {test}) AS outlier_count,
           round((SELECT count(*) FROM documents, k WHERE {test}) / (SELECT count(*) FROM documents), 6) AS outlier_ratio,
           round(m - 3 * s, 4) AS lower, round(m + 3 * s, 4) AS upper, '{method}' AS method, 3.0::DOUBLE AS threshold FROM k
    """


@query("outlier_bounds_std", _std_info_sql("std"))
def outlier_bounds_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    info = outliers.outlier_info(docs, outliers.fit_bounds(docs, ["n_chars"], "std", 3))
    return info.withColumns({c: F.round(c, d) for c, d in (("outlier_ratio", 6), ("lower", 4), ("upper", 4))})


@query("outlier_bounds_z_score", _std_info_sql("z_score"))
def outlier_bounds_z_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    info = outliers.outlier_info(docs, outliers.fit_bounds(docs, ["n_chars"], "z_score", 3))
    return info.withColumns({c: F.round(c, d) for c, d in (("outlier_ratio", 6), ("lower", 4), ("upper", 4))})


@query(
    "outlier_flags",
    """
    WITH k AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
    SELECT event_id, value, abs((value - m) / s) > 3 AS value_is_outlier FROM events, k
    """,
)
def outlier_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "value")
    return outliers.flag_outliers(events, outliers.fit_bounds(events, ["value"], "z_score", 3))


@query(
    "outliers_dropped",
    EVENT_BOUNDS + "SELECT event_id, event_type, value FROM events, b WHERE NOT (value < lo OR value > hi)",
)
def outliers_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return outliers.treat_outliers(events, outliers.fit_bounds(events, ["value"]), "del_outlier")


@query("outliers_kept", "SELECT event_id, value FROM events")
def outliers_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "value")
    return outliers.treat_outliers(events, outliers.fit_bounds(events, ["value"]), "save_outlier")


@query(
    "outliers_clipped",
    EVENT_BOUNDS + "SELECT event_id, event_type, round(greatest(least(value, hi), lo), 6) AS value FROM events, b",
)
def outliers_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return rounded(outliers.treat_outliers(events, outliers.fit_bounds(events, ["value"]), "fill_outlier"), 6)


@query(
    "outliers_replaced",
    EVENT_BOUNDS + "SELECT event_id, CASE WHEN value < lo OR value > hi THEN 3.0 ELSE value END AS value FROM events, b",
)
def outliers_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "value")
    return outliers.treat_outliers(events, outliers.fit_bounds(events, ["value"]), "fill_outlier", 3)


@query(
    "outlier_recheck",
    EVENT_BOUNDS + """, k AS (SELECT value FROM events, b WHERE NOT (value < lo OR value > hi)),
    q2 AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM k)
    SELECT 'value' AS "column",
           (SELECT count(*) FROM k WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outlier_count,
           round(q1 - 1.5 * (q3 - q1), 4) AS lower, round(q3 + 1.5 * (q3 - q1), 4) AS upper FROM q2
    """,
)
def outlier_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("value")
    kept = outliers.treat_outliers(events, outliers.fit_bounds(events, ["value"]), "del_outlier")
    return rounded(outliers.recheck_outliers(kept, ["value"]).select("column", "outlier_count", "lower", "upper"))


@query(
    "outlier_report",
    EVENT_BOUNDS + """
    SELECT 'value' AS "column", (SELECT count(*) FROM events, b WHERE value < lo OR value > hi) AS original_count,
           CAST(0 AS BIGINT) AS remaining_count,
           (SELECT count(*) FROM events, b WHERE value < lo OR value > hi) AS handled_count,
           3.0::DOUBLE AS fill_value, 'iqr' AS method, 1.5::DOUBLE AS threshold, 'fill_outlier' AS treatment
    """,
)
def outlier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    bounds = outliers.fit_bounds(events, ["value"])
    after = outliers.treat_outliers(events, bounds, "fill_outlier", 3)
    return outliers.outlier_report(events, after, bounds, "fill_outlier", 3)


@query(
    "clipped_by_event_type",
    EVENT_BOUNDS + """
    SELECT event_type, count(*) AS events, count(*) FILTER (WHERE value < lo OR value > hi) AS outliers,
           round(avg(value), 4) AS mean_raw, round(avg(greatest(least(value, hi), lo)), 4) AS mean_clipped
    FROM events, b GROUP BY event_type
    """,
)
def clipped_by_event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "value")
    bounds = outliers.fit_bounds(events, ["value"])
    flagged = outliers.flag_outliers(events.withColumn("raw", F.col("value")), bounds)
    clipped = outliers.treat_outliers(flagged, bounds, "fill_outlier")
    return clipped.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if("value_is_outlier").alias("outliers"),
        F.round(F.avg("raw"), 4).alias("mean_raw"),
        F.round(F.avg("value"), 4).alias("mean_clipped"),
    )


# ---------------------------------------------------------------- cleaning runs

_COLUMN_RUN = """
WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS value,
                  CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type FROM events),
f AS (SELECT event_id, user_id, event_type, coalesce(value, (SELECT avg(value) FROM e)) AS value FROM e),
q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM f),
g AS (SELECT f.* FROM f, q WHERE NOT (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))),
m AS (SELECT event_type AS t FROM g WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
u AS (SELECT avg(user_id) AS a, stddev_samp(user_id) AS s FROM g),
done AS (SELECT event_id, coalesce(event_type, (SELECT t FROM m)) AS event_type, value,
         greatest(least(CAST(user_id AS DOUBLE), a + 1.5 * s), a - 1.5 * s) AS user_id FROM g, u)
"""


def _column_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, cleaning.CleanResult]:
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id",
        F.expr("CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END").alias("value"),
        F.expr("CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END").alias("event_type"),
    )
    plans = [
        cleaning.ColumnPlan("value", "mean_cols", treatment="del_outlier"),
        cleaning.ColumnPlan("event_type", "mode_cols"),
        cleaning.ColumnPlan("user_id", "median_cols", outlier_method="std", treatment="fill_outlier"),
    ]
    return events, cleaning.clean_columns(events, plans)


@query(
    "clean_columns_run",
    _COLUMN_RUN + "SELECT event_id, event_type, round(value, 4) AS value, round(user_id, 4) AS user_id FROM done",
)
def clean_columns_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, result = _column_run(spark, sf_dir)
    return rounded(result.data.select("event_id", "event_type", "value", "user_id"))


@query(
    "cleaning_summary",
    _COLUMN_RUN + """
    SELECT CAST(3 AS BIGINT) AS total_columns_processed, (SELECT count(*) FROM events) AS rows_before_process,
           (SELECT count(*) FROM done) AS rows_after_process,
           (SELECT count(*) FROM events) - (SELECT count(*) FROM done) AS rows_removed,
           round(((SELECT count(*) FROM events) - (SELECT count(*) FROM done)) / (SELECT count(*) FROM events), 6)
             AS rows_removed_ratio
    """,
)
def cleaning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, result = _column_run(spark, sf_dir)
    return rounded(cleaning.run_summary(before, result.data, ["value", "event_type", "user_id"]), 6)


@query(
    "clean_uniform_run",
    """
    WITH e AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS value,
                      CASE WHEN event_id % 9 = 0 THEN NULL ELSE user_id END AS user_id FROM events),
    f AS (SELECT event_id, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM e)) AS value,
                 coalesce(CAST(user_id AS DOUBLE), (SELECT quantile_cont(user_id, 0.5) FROM e)) AS user_id FROM e),
    q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM f),
    g AS (SELECT f.* FROM f, q WHERE NOT (value < q1 - 0.5 * (q3 - q1) OR value > q3 + 0.5 * (q3 - q1))),
    r AS (SELECT quantile_cont(user_id, 0.25) AS q1, quantile_cont(user_id, 0.75) AS q3 FROM g)
    SELECT event_id, round(value, 4) AS value, round(user_id, 4) AS user_id FROM g, r
    WHERE NOT (user_id < q1 - 0.5 * (q3 - q1) OR user_id > q3 + 0.5 * (q3 - q1))
    """,
)
def clean_uniform_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.expr("CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END").alias("value"),
        F.expr("CASE WHEN event_id % 9 = 0 THEN NULL ELSE user_id END").alias("user_id"),
    )
    result = cleaning.clean_uniform(
        events, ["value", "user_id", "value"], "median_cols", outlier_threshold=0.5, treatment="del_outlier"
    )
    return rounded(result.data)


# ---------------------------------------------------------------- duplicates


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    return duplicates.drop_duplicate_rows(rows)


def _keep_sql(direction: str) -> str:
    return f"""
    SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM (
      SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id {direction}) AS rn FROM documents)
    WHERE rn = 1
    """


@query("dedup_keep_first", _keep_sql("ASC"))
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = duplicates.drop_duplicates_by(docs, ["text", "lang"], "first", "doc_id")
    return kept.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@query("dedup_keep_last", _keep_sql("DESC"))
def dedup_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = duplicates.drop_duplicates_by(docs, ["text", "lang"], "last", "doc_id")
    return kept.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@query(
    "dedup_keep_none",
    """
    SELECT doc_id, lang, n_chars FROM (
      SELECT *, count(*) OVER (PARTITION BY text, lang) AS n FROM documents) WHERE n = 1
    """,
)
def dedup_keep_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return duplicates.drop_duplicates_by(docs, ["text", "lang"], False).select("doc_id", "lang", "n_chars")


@query(
    "duplicate_report",
    """
    WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text, lang)
    SELECT CAST(sum(n) AS BIGINT) AS rows_before, count(*) AS rows_after,
           CAST(sum(n) - count(*) AS BIGINT) AS rows_removed,
           round((sum(n) - count(*)) / sum(n), 6) AS repeat_rate FROM g
    """,
)
def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(duplicates.duplicate_report(table(spark, sf_dir, "documents"), ["text", "lang"]), 6)
