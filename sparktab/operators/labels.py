"""Label checks, label codes and feature typing."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import (
    is_categorical,
    is_datetime,
    is_numeric,
    nan_to_null,
    quoted,
    require_columns,
)
from ..functions.dictionary import Dictionary
from ..functions.quantiles import exact_quantiles
from ..session import local_table

# Words and patterns that decide results.
IRRELEVANT_WORDS = ["id", "index", "序号", "编号", "行号"]
YEAR_NAME_PATTERN = r"(?i)(\d{4,}|year|年)"
DATE_VALUE_PATTERN = r"^\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}(日)?$|^\d{8}$"
TIME_VALUE_PATTERN = r"^\d{1,2}:\d{1,2}(:\d{1,2})?$"
MAX_CLASSES = 100
UNKNOWN_LABEL = "UNKNOWN"


def problem_types(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """``(label, non_null, distinct_values, problem_type)`` per candidate, in one pass."""
    require_columns(df, labels)
    data = nan_to_null(df.select(*[quoted(c) for c in labels]))
    facts = data.agg(
        *[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(labels)],
        *[F.count_distinct(quoted(c)).alias(f"d{i}") for i, c in enumerate(labels)],
    )

    def kind(i: int, c: str) -> Column:
        n, d = F.col(f"n{i}"), F.col(f"d{i}")
        if is_numeric(df, c):
            many = (d > 10) | ((n < 100) & (F.try_divide(d, n) > 0.5))
            rule = F.when(many, "regression").otherwise("classification")
        else:
            rule = F.lit("classification" if is_categorical(df, c) else "unknown")
        return F.when(n == 0, "unknown").otherwise(rule)

    return facts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("label"),
                        F.col(f"n{i}").alias("non_null"),
                        F.col(f"d{i}").alias("distinct_values"),
                        kind(i, c).alias("problem_type"),
                    )
                    for i, c in enumerate(labels)
                ]
            )
        )
    )


def detect_problem_type(df: DataFrame, label: str) -> str:
    """``classification``, ``regression`` or ``unknown``."""
    return problem_types(df, [label]).first().problem_type


def split_label_kinds(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """``(label, kind)`` by the rule used when splitting: ``class`` or ``continuous``.

    Text is a class; a number is one if under 10 % of the rows are distinct values and
    all are whole. A null counts as a value that is not whole.
    """
    require_columns(df, labels)
    data = nan_to_null(df.select(*[quoted(c) for c in labels]))
    numeric = [c for c in labels if is_numeric(df, c)]
    facts = data.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_distinct(quoted(c)).alias(f"d{i}") for i, c in enumerate(labels) if c in numeric],
        *[
            F.count_if(F.coalesce(quoted(c) % 1 != 0, F.lit(True))).alias(f"w{i}")
            for i, c in enumerate(labels)
            if c in numeric
        ],
    )
    rows = []
    for i, c in enumerate(labels):
        if c in numeric:
            is_class = (F.try_divide(F.col(f"d{i}"), F.col("rows")) < 0.1) & (F.col(f"w{i}") == 0)
            kind = F.when(is_class, "class").otherwise("continuous")
        else:
            kind = F.lit("class")
        rows.append(F.struct(F.lit(c).alias("label"), kind.alias("kind")))
    return facts.select(F.inline(F.array(*rows)))


def split_label_kind(df: DataFrame, label: str) -> str:
    return split_label_kinds(df, [label]).first().kind


def value_distribution(df: DataFrame, label: str) -> DataFrame:
    """``(value, n)`` of the non-null label values."""
    return (
        nan_to_null(df.select(quoted(label).alias("value")))
        .where("value IS NOT NULL")
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def validate_label(df: DataFrame, label: str) -> DataFrame:
    """One row of label facts; raises if the label cannot be modelled.

    A label is refused if it is missing, all null, a one-valued regression target or has
    more than 100 classes.
    """
    require_columns(df, [label])
    facts = problem_types(df, [label]).first()
    total = df.count()
    if facts.non_null == 0:
        raise ValueError("the label column holds only nulls")
    if facts.problem_type == "regression" and facts.distinct_values == 1:
        raise ValueError("a regression label needs more than one value")
    if facts.problem_type == "classification" and facts.distinct_values > MAX_CLASSES:
        raise ValueError(f"{facts.distinct_values} classes are too many; choose another label")
    return local_table(
        df.sparkSession,
        [(
            label, facts.problem_type, dict(df.dtypes)[label], total, facts.non_null,
            total - facts.non_null, facts.distinct_values,
        )],
        "label_column string, problem_type string, label_dtype string, total_samples bigint, "
        "non_null_samples bigint, null_samples bigint, unique_values bigint",
    )


def suggest_features(df: DataFrame, label: str, match: str = "substring") -> list[str]:
    """Columns other than the label whose names do not look like row numbers.

    ``substring`` drops any name containing a listed word (so also ``width``);
    ``token`` drops only whole words between non-letters.
    """
    if match not in ("substring", "token"):
        raise ValueError("match must be 'substring' or 'token'")

    def irrelevant(name: str) -> bool:
        lowered = name.lower()
        if match == "substring":
            return any(word in lowered for word in IRRELEVANT_WORDS)
        tokens = "".join(ch if ch.isalpha() else " " for ch in lowered).split()
        return any(word in tokens for word in IRRELEVANT_WORDS)

    return [c for c in df.columns if c != label and not irrelevant(c)]


def _name_has_year(name: str) -> bool:
    import re

    return re.search(YEAR_NAME_PATTERN, name) is not None


def _date_share(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    return [
        F.avg(
            (quoted(c).rlike(DATE_VALUE_PATTERN) | quoted(c).rlike(TIME_VALUE_PATTERN)).cast("double")
        ).alias(f"share{i}")
        for i, c in enumerate(columns)
    ]


def datetime_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, is_datetime)``: native type, year-like name, or mostly date-like text.

    The share of matching values is taken over every non-null value, not over a sample.
    """
    columns = list(columns or df.columns)
    require_columns(df, columns)
    texts = [c for c in columns if dict(df.dtypes)[c] == "string"]
    facts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(texts)],
        *_date_share(df, texts),
    )
    rows = []
    for c in columns:
        if c in texts:
            i = texts.index(c)
            named = F.lit(_name_has_year(c))
            test = (F.col(f"n{i}") > 0) & (named | F.coalesce(F.col(f"share{i}") > 0.5, F.lit(False)))
        else:
            test = F.lit(is_datetime(df, c))
        rows.append(F.struct(F.lit(c).alias("column"), test.alias("is_datetime")))
    return facts.select(F.inline(F.array(*rows)))


def feature_kinds(df: DataFrame, label: str, match: str = "substring") -> DataFrame:
    """``(column, kind)`` with kind datetime, numeric, text or categorical; one pass."""
    features = suggest_features(df, label, match)
    dates = {r["column"] for r in datetime_columns(df, features).collect() if r["is_datetime"]}
    texts = [c for c in features if c not in dates and is_categorical(df, c)]
    facts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_distinct(quoted(c)).alias(f"d{i}") for i, c in enumerate(texts)],
    )
    rows = []
    for c in features:
        if c in dates:
            kind = F.lit("datetime")
        elif is_numeric(df, c):
            kind = F.lit("numeric")
        elif c in texts:
            limit = F.greatest(F.lit(50.0), F.col("rows") * 0.1)
            kind = F.when(F.col(f"d{texts.index(c)}") > limit, "text").otherwise("categorical")
        else:
            kind = F.lit("text")
        rows.append(F.struct(F.lit(c).alias("column"), kind.alias("kind")))
    return facts.select(F.inline(F.array(*rows)))


def fit_label_codes(df: DataFrame, label: str) -> Dictionary:
    """Sorted classes to 0..k-1 (numeric order for numbers); null text is a class."""
    return Dictionary.fit(_fill_label(df, label), label)


def _fill_label(df: DataFrame, label: str) -> DataFrame:
    if dict(df.dtypes)[label] != "string":
        return df
    return df.withColumn(label, F.coalesce(quoted(label), F.lit(UNKNOWN_LABEL)))


def encode_label(df: DataFrame, label: str, codes: Dictionary, out: str | None = None) -> DataFrame:
    """Replace the label by its code, or write the code to ``out``."""
    filled = _fill_label(df, label)
    if out is None or out == label:
        return codes.encode(filled, "__code").drop(label).withColumnRenamed("__code", label)
    return codes.encode(filled, out)


def decode_label(df: DataFrame, code_column: str, codes: Dictionary, out: str) -> DataFrame:
    """Text labels behind codes; an unknown code is shown as it is."""
    return codes.decode(df, code_column, out)


def label_distribution(df: DataFrame, code_column: str, codes: Dictionary) -> DataFrame:
    """``(name, n)`` per class, the name written ``code(label)``."""
    counts = df.groupBy(quoted(code_column).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    named = codes.decode(counts, "code", "label")
    return named.select(F.format_string("%s(%s)", F.col("code").cast("string"), F.col("label")).alias("name"), "n")


def continuous_label_summary(df: DataFrame, label: str) -> DataFrame:
    """Mean, median, min and max of a continuous label."""
    data = nan_to_null(df.select(quoted(label)))
    row = data.agg(F.avg(quoted(label)).alias("a"), F.min(quoted(label)).alias("b"), F.max(quoted(label)).alias("c")).first()
    median: Any = exact_quantiles(data, {label: [0.5]})[label][0]
    as_float = lambda x: None if x is None else float(x)
    return local_table(
        df.sparkSession,
        [(label, as_float(row.a), median, as_float(row.b), as_float(row.c))],
        "label string, mean double, median double, min double, max double",
    )


def collapse_to_binary(df: DataFrame, code_column: str, out: str) -> DataFrame:
    """Class 0 stays 0, every other class becomes 1."""
    code = quoted(code_column)
    return df.withColumn(out, F.when(code == 0, F.lit(0)).when(code.isNotNull(), F.lit(1)))


def feature_columns(df: DataFrame, wanted: Sequence[str], strict: bool = False) -> list[str]:
    """Known columns in the given order; raises if none is known, or any is unknown when strict."""
    unknown = [c for c in wanted if c not in df.columns]
    if strict and unknown:
        raise ValueError(f"unknown feature columns: {unknown}")
    known = [c for c in wanted if c in df.columns]
    if not known:
        raise ValueError(f"none of {list(wanted)} is a column")
    return known
