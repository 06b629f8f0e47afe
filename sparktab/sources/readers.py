"""Reading delimited and JSON tables with inferred types."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import nan_to_null, quoted
from ..session import local_table

# Texts that mean "missing" in a delimited file.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"
DECIMAL_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|Inf|infinity|Infinity)\s*$"
BOOLEAN_PATTERN = r"^(True|TRUE|true|False|FALSE|false)$"


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False
) -> DataFrame:
    """Header CSV with missing-value tokens and types found from all values.

    The file is read as text columns; one aggregate counts which values parse as whole
    numbers, decimals or booleans. An explicit schema skips that pass. ``multi_line``
    admits line breaks inside quotes but makes files unsplittable.
    """
    try:
        raw = spark.read.csv(path, header=True, escape='"', multiLine=multi_line)
    except AnalysisException as error:
        raise FileNotFoundError(f"cannot read {path}: {error}") from error
    texts = raw.select(
        *[F.when(~quoted(c).isin(NA_TOKENS), quoted(c)).alias(c) for c in raw.columns]
    )
    if schema is not None:
        return nan_to_null(
            texts.select(*[quoted(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])
        )
    kinds = infer_types(texts)
    return nan_to_null(
        texts.select(
            *[
                (F.trim(quoted(c)) if kinds[c] != "string" else quoted(c)).cast(kinds[c]).alias(c)
                for c in texts.columns
            ]
        )
    )


def infer_types(texts: DataFrame) -> dict[str, str]:
    """bigint, double, boolean or string per text column, from one aggregate.

    A column without any value is double, like a column of only missing numbers.
    """
    exprs = []
    for i, c in enumerate(texts.columns):
        v = quoted(c)
        exprs += [
            F.count(v).alias(f"n{i}"),
            F.count_if(v.rlike(INTEGER_PATTERN) & F.trim(v).try_cast("bigint").isNotNull()).alias(f"i{i}"),
            F.count_if(v.rlike(DECIMAL_PATTERN) & F.trim(v).try_cast("double").isNotNull()).alias(f"d{i}"),
            F.count_if(v.rlike(BOOLEAN_PATTERN)).alias(f"b{i}"),
        ]
    row = texts.agg(*exprs).first()
    kinds = {}
    for i, c in enumerate(texts.columns):
        n = row[f"n{i}"]
        if n == 0 or row[f"d{i}"] == n:
            kinds[c] = "bigint" if n and row[f"i{i}"] == n else "double"
        else:
            kinds[c] = "boolean" if row[f"b{i}"] == n else "string"
    return kinds


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A JSON array of records, or one record per line (splittable).

    The column-oriented form (one object of columns) is refused: it would read as a
    single row of structs.
    """
    try:
        first = spark.read.text(path).where(F.length(F.trim("value")) > 0).first()
    except AnalysisException as error:
        raise FileNotFoundError(f"cannot read {path}: {error}") from error
    if first is None:
        raise ValueError(f"{path} is empty")
    array = first.value.lstrip("﻿ \t").startswith("[")
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.json(path, multiLine=array)
    if not array and schema is None:
        structs = [f.dataType for f in df.schema if isinstance(f.dataType, T.StructType)]
        by_row = all(name.isdigit() for s in structs for name in s.fieldNames())
        if "_corrupt_record" in df.columns or (structs and len(structs) == len(df.columns) and by_row):
            raise ValueError("only an array of records or one record per line can be read")
    return nan_to_null(df)


def load_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read by extension: .csv, .json, .jsonl, or .parquet (cleaned tables)."""
    lowered = path.lower().rstrip("/")
    if lowered.endswith((".csv", ".csv.gz")):
        return read_csv(spark, path, schema)
    if lowered.endswith((".json", ".jsonl")):
        return read_json(spark, path, schema)
    if lowered.endswith(".parquet"):
        try:
            return nan_to_null(spark.read.parquet(path))
        except AnalysisException as error:
            raise FileNotFoundError(f"cannot read {path}: {error}") from error
    raise ValueError(f"unsupported file type: {path} (csv, json, jsonl and parquet are read)")


def column_table(df: DataFrame) -> DataFrame:
    """``(position, column, dtype)`` of a table."""
    return local_table(
        df.sparkSession,
        [(i, name, dtype) for i, (name, dtype) in enumerate(df.dtypes)],
        "position int, column string, dtype string",
    )
