"""Column-type rules and small column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def quoted(name: str) -> Column:
    """Column by exact name, also for names such as ``A/DA`` or ``Max.IP``."""
    return F.col("`" + name.replace("`", "``") + "`")


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), T.NumericType)


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), (T.FloatType, T.DoubleType))


def is_categorical(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), (T.StringType, T.BooleanType))


def is_datetime(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), (T.TimestampType, T.TimestampNTZType, T.DateType))


def numeric_columns(df: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    return [c for c in (columns or df.columns) if is_numeric(df, c)]


def nan_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Turn NaN into NULL, so that counts, means and quantiles skip it."""
    targets = [c for c in (columns or df.columns) if c in df.columns and is_floating(df, c)]
    if not targets:
        return df
    return df.withColumns({c: F.when(~F.isnan(quoted(c)), quoted(c)) for c in targets})


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {missing}; the table has {df.columns}")
