"""Handling of missing values, one style for any number of columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import data_type, is_numeric, nan_to_null, quoted
from ..functions.frequencies import column_modes
from ..functions.quantiles import exact_quantiles
from ..session import local_table

STYLES = (
    "missing_all_cols", "missing_50%_cols", "mean_cols", "mode_cols", "median_cols", "fill_cols",
)


@dataclass(frozen=True)
class NullAction:
    """What to do with one column: ``drop_rows``, ``drop_column``, ``fill`` or ``keep``."""

    kind: str
    value: Any = None


KEEP = NullAction("keep")


def _constant(df: DataFrame, column: str, value: Any) -> NullAction:
    if value is None:
        raise ValueError(f"column {column}: a constant fill needs a value")
    kind = data_type(df, column)
    try:
        if isinstance(kind, T.NumericType):
            return NullAction("fill", float(value))
        if isinstance(kind, T.BooleanType):
            return NullAction("fill", bool(value))
        if isinstance(kind, T.StringType):
            return NullAction("fill", str(value))
    except (TypeError, ValueError):
        raise ValueError(f"fill value {value!r} does not fit column {column} ({kind.simpleString()})") from None
    probe = df.sparkSession.range(1).select(F.lit(str(value)).try_cast(kind).alias("v")).first()
    if probe.v is None:
        raise ValueError(f"fill value {value!r} does not fit column {column} ({kind.simpleString()})")
    return NullAction("fill", probe.v)


def fit_null_actions(
    df: DataFrame,
    columns: Sequence[str],
    style: str,
    fill_value: Any = None,
    unknown_text: str | None = None,
) -> dict[str, NullAction]:
    """Decide per column; unknown columns and columns without nulls are kept as is.

    All columns share the passes. ``fill_value`` may be a mapping by column.
    ``unknown_text`` fills text columns that hold no value
    at all when the style is ``mode_cols``.
    """
    if style not in STYLES:
        raise ValueError(f"unknown null style {style!r}; choose one of {STYLES}")
    present = [c for c in dict.fromkeys(columns) if c in df.columns]
    actions = dict.fromkeys(present, KEEP)
    if not present:
        return actions
    if style == "missing_all_cols":
        return dict.fromkeys(present, NullAction("drop_rows"))
    data = nan_to_null(df.select(*[quoted(c) for c in present]))
    row = data.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(present)],
        *[
            F.avg(quoted(c).cast("double")).alias(f"m{i}")
            for i, c in enumerate(present)
            if style == "mean_cols" and is_numeric(df, c)
        ],
    ).first()
    holes = [c for i, c in enumerate(present) if row[f"n{i}"] < row["rows"]]
    if style == "missing_50%_cols":
        for i, c in enumerate(present):
            if (row["rows"] - row[f"n{i}"]) * 2 > row["rows"]:
                actions[c] = NullAction("drop_column")
    elif style == "mean_cols":
        for i, c in enumerate(present):
            if c in holes and is_numeric(df, c) and row[f"m{i}"] is not None:
                actions[c] = NullAction("fill", row[f"m{i}"])
    elif style == "median_cols":
        numeric = [c for c in holes if is_numeric(df, c)]
        for c, (median,) in exact_quantiles(data, {c: [0.5] for c in numeric}).items():
            if median is not None:
                actions[c] = NullAction("fill", median)
    elif style == "mode_cols":
        for c, mode in column_modes(data, holes).items():
            if mode is not None:
                actions[c] = NullAction("fill", mode)
            elif unknown_text is not None and isinstance(data_type(df, c), T.StringType):
                actions[c] = NullAction("fill", unknown_text)
    else:
        for c in holes:
            value = fill_value.get(c) if isinstance(fill_value, Mapping) else fill_value
            actions[c] = _constant(df, c, value)
    return actions


def apply_null_actions(df: DataFrame, actions: Mapping[str, NullAction]) -> DataFrame:
    """One filter, one projection and one drop for all columns.

    Numeric fills turn the column into double, so that a mean of 1.5 is not cut to 1.
    """
    df = nan_to_null(df, [c for c, a in actions.items() if a.kind != "keep"])
    rows = [c for c, a in actions.items() if a.kind == "drop_rows" and c in df.columns]
    if rows:
        keep = F.lit(True)
        for c in rows:
            keep = keep & quoted(c).isNotNull()
        df = df.where(keep)
    fills = {}
    for c, a in actions.items():
        if a.kind != "fill":
            continue
        if is_numeric(df, c):
            fills[c] = F.coalesce(quoted(c).cast("double"), F.lit(float(a.value)))
        else:
            fills[c] = F.coalesce(quoted(c), F.lit(a.value).cast(data_type(df, c)))
    if fills:
        df = df.withColumns(fills)
    gone = [c for c, a in actions.items() if a.kind == "drop_column"]
    return df.drop(*gone) if gone else df


def handle_nulls(
    df: DataFrame, columns: Sequence[str], style: str, fill_value: Any = None,
    unknown_text: str | None = None,
) -> DataFrame:
    """Fit and apply one style to many columns."""
    return apply_null_actions(df, fit_null_actions(df, columns, style, fill_value, unknown_text))


def null_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Nulls (and NaN) per column in one pass."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return {}
    data = nan_to_null(df.select(*[quoted(c) for c in present]))
    row = data.agg(*[F.count_if(quoted(c).isNull()).alias(f"n{i}") for i, c in enumerate(present)]).first()
    return {c: row[f"n{i}"] for i, c in enumerate(present)}


def null_report(
    before: DataFrame, after: DataFrame, columns: Sequence[str], style: str, fill_value: Any = None
) -> DataFrame:
    """Per column: nulls before, after, handled, style, fill value, dropped or not."""
    had, left = null_counts(before, columns), null_counts(after, columns)
    shown = str(fill_value) if style == "fill_cols" and fill_value is not None else None
    return local_table(
        before.sparkSession,
        [
            (c, had[c], left.get(c, 0), had[c] - left.get(c, 0), style, shown, c not in after.columns)
            for c in columns
            if c in had
        ],
        "column string, null_before bigint, null_after bigint, null_handled bigint, "
        "style string, fill_value string, dropped boolean",
    )
