"""Most frequent values and distinct lists, pre-aggregated before any shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from .columns import quoted

SETS_PER_SCAN = 48  # grouping ids hold at most 64 columns


def _value_sets(df: DataFrame, columns: Sequence[str]):
    """Group by each column alone, all columns in one scan."""
    renamed = df.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(columns)])
    keys = [F.col(f"c{i}") for i in range(len(columns))]
    return renamed.groupingSets([[k] for k in keys], *keys), keys


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, Any]:
    """Most frequent non-null value per column, ties to the smallest value.

    Value counts come from grouping sets (partial aggregation runs before the shuffle, so
    a hot value is one row per map task), then the best value per set is kept. Spark's
    ``mode`` would hold all distinct values in one buffer.
    """
    columns = list(dict.fromkeys(columns))
    if not columns:
        return {}
    if len(columns) > SETS_PER_SCAN:
        rest = column_modes(df, columns[SETS_PER_SCAN:])
        return column_modes(df, columns[:SETS_PER_SCAN]) | rest
    sets, keys = _value_sets(df, columns)
    counted = sets.agg(F.grouping_id().alias("set"), F.count(F.lit(1)).alias("n"))
    filled = counted.where(F.coalesce(*[F.when(k.isNotNull(), True) for k in keys], F.lit(False)))
    best = filled.groupBy("set").agg(F.min(F.struct((-F.col("n")).alias("rank"), *keys)).alias("b"))
    modes: dict[str, Any] = dict.fromkeys(columns)
    for row in best.select("b.*").collect():
        for i, c in enumerate(columns):
            if row[f"c{i}"] is not None:
                modes[c] = row[f"c{i}"]
    return modes


def distinct_values(df: DataFrame, column: str, limit: int) -> tuple[list[Any], bool] | None:
    """``(sorted values, has nulls)`` of one column, ``None`` beyond ``limit`` values."""
    rows = df.select(quoted(column).alias("v")).distinct().limit(limit + 2).collect()
    values = [r.v for r in rows if r.v is not None]
    return None if len(values) > limit else (sorted(values), len(values) < len(rows))


def distinct_lists(
    df: DataFrame, columns: Sequence[str], limit: int
) -> dict[str, tuple[list[Any], bool] | None]:
    """:func:`distinct_values` for several columns in one scan.

    The number of gathered rows is bounded by the limit before they are gathered.
    """
    columns = list(dict.fromkeys(columns))
    if len(columns) > SETS_PER_SCAN:
        rest = distinct_lists(df, columns[SETS_PER_SCAN:], limit)
        return distinct_lists(df, columns[:SETS_PER_SCAN], limit) | rest
    if len(columns) < 2:
        return {c: distinct_values(df, c, limit) for c in columns}
    sets, _ = _value_sets(df, columns)
    ceiling = len(columns) * (limit + 1)
    rows = sets.agg(F.grouping_id().alias("set")).limit(ceiling + 1).collect()
    if len(rows) > ceiling:
        return {c: distinct_values(df, c, limit) for c in columns}
    full = (1 << len(columns)) - 1
    found: dict[str, tuple[list[Any], bool] | None] = {}
    for i, c in enumerate(columns):
        own = [r[f"c{i}"] for r in rows if r["set"] == full ^ (1 << (len(columns) - 1 - i))]
        values = [v for v in own if v is not None]
        found[c] = None if len(values) > limit else (sorted(values), len(values) < len(own))
    return found
