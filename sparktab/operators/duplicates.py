"""Removal of repeated rows, whole-row or by a subset of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import data_type, quoted, require_columns
from ..session import cut_lineage

#: Rows of keys up to which a measured side of a join is broadcast.
BROADCAST_ROWS = 500_000


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Keep one of each set of equal rows (nulls equal nulls)."""
    return df.dropDuplicates()


def group_hashes(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Two independent 64-bit hashes that stand for the values of some columns; nulls and maps included."""
    values = []
    for c in columns:
        value = quoted(c)
        values.append(value.isNull())
        values.append(F.array_sort(F.map_entries(value)) if isinstance(data_type(df, c), T.MapType) else value)
    return [F.xxhash64(F.lit(seed), *values) for seed in (1, 2)]


def drop_duplicates_by(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: str | bool = "first",
    order_by: Sequence[str] | str | None = None,
) -> DataFrame:
    """One row per combination of ``subset``.

    ``keep="first"`` or ``"last"`` needs ``order_by`` columns, since a distributed table
    has no row order; equal order keys are settled by the other columns. ``keep=False``
    drops every row of a repeated combination.

    Decisions are made on slim rows: a 128-bit hash of the combination and the order keys, with
    partial aggregation, so a combination holding a third of the rows shrinks to few rows per
    task. The rows that go are then taken out of the table by their hashes and order keys,
    without a shuffle of whole rows if they are few. Only rows that share combination and order
    keys are compared as a whole.
    """
    if subset is None and keep is not False:
        return df.dropDuplicates()
    subset = list(subset or df.columns)
    require_columns(df, subset)
    if isinstance(order_by, str):
        order_by = [order_by]
    k1, k2 = group_hashes(df, subset)
    if keep is False:
        hashed = df.withColumns({"__k1": k1, "__k2": k2})
        counted = hashed.groupBy("__k1", "__k2").agg(F.count(F.lit(1)).alias("__n"))
        repeated = _side(counted.where("__n > 1").select("__k1", "__k2"))
        return hashed.join(repeated, ["__k1", "__k2"], "left_anti").select(*[quoted(c) for c in df.columns])
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first', 'last' or False")
    if not order_by:
        raise ValueError("keep='first' and 'last' need order_by columns")
    require_columns(df, list(order_by))
    rest = [c for c in df.columns if c not in subset]
    if not rest:
        return df.dropDuplicates()

    spots = {f"__o{i}": quoted(c) for i, c in enumerate(order_by)}
    key = ["__k1", "__k2", *spots]
    hashed = df.withColumns({"__k1": k1, "__k2": k2, **spots})
    counted = cut_lineage(hashed.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")))
    order = F.struct(*spots)
    best = counted.groupBy("__k1", "__k2").agg(
        (F.min(order) if keep == "first" else F.max(order)).alias("__best"), F.count(F.lit(1)).alias("__orders")
    )
    # Only combinations with several order keys or with ties lose rows.
    several = best.where("__orders > 1")
    marks = _marks(key)
    losers = counted.join(_side(several), ["__k1", "__k2"]).where(~order.eqNullSafe(F.col("__best"))).select(*marks)
    winners = counted.where("__n > 1").join(best, ["__k1", "__k2"]).where(order.eqNullSafe(F.col("__best")))
    losers, tied = _side(losers), _side(winners.select(*marks))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in key]
    left = hashed.join(losers, same, "left_anti")
    columns = [quoted(c) for c in df.columns]
    alone = left.join(tied, same, "left_anti").select(*columns)
    together = left.join(tied, same, "left_semi").select(*columns)
    return alone.unionByName(_whole_rows(together, subset, rest, keep, order_by))


def _marks(key: Sequence[str]) -> list[Column]:
    return [F.col(k).alias(f"{k}_") for k in key]


def _side(keys: DataFrame) -> DataFrame:
    """Keys written once, marked for broadcast if they are few."""
    written = cut_lineage(keys)
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def _whole_rows(df: DataFrame, subset: Sequence[str], rest: Sequence[str], keep: str, order_by: Sequence[str]) -> DataFrame:
    """The least (or greatest) row of each combination by its order keys and all other columns."""

    def comparable(c: str) -> Column:
        value = quoted(c)
        return F.array_sort(F.map_entries(value)) if isinstance(data_type(df, c), T.MapType) else value

    ranked = F.struct(
        *[comparable(c).alias(f"k{i}") for i, c in enumerate(order_by)],
        *[comparable(c).alias(f"v{i}") for i, c in enumerate(rest)],
    )
    chosen = df.groupBy(*[comparable(c).alias(f"__s{i}") for i, c in enumerate(subset)]).agg(
        (F.min(ranked) if keep == "first" else F.max(ranked)).alias("__row")
    )
    found = {c: F.col(f"__s{i}") for i, c in enumerate(subset)} | {c: F.col(f"__row.v{i}") for i, c in enumerate(rest)}
    maps = {c for c in df.columns if isinstance(data_type(df, c), T.MapType)}
    return chosen.select(*[(F.map_from_entries(found[c]) if c in maps else found[c]).alias(c) for c in df.columns])


def duplicate_report(df: DataFrame, subset: Sequence[str] | None = None, keep: str | bool = "first") -> DataFrame:
    """One row: rows before and after, rows removed, share removed."""
    groups = [quoted(c) for c in (subset or df.columns)]
    counted = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"))
    kept = F.count_if(F.col("__n") == 1) if keep is False else F.count(F.lit(1))
    return counted.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("rows_before"), kept.alias("rows_after")
    ).select(
        "rows_before",
        "rows_after",
        (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
        F.coalesce(
            F.try_divide(F.col("rows_before") - F.col("rows_after"), F.col("rows_before")), F.lit(0.0)
        ).alias("repeat_rate"),
    )
