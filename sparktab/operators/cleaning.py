"""Cleaning runs composed from null and outlier handling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import is_numeric, quoted, require_columns
from ..session import cut_lineage
from .nulls import NullAction, apply_null_actions, fit_null_actions
from .outliers import Bounds, fit_bounds, treat_outliers


#: Columns after which a sequential run writes the numbers of the rows that are left.
COLUMNS_PER_CUT = 4
KEEP_NULLS = "keep"  # a null style for columns whose nulls are left alone


@dataclass(frozen=True)
class ColumnPlan:
    """Settings of one column; ``None`` falls back to the run-wide setting."""

    column: str
    null_style: str | None = "mean_cols"
    null_fill: Any = None
    outlier_method: str | None = "iqr"
    outlier_threshold: float | None = 1.5
    treatment: str | None = "save_outlier"
    outlier_fill: float | None = None

    def with_defaults(self, null_style, method, threshold, treatment) -> ColumnPlan:
        return ColumnPlan(
            self.column.strip(),
            self.null_style or null_style,
            self.null_fill,
            self.outlier_method or method,
            threshold if self.outlier_threshold is None else self.outlier_threshold,
            self.treatment or treatment,
            self.outlier_fill,
        )

    @property
    def drops_rows(self) -> bool:
        return self.null_style == "missing_all_cols" or self.treatment == "del_outlier"


@dataclass
class CleanResult:
    """The cleaned table (lazy) and what was fitted on the way."""

    data: DataFrame
    null_actions: dict[str, NullAction] = field(default_factory=dict)
    bounds: dict[str, Bounds] = field(default_factory=dict)


def _batches(plans: Sequence[ColumnPlan]) -> Iterator[list[ColumnPlan]]:
    """Columns that can be fitted together: a row-dropping column ends a batch."""
    batch: list[ColumnPlan] = []
    for plan in plans:
        if any(p.column == plan.column for p in batch):
            yield batch
            batch = []
        batch.append(plan)
        if plan.drops_rows:
            yield batch
            batch = []
    if batch:
        yield batch


def clean_columns(
    df: DataFrame,
    plans: Sequence[ColumnPlan],
    global_null_style: str = "missing_all_cols",
    global_method: str = "iqr",
    global_threshold: float = 1.5,
    global_treatment: str = "save_outlier",
    sequential: bool = True,
) -> CleanResult:
    """Own null and outlier settings per column, handled in order, null before outlier.

    Rows dropped for one column are gone when the next column is fitted. Columns between
    two droppings are fitted in shared passes. ``sequential=False`` fits every column on
    the incoming table at once, which saves passes when exact ordering does not matter.
    """
    plans = [
        p.with_defaults(global_null_style, global_method, global_threshold, global_treatment)
        for p in plans
    ]
    require_columns(df, [p.column for p in plans])
    for p in plans:
        if not is_numeric(df, p.column) and p.treatment != "save_outlier":
            raise ValueError(f"column {p.column} is not numeric and accepts save_outlier only")
    result = CleanResult(df)
    for batch in _batches(plans) if sequential else [plans]:
        _clean_batch(result, batch)
    return result


def _clean_batch(result: CleanResult, batch: Sequence[ColumnPlan]) -> None:
    batch = [p for p in batch if p.column in result.data.columns]
    actions: dict[str, NullAction] = {}
    for style in dict.fromkeys(p.null_style for p in batch if p.null_style != KEEP_NULLS):
        same = [p for p in batch if p.null_style == style]
        actions |= fit_null_actions(
            result.data, [p.column for p in same], style, {p.column: p.null_fill for p in same}
        )
    result.data = apply_null_actions(result.data, actions)
    result.null_actions |= actions
    treated = [p for p in batch if p.treatment != "save_outlier" and p.column in result.data.columns]
    fitted: dict[str, Bounds] = {}
    for method, threshold in dict.fromkeys((p.outlier_method, p.outlier_threshold) for p in treated):
        same = [p.column for p in treated if (p.outlier_method, p.outlier_threshold) == (method, threshold)]
        fitted |= fit_bounds(result.data, same, method, threshold)
    for p in treated:
        if p.column in fitted:
            result.data = treat_outliers(
                result.data, {p.column: fitted[p.column]}, p.treatment, p.outlier_fill
            )
    result.bounds |= fitted


def clean_uniform(
    df: DataFrame,
    columns: Sequence[str],
    null_style: str = "mean_cols",
    null_fill: Any = 3,
    outlier_method: str = "iqr",
    outlier_threshold: float = 1.5,
    treatment: str = "save_outlier",
    outlier_fill: float | None = 3,
    sequential: bool = True,
) -> CleanResult:
    """One setting for many columns: all nulls first, then outliers column by column.

    Bounds are fitted on the numeric columns alone, which are written once, and again every few
    columns with the rows that are left; the whole table only gets the filters that come out.
    So the work is linear in the columns, whatever they drop.
    """
    columns = list(dict.fromkeys(c.strip() for c in columns))
    require_columns(df, columns)
    actions = fit_null_actions(df, columns, null_style, null_fill)
    result = CleanResult(apply_null_actions(df, actions), actions)
    if treatment == "save_outlier":
        fit_bounds(result.data, [], outlier_method, outlier_threshold)
        return result
    left = [c for c in columns if c in result.data.columns and is_numeric(result.data, c)]
    rounds = [[c] for c in left] if treatment == "del_outlier" and sequential else [left]
    slim = cut_lineage(result.data.select(*[quoted(c) for c in left])) if len(rounds) > 1 else result.data
    for n, group in enumerate(rounds):
        if n and n % COLUMNS_PER_CUT == 0:
            slim = cut_lineage(slim)
        fitted = fit_bounds(slim, group, outlier_method, outlier_threshold)
        if len(rounds) > 1:
            slim = treat_outliers(slim, fitted, treatment, outlier_fill)
        result.data = treat_outliers(result.data, fitted, treatment, outlier_fill)
        result.bounds |= fitted
    return result


def run_summary(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: columns processed, rows before and after, rows removed and their share."""
    counts = before.agg(F.count(F.lit(1)).alias("rows_before_process"))
    left = after.agg(F.count(F.lit(1)).alias("rows_after_process"))
    both = counts.withColumn("__k", F.lit(1)).join(left.withColumn("__k", F.lit(1)), "__k").drop("__k")
    removed = F.col("rows_before_process") - F.col("rows_after_process")
    return both.select(
        F.lit(len(list(columns))).cast("bigint").alias("total_columns_processed"),
        "rows_before_process",
        "rows_after_process",
        removed.alias("rows_removed"),
        F.coalesce(F.try_divide(removed, F.col("rows_before_process")), F.lit(0.0)).alias(
            "rows_removed_ratio"
        ),
    )
