"""Table and column profiles, validation of column lists, box-plot tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import (
    is_categorical,
    is_numeric,
    nan_to_null,
    numeric_columns,
    quoted,
    require_columns,
)
from ..functions.quantiles import exact_quantiles
from ..session import local_table
from .outliers import count_outside, fit_bounds

COLUMN_PROFILE_SCHEMA = (
    "column string, dtype string, non_null_count bigint, null_count bigint, "
    "unique_values bigint, unique_ratio double, mean double, median double, "
    "min double, max double, outliers_count bigint, outlier_lower double, outlier_upper double"
)


def table_profile(df: DataFrame) -> DataFrame:
    """One row: total rows, columns, and rows that repeat an earlier row.

    Equal rows are counted with partial aggregation, so a row repeated a billion times
    is one shuffled row per task.
    """
    counted = df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    return counted.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("total_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def _distinct_counts(data: DataFrame, spot: dict[str, int]) -> dict[int, int]:
    """Distinct non-null values per column number.

    One job with a branch per column: each reads its own column only and counts distinct
    values. A single aggregate over all columns would copy every row once per column.
    """
    branches = [
        data.select(quoted(c).alias("value")).where("value IS NOT NULL").distinct()
        .agg(F.lit(i).alias("spot"), F.count(F.lit(1)).alias("n"))
        for c, i in spot.items()
    ]
    found = branches[0]
    for branch in branches[1:]:
        found = found.unionAll(branch)
    return {r.spot: r.n for r in found.collect()}


def column_profile(
    df: DataFrame,
    outliers_method: str = "iqr",
    outliers_threshold: float = 1.5,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One row per column: type, counts, distinct values, numeric summary, outliers.

    Text columns carry ``unique_ratio``; numeric columns mean, median, min, max and the
    outlier count and range. Five passes over the data for all columns together.
    """
    columns = list(columns or df.columns)
    require_columns(df, columns)
    dtypes = dict(df.dtypes)
    data = nan_to_null(df.select(*[quoted(c) for c in columns]))
    numeric = numeric_columns(data)
    spot = {c: i for i, c in enumerate(columns)}
    basics = data.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(quoted(c)).alias(f"n{i}") for c, i in spot.items()],
        *[
            f(quoted(c).cast("double")).alias(f"{k}{spot[c]}")
            for c in numeric
            for k, f in (("mean", F.avg), ("min", F.min), ("max", F.max))
        ],
    ).first()
    distinct = _distinct_counts(data, spot)
    probs = [0.25, 0.5, 0.75] if outliers_method == "iqr" else [0.5]
    quantiles = exact_quantiles(data, {c: probs for c in numeric})
    bounds = fit_bounds(
        data, numeric, outliers_method, outliers_threshold,
        quartiles={c: (q[0], q[-1]) for c, q in quantiles.items()} if outliers_method == "iqr" else None,
    )
    outside = count_outside(data, bounds)
    rows = []
    for c, i in spot.items():
        non_null = basics[f"n{i}"]
        common = (c, dtypes[c], non_null, basics["rows"] - non_null, distinct[i])
        if c in numeric:
            q = quantiles[c]
            b = bounds.get(c)
            rows.append(common + (
                None, basics[f"mean{i}"], q[len(q) // 2], basics[f"min{i}"], basics[f"max{i}"],
                outside.get(c, 0), b and b.lower, b and b.upper,
            ))
        else:
            ratio = distinct[i] / non_null if non_null else 0.0
            rows.append(common + (ratio, None, None, None, None, 0, None, None))
    return local_table(df.sparkSession, rows, COLUMN_PROFILE_SCHEMA)


def sample_values(df: DataFrame, column: str, key: str, n: int = 5) -> DataFrame:
    """The first ``n`` values of a column in the order of a caller-named key."""
    return df.select(quoted(key), quoted(column)).orderBy(quoted(key)).limit(n)


def duplicate_column_names(columns: Iterable[str]) -> list[str]:
    """Names that occur more than once, each listed once, in first-seen order."""
    seen: dict[str, int] = {}
    for c in columns:
        seen[c] = seen.get(c, 0) + 1
    return [c for c, n in seen.items() if n > 1]


def validate_columns(
    df: DataFrame, columns: Sequence[str] | str | None = None
) -> tuple[list[str], list[str]]:
    """``(valid, unknown)`` names after trimming; ``None`` means every column."""
    if columns is None:
        return list(df.columns), []
    if isinstance(columns, str):
        columns = [columns]
    names = [c.strip() for c in columns]
    return [c for c in names if c in df.columns], [c for c in names if c not in df.columns]


def split_columns_by_type(df: DataFrame) -> tuple[list[str], list[str]]:
    """``(numeric, text)`` column names by schema."""
    return (
        [c for c in df.columns if is_numeric(df, c)],
        [c for c in df.columns if is_categorical(df, c)],
    )


def missing_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, null_count)`` for the columns that have nulls, in one scan."""
    columns = list(columns or df.columns)
    data = nan_to_null(df.select(*[quoted(c) for c in columns]))
    counts = data.agg(*[F.count_if(quoted(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], [quoted(c) for c in columns], "column", "null_count").where(
        "null_count > 0"
    )


def compare_profiles(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two column profiles side by side; a dropped column has nulls on the right."""
    measures = [c for c in before.columns if c != "column"]
    left = before.select("column", *[F.col(m).alias(f"{m}_before") for m in measures])
    right = after.select("column", *[F.col(m).alias(f"{m}_after") for m in measures])
    return left.join(right, "column", "full_outer")


def box_plot_summary(df: DataFrame, columns: Sequence[str], whis: float = 3.0) -> DataFrame:
    """Quartiles, whisker ends and flier count per numeric column.

    A whisker ends at the last value inside ``whis`` times the quartile distance, and
    never inside the box.
    """
    columns = numeric_columns(df, columns)
    data = nan_to_null(df.select(*[quoted(c) for c in columns]))
    quartiles = exact_quantiles(data, {c: [0.25, 0.5, 0.75] for c in columns})
    exprs = []
    for i, c in enumerate(columns):
        q1, _, q3 = quartiles[c]
        if q1 is None:
            exprs += [F.lit(None).cast("double").alias(f"{k}{i}") for k in ("lo", "hi")]
            exprs.append(F.lit(0).alias(f"fliers{i}"))
            continue
        v = quoted(c).cast("double")
        low, high = q1 - whis * (q3 - q1), q3 + whis * (q3 - q1)
        exprs += [
            F.least(F.min(F.when(v >= low, v)), F.lit(q1)).alias(f"lo{i}"),
            F.greatest(F.max(F.when(v <= high, v)), F.lit(q3)).alias(f"hi{i}"),
            F.count_if((v < low) | (v > high)).alias(f"fliers{i}"),
        ]
    row = data.agg(*exprs).first()
    return local_table(
        df.sparkSession,
        [
            (c, *quartiles[c], row[f"lo{i}"], row[f"hi{i}"], row[f"fliers{i}"])
            for i, c in enumerate(columns)
        ],
        "column string, q1 double, median double, q3 double, whisker_low double, "
        "whisker_high double, fliers bigint",
    )
