"""Outlier bounds, flags, treatment and reports for numeric columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from numbers import Real

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import is_numeric, nan_to_null, quoted
from ..functions.quantiles import exact_quantiles
from ..session import local_table

METHODS = ("iqr", "std", "z_score")
TREATMENTS = ("del_outlier", "save_outlier", "fill_outlier")


@dataclass(frozen=True)
class Bounds:
    """Fitted range of one column; ``None`` limits mean nothing lies outside."""

    column: str
    method: str
    threshold: float
    lower: float | None
    upper: float | None
    mean: float | None = None
    std: float | None = None

    @property
    def flag(self) -> Column:
        """True outside the range, false inside and for null."""
        value = quoted(self.column).cast("double")
        if self.method == "z_score":
            if not self.std:
                return F.lit(False)
            test = F.abs((value - F.lit(self.mean)) / F.lit(self.std)) > F.lit(float(self.threshold))
        elif self.lower is None or self.upper is None:
            return F.lit(False)
        else:
            test = (value < F.lit(self.lower)) | (value > F.lit(self.upper))
        return F.coalesce(test, F.lit(False))

    @property
    def outside(self) -> Column:
        """Strictly beyond the limits, false for null; the test used for treatment."""
        if self.lower is None or self.upper is None:
            return F.lit(False)
        value = quoted(self.column).cast("double")
        return F.coalesce((value < F.lit(self.lower)) | (value > F.lit(self.upper)), F.lit(False))


def _check(method: str, threshold: object) -> None:
    if isinstance(threshold, bool) or not isinstance(threshold, Real):
        raise ValueError(f"threshold must be a number, got {type(threshold).__name__}")
    if method not in METHODS:
        raise ValueError(f"unknown outlier method {method!r}; choose one of {METHODS}")


def fit_bounds(
    df: DataFrame,
    columns: Sequence[str],
    method: str = "iqr",
    threshold: float = 1.5,
    quartiles: Mapping[str, tuple[float, float]] | None = None,
) -> dict[str, Bounds]:
    """Bounds per column; missing, non-numeric and all-null columns are left out.

    All columns share the passes. ``quartiles`` reuses quartiles already computed.
    """
    _check(method, threshold)
    usable = [c for c in dict.fromkeys(columns) if c in df.columns and is_numeric(df, c)]
    if not usable:
        return {}
    fitted: dict[str, Bounds] = {}
    if method == "iqr":
        if quartiles is None:
            found = exact_quantiles(df, {c: [0.25, 0.75] for c in usable})
            quartiles = {c: (q[0], q[1]) for c, q in found.items()}
        for c in usable:
            q1, q3 = quartiles[c]
            if q1 is not None:
                reach = threshold * (q3 - q1)
                fitted[c] = Bounds(c, method, threshold, q1 - reach, q3 + reach)
        return fitted
    data = nan_to_null(df.select(*[quoted(c) for c in usable]))
    row = data.agg(
        *[F.avg(quoted(c).cast("double")).alias(f"m{i}") for i, c in enumerate(usable)],
        *[F.stddev_samp(quoted(c).cast("double")).alias(f"s{i}") for i, c in enumerate(usable)],
    ).first()
    for i, c in enumerate(usable):
        mean, std = row[f"m{i}"], row[f"s{i}"]
        if mean is None:
            continue
        if std is None or std != std:
            fitted[c] = Bounds(c, method, threshold, None, None, mean, None)
        else:
            reach = threshold * std
            fitted[c] = Bounds(c, method, threshold, mean - reach, mean + reach, mean, std)
    return fitted


def count_outside(df: DataFrame, bounds: Mapping[str, Bounds]) -> dict[str, int]:
    """Flagged rows per column, one pass for all columns."""
    if not bounds:
        return {}
    row = df.agg(*[F.count_if(b.flag).alias(f"o{i}") for i, b in enumerate(bounds.values())]).first()
    return {c: row[f"o{i}"] for i, c in enumerate(bounds)}


def flag_outliers(df: DataFrame, bounds: Mapping[str, Bounds], suffix: str = "_is_outlier") -> DataFrame:
    """Add one boolean column per fitted column."""
    return df.withColumns({f"{c}{suffix}": b.flag for c, b in bounds.items()})


def outlier_info(df: DataFrame, bounds: Mapping[str, Bounds]) -> DataFrame:
    """Per column: flagged rows, their share of all rows, range, method, threshold."""
    exprs = [F.count_if(b.flag).alias(f"o{i}") for i, b in enumerate(bounds.values())]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *exprs).first()
    return local_table(
        df.sparkSession,
        [
            (
                c, row[f"o{i}"], row[f"o{i}"] / row["rows"], b.lower, b.upper,
                b.method, float(b.threshold),
            )
            for i, (c, b) in enumerate(bounds.items())
        ],
        "column string, outlier_count bigint, outlier_ratio double, lower double, "
        "upper double, method string, threshold double",
    )


def treat_outliers(
    df: DataFrame,
    bounds: Mapping[str, Bounds],
    treatment: str,
    fill_value: float | None = None,
) -> DataFrame:
    """Drop, keep, clip or replace the values beyond the limits. Null rows stay."""
    if treatment not in TREATMENTS:
        raise ValueError(f"unknown treatment {treatment!r}; choose one of {TREATMENTS}")
    if not bounds or treatment == "save_outlier":
        return df
    if treatment == "del_outlier":
        keep = F.lit(True)
        for b in bounds.values():
            keep = keep & ~b.outside
        return df.where(keep)
    if fill_value is not None:
        try:
            number = float(fill_value)
        except (TypeError, ValueError):
            raise TypeError(f"fill value {fill_value!r} must be a number") from None
        return df.withColumns(
            {
                c: F.when(b.outside, F.lit(number)).otherwise(quoted(c).cast("double"))
                for c, b in bounds.items()
            }
        )
    clipped = {}
    for c, b in bounds.items():
        value = quoted(c).cast("double")
        if b.lower is not None:
            clipped[c] = (
                F.when(value < F.lit(b.lower), F.lit(b.lower))
                .when(value > F.lit(b.upper), F.lit(b.upper))
                .otherwise(value)
            )
    return df.withColumns(clipped) if clipped else df


def recheck_outliers(
    handled: DataFrame, columns: Sequence[str], method: str = "iqr", threshold: float = 1.5
) -> DataFrame:
    """Refit on handled data and report what is still flagged."""
    return outlier_info(handled, fit_bounds(handled, columns, method, threshold))


def outlier_report(
    before: DataFrame,
    after: DataFrame,
    bounds: Mapping[str, Bounds],
    treatment: str,
    fill_value: float | None = None,
) -> DataFrame:
    """Per column: flagged before, still beyond the same limits after, difference."""
    original = count_outside(before, bounds)
    remaining = count_outside(after, bounds)
    return local_table(
        before.sparkSession,
        [
            (
                c, original[c], remaining[c], original[c] - remaining[c],
                float(fill_value) if treatment == "fill_outlier" and fill_value is not None else None,
                b.method, float(b.threshold), treatment,
            )
            for c, b in bounds.items()
        ],
        "column string, original_count bigint, remaining_count bigint, handled_count bigint, "
        "fill_value double, method string, threshold double, treatment string",
    )
