"""Linear and logistic regression."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import quoted
from ..session import local_table
from .base import VECTOR, ModelSpec, SparkModel, assembled, reject_unknown

COLUMNS = {"featuresCol": VECTOR, "labelCol": "__label", "predictionCol": "__prediction"}


def total_weight(data: DataFrame, weight: str | None) -> float:
    total = F.count(F.lit(1)) if weight is None else F.sum("__weight")
    return float(data.agg(total.alias("n")).first().n)


def train_logistic_regression(df: DataFrame, spec: ModelSpec, weight: str | None = None) -> SparkModel:
    """Multinomial logistic regression; the penalty strength is ``1 / (C * total weight)``."""
    reject_unknown(
        spec.params,
        ["max_iter", "penalty", "C", "l1_ratio", "tol", "fit_intercept", "random_state", "solver", "multi_class"],
        spec.model_type,
    )
    penalty = spec.params.get("penalty", "l2")
    mix = {"l2": 0.0, "l1": 1.0, "elasticnet": float(spec.params.get("l1_ratio") or 0.0), None: 0.0, "none": 0.0}
    if penalty not in mix:
        raise ValueError(f"unknown penalty {penalty!r}")
    data = assembled(df, spec.features, spec.label, weight)
    strength = 0.0
    if penalty not in (None, "none"):
        strength = 1.0 / (float(spec.params.get("C", 1.0)) * total_weight(data, weight))
    fitted = LogisticRegression(
        maxIter=int(spec.params.get("max_iter", 1000)),
        regParam=strength,
        elasticNetParam=mix[penalty],
        tol=float(spec.params.get("tol", 1e-6)),
        fitIntercept=bool(spec.params.get("fit_intercept", True)),
        standardization=False,
        family="multinomial",
        rawPredictionCol="__raw",
        probabilityCol="__probability",
        **COLUMNS,
        **({} if weight is None else {"weightCol": "__weight"}),
    ).fit(data)
    return SparkModel(spec, fitted)


def train_linear_regression(df: DataFrame, spec: ModelSpec, weight: str | None = None) -> SparkModel:
    """Ordinary least squares."""
    reject_unknown(spec.params, ["fit_intercept"], spec.model_type)
    data = assembled(df, spec.features, spec.label, weight)
    fitted = LinearRegression(
        regParam=0.0, fitIntercept=bool(spec.params.get("fit_intercept", True)),
        **COLUMNS, **({} if weight is None else {"weightCol": "__weight"}),
    ).fit(data)
    return SparkModel(spec, fitted)


def train_lasso(df: DataFrame, spec: ModelSpec, weight: str | None = None) -> SparkModel:
    """Least squares with an absolute-value penalty on the raw feature scale."""
    reject_unknown(spec.params, ["alpha", "max_iter", "tol", "fit_intercept", "selection", "random_state"], spec.model_type)
    data = assembled(df, spec.features, spec.label, weight)
    fitted = LinearRegression(
        regParam=float(spec.params.get("alpha", 3.0)),
        elasticNetParam=1.0,
        maxIter=int(spec.params.get("max_iter", 1000)),
        tol=float(spec.params.get("tol", 1e-8)),
        fitIntercept=bool(spec.params.get("fit_intercept", True)),
        standardization=False,
        **COLUMNS,
        **({} if weight is None else {"weightCol": "__weight"}),
    ).fit(data)
    return SparkModel(spec, fitted)


def coefficients(model: SparkModel) -> list[tuple[str, float]]:
    """``(feature, coefficient)`` pairs and the intercept of a linear regression."""
    pairs = list(zip(model.spec.features, (float(v) for v in model.stage.coefficients)))
    return [*pairs, ("(intercept)", float(model.stage.intercept))]


def coefficient_table(spark: SparkSession, model: SparkModel) -> DataFrame:
    """The same pairs as a table ``(term, coefficient)``."""
    return local_table(spark, coefficients(model), "term string, coefficient double")


def simple_regression(df: DataFrame, feature: str, label: str) -> DataFrame:
    """Slope, intercept and R2 of one feature, as one aggregate."""
    x, y = quoted(feature).cast("double"), quoted(label).cast("double")
    return df.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )
