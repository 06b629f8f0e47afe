"""Gaussian, Bernoulli and multinomial naive Bayes from one grouped aggregate."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import nan_to_null, quoted, require_columns
from .base import ModelSpec, TabularModel, reject_unknown

SMOOTHING = 1e-9
INLINE_TERMS = 2048


def _total(terms: Sequence[Column]) -> Column:
    """Balanced sum, so that long sums stay shallow."""
    terms = list(terms)
    while len(terms) > 1:
        pairs = [reduce(lambda a, b: a + b, terms[i : i + 2]) for i in range(0, len(terms), 2)]
        terms = pairs
    return terms[0]


class NaiveBayesModel(TabularModel):
    """Per class a constant and, per feature, weights for ``x`` and ``(x - centre)^2``."""

    kind = "naive_bayes"

    def __init__(self, spec, constants, linear, centres, curvature, threshold=None) -> None:
        super().__init__(spec)
        self.constants = constants
        self.linear = linear
        self.centres = centres
        self.curvature = curvature
        self.threshold = threshold

    def _scores(self) -> list[Column]:
        inputs = [quoted(c).cast("double") for c in self.spec.features]
        if self.threshold is not None:
            inputs = [F.when(x > self.threshold, 1.0).otherwise(0.0) for x in inputs]
        out = []
        for k, constant in enumerate(self.constants):
            terms = [F.lit(float(constant))]
            for j, x in enumerate(inputs):
                if self.linear is not None:
                    terms.append(x * F.lit(float(self.linear[k][j])))
                else:
                    off = x - F.lit(float(self.centres[k][j]))
                    terms.append(off * off * F.lit(float(self.curvature[k][j])))
            out.append(_total(terms))
        return out

    def _array_scores(self) -> Column:
        """The same scores with array functions, for very wide tables."""
        x = F.array(*[quoted(c).cast("double") for c in self.spec.features])
        if self.threshold is not None:
            x = F.transform(x, lambda v: F.when(v > self.threshold, 1.0).otherwise(0.0))
        literal = lambda values: F.array(*[F.lit(float(v)) for v in values])
        out = []
        for k, constant in enumerate(self.constants):
            if self.linear is not None:
                terms = F.zip_with(x, literal(self.linear[k]), lambda v, w: v * w)
            else:
                square = F.zip_with(x, literal(self.centres[k]), lambda v, c: (v - c) * (v - c))
                terms = F.zip_with(square, literal(self.curvature[k]), lambda v, w: v * w)
            out.append(F.aggregate(terms, F.lit(float(constant)), lambda a, b: a + b))
        return F.array(*out)

    def transform(self, df: DataFrame) -> DataFrame:
        require_columns(df, self.spec.features)
        small = len(self.constants) * len(self.spec.features) <= INLINE_TERMS
        scores = F.array(*self._scores()) if small else self._array_scores()
        kept = [quoted(c) for c in df.columns if c not in ("prediction", "probability")]
        scored = df.select(*kept, scores.alias("__scores"))
        best = F.array_max("__scores")
        odds = F.transform("__scores", lambda s: F.exp(s - best))
        total = F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)
        return scored.select(
            *kept,
            (F.array_position("__scores", best) - 1).cast("double").alias("prediction"),
            F.transform(odds, lambda o: o / total).alias("probability"),
        )

    def _state(self, spark, path) -> Any:
        return [self.constants, self.linear, self.centres, self.curvature, self.threshold]

    @classmethod
    def _restore(cls, spark, path, spec, state):
        return cls(spec, *state)


def _class_rows(df: DataFrame, spec: ModelSpec, weight: str | None, exprs) -> list[Any]:
    used = [*spec.features, spec.label, *([weight] if weight else [])]
    require_columns(df, used)
    data = nan_to_null(df, spec.features).where(quoted(spec.label).isNotNull())
    rows = data.groupBy(quoted(spec.label).cast("int").alias("k")).agg(*exprs).collect()
    return sorted(rows, key=lambda r: r.k)


def _priors(spec: ModelSpec, rows: list[Any]) -> list[float]:
    given = spec.params.get("class_prior")
    if given is not None:
        return [math.log(p) for p in given]
    if not spec.params.get("fit_prior", True):
        return [-math.log(len(rows))] * len(rows)
    total = sum(r.n for r in rows)
    return [math.log(r.n / total) for r in rows]


def _require_dense(rows: list[Any]) -> None:
    if [r.k for r in rows] != list(range(len(rows))):
        raise ValueError("class codes must be 0..k-1")


def train_gaussian(df: DataFrame, spec: ModelSpec, weight: str | None = None) -> NaiveBayesModel:
    """Class means and variances; variances grow by 1e-9 of the largest feature variance.

    Partial means and variances are combined per class, so the aggregate is one small
    shuffle whatever the class sizes.
    """
    reject_unknown(spec.params, ["var_smoothing", "priors"], spec.model_type)
    if weight is not None:
        raise ValueError("Gaussian naive Bayes takes no weights")
    columns = [quoted(c).cast("double") for c in spec.features]
    exprs = [F.count(F.lit(1)).alias("n")]
    for j, x in enumerate(columns):
        exprs += [F.avg(x).alias(f"m{j}"), F.var_pop(x).alias(f"v{j}")]
    rows = _class_rows(df, spec, None, exprs)
    _require_dense(rows)
    total = sum(r.n for r in rows)
    widest = 0.0
    for j in range(len(columns)):
        mean = sum(r.n * r[f"m{j}"] for r in rows) / total
        spread = sum(r.n * (r[f"v{j}"] + (r[f"m{j}"] - mean) ** 2) for r in rows) / total
        widest = max(widest, spread)
    floor = float(spec.params.get("var_smoothing", SMOOTHING)) * widest
    given = spec.params.get("priors")
    constants, centres, curvature = [], [], []
    for i, r in enumerate(rows):
        variances = [r[f"v{j}"] + floor for j in range(len(columns))]
        prior = math.log(given[i] if given else r.n / total)
        constants.append(prior - 0.5 * sum(math.log(2 * math.pi * v) for v in variances))
        centres.append([r[f"m{j}"] for j in range(len(columns))])
        curvature.append([-0.5 / v for v in variances])
    return NaiveBayesModel(spec, constants, None, centres, curvature)


def _sums(df: DataFrame, spec: ModelSpec, weight: str | None, inputs: list[Column]) -> list[Any]:
    w = F.lit(1.0) if weight is None else quoted(weight).cast("double")
    exprs = [F.sum(w).alias("n"), *[F.sum(x * w).alias(f"s{j}") for j, x in enumerate(inputs)]]
    rows = _class_rows(df, spec, weight, exprs)
    _require_dense(rows)
    return rows


def train_bernoulli(df: DataFrame, spec: ModelSpec, weight: str | None = None) -> NaiveBayesModel:
    """Present/absent features: values above ``binarize`` count as present."""
    reject_unknown(spec.params, ["alpha", "binarize", "fit_prior", "class_prior"], spec.model_type)
    alpha, cut = float(spec.params.get("alpha", 1.0)), float(spec.params.get("binarize", 0.0))
    inputs = [F.when(quoted(c) > cut, 1.0).otherwise(0.0) for c in spec.features]
    rows = _sums(df, spec, weight, inputs)
    constants, linear = [], []
    for r, prior in zip(rows, _priors(spec, rows)):
        shares = [(r[f"s{j}"] + alpha) / (r.n + 2 * alpha) for j in range(len(inputs))]
        constants.append(prior + sum(math.log(1 - p) for p in shares))
        linear.append([math.log(p) - math.log(1 - p) for p in shares])
    return NaiveBayesModel(spec, constants, linear, None, None, cut)


def train_multinomial(df: DataFrame, spec: ModelSpec, weight: str | None = None) -> NaiveBayesModel:
    """Counts; negative values are refused."""
    reject_unknown(spec.params, ["alpha", "fit_prior", "class_prior"], spec.model_type)
    alpha = float(spec.params.get("alpha", 1.0))
    inputs = [quoted(c).cast("double") for c in spec.features]
    lowest = df.agg(F.min(F.least(*inputs) if len(inputs) > 1 else inputs[0]).alias("m")).first().m
    if lowest is not None and lowest < 0:
        raise ValueError("multinomial naive Bayes needs counts of at least 0")
    rows = _sums(df, spec, weight, inputs)
    linear = []
    for r in rows:
        counts = [r[f"s{j}"] + alpha for j in range(len(inputs))]
        total = sum(counts)
        linear.append([math.log(c) - math.log(total) for c in counts])
    return NaiveBayesModel(spec, _priors(spec, rows), linear, None, None)
