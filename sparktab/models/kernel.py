"""Support vector machines: linear, and kernels through landmark features.

Kernel machines use the Nystrom map (Williams and Seeger, 2001): each row becomes its
kernel values against a fixed number of landmark rows, whitened. With all rows as
landmarks this is the exact kernel machine; with fewer it is an approximation whose cost
grows with the rows and not with their square.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from itertools import count
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.columns import quoted, require_columns
from .base import ModelSpec, TabularModel, any_null, class_count, refuse_nulls, reject_unknown
from .network import _summed

LANDMARKS = 200
MOST_LANDMARKS = 2000
PAYLOAD_NUMBERS = 2_000_000
KERNELS = ("linear", "rbf", "poly", "sigmoid")
PARAMETERS = [
    "kernel", "gamma", "C", "degree", "coef0", "epsilon", "landmarks", "max_iter", "tol",
    "random_state", "probability",
]


def kernel_values(x: np.ndarray, z: np.ndarray, kind: str, gamma: float, degree: int, coef0: float) -> np.ndarray:
    """Kernel matrix between the rows of ``x`` and ``z``."""
    if kind == "linear":
        return x @ z.T
    if kind == "rbf":
        square = (x**2).sum(axis=1)[:, None] + (z**2).sum(axis=1)[None, :] - 2.0 * x @ z.T
        return np.exp(-gamma * np.maximum(square, 0.0))
    if kind == "poly":
        return (gamma * (x @ z.T) + coef0) ** degree
    return np.tanh(gamma * (x @ z.T) + coef0)


class LandmarkMap:
    """Landmark rows and the matrix that whitens kernel values against them."""

    def __init__(self, kind: str, gamma: float, degree: int, coef0: float, points: np.ndarray) -> None:
        self.kind, self.gamma, self.degree, self.coef0 = kind, gamma, degree, coef0
        self.points = points
        inner = kernel_values(points, points, kind, gamma, degree, coef0)
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        usable = values > max(values.max(), 0.0) * 1e-10
        self.whiten = vectors[:, usable] / np.sqrt(values[usable])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return kernel_values(x, self.points, self.kind, self.gamma, self.degree, self.coef0) @ self.whiten

    def state(self) -> list[Any]:
        return [self.kind, self.gamma, self.degree, self.coef0, self.points.tolist()]

    @classmethod
    def restore(cls, state: list[Any]) -> LandmarkMap:
        return cls(*state[:4], np.asarray(state[4]))


def diagonal(x: np.ndarray, lift: LandmarkMap) -> np.ndarray:
    """Kernel values of rows with themselves."""
    inner = (x**2).sum(axis=1)
    if lift.kind == "rbf":
        return np.ones(len(x))
    if lift.kind == "poly":
        return (lift.gamma * inner + lift.coef0) ** lift.degree
    return inner if lift.kind == "linear" else np.tanh(lift.gamma * inner + lift.coef0)


def landmark_error(rows: DataFrame, lift: LandmarkMap) -> float:
    """Share of the kernel's diagonal that the landmark features miss, over rows of features, y and w.

    0 with all rows as landmarks (of a kernel that is one); near 1 where landmarks say little.
    """

    def miss(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = missed = 0.0
        for pdf in batches:
            x = pdf.iloc[:, :-2].to_numpy(dtype=float)
            own = diagonal(x, lift)
            whole += float(np.abs(own).sum())
            missed += float(np.abs(own - (lift(x) ** 2).sum(axis=1)).sum()) if len(x) else 0.0
        yield pd.DataFrame({"whole": [whole], "missed": [missed]})

    row = rows.mapInPandas(miss, "whole double, missed double").agg(F.sum("whole").alias("w"), F.sum("missed").alias("m")).first()
    return (row.m or 0.0) / row.w if row.w else 0.0


def scale_gamma(df: DataFrame, features: list[str]) -> float:
    """``1 / (features * variance of all feature values)``."""
    x = [quoted(c).cast("double") for c in features]
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)],
        *[F.var_pop(v).alias(f"v{i}") for i, v in enumerate(x)],
    ).first()
    means = np.array([row[f"m{i}"] for i in range(len(x))], dtype=float)
    within = np.array([row[f"v{i}"] for i in range(len(x))], dtype=float)
    variance = within.mean() + means.var()
    return 1.0 / (len(x) * variance) if variance > 0 else 1.0


def fit_landmarks(df: DataFrame, spec: ModelSpec) -> LandmarkMap:
    """Landmarks are the rows with the smallest seeded hash, a bounded top-k."""
    params = spec.params
    kind = params.get("kernel", "rbf")
    gamma = params.get("gamma", "scale")
    if gamma == "scale":
        gamma = scale_gamma(df, spec.features)
    elif gamma == "auto":
        gamma = 1.0 / len(spec.features)
    count = int(params.get("landmarks", LANDMARKS))
    if count > MOST_LANDMARKS:
        raise ValueError(f"at most {MOST_LANDMARKS} landmarks")
    x = [quoted(c).cast("double").alias(f"f{i}") for i, c in enumerate(spec.features)]
    seed = int(params.get("random_state", 42))
    # Equal rows share one landmark: a second copy would add nothing.
    chosen = (
        df.select(*x)
        .groupBy(*[f"f{i}" for i in range(len(x))])
        .agg(F.count(F.lit(1)).alias("__n"))
        .orderBy(F.xxhash64(F.lit(seed), *[F.col(f"f{i}") for i in range(len(x))]))
        .limit(count)
        .drop("__n")
        .toArrow()
        .to_pandas()
    )
    return LandmarkMap(
        kind, float(gamma), int(params.get("degree", 3)), float(params.get("coef0", 0.0)),
        chosen.to_numpy(dtype=float),
    )


# How far past the margin a loss is rounded off, as shares of the scale of the losses: wide
# at first, where steps are long, then nearly sharp.
ROUNDINGS = (1.0, 0.1, 0.01, 0.001)
ROUGH_TOL = 1e-2


class _System:
    """One margin or one regression: its current weights and the step being tried."""

    def __init__(self, start: np.ndarray) -> None:
        self.beta = start
        self.step = np.zeros_like(start)
        self.share = 1.0
        self.best = np.inf
        self.level = 0
        self.done = False

    @property
    def candidate(self) -> np.ndarray:
        return self.beta + self.share * self.step

    def judge(self, value: float, gram: np.ndarray, moment: np.ndarray, ridge: np.ndarray, tol: float) -> None:
        """Take the candidate if it lowers the objective, else try half the step."""
        if value < self.best:
            gain = self.best - value
            self.beta, self.best, self.share = self.candidate, value, 1.0
            self.step = np.linalg.solve(gram + ridge, moment) - self.beta
            last = self.level == len(ROUNDINGS) - 1
            settled = gain <= (tol if last else ROUGH_TOL) * max(1.0, abs(value))
        else:
            self.share /= 2
            settled = self.share < 1e-3
        if settled and self.level < len(ROUNDINGS) - 1:
            self.level, self.best, self.share = self.level + 1, np.inf, 1.0
            self.step = np.zeros_like(self.beta)
        elif settled:
            self.done = True


def _pull(kind: str, y: np.ndarray, f: np.ndarray, tube: float, soft: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights and targets of the least-squares problem around ``f``, and the losses."""
    if kind == "hinge":
        over, target = 1.0 - y * f, y
    else:
        over, target = np.abs(y - f) - tube, y - np.sign(y - f) * tube
    out = over > 0
    weight = np.where(out, 1.0 / np.maximum(over, soft), 0.0)
    eased = np.where(over < soft, over**2 / (2 * soft), over - soft / 2)
    return weight, target, np.where(out, eased, 0.0)


def fit_machines(
    data: DataFrame, lift, size: int, kind: str, starts: list[np.ndarray], spec: ModelSpec, scale: float
) -> list[np.ndarray]:
    """Reweighted least squares for the hinge or the epsilon-insensitive loss.

    ``data`` holds the features, ``y`` and ``w``. Each round is one job for all machines:
    partitions add up their share of the weighted normal equations and of the objectives;
    the driver solves one system of ``size`` unknowns per machine. Some thirty passes
    settle what a gradient method with line search needs hundreds for. ``max_iter`` of -1
    sets no limit; if a limit ends the rounds before all machines are settled, a warning
    says so.
    """
    cost, tube = float(spec.params.get("C", 1.0)), float(spec.params.get("epsilon", 0.1))
    tol = float(spec.params.get("tol", 1e-4))
    ridge = np.eye(size)
    ridge[-1, -1] = 1e-9
    systems = [_System(s) for s in starts]
    width = 1 + size * size + size
    together = max(1, PAYLOAD_NUMBERS // width)

    def measure(numbers: list[int]) -> np.ndarray:
        tried = [(systems[i].candidate, scale * ROUNDINGS[systems[i].level]) for i in numbers]

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            total, seen = np.zeros((len(numbers), width)), False
            for pdf in batches:
                values = pdf.to_numpy(dtype=float)
                if not len(values):
                    continue
                seen = True
                phi = np.column_stack([lift(values[:, :-2]), np.ones(len(values))])
                y, w = values[:, -2], values[:, -1]
                for row, number, (beta, soft) in zip(total, numbers, tried):
                    goal = np.where(y == number, 1.0, -1.0) if kind == "hinge" else y
                    weight, target, losses = _pull(kind, goal, phi @ beta, tube, soft)
                    weight = cost * w * weight
                    used = weight > 0
                    scaled = phi[used] * weight[used, None]
                    row[0] += float((w * losses).sum())
                    row[1 : 1 + size * size] += (phi[used].T @ scaled).ravel()
                    row[1 + size * size :] += scaled.T @ target[used]
            if seen:
                part = TaskContext.get().partitionId()
                yield pd.DataFrame({"part": [part], "payload": [total.ravel()]})

        found = _summed(data.mapInPandas(work, "part int, payload array<double>"))
        return found.reshape(len(numbers), width)

    limit = int(spec.params.get("max_iter", 100))
    if limit < -1 or limit == 0:
        raise ValueError("max_iter must be positive, or -1 for no limit")
    for _ in count() if limit == -1 else range(limit):
        waiting = [i for i, s in enumerate(systems) if not s.done]
        if not waiting:
            break
        for at in range(0, len(waiting), together):
            group = waiting[at : at + together]
            for i, row in zip(group, measure(group)):
                system = systems[i]
                penalty = 0.5 * float(system.candidate[:-1] @ system.candidate[:-1])
                gram = row[1 : 1 + size * size].reshape(size, size)
                system.judge(penalty + cost * row[0], gram, row[1 + size * size :], ridge, tol)
    if unsettled := sum(not s.done for s in systems):
        warnings.warn(f"{unsettled} of {len(systems)} machines are not settled after {limit} rounds", RuntimeWarning, stacklevel=2)
    return [s.beta for s in systems]


def _identity(x: np.ndarray) -> np.ndarray:
    return x


class MarginModel(TabularModel):
    """Linear machines on the features or on landmark features."""

    kind = "margins"

    def __init__(
        self, spec: ModelSpec, lift: LandmarkMap | None, weights: np.ndarray, sigmoids: list[tuple[float, float]] | None = None
    ) -> None:
        super().__init__(spec)
        self.lift = lift
        self.weights = weights
        #: Slope and offset per machine, where class probabilities were asked for.
        self.sigmoids = sigmoids
        #: Share of the kernel that the landmarks miss on the training rows; None without landmarks.
        self.landmark_error: float | None = None

    def _margins(self, df: DataFrame) -> Column:
        inputs = [quoted(c).cast("double") for c in self.spec.features]
        if self.lift is None:
            x = F.array(*inputs)
            scores = []
            for row in self.weights:
                terms = F.zip_with(x, F.array(*[F.lit(float(v)) for v in row[:-1]]), lambda v, w: v * w)
                scores.append(F.aggregate(terms, F.lit(float(row[-1])), lambda a, b: a + b))
            return F.array(*scores)
        lift, weights = self.lift, self.weights

        @pandas_udf("array<double>")
        def margins(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            return pd.Series(list(lift(x) @ weights[:, :-1].T + weights[:, -1]))

        return margins(*inputs)

    def transform(self, df: DataFrame) -> DataFrame:
        require_columns(df, self.spec.features)
        out = ["prediction"] if self.sigmoids is None else ["prediction", "probability"]
        kept = [quoted(c) for c in df.columns if c not in out]
        scored = df.select(*kept, self._margins(df).alias("__m"))
        first = F.get("__m", 0)
        if self.spec.problem_type == "regression":
            made = first
        elif len(self.weights) == 1:
            made = F.when(first > 0, 1.0).otherwise(0.0)
        else:
            made = (F.array_position("__m", F.array_max("__m")) - 1).cast("double")
        missing = any_null([quoted(c).cast("double") for c in self.spec.features])
        columns = [F.when(~missing, made).alias("prediction")]
        if self.sigmoids is not None:
            columns.append(F.when(~missing, self._probability()).alias("probability"))
        return scored.select(*kept, *columns)

    def _probability(self) -> Column:
        odds = [1 / (1 + F.exp(F.get("__m", i) * a + b)) for i, (a, b) in enumerate(self.sigmoids)]
        if len(odds) == 1:
            return F.array(1 - odds[0], odds[0])
        total = sum(odds[1:], odds[0])
        even = F.lit(1.0 / len(odds))
        return F.array(*[F.when(total > 0, o / total).otherwise(even) for o in odds])

    def _state(self, spark, path) -> Any:
        return [self.lift.state() if self.lift else None, self.weights.tolist(), self.sigmoids, self.landmark_error]

    @classmethod
    def _restore(cls, spark, path, spec, state):
        lift = LandmarkMap.restore(state[0]) if state[0] else None
        model = cls(spec, lift, np.asarray(state[1]), *state[2:3])
        model.landmark_error = state[3] if len(state) > 3 else None
        return model


def train_svm(df: DataFrame, spec: ModelSpec, weight: str | None = None) -> MarginModel:
    """Support vector machine for classes (one against the rest) or numbers.

    The objective is half the squared weights plus ``C`` times the summed losses, the
    intercept unpenalised. A linear kernel works on the features themselves. Nulls in the
    features are refused here and give a null prediction later.
    """
    reject_unknown(spec.params, PARAMETERS, spec.model_type)
    kernel = spec.params.get("kernel", "rbf")
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel {kernel!r}; choose one of {KERNELS}")
    if spec.params.get("probability"):
        raise ValueError("class probabilities are fitted by calibration.train_svm_with_probability")
    require_columns(df, [*spec.features, spec.label])
    refuse_nulls(df.where(quoted(spec.label).isNotNull()), spec.features, spec.model_type)
    lift = None if kernel == "linear" else fit_landmarks(df, spec)
    size = (len(spec.features) if lift is None else lift.whiten.shape[1]) + 1
    share = F.lit(1.0) if weight is None else quoted(weight).cast("double")
    data = df.select(
        *[quoted(c).cast("double").alias(f"f{i}") for i, c in enumerate(spec.features)],
        quoted(spec.label).cast("double").alias("y"),
        share.alias("w"),
    ).where("y IS NOT NULL").persist()
    try:
        if spec.problem_type == "classification":
            classes = class_count(data, "y")
            # Two classes need one machine, for class 1; system numbers are class codes.
            starts = [np.zeros(size) for _ in range(classes)]
            fitted = fit_machines(data, lift or _identity, size, "hinge", starts, spec, 1.0)
            return _model(spec, lift, fitted if classes > 2 else fitted[1:], data)
        middle = data.agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s")).first()
        start = np.zeros(size)
        start[-1] = middle.m
        return _model(spec, lift, fit_machines(data, lift or _identity, size, "tube", [start], spec, middle.s or 1.0), data)
    finally:
        data.unpersist()


def _model(spec: ModelSpec, lift: LandmarkMap | None, weights: list[np.ndarray], data: DataFrame) -> MarginModel:
    model = MarginModel(spec, lift, np.array(weights))
    model.landmark_error = None if lift is None else landmark_error(data, lift)
    return model
