"""Class probabilities of margin machines.

The margins of rows that a machine was not trained on come from as many machines as there are
folds, trained together (see ``margins``); folds follow a hash of the row, so equal rows share
one. Per class they are counted into a histogram of bounded size, by whether the row belongs to
the class, with the sum of margins per bin. A sigmoid of the margin with two parameters is fitted
to the histogram by Newton steps on the log loss with smoothed targets (Platt, 1999; Lin, Lin and
Weng, 2007). More than two classes have one sigmoid each, and the probabilities are scaled to a
sum of 1. The predicted class stays that of the largest margin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import quoted
from .base import ModelSpec
from .kernel import MarginModel, train_svm
from .margins import Machine, MachineGroup, train_groups

FOLDS = 5
BINS = 2_000
STEPS = 100


def train_svm_with_probability(df: DataFrame, spec: ModelSpec, weight: str | None = None) -> MarginModel:
    """A support vector machine; with ``probability`` it also gives class probabilities."""
    wanted = bool(spec.params.get("probability")) and spec.problem_type == "classification"
    plain = {k: v for k, v in spec.params.items() if k != "probability"}
    model = train_svm(df, ModelSpec(spec.problem_type, spec.model_type, spec.features, spec.label, plain), weight)
    model.spec = spec
    if wanted:
        model.sigmoids = fit_sigmoids(df, model, weight)
    return model


def fit_sigmoids(df: DataFrame, model: MarginModel, weight: str | None = None, folds: int = FOLDS) -> list[tuple[float, float]]:
    """(slope, offset) of the sigmoid of each machine of the model, from held-out margins."""
    spec, each = model.spec, len(model.weights)
    features = [quoted(c).cast("double") for c in spec.features]
    label = quoted(spec.label).cast("double")
    hashed = F.xxhash64(F.lit(int(spec.params.get("random_state", 42))), *features, label)
    rows = df.where(label.isNotNull()).select(
        *[x.alias(f"f{i}") for i, x in enumerate(features)],
        label.alias("y"),
        (F.lit(1.0) if weight is None else quoted(weight).cast("double")).alias("w"),
        F.pmod(hashed, F.lit(folds)).cast("double").alias("fold"),
    ).persist()
    try:
        positives = range(each) if each > 1 else [1]
        machines = [Machine(float(spec.params.get("C", 1.0)), p, f) for f in range(folds) for p in positives]
        group = MachineGroup(model.lift, len(spec.features), machines)
        train_groups(rows, [group], float(spec.params.get("tol", 1e-4)), int(spec.params.get("max_iter", 100)))
        weights = group.weights().reshape(folds, each, -1)
        counts, sums = held_out_histogram(rows, group, weights, list(positives))
    finally:
        rows.unpersist()
    return [fit_sigmoid(counts[i], sums[i]) for i in range(each)]


def held_out_histogram(rows: DataFrame, group: MachineGroup, weights: np.ndarray, positives: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Per machine, bin and side (0: other classes, 1: its class) the weight of rows and the sum of margins.

    Bins are even between the least and the largest margin of each machine.
    """
    lift, each = group.lift, len(positives)

    def margins(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values = pdf.to_numpy(dtype=float)
        phi = np.column_stack([lift(values[:, :-3]), np.ones(len(values))])
        own = weights[values[:, -1].astype(int)]
        return (own * phi[:, None, :]).sum(axis=2), values[:, -3], values[:, -2]

    def extremes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                found = margins(pdf)[0]
                yield pd.DataFrame({"machine": range(each), "low": found.min(axis=0), "high": found.max(axis=0)})

    seen = rows.mapInPandas(extremes, "machine int, low double, high double")
    low, high = np.zeros(each), np.ones(each)
    for row in seen.groupBy("machine").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        low[row.machine], high[row.machine] = row.low, row.high
    step = np.maximum((high - low) / BINS, 1e-300)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, each * BINS * 2))
        for pdf in batches:
            if not len(pdf):
                continue
            found, y, w = margins(pdf)
            spot = np.clip((found - low) / step, 0, BINS - 1).astype(int)
            side = (y[:, None] == np.array(positives)).astype(int)
            cell = ((np.arange(each) * BINS + spot) * 2 + side).ravel()
            share = np.repeat(w, each)
            total[0] += np.bincount(cell, share, total.shape[1])
            total[1] += np.bincount(cell, share * found.ravel(), total.shape[1])
        cells = np.flatnonzero(total[0])
        yield pd.DataFrame({"cell": cells, "n": total[0][cells], "s": total[1][cells]})

    counts, sums = np.zeros(each * BINS * 2), np.zeros(each * BINS * 2)
    parts = rows.mapInPandas(count, "cell bigint, n double, s double")
    for row in parts.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        counts[row.cell], sums[row.cell] = row.n, row.s
    shape = (each, BINS, 2)
    return counts.reshape(shape), sums.reshape(shape)


def fit_sigmoid(counts: np.ndarray, sums: np.ndarray) -> tuple[float, float]:
    """Newton steps with halving for p = 1 / (1 + exp(slope * margin + offset))."""
    n0, n1 = counts.sum(axis=0)
    used = counts.ravel() > 0
    weight = counts.ravel()[used]
    margin = sums.ravel()[used] / weight
    target = np.tile([1 / (n0 + 2), (n1 + 1) / (n1 + 2)], len(counts))[used]

    def loss(a: float, b: float) -> float:
        z = a * margin + b
        return float((weight * (np.logaddexp(0, z) - (1 - target) * z)).sum())

    a, b = 0.0, float(np.log((n0 + 1) / (n1 + 1)))
    best = loss(a, b)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(a * margin + b, -700, 700)))
        slope = np.array([(weight * (target - p) * margin).sum(), (weight * (target - p)).sum()])
        curve = weight * p * (1 - p)
        hessian = np.array([[(curve * margin**2).sum(), (curve * margin).sum()], [(curve * margin).sum(), curve.sum()]])
        move = -np.linalg.solve(hessian + 1e-12 * np.eye(2), slope)
        if np.abs(slope).max() < 1e-8 * max(1.0, weight.sum()):
            break
        share = 1.0
        while share > 1e-10 and loss(a + share * move[0], b + share * move[1]) > best:
            share /= 2
        if share <= 1e-10:
            break
        a, b = a + share * move[0], b + share * move[1]
        best = loss(a, b)
    return float(a), float(b)
