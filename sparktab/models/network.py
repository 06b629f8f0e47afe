"""Feed-forward networks trained by minibatches, one after the other.

An epoch deals the rows to its minibatches by a hash of row and epoch, about ``batch_size`` rows
each, and takes all of them; only ``epoch_steps``, if given, makes them fewer and larger. Large
minibatches take a Spark job each: partitions add up the gradients of their part, the sums meet in
a tree, and the driver, which holds the one Adam state, takes the step. Small ones follow each
other in one task, a bounded number of rows a job, and the state goes from job to job. Either
way the weights do not depend on how the table is partitioned. Equal rows are numbered, so that
they are dealt to different minibatches. Dropout draws by row hash too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.columns import quoted, require_columns
from ..session import local_table
from .base import ModelSpec, TabularModel, any_null, class_count, refuse_nulls, reject_unknown

# Adam's usual decay rates and guard.
BETA1, BETA2, GUARD = 0.9, 0.999, 1e-8
FAN_IN = 16
#: Numbers of a payload from which the driver no longer adds payloads itself.
DRIVER_NUMBERS = 20_000
#: Rows whose gradient is taken at a time; larger minibatches take a job each.
BLOCK = 4_096
#: Rows whose minibatches follow each other in one task.
CHAIN_ROWS = 1 << 18


@dataclass(frozen=True)
class Shape:
    """Layer sizes from inputs to outputs, and what the output is."""

    sizes: tuple[int, ...]
    classes: int | None
    activation: str = "relu"

    @property
    def length(self) -> int:
        return sum(a * b + b for a, b in zip(self.sizes, self.sizes[1:]))

    def layers(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def penalised(self, flat: np.ndarray) -> np.ndarray:
        """The weights with biases set to 0."""
        parts = [part for w, b in self.layers(flat) for part in (w.ravel(), np.zeros_like(b))]
        return np.concatenate(parts)

    def start(self, seed: int) -> np.ndarray:
        """Uniform start within the usual fan-in/fan-out limit."""
        rng = np.random.default_rng(seed)
        parts = []
        for a, b in zip(self.sizes, self.sizes[1:]):
            limit = np.sqrt((2.0 if self.activation == "logistic" else 6.0) / (a + b))
            parts += [rng.uniform(-limit, limit, a * b), rng.uniform(-limit, limit, b)]
        return np.concatenate(parts)


def _activate(z: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    if name == "relu":
        return np.maximum(z, 0.0), (z > 0).astype(float)
    if name == "tanh":
        a = np.tanh(z)
        return a, 1 - a * a
    if name == "logistic":
        a = 1 / (1 + np.exp(-z))
        return a, a * (1 - a)
    return z, np.ones_like(z)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def forward(shape: Shape, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Class probabilities, or the predicted number as one column."""
    layers = shape.layers(flat)
    for i, (w, b) in enumerate(layers):
        x = x @ w + b
        if i < len(layers) - 1:
            x = _activate(x, shape.activation)[0]
    return _softmax(x) if shape.classes else x


def loss_and_hits(shape: Shape, out: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Summed loss and number of right classes."""
    if shape.classes:
        k = y.astype(int)
        picked = np.clip(out[np.arange(len(k)), k], 1e-12, None)
        return float(-np.log(picked).sum()), float((out.argmax(axis=1) == k).sum())
    return float(((out[:, 0] - y) ** 2).sum() / 2), 0.0


def gradient(
    shape: Shape, flat: np.ndarray, x: np.ndarray, y: np.ndarray, alpha: float, dropout: float,
    rng: np.random.Generator,
) -> tuple[np.ndarray, float, float]:
    """Mean gradient of one minibatch with its summed loss and hits."""
    layers = shape.layers(flat)
    inputs, slopes = [x], []
    a = x
    for i, (w, b) in enumerate(layers):
        z = a @ w + b
        if i == len(layers) - 1:
            out = _softmax(z) if shape.classes else z
            break
        a, slope = _activate(z, shape.activation)
        if dropout:
            mask = (rng.random(a.shape) >= dropout) / (1 - dropout)
            a, slope = a * mask, slope * mask
        inputs.append(a)
        slopes.append(slope)
    loss, hits = loss_and_hits(shape, out, y)
    delta = out.copy()
    if shape.classes:
        delta[np.arange(len(y)), y.astype(int)] -= 1
    else:
        delta[:, 0] -= y
    delta /= len(y)
    parts: list[np.ndarray] = []
    for i in range(len(layers) - 1, -1, -1):
        w, _ = layers[i]
        parts = [(inputs[i].T @ delta + alpha * w / len(y)).ravel(), delta.sum(axis=0), *parts]
        if i:
            delta = (delta @ w.T) * slopes[i - 1]
    return np.concatenate(parts), loss, hits


@dataclass
class AdamState:
    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: int

    def step(self, grad: np.ndarray, rate: float) -> None:
        self.steps += 1
        self.first = BETA1 * self.first + (1 - BETA1) * grad
        self.second = BETA2 * self.second + (1 - BETA2) * grad * grad
        scale = rate * np.sqrt(1 - BETA2**self.steps) / (1 - BETA1**self.steps)
        self.weights = self.weights - scale * self.first / (np.sqrt(self.second) + GUARD)


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    ordered = pdf.sort_values("spot")["payload"]
    return pd.DataFrame({"part": pdf["part"].iloc[:1], "payload": [np.sum(np.stack(ordered.to_numpy()), axis=0)]})


def _summed(parts: DataFrame, numbers: int = 0) -> np.ndarray:
    """Element-wise sum of the ``payload`` arrays of numbered parts.

    A tree: at most FAN_IN payloads meet in a group, level after level, until so few are
    left that the driver adds them, taken over as Arrow buffers. Of payloads of many
    ``numbers`` it takes the sum alone.
    """
    left, last = parts.rdd.getNumPartitions(), 1 if numbers > DRIVER_NUMBERS else FAN_IN
    while left > last:
        dealt = parts.withColumn("spot", F.col("part")).withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        parts = dealt.groupBy("part").applyInPandas(_added, "part int, payload array<double>")
        left = -(-left // FAN_IN)
    found = parts.select("payload").toArrow().column("payload").combine_chunks()
    if not len(found):
        raise ValueError("no rows to train on")
    return found.flatten().to_numpy().reshape(len(found), -1).sum(axis=0)


class RowRandom:
    """Uniform numbers per row and column that depend on the row's hash and on a salt only."""

    def __init__(self, hashes: np.ndarray, salt: int) -> None:
        self.hashes = hashes.astype(np.int64).view(np.uint64)
        self.salt, self.calls = salt, 0

    def random(self, shape: tuple[int, int]) -> np.ndarray:
        self.calls += 1
        column = np.arange(shape[1], dtype=np.uint64) + np.uint64((self.salt * 1009 + self.calls) << 20)
        x = self.hashes[:, None] ^ (column * np.uint64(0x9E3779B97F4A7C15))[None, :]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53


def run_epoch(
    data: DataFrame, shape: Shape, state: AdamState, rate: float, alpha: float, steps: int,
    dropout: float, seed: int, rows: int | None = None,
) -> tuple[AdamState, float, float, float]:
    """One pass in ``steps`` minibatches; returns the new state, rows, summed loss and hits.

    ``data`` holds the features, ``y`` and the hash ``row``; ``rows`` is their number.
    """
    each = (data.count() if rows is None else rows) / steps
    data = data.withColumn("step", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(steps)) if steps > 1 else F.lit(0).cast("bigint"))
    if each <= BLOCK:
        together = max(1, int(CHAIN_ROWS / max(each, 1.0)))
        seen = np.zeros(3)
        for start in range(0, steps, together):
            mine = data.where(F.col("step").between(start, start + together - 1)) if together < steps else data
            state, found = _chained(mine, shape, state, rate, alpha, dropout, seed)
            seen += found
    else:
        seen = _one_by_one(data, shape, state, rate, alpha, steps, dropout, seed)
    if not seen[0]:
        raise ValueError("no rows to train on")
    return state, *seen


def _one_by_one(
    data: DataFrame, shape: Shape, state: AdamState, rate: float, alpha: float, steps: int, dropout: float, seed: int
) -> np.ndarray:
    """A job for each minibatch, all partitions at work on it; returns rows, summed loss and hits."""
    width = shape.sizes[0]
    seen = np.zeros(3)
    for step in range(steps):
        weights = state.weights
        mine = data.where(F.col("step") == step).drop("step")

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            total = np.zeros(3 + shape.length)
            for pdf in batches:
                if not len(pdf):
                    continue
                rows = pdf["row"].to_numpy()
                values = pdf.drop(columns="row").to_numpy(dtype=float)
                for at in range(0, len(values), BLOCK):
                    part = values[at : at + BLOCK]
                    grad, loss, hits = gradient(
                        shape, weights, part[:, :width], part[:, width], 0.0, dropout, RowRandom(rows[at : at + BLOCK], seed)
                    )
                    total[:3] += [len(part), loss, hits]
                    total[3:] += grad * len(part)
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "payload": [total]})

        total = _summed(mine.mapInPandas(work, "part int, payload array<double>"))
        seen += total[:3]
        if total[0]:
            state.step((total[3:] + alpha * shape.penalised(weights)) / total[0], rate)
    return seen


def _chained(
    data: DataFrame, shape: Shape, state: AdamState, rate: float, alpha: float, dropout: float, seed: int
) -> tuple[AdamState, np.ndarray]:
    """The minibatches of these rows, one step after the other in one task."""
    width = shape.sizes[0]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(pdf["step"].to_numpy(), pdf["row"].to_numpy(), pdf.drop(columns=["row", "step"]).to_numpy(dtype=float)) for pdf in batches if len(pdf)]
        own, seen = AdamState(state.weights, state.first, state.second, state.steps), np.zeros(3)
        if held:
            step, rows, values = (np.concatenate(parts) for parts in zip(*held))
            # In a fixed order, so that the sums do not depend on which rows came first.
            order = np.lexsort((rows, step))
            rows, values = rows[order], values[order]
            cuts = np.flatnonzero(np.diff(step[order])) + 1
            for at, end in zip([0, *cuts], [*cuts, len(rows)]):
                x, y = values[at:end, :width], values[at:end, width]
                grad, loss, hits = gradient(shape, own.weights, x, y, alpha, dropout, RowRandom(rows[at:end], seed))
                own.step(grad, rate)
                seen += [end - at, loss, hits]
        yield pd.DataFrame({"payload": [np.concatenate([seen, [own.steps], own.weights, own.first, own.second])]})

    found = data.repartition(1).mapInPandas(work, "payload array<double>").toArrow().column("payload").combine_chunks().flatten().to_numpy()
    return AdamState(*found[4:].reshape(3, shape.length), int(found[3])), found[:3]


def evaluate(data: DataFrame, shape: Shape, weights: np.ndarray) -> tuple[float, float, float]:
    """Rows, summed loss and hits of a table under fixed weights."""
    width = shape.sizes[0]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(3)
        for pdf in batches:
            values = pdf.drop(columns="row").to_numpy(dtype=float)
            if len(values):
                y = values[:, width]
                total += [len(y), *loss_and_hits(shape, forward(shape, weights, values[:, :width]), y)]
        yield pd.DataFrame({"rows": [total[0]], "loss": [total[1]], "hits": [total[2]]})

    found = data.mapInPandas(work, "rows double, loss double, hits double")
    row = found.agg(F.sum("rows").alias("r"), F.sum("loss").alias("l"), F.sum("hits").alias("h")).first()
    return row.r or 0.0, row.l or 0.0, row.h or 0.0


class NetworkModel(TabularModel):
    """A trained network; scoring is an Arrow-batched function of the feature columns."""

    kind = "network"

    def __init__(self, spec: ModelSpec, shape: Shape, weights: np.ndarray, history: list[tuple]) -> None:
        super().__init__(spec)
        self.shape = shape
        self.weights = weights
        self.history = history

    def transform(self, df: DataFrame) -> DataFrame:
        require_columns(df, self.spec.features)
        shape, weights = self.shape, self.weights

        @pandas_udf("array<double>")
        def outputs(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            return pd.Series(list(forward(shape, weights, x)))

        whole = ~any_null([quoted(c).cast("double") for c in self.spec.features])
        kept = [quoted(c) for c in df.columns if c not in ("prediction", "probability")]
        scored = df.select(*kept, outputs(*[quoted(c).cast("double") for c in self.spec.features]).alias("__out"))
        if shape.classes is None:
            return scored.select(*kept, F.when(whole, F.get("__out", 0)).alias("prediction"))
        best = F.array_position("__out", F.array_max("__out")) - 1
        return scored.select(
            *kept, F.when(whole, best.cast("double")).alias("prediction"), F.when(whole, F.col("__out")).alias("probability")
        )

    def history_table(self, spark) -> DataFrame:
        """Per epoch: learning rate, train and validation loss and accuracy."""
        return local_table(
            spark, self.history,
            "epoch int, learning_rate double, train_loss double, train_accuracy double, "
            "val_loss double, val_accuracy double, best boolean",
        )

    def _state(self, spark, path) -> Any:
        return [self.shape.__dict__, self.weights.tolist(), self.history]

    @classmethod
    def _restore(cls, spark, path, spec, state):
        shape = Shape(tuple(state[0]["sizes"]), state[0]["classes"], state[0]["activation"])
        return cls(spec, shape, np.asarray(state[1]), [tuple(h) for h in state[2]])


PARAMETERS = [
    "hidden_layer_sizes", "activation", "solver", "alpha", "learning_rate", "learning_rate_init",
    "max_iter", "early_stopping", "validation_fraction", "n_iter_no_change", "tol", "batch_size",
    "dropout", "decay_every", "decay_factor", "random_state", "epoch_steps",
]


def train_network(
    df: DataFrame, spec: ModelSpec, weight: str | None = None, validation: DataFrame | None = None
) -> NetworkModel:
    """Train a network and keep its epoch history.

    With a validation table (or ``early_stopping``, which sets a share of the rows aside
    by row hash) the state of the best epoch is kept: best accuracy, or lowest loss for a
    number. Training stops when the watched loss has not improved by ``tol`` for
    ``n_iter_no_change`` epochs; None for it never stops before ``max_iter``. ``decay_every``
    and ``decay_factor`` lower the learning rate in steps.
    """
    params = spec.params
    reject_unknown(params, PARAMETERS, spec.model_type)
    if weight is not None:
        raise ValueError("networks take no weights")
    if params.get("solver", "adam") != "adam":
        raise ValueError("only the adam solver is available")
    activation = params.get("activation", "relu")
    if activation not in ("relu", "tanh", "logistic", "identity"):
        raise ValueError(f"unknown activation {activation!r}")
    require_columns(df, [*spec.features, spec.label])
    columns = [*[quoted(c).cast("double").alias(f"f{i}") for i, c in enumerate(spec.features)],
               quoted(spec.label).cast("double").alias("y")]
    refuse_nulls(df.where(quoted(spec.label).isNotNull()), spec.features, spec.model_type)
    seed = int(params.get("random_state", 42))

    def hashed(rows: DataFrame) -> DataFrame:
        return rows.select(*columns).withColumn("row", F.xxhash64(F.lit(seed), "y", *[f"f{i}" for i in range(len(spec.features))]))

    data = hashed(df.where(quoted(spec.label).isNotNull()))
    stopping = bool(params.get("early_stopping", False))
    held = None if validation is None else hashed(validation)
    if held is None and stopping:
        share = float(params.get("validation_fraction", 0.1))
        spot = F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(10_000))
        data, held = data.where(spot >= share * 10_000), data.where(spot < share * 10_000)
    data = _told_apart(data).persist()
    held = held.persist() if held is not None else None
    try:
        return _train(spec, data, held, activation, seed, stopping)
    finally:
        data.unpersist()
        if held is not None:
            held.unpersist()


def _told_apart(data: DataFrame) -> DataFrame:
    """The same rows, equal ones with hashes of their own by number."""
    counted = data.groupBy(*data.columns).agg(F.count(F.lit(1)).alias("copies"))
    numbered = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")
    return numbered.withColumn("row", F.when(F.col("copy") == 1, F.col("row")).otherwise(F.xxhash64("row", "copy"))).drop("copy")


def _train(spec, data, held, activation, seed, stopping) -> NetworkModel:
    params = spec.params
    classes = class_count(data, "y") if spec.problem_type == "classification" else None
    hidden: Sequence[int] = params.get("hidden_layer_sizes", (64, 32))
    hidden = (hidden,) if isinstance(hidden, int) else tuple(hidden)
    shape = Shape((len(spec.features), *hidden, classes or 1), classes, activation)
    start = shape.start(seed)
    state = AdamState(start, np.zeros_like(start), np.zeros_like(start), 0)
    rate = float(params.get("learning_rate_init", 1e-3))
    every, factor = params.get("decay_every"), float(params.get("decay_factor", 0.9))
    tol, patience = float(params.get("tol", 1e-4)), params.get("n_iter_no_change", 10)
    size = data.count()
    steps = max(1, size // int(params.get("batch_size", 200)))
    if params.get("epoch_steps") is not None:
        steps = max(1, min(steps, int(params["epoch_steps"])))
    history: list[tuple] = []
    best_score, best_weights, best_epoch = -np.inf, None, -1
    watched_best, stale = np.inf, 0
    for epoch in range(int(params.get("max_iter", 200))):
        now = rate * factor ** (epoch // int(every)) if every else rate
        state, rows, loss, hits = run_epoch(
            data, shape, state, now, float(params.get("alpha", 1e-4)), steps, float(params.get("dropout", 0.0)), seed + epoch, size,
        )
        if not np.isfinite(state.weights).all():
            raise ValueError("training diverged; lower the learning rate or scale the features")
        val_loss = val_hits = None
        if held is not None:
            seen, val_sum, val_right = evaluate(held, shape, state.weights)
            if seen:
                val_loss, val_hits = val_sum / seen, (val_right / seen if classes else None)
                score = val_hits if classes else -val_loss
                if score > best_score:
                    best_score, best_weights, best_epoch = score, state.weights, epoch
        history.append(
            (epoch + 1, now, loss / rows, hits / rows if classes else None, val_loss, val_hits, False)
        )
        watched = val_loss if stopping and val_loss is not None else loss / rows
        stale = stale + 1 if watched > watched_best - tol else 0
        watched_best = min(watched_best, watched)
        if patience is not None and stale >= int(patience):
            break
    if best_weights is None:
        best_weights, best_epoch = state.weights, len(history) - 1
    history[best_epoch] = (*history[best_epoch][:-1], True)
    return NetworkModel(spec, shape, best_weights, history)
