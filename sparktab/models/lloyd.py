"""Many k-means runs in shared passes.

A run is a number of clusters and a start. Every pass over the rows serves all runs that are not
done: one matrix product gives the distances to all their centres, and partitions return sums and
counts per centre, added up in a tree. Starts are chosen like k-means++: each pass picks the
next centre of every run, the row with the smallest exponential variate divided by its squared
distance to the run's centres, which is a draw in proportion to that distance. The variates
come from a hash of row, run and step, so partitions do not matter; equal rows share theirs and
are drawn as one, but count each in every move.

A run is done when its centres move by no more than ``tol`` times the mean variance of the
columns, or after ``max_iter`` moves. A centre without rows stays where it is. Rows with nulls
are refused by the caller.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import quoted
from .network import _summed

#: Cells of distances that a task holds at a time.
CELLS = 4_000_000


@dataclass
class Run:
    """One run: its centres so far, and the squares within its clusters in the last pass."""

    k: int
    start: int
    centres: list[np.ndarray] = field(default_factory=list)
    cost: float = np.inf
    moves: int = 0
    done: bool = False


def uniforms(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) from row hashes and a salt."""
    x = hashes ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def squares_to(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2.0 * x @ centres.T, 0.0)


def _packed(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """The vector of each row as its bytes, and its hash: one column to hand to Python in every pass."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names])
            sides = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * len(names)), len(x), [None, pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([sides.cast(pa.binary()), batch.column("hash")], names=["x", "hash"])

    return rows.mapInArrow(pack, "x binary, hash bigint")


def _pieces(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors and hashes of a batch, packed or in columns, a bounded number of rows at a time."""
    if "x" in batch.schema.names:
        x = np.frombuffer(b"".join(batch.column("x").to_pylist())).reshape(batch.num_rows, -1)
    else:
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]])
    hashes = batch.column("hash").to_numpy().view(np.uint64)
    step = max(16, CELLS // max(1, width))
    for at in range(0, len(x), step):
        yield x[at : at + step], hashes[at : at + step]


def draw_next(rows: DataFrame, runs: Sequence[Run], seed: int, step: int) -> None:
    """Give every run its next centre."""
    starts = np.concatenate([[0], np.cumsum([len(r.centres) for r in runs])])
    known = np.array([c for r in runs for c in r.centres])
    salts = [hash((seed, r.k, r.start, step)) & 0xFFFFFFFF for r in runs]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full(len(runs), np.inf)
        found: list[np.ndarray] = [np.zeros(0)] * len(runs)
        for batch in batches:
            if not batch.num_rows:
                continue
            for x, hashes in _pieces(batch, max(1, len(known))):
                away = squares_to(x, known) if len(known) else None
                for i, salt in enumerate(salts):
                    own = np.ones(len(x)) if away is None else away[:, starts[i] : starts[i + 1]].min(axis=1)
                    with np.errstate(divide="ignore"):
                        key = -np.log(uniforms(hashes, salt)) / own
                    at = int(key.argmin())
                    if key[at] < best[i]:
                        best[i], found[i] = key[at], x[at]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(runs)), pa.int32()), pa.array(best), pa.array([f.tolist() for f in found], pa.list_(pa.float64()))],
            names=["run", "key", "x"],
        )

    keyed = rows.mapInArrow(draw, "run int, key double, x array<double>")
    chosen = keyed.groupBy("run").agg(F.min(F.struct("key", "x")).alias("least"))
    for row in chosen.collect():
        run = runs[row.run]
        # Fewer distinct rows than clusters: the last ones have no row of their own.
        run.centres.append(np.array(row.least.x if np.isfinite(row.least.key) else run.centres[0]))


def move_all(rows: DataFrame, runs: Sequence[Run], limit: float, max_iter: int) -> None:
    """One Lloyd step of every run."""
    sizes = [r.k for r in runs]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    centres = np.concatenate([np.array(r.centres) for r in runs])
    width = centres.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums = np.zeros((len(centres), width + 1))
        cost = np.zeros(len(sizes))
        seen = False
        for batch in batches:
            if not batch.num_rows:
                continue
            for x, _ in _pieces(batch, len(centres)):
                seen = True
                away = squares_to(x, centres)
                counted = np.column_stack([x, np.ones(len(x))])
                for i, k in enumerate(sizes):
                    own = away[:, starts[i] : starts[i + 1]]
                    nearest = own.argmin(axis=1)
                    cost[i] += own[np.arange(len(x)), nearest].sum()
                    member = np.zeros((len(x), k))
                    member[np.arange(len(x)), nearest] = 1.0
                    sums[starts[i] : starts[i + 1]] += member.T @ counted
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([np.concatenate([cost, sums.ravel()])], pa.list_(pa.float64()))],
                names=["part", "payload"],
            )

    total = _summed(rows.mapInArrow(work, "part int, payload array<double>"), len(sizes) + len(centres) * (width + 1))
    cost, sums = total[: len(sizes)], total[len(sizes) :].reshape(-1, width + 1)
    for i, run in enumerate(runs):
        own = sums[starts[i] : starts[i + 1]]
        before = np.array(run.centres)
        held = own[:, -1] > 0
        after = before.copy()
        after[held] = own[held, :-1] / own[held, -1:]
        run.cost, run.moves = float(cost[i]), run.moves + 1
        # The cost belongs to the centres before the move: a settled run keeps them.
        if run.moves > max_iter or ((after - before) ** 2).sum() <= limit:
            run.done = True
        else:
            run.centres = list(after)


def run_all(
    df: DataFrame, features: Sequence[str], sizes: Sequence[int], starts: int, seed: int = 42,
    max_iter: int = 300, tol: float = 1e-4,
) -> tuple[list[Run], int]:
    """All runs, ``starts`` for each number of clusters, and how many passes they took."""
    x = [quoted(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)]
    names = [f"f{i}" for i in range(len(features))]
    plain = df.select(*x).withColumn("hash", F.xxhash64(F.lit(seed), *names))
    spread = plain.agg(F.count(F.lit(1)).alias("n"), *[F.var_pop(c).alias(c) for c in names]).first()
    if not spread.n:
        raise ValueError("no rows to cluster")
    rows = _packed(plain, names).persist()
    try:
        variances = [spread[c] for c in names]
        runs = [Run(k, s) for k in sizes for s in range(starts)]
        passes = 0
        for step in range(max(sizes)):
            draw_next(rows, [r for r in runs if r.k > step], seed, step)
            passes += 1
        while waiting := [r for r in runs if not r.done]:
            move_all(rows, waiting, tol * float(np.mean(variances)), max_iter)
            passes += 1
    finally:
        rows.unpersist()
    return runs, passes
