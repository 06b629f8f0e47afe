"""Exact k nearest neighbours: broadcast points, or cells pruned by the triangle inequality."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.blocks import BLOCK_BYTES, BLOCK_ROWS, BROADCAST_BYTES, against_all
from ..functions.columns import quoted, require_columns
from ..functions.pivots import SLACK, Found, matrix, merged, nearest_by_pivots
from ..session import cut_lineage
from .base import ModelSpec, TabularModel, refuse_nulls, reject_unknown

#: Pairs looked at together: without a bound, and with one, where they are compared in a processor's cache.
CELLS, TILE = 1_000_000, 1 << 17
NEIGHBORS = "array<struct<distance:double,id:bigint,label:double>>"


def nearest_in_block(
    queries: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, p: float, bound: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query row, point row, distance)`` of the k nearest, ties to the smaller id.

    For p = 2 a matrix product finds every candidate that could be among the k nearest
    and their distances are then computed directly, so that equal distances are equal.
    With a ``bound`` per query, points farther away are left out; a query may find none.
    """
    k = min(k, len(points))
    found = []
    for rows, cols in _candidates(queries, points, k, p, bound):
        exact = (np.abs(queries[rows] - points[cols]) ** p).sum(axis=1) ** (1.0 / p)
        if bound is not None:
            near = exact <= bound[rows] * (1 + 1e-12)
            rows, cols, exact = rows[near], cols[near], exact[near]
        found.append(_first_k(rows, cols, exact, ids, k))
    rows, cols, exact = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in enumerate((int, int, float)))
    return (rows, cols, exact) if bound is None else _first_k(rows, cols, exact, ids, k)


def _first_k(rows: np.ndarray, cols: np.ndarray, exact: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Per query row its k nearest, in order."""
    order = np.lexsort((ids[cols], exact, rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return rows[keep], cols[keep], exact[keep]


def _candidates(
    queries: np.ndarray, points: np.ndarray, k: int, p: float, bound: np.ndarray | None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that hold every query's k nearest, a bounded number of pairs looked at a time."""
    if bound is None or p != 2:
        yield from _close(queries, np.arange(len(queries)), points, np.arange(len(points)), k, p, bound)
        return
    for own, members in _parts(queries, points, bound):
        yield from _close(queries, own, points, members, k, p, bound)


def _close(
    queries: np.ndarray, own: np.ndarray, points: np.ndarray, members: np.ndarray, k: int, p: float, bound: np.ndarray | None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of some queries and some points that rough distances leave."""
    near = points[members]
    width = points.shape[1] if p != 2 else 1
    k = min(k, len(members))
    step = max(1, (CELLS if bound is None else TILE) // max(1, len(members) * width))
    squares = (near**2).sum(axis=1)
    for start in range(0, len(own), step):
        rows = own[start : start + step]
        part = queries[rows]
        if p == 2:
            size = (part**2).sum(axis=1)
            rough = size[:, None] + squares[None, :] - 2.0 * part @ near.T
            slack = SLACK * (1.0 + squares.max() + size)
        else:
            rough = (np.abs(part[:, None, :] - near[None, :, :]) ** p).sum(axis=2)
            slack = 0.0 if bound is None else SLACK * (1.0 + bound[rows] ** p)
        if bound is None:
            limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + slack
            hit = rough <= limit[:, None]
        else:
            hit = rough <= (bound[rows] ** p + slack)[:, None]
            many = np.flatnonzero(np.count_nonzero(hit, axis=1) > k)
            if len(many):
                limit = np.partition(rough[many], k - 1, axis=1)[:, k - 1] + (slack[many])
                hit[many] &= rough[many] <= limit[:, None]
        at, cols = np.nonzero(hit)
        yield rows[at], members[cols]


def _parts(queries: np.ndarray, points: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Small parts of the points, each with the queries whose bound reaches it by the triangle inequality."""
    middle = np.unique(points[:: max(1, math.isqrt(len(points)))], axis=0)
    own = np.empty(len(points), int)
    sizes = (middle**2).sum(axis=1)
    step = max(1, CELLS // len(middle))
    for at in range(0, len(points), step):
        own[at : at + step] = (sizes - 2.0 * points[at : at + step] @ middle.T).argmin(axis=1)
    away = np.sqrt(((points - middle[own]) ** 2).sum(axis=1))
    order = np.argsort(own, kind="stable")
    ends = np.cumsum(np.bincount(own, minlength=len(middle)))
    radius = np.zeros(len(middle))
    np.maximum.at(radius, own, away)
    for at in range(0, len(queries), step):
        part = queries[at : at + step]
        size = (part**2).sum(axis=1)
        rough = sizes[:, None] + size[None, :] - 2.0 * middle @ part.T
        reach = (radius[:, None] + bound[at : at + step]) ** 2
        near = rough <= reach + SLACK * (1.0 + sizes.max() + size + reach)
        for nth in np.flatnonzero(near.any(axis=1)):
            members = order[ends[nth - 1] if nth else 0 : ends[nth]]
            if len(members):
                yield at + np.flatnonzero(near[nth]), members


def nearest_neighbors(
    queries: DataFrame,
    points: DataFrame,
    features: list[str],
    k: int,
    p: float = 2.0,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Per query key the sorted array of its k nearest points."""
    return neighbor_search(queries, points, features, k, p, broadcast_bytes, block_rows).lists


def neighbor_search(
    queries: DataFrame,
    points: DataFrame,
    features: list[str],
    k: int,
    p: float = 2.0,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> Found:
    """The k nearest points per query key, and how many pairs were compared.

    ``queries`` has ``__q`` (unique bigint), ``points`` has ``__id`` (unique bigint) and
    ``__label``. Points measured to be few are broadcast and searched where the queries lie;
    more are searched cell by cell (see ``functions.pivots``). Only k rows per query and block
    are shuffled, never the pairs. Queries with nulls find nothing.
    """
    width = len(features)

    def vectors(df: DataFrame, *names: str) -> DataFrame:
        return df.select(*names, F.array(*[quoted(c).cast("double") for c in features]).alias("x"))

    left, right = vectors(queries, "__q"), vectors(points, "__id", "__label")
    size = right.count()
    lacking = F.exists("x", lambda v: v.isNull() | F.isnan(v))
    if size * (width + 2) * 8 > broadcast_bytes and p >= 1:
        whole = left.where(~lacking)
        found = nearest_by_pivots(whole, right, width, k, p, nearest_in_block, NEIGHBORS, block_rows)
        none = left.where(lacking).select("__q", F.array().cast(NEIGHBORS).alias("neighbors"))
        return Found(found.lists.unionByName(none), found.compared, found.pairs)
    if size * (width + 2) * 8 > broadcast_bytes:
        return _all_blocks(left, right, width, k, p, block_rows)
    table = right.toArrow()
    shared = left.sparkSession.sparkContext.broadcast(
        (matrix(table.column("x").combine_chunks(), width), table.column("__id").to_numpy(), table.column("__label").to_numpy())
    )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, ids, labels = shared.value
        for batch in batches:
            x = np.array(batch.column("x").flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(-1, width)
            good = np.flatnonzero(~np.isnan(x).any(axis=1))
            if len(good) and len(ids):
                rows, cols, dist = nearest_in_block(x[good], near, ids, k, p)
            else:
                rows, cols, dist = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
            counts = np.zeros(len(x), np.int64)
            counts[good] = np.bincount(rows, minlength=len(good))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            items = pa.StructArray.from_arrays([pa.array(dist), pa.array(ids[cols]), pa.array(labels[cols])], names=["distance", "id", "label"])
            yield pa.RecordBatch.from_arrays([batch.column("__q"), pa.ListArray.from_arrays(offsets, items)], names=["__q", "neighbors"])

    lists = left.mapInArrow(stream, f"__q bigint, neighbors {NEIGHBORS}")
    return Found(lists, -1, -1)


def _all_blocks(left: DataFrame, right: DataFrame, width: int, k: int, p: float, block_rows: int) -> Found:
    """Every block of queries against every block of points, for distances that are no metric."""

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(a["x"]).astype(float)
        good = ~np.isnan(x).any(axis=1)
        none = pd.DataFrame({"__q": a["__q"][~good].to_numpy(), "neighbors": [[] for _ in range(int((~good).sum()))]})
        if not good.any():
            return none
        ids, labels = b["__id"].to_numpy(), b["__label"].to_numpy(dtype=float)
        rows, cols, dist = nearest_in_block(x[good], np.stack(b["x"]), ids, k, p)
        cuts = np.flatnonzero(np.diff(rows)) + 1
        lists = [
            [{"distance": d, "id": i, "label": y} for d, i, y in zip(ds, js, ys)]
            for ds, js, ys in zip(np.split(dist, cuts), np.split(ids[cols], cuts), np.split(labels[cols], cuts))
        ]
        return pd.concat([pd.DataFrame({"__q": a["__q"][good].to_numpy(), "neighbors": lists}), none])

    rows = max(1, min(block_rows, BLOCK_BYTES // (8 * (width + 2))))
    found, _ = against_all(left, right, "__q", "__id", kernel, f"__q bigint, neighbors {NEIGHBORS}", broadcast_bytes=0, block_rows=rows)
    return Found(merged(found, k), -1, -1)


def _weights(neighbors: Column, weighting: str) -> Column:
    """Neighbours with a weight each; exact hits outweigh everything else."""
    if weighting == "uniform":
        return F.transform(neighbors, lambda n: F.struct(n["label"].alias("label"), F.lit(1.0).alias("w")))
    hit = F.exists(neighbors, lambda n: n["distance"] == 0)
    return F.transform(
        neighbors,
        lambda n: F.struct(
            n["label"].alias("label"),
            F.when(hit, F.when(n["distance"] == 0, 1.0).otherwise(0.0))
            .otherwise(1.0 / n["distance"])
            .alias("w"),
        ),
    )


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, b: a + b)


class NeighborsModel(TabularModel):
    """The training table itself; neighbours are searched when scoring."""

    kind = "neighbors"

    def __init__(self, spec: ModelSpec, points: DataFrame, classes: int | None) -> None:
        super().__init__(spec)
        self.points = points
        self.classes = classes

    def transform(self, df: DataFrame, key: str | None = None, **limits: int) -> DataFrame:
        """Add ``prediction``; ``key`` names a unique bigint column.

        Without a key the rows are numbered and written to the checkpoint folder, so that
        a lost executor cannot renumber them. A row with a null feature has a null prediction.
        """
        require_columns(df, self.spec.features)
        params = self.spec.params
        if key is None:
            keyed = cut_lineage(df.withColumn("__q", F.monotonically_increasing_id()))
        else:
            keyed = df.withColumn("__q", quoted(key).cast("bigint"))
        found = nearest_neighbors(
            keyed, self.points, self.spec.features,
            int(params.get("n_neighbors", 5)), float(params.get("p", 2)), **limits,
        )
        votes = found.select("__q", _weights(F.col("neighbors"), params.get("weights", "uniform")).alias("__v"))
        out = self._regress(votes) if self.classes is None else self._vote(votes)
        names = [c for c in out.columns if c != "__q"]
        kept = [quoted(c) for c in df.columns if c not in names]
        return keyed.join(out, "__q").select(*kept, *names)

    def _regress(self, votes: DataFrame) -> DataFrame:
        total = _sum(F.transform("__v", lambda n: n["w"]))
        mean = F.try_divide(_sum(F.transform("__v", lambda n: n["w"] * n["label"])), total)
        return votes.select("__q", mean.alias("prediction"))

    def _vote(self, votes: DataFrame) -> DataFrame:
        classes = F.sequence(F.lit(0), F.lit(self.classes - 1))
        shares = F.transform(
            classes,
            lambda c: _sum(
                F.transform(F.filter("__v", lambda n: n["label"] == c.cast("double")), lambda n: n["w"])
            ),
        )
        counted = votes.select("__q", F.when(F.size("__v") > 0, shares).alias("__s"))
        total = _sum(F.col("__s"))
        return counted.select(
            "__q",
            (F.array_position("__s", F.array_max("__s")) - 1).cast("double").alias("prediction"),
            F.transform("__s", lambda s: s / total).alias("probability"),
        )

    def _state(self, spark, path) -> Any:
        self.points.write.mode("overwrite").parquet(f"{path}/points")
        return self.classes

    @classmethod
    def _restore(cls, spark, path, spec, state):
        return cls(spec, spark.read.parquet(f"{path}/points"), state)


def train_neighbors(df: DataFrame, spec: ModelSpec, weight: str | None = None) -> NeighborsModel:
    """Keep the training rows; ``id_column`` names their unique bigint key.

    Without one the rows are numbered and written to the checkpoint folder, since a
    number given on the fly would change when a task runs again.
    """
    reject_unknown(
        spec.params, ["n_neighbors", "weights", "p", "metric", "id_column", "algorithm", "leaf_size", "n_jobs"],
        spec.model_type,
    )
    if weight is not None:
        raise ValueError("neighbours take no row weights")
    if spec.params.get("weights", "uniform") not in ("uniform", "distance"):
        raise ValueError("weights must be 'uniform' or 'distance'")
    metrics = {"minkowski": spec.params.get("p", 2), "euclidean": 2, "manhattan": 1}
    metric = spec.params.get("metric", "minkowski")
    if metric not in metrics:
        raise ValueError(f"unknown metric {metric!r}")
    spec.params["p"] = metrics[metric]
    require_columns(df, [*spec.features, spec.label])
    refuse_nulls(df.where(quoted(spec.label).isNotNull()), spec.features, spec.model_type)
    given = spec.params.get("id_column")
    number = quoted(given).cast("bigint") if given else F.monotonically_increasing_id()
    points = df.select(
        number.alias("__id"),
        quoted(spec.label).cast("double").alias("__label"),
        *[quoted(c) for c in spec.features],
    ).where("__label IS NOT NULL")
    if not given:
        points = cut_lineage(points)
    classes = None
    if spec.problem_type == "classification":
        classes = int(points.agg(F.max("__label").alias("m")).first().m) + 1
    return NeighborsModel(spec, points, classes)
