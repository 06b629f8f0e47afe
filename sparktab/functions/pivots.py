"""Exact nearest neighbours between two large tables, with cells pruned by the triangle inequality.

Pivots are a bounded sample of the points. Each point and each query belongs to the cell of its
nearest pivot; of a cell, the number of its points and its radius are known. Round one searches
for each query the nearest cells that together hold k points, which bounds the distance of its
k-th neighbour. Round two searches only cells that can hold something nearer: the distance to
the pivot less the radius is a lower bound of what a cell holds, and so is, for p = 2, the
distance to the plane halfway to its pivot. A cell gives only what is no farther than the bound. Cells are cut into blocks of points and chunks of
queries of bounded size, so a cell with a third of all points is many groups. In round two, where a query
may want every cell, neighbouring cells share a group: a query goes there once, with a bit for each cell
that it wants, and nothing of that is written but the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .blocks import BLOCK_BYTES, BLOCK_ROWS

MOST_PIVOTS = 512
#: Numbers in the rows of query and cell that a task holds at a time.
PAIR_NUMBERS = 1_000_000
#: Groups of points, and chunks of queries, that tables of some size are cut into at least.
GROUPS, CHUNKS = 16, 4
#: Room for rounding, as a share of the distances.
SLACK = 1e-9

NEIGHBORS = pa.list_(pa.struct([("distance", pa.float64()), ("id", pa.int64()), ("label", pa.float64())]))
#: (queries, points, ids, k, p[, bounds]) -> query rows, point rows and distances of the k nearest.
Search = Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass
class Found:
    """Neighbours per query in up to several rows, and how many pairs were compared of all."""

    lists: DataFrame
    compared: int
    pairs: int


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def distances(x: np.ndarray, pivots: np.ndarray, p: float) -> np.ndarray:
    """Minkowski distances, computed directly so that they err by rounding only."""
    out = np.empty((len(x), len(pivots)))
    for i, pivot in enumerate(pivots):
        out[:, i] = (np.abs(x - pivot) ** p).sum(axis=1) ** (1.0 / p)
    return out


def chosen_pivots(points: DataFrame, count: int, width: int) -> np.ndarray:
    """Distinct vectors of the points with the smallest hashes of their ids."""
    rows = points.orderBy(F.xxhash64(F.lit("pivot"), "__id"), "__id").limit(count).select("x").toArrow()
    found = matrix(pa.chunked_array(rows.column("x")).combine_chunks(), width) if rows.num_rows else np.zeros((0, width))
    return np.unique(found, axis=0)


def _spread(cells: dict[int, int], size: int, pivots: int, column: str = "cell") -> Column:
    """Blocks per cell, as a literal array indexed by cell."""
    return F.array(*[F.lit(max(1, math.ceil(cells.get(c, 0) / size))) for c in range(pivots)])[F.col(column)]


def grouped(holds: np.ndarray, room: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Groups of cells with at most ``room`` points: the cells of each; per cell its first group and its number of groups.

    A cell of more points has groups of its own, among which its points are dealt out.
    """
    cells: list[list[int]] = []
    first, number = np.zeros(len(holds), int), np.maximum(1, -(-holds // room))
    held = room
    for c, n in enumerate(holds.tolist()):
        if held + n > room:
            cells.append([])
            held = 0
        first[c] = len(cells) - 1
        cells[-1].append(c)
        held += n
        cells += [[c] for _ in range(number[c] - 1)]
    return [np.array(c) for c in cells], first, number


def by_group(batch: pa.RecordBatch, wanted: np.ndarray, cells: list[np.ndarray], step: int) -> Iterator[pa.RecordBatch]:
    """A row per query and group that holds a wanted cell, with a bit for each of the group's cells."""
    for g, own in enumerate(cells):
        mine = wanted[:, own]
        rows = np.flatnonzero(mine.any(axis=1))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            bits = pa.array([b.tobytes() for b in np.packbits(mine[some], axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*[column.take(pa.array(some)) for column in batch.columns], pa.array(np.full(len(some), g), pa.int32()), bits],
                names=[*batch.schema.names, "group", "bits"],
            )


def pairs_of(batch: pa.RecordBatch, wanted: np.ndarray, step: int) -> Iterator[pa.RecordBatch]:
    """A row per query and wanted cell, ``step`` rows at a time, since a query may want all cells."""
    rows, cells = np.nonzero(wanted)
    for at in range(0, len(rows), step):
        own = pa.array(rows[at : at + step])
        yield pa.RecordBatch.from_arrays(
            [*[column.take(own) for column in batch.columns], pa.array(cells[at : at + step], pa.int32())],
            names=[*batch.schema.names, "cell"],
        )


def nearest_by_pivots(
    queries: DataFrame, points: DataFrame, width: int, k: int, p: float, search: Search, schema: str,
    block_rows: int = BLOCK_ROWS, pivots: int | None = None,
) -> Found:
    """Lists of the k nearest points per query.

    ``queries`` holds ``__q`` and ``x``, ``points`` ``__id``, ``__label`` and ``x``; x are lists of
    ``width`` numbers without nulls. The metric needs p of 1 or more.
    """
    points, queries = cut_lineage(points), cut_lineage(queries)
    size = points.count()
    block_rows = max(1, min(block_rows, BLOCK_BYTES // (8 * (width + 2))))
    count = pivots or max(1, min(MOST_PIVOTS, math.isqrt(size)))
    middle = chosen_pivots(points, count, width)
    if not len(middle):
        return Found(queries.select("__q", F.array().cast(schema).alias("neighbors")), 0, 0)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = distances(matrix(batch.column("x"), width), middle, p)
            cell = away.argmin(axis=1)
            columns = [*batch.columns, pa.array(cell, pa.int32()), pa.array(away[np.arange(len(cell)), cell])]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "cell", "away"])

    dealt = cut_lineage(
        points.select("__id", "__label", "x").mapInArrow(celled, "__id bigint, __label double, x array<double>, cell int, away double")
    )
    sizes, radius = {}, np.full(len(middle), -np.inf)
    for row in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).collect():
        sizes[row.cell], radius[row.cell] = row.n, row.r
    holds = np.array([sizes.get(c, 0) for c in range(len(middle))])
    step = max(1, PAIR_NUMBERS // (width + 2))
    asking = queries.count()
    most = max(1, BLOCK_BYTES // (8 * (width + 2)))
    # Rows of a group's points and of its queries: as few groups as memory and parallel work allow.
    room, chunk_room = (max(block_rows, min(most, -(-n // parts))) for n, parts in ((size, GROUPS), (asking, CHUNKS)))
    cells, first_group, groups_of = grouped(holds, room)

    def home(away: np.ndarray) -> np.ndarray:
        """Which cells, nearest first, together hold k points."""
        order = np.argsort(away, axis=1, kind="stable")
        before = np.cumsum(holds[order], axis=1) - holds[order]
        wanted = np.zeros(away.shape, bool)
        np.put_along_axis(wanted, order, (before < k) & (holds[order] > 0), axis=1)
        return wanted

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from pairs_of(batch, home(distances(matrix(batch.column("x"), width), middle, p)), step)

    apart = distances(middle, middle, p)

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for batch in batches:
            away = distances(matrix(batch.column("x"), width), middle, p)
            bound = batch.column("bound").to_numpy(zero_copy_only=False)[:, None]
            slack = SLACK * (1 + away)
            near = away - radius - slack <= bound
            if p == 2:
                own = away.argmin(axis=1)
                gap = np.maximum(apart[own], 1e-300)
                near &= (away**2 - away[np.arange(len(away)), own][:, None] ** 2) / (2 * gap) - slack <= bound
            yield batch, near & (holds > 0) & ~home(away)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, wanted in reached(batches):
            yield from by_group(batch, wanted, cells, step)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many queries want each cell, and each group."""
        total = np.zeros(len(holds) + len(cells), np.int64)
        for _, wanted in reached(batches):
            total += np.concatenate([wanted.sum(axis=0), [wanted[:, own].any(axis=1).sum() for own in cells]]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["spot", "n"])

    def met(a: pa.Table, found: list[tuple[np.ndarray, ...]], b: pa.Table) -> pa.Table:
        """Lists from query rows, point rows and distances, each part's query rows in order."""
        lists = []
        labels, ids = b.column("__label").to_numpy().astype(float), b.column("__id").to_numpy()
        for rows, cols, dist in found:
            # Nulls where a number is none, as pandas has them.
            items = pa.StructArray.from_arrays(
                [pa.array(dist, from_pandas=True), pa.array(ids[cols]), pa.array(labels[cols], from_pandas=True)], names=["distance", "id", "label"]
            )
            own, start = np.unique(rows, return_index=True)
            offsets = pa.array(np.append(start, len(rows)), pa.int32())
            lists.append(pa.table({"__q": a.column("__q").combine_chunks().take(pa.array(own)), "neighbors": pa.ListArray.from_arrays(offsets, items)}))
        return pa.concat_tables(lists) if lists else pa.table({"__q": pa.array([], pa.int64()), "neighbors": pa.array([], NEIGHBORS)})

    def searched(pairs: DataFrame) -> tuple[DataFrame, int]:
        pairs = cut_lineage(pairs)
        asked = {r.cell: r.n for r in pairs.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        blocks, chunks = _spread(sizes, room, len(middle)), _spread(asked, chunk_room, len(middle))
        left = pairs.withColumn("chunk", F.pmod(F.xxhash64("__q"), chunks).cast("int"))
        left = left.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        right = dealt.where(F.col("cell").isin(list(asked))).withColumn("block", F.pmod(F.xxhash64("__id"), blocks).cast("int"))
        right = right.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            if not len(a) or not len(b):
                return met(a, [], b)
            x, y = (matrix(side.column("x").combine_chunks(), width) for side in (a, b))
            return met(a, [search(x, y, b.column("__id").to_numpy(), k, p)], b)

        key = ["cell", "block", "chunk"]
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, f"__q bigint, neighbors {schema}")
        return found, sum(n * sizes[c] for c, n in asked.items())

    found, compared = searched(queries.select("__q", "x").mapInArrow(first, "__q bigint, x array<double>, cell int"))
    found = cut_lineage(merged(found, k))
    bounds = found.select("__q", F.when(F.size("neighbors") >= k, F.element_at("neighbors", -1)["distance"]).otherwise(float("inf")).alias("bound"))
    bounded = cut_lineage(queries.join(bounds, "__q").select("__q", "x", "bound"))
    wants = np.zeros(len(holds) + len(cells), np.int64)
    for row in bounded.mapInArrow(counted, "spot int, n bigint").groupBy("spot").agg(F.sum("n").alias("n")).collect():
        wants[row.spot] = row.n
    chunks = _spread(dict(enumerate(wants[len(holds) :].tolist())), chunk_room, len(cells), "group")
    left = bounded.mapInArrow(second, "__q bigint, x array<double>, bound double, group int, bits binary")
    left = left.withColumn("chunk", F.pmod(F.xxhash64("__q"), chunks).cast("int"))
    start, number = (F.array(*[F.lit(int(v)) for v in values])[F.col("cell")] for values in (first_group, groups_of))
    right = dealt.withColumn("group", (start + F.pmod(F.xxhash64("__id"), number)).cast("int"))
    right = right.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))

    def meet_cells(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return met(a, [], b)
        own = cells[a.column("group")[0].as_py()]
        wanted = np.unpackbits(np.frombuffer(b"".join(a.column("bits").to_pylist()), np.uint8).reshape(len(a), -1), axis=1, count=len(own))
        x, y = (matrix(side.column("x").combine_chunks(), width) for side in (a, b))
        limit, ids, cell = a.column("bound").to_numpy(), b.column("__id").to_numpy(), b.column("cell").to_numpy()
        found = []
        for nth, c in enumerate(own):
            mine, near = np.flatnonzero(wanted[:, nth]), np.flatnonzero(cell == c)
            if len(mine) and len(near):
                rows, cols, dist = search(x[mine], y[near], ids[near], k, p, limit[mine])
                found.append((mine[rows], near[cols], dist))
        return met(a, found, b)

    key = ["group", "chunk"]
    more = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet_cells, f"__q bigint, neighbors {schema}")
    compared_more = int((wants[: len(holds)] * holds).sum())
    return Found(merged(found.unionByName(more), k), compared + compared_more, size * asking)


#: Rows in which the lists of one query meet before the last step.
MERGED_SHARES = 64


def merged(lists: DataFrame, k: int) -> DataFrame:
    """One list per query, in two steps, so that no row gathers the lists of all blocks."""
    best = F.slice(F.sort_array(F.flatten(F.collect_list("neighbors"))), 1, k).alias("neighbors")
    share = F.pmod(F.xxhash64("neighbors"), F.lit(MERGED_SHARES)).alias("__share")
    return lists.groupBy("__q", share).agg(best).groupBy("__q").agg(best)
