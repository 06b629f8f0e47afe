"""Deep regression trees and forests, grown without dense sums for every small node.

Feature values become bin codes once, and each tree draws its rows once; both are written in
blocks to the shared folder. Nodes of many rows are split by sums per (node, feature, bin) that
meet in a task, one job for a level of all trees. A node whose rows fit a task is finished there:
its rows go to that task once, are sorted by every feature, and all levels below are grown from
running sums over these orders, so that a level costs its rows and not its nodes times its bins.

Splits, leaves, bins and draws are those of ``pyspark.ml``: the first split of the largest drop in
variance, sibling leaves of equal value merged, bins between all values or of about equal rows,
and Poisson draws by partition. Bins are counted over all rows, where ``pyspark.ml`` takes a sample.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from ..functions.columns import quoted
from ..functions.quantiles import SKETCH_ACCURACY
from ..session import ensure_checkpoint_dir, remove_folder
from .base import VECTOR, ModelSpec, TabularModel, with_vector

#: Codes (rows times features) of a node that one task finishes, and bytes of sums a task holds.
CELLS, SUM_BYTES = 1 << 21, 32 << 20
#: Distinct values up to which a feature's values are counted one by one.
VALUES = 50_000
#: Impurities below this are none.
PURE = 2.0**-52
BLOCKS = "spot bigint, n int, codes binary, y binary, draws binary"
PACKS = "pack int, spot bigint, n int, rows binary"
GROWN = "pack int, units int, feature binary, cut binary, payload binary, value binary, importance binary"


class JavaPoisson:
    """Draws of a Poisson law of mean 1 as commons-math makes them from a seeded Well19937c."""

    def __init__(self, seed: int) -> None:
        state = [(seed >> 32) & 0xFFFFFFFF, seed & 0xFFFFFFFF]
        for i in range(2, 624):
            before = state[i - 2] - ((state[i - 2] & 0x80000000) << 1)
            state.append((1812433253 * (before ^ (before >> 30)) + i) & 0xFFFFFFFF)
        self.state, self.index, self.left = state, 0, []

    def _words(self, count: int) -> np.ndarray:
        v, i, out = self.state, self.index, []
        put = out.append
        for _ in range(count):
            a, m1, m3 = v[i], v[i - 554], v[i - 175]
            z1 = (a ^ (a << 25) ^ m1 ^ (m1 >> 27)) & 0xFFFFFFFF
            z2 = (v[i - 445] >> 9) ^ m3 ^ (m3 >> 1)
            z3 = z1 ^ z2
            v[i] = z3
            z4 = ((v[i - 1] & 0x80000000) ^ (v[i - 2] & 0x7FFFFFFF) ^ z1 ^ (z1 << 9) ^ z2 ^ (z2 << 21) ^ z3 ^ (z3 >> 21)) & 0xFFFFFFFF
            v[i - 2] &= 0x80000000
            i -= 1
            v[i] = z4
            if i < 0:
                i += 624
            put(z4)
        self.index = i
        z = np.array(out, np.uint32)
        z ^= (z << np.uint32(7)) & np.uint32(0xE46E1700)
        return z ^ ((z << np.uint32(15)) & np.uint32(0x9B868000))

    def take(self, count: int) -> np.ndarray:
        found: list[int] = []
        limit, product, n = math.exp(-1.0), 1.0, 0
        while len(found) < count:
            z = self._words(4 * (count - len(found)) + 64).astype(np.uint64) >> np.uint64(6)
            values = self.left + (((z[::2] << np.uint64(26)) | z[1::2]) * 2.0**-52).tolist()
            self.left = []
            for at, u in enumerate(values):
                product *= u
                if product >= limit:
                    n += 1
                    continue
                found.append(n)
                product, n = 1.0, 0
                if len(found) == count:
                    self.left = values[at + 1 :]
                    break
        return np.minimum(found, 255).astype(np.uint8)


def cuts_between(values: np.ndarray, counts: np.ndarray, splits: int) -> np.ndarray:
    """Thresholds between all values if they are few, else where about equal shares of the rows meet."""
    middle = (values[:-1] + values[1:]) / 2.0
    if len(middle) <= splits:
        return middle
    stride = counts.sum() / (splits + 1)
    below = np.cumsum(counts).tolist()
    chosen, target = [], stride
    for i in range(1, len(below)):
        if abs(below[i - 1] - target) < abs(below[i] - target):
            chosen.append(i - 1)
            target += stride
    return middle[chosen]


def tree_edges(rows: DataFrame, width: int, size: int, bins: int) -> list[np.ndarray]:
    """Per feature of the array ``x`` its thresholds."""
    splits = min(bins, size) - 1
    about = rows.agg(*[F.approx_count_distinct(F.get("x", i)).alias(f"n{i}") for i in range(width)]).first()
    few = [i for i in range(width) if about[i] <= VALUES]
    edges: dict[int, np.ndarray] = {}
    if few:
        pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.get("x", i).alias("v")) for i in few]))
        found = rows.select(pairs.alias("p")).groupBy("p.f", "p.v").count().toArrow().to_pandas()
        for i in few:
            own = found[found["f"] == i].sort_values("v")
            edges[i] = cuts_between(own["v"].to_numpy(dtype=float), own["count"].to_numpy(), splits)
    many = [i for i in range(width) if i not in edges]
    if many:
        shares = [j / (splits + 1) for j in range(1, splits + 1)]
        row = rows.agg(*[F.percentile_approx(F.get("x", i), shares, SKETCH_ACCURACY).alias(f"q{i}") for i in many]).first()
        edges |= {i: np.unique(row[f"q{i}"]) for i in many}
    return [edges[i] for i in range(width)]


def coded(x: np.ndarray, edges: Sequence[np.ndarray], kind: type) -> np.ndarray:
    """Bin codes, one row per feature."""
    return np.stack([np.searchsorted(cuts, x[:, f], "left").astype(kind) for f, cuts in enumerate(edges)])


def impurity(w: np.ndarray, y: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Variance from rows, sums and sums of squares."""
    return (q - y * y / w) / w


@dataclass
class Branches:
    """Nodes by number. ``payload`` is the left child (the right one follows), or the value of a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    payload: np.ndarray

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The node each row comes to rest in; ``codes`` has one row per feature."""
        node = np.zeros(codes.shape[1], np.int64)
        rows = np.arange(codes.shape[1])
        f = self.feature[node]
        while True:
            inner = f >= 0
            rows, f = rows[inner], f[inner]
            if not len(rows):
                return node
            at = node[rows]
            at = self.payload[at].astype(np.int64) + (codes[f, rows] > self.cut[at])
            node[rows] = at
            f = self.feature[at]


def merge_equal(feature: np.ndarray, left: np.ndarray, value: np.ndarray, levels: Sequence[int]) -> None:
    """Nodes whose children are leaves of one value become leaves; ``levels`` are the starts of the levels."""
    for start, end in zip(reversed(levels[:-1]), reversed(levels[1:])):
        inner = start + np.flatnonzero(feature[start:end] >= 0)
        below = left[inner]
        same = (feature[below] < 0) & (feature[below + 1] < 0) & (value[below] == value[below + 1])
        feature[inner[same]] = -1


def grow_units(
    codes: np.ndarray, y: np.ndarray, w: np.ndarray, unit: np.ndarray, depths: np.ndarray, deepest: int, least: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All levels below some nodes, from their rows: feature, cut, left child, value and importance.

    ``codes`` has one row per feature; node i of the result is unit i, whose rows have ``unit`` i
    and which lies ``depths[i]`` below its root.
    """
    width, units = len(codes), len(depths)
    wy = w * y
    wyy = wy * y

    def totals(group: np.ndarray, size: int) -> list[np.ndarray]:
        return [np.bincount(group, v, size) for v in (w, wy, wyy)]

    def spread(group: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        low, high = np.full(size, np.inf), np.full(size, -np.inf)
        np.minimum.at(low, group, values)
        np.maximum.at(high, group, values)
        return low < high

    W, Y, Q = totals(unit, units)
    with np.errstate(invalid="ignore", divide="ignore"):
        values = [np.where(W > 0, Y / W, 0.0)]
        spot = impurity(W, Y, Q)
    features, cuts, lefts, gains = [np.full(units, -1, np.int32)], [np.zeros(units, np.int32)], [np.zeros(units, np.int64)], [np.zeros(units)]
    levels, made = [0, units], units
    alive = spread(unit, y, units) & (depths < deepest)
    depth = depths
    slot_of = np.where(alive, np.cumsum(alive) - 1, -1)[unit]
    orders = [np.argsort(codes[f], kind="stable") for f in range(width)]
    place = np.flatnonzero(alive)  # of each slot, within the level
    while len(place):
        W, Y, Q, spot, depth = W[place], Y[place], Q[place], spot[place], depth[place]
        count = len(place)
        kind = np.uint16 if count < 65_536 else np.int64
        for f in range(width):
            own = slot_of[orders[f]]
            kept = own >= 0
            orders[f] = orders[f][kept][np.argsort(own[kept].astype(kind), kind="stable")]
        rows = orders[0]
        node = slot_of[rows]
        sizes = np.bincount(node, minlength=count)
        starts = np.cumsum(sizes) - sizes
        within = node[1:] == node[:-1]
        best, chosen, cut = np.zeros(count), np.full(count, -1, np.int32), np.zeros(count, np.int32)
        LW, LY, LQ = np.zeros(count), np.zeros(count), np.zeros(count)
        for f in range(width):
            order = orders[f]
            code = codes[f][order]
            ends = np.flatnonzero(within & (code[1:] != code[:-1]))
            if not len(ends):
                continue
            at = node[ends]
            sums = []
            for v in (w, wy, wyy):
                running = np.cumsum(v[order])
                before = np.where(starts > 0, running[starts - 1], 0.0)
                sums.append(running[ends] - before[at])
            lw, ly, lq = sums
            tw = W[at]
            rw, ry, rq = tw - lw, Y[at] - ly, Q[at] - lq
            gain = spot[at] - lw / tw * impurity(lw, ly, lq) - rw / tw * impurity(rw, ry, rq)
            if least > 1:
                gain = np.where((lw >= least) & (rw >= least), gain, -np.inf)
            first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
            top = np.maximum.reduceat(gain, first)
            hits = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(first, len(at)))))
            where, nodes = hits[np.searchsorted(hits, first)], at[first]
            better = top > best[nodes]
            where, nodes = where[better], nodes[better]
            best[nodes], chosen[nodes], cut[nodes] = top[better], f, code[ends[where]]
            LW[nodes], LY[nodes], LQ[nodes] = lw[where], ly[where], lq[where]
        split = np.flatnonzero(chosen >= 0)
        last = levels[-2]
        ids = last + place[split]
        # Nodes of the level before are in the last chunk of every list.
        features[-1][place[split]], cuts[-1][place[split]] = chosen[split], cut[split]
        lefts[-1][place[split]] = made + 2 * np.arange(len(split))
        gains[-1][place[split]] = best[split] * W[split]
        if not len(ids):
            break
        rank = np.full(count, -1)
        rank[split] = np.arange(len(split))
        moved = rank[node] >= 0
        rows, at = rows[moved], node[moved]
        child = 2 * rank[at] + (codes[chosen[at], rows] > cut[at])
        pair = lambda a, b: np.column_stack([a, b]).ravel()
        W, Y, Q = (pair(l[split], t[split] - l[split]) for l, t in ((LW, W), (LY, Y), (LQ, Q)))
        spot, depth = impurity(W, Y, Q), np.repeat(depth[split] + 1, 2)
        values.append(Y / W)
        size = len(W)
        for out, start in ((features, np.full(size, -1, np.int32)), (cuts, np.zeros(size, np.int32)), (lefts, np.zeros(size, np.int64)), (gains, np.zeros(size))):
            out.append(start)
        made += size
        levels.append(made)
        alive = spread(child, y[rows], size) & (depth < deepest) & (np.abs(spot) >= PURE)
        slot_of = np.full(len(y), -1)
        slot_of[rows] = np.where(alive, np.cumsum(alive) - 1, -1)[child]
        place = np.flatnonzero(alive)
    feature, left, value, gain = np.concatenate(features), np.concatenate(lefts), np.concatenate(values), np.concatenate(gains)
    merge_equal(feature, left, value, levels)
    inner = feature >= 0
    return feature, np.concatenate(cuts), left, value, np.bincount(feature[inner], gain[inner], width)


@dataclass
class Trunk:
    """The upper nodes of a tree, split by sums; open ones wait to be finished in a task."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])
    rows: list[int] = field(default_factory=lambda: [0])
    open: set[int] = field(default_factory=lambda: {0})

    def add(self, value: float, depth: int, rows: int) -> int:
        for column, start in zip((self.feature, self.cut, self.left, self.value, self.gain, self.depth, self.rows), (-1, 0, 0, value, 0.0, depth, rows)):
            column.append(start)
        return len(self.feature) - 1

    def branches(self) -> Branches:
        return Branches(np.array(self.feature, np.int32), np.array(self.cut, np.int32), np.array(self.left, float))


class Grower:
    """One training run over a written table of blocks of codes, labels and draws."""

    def __init__(self, rows: DataFrame, spec: ModelSpec, trees: int, drawn: bool, deepest: int, least: int, bins: int, seed: int) -> None:
        self.spark, self.spec = rows.sparkSession, spec
        self.trees, self.deepest, self.least = trees, deepest, least
        self.width = len(spec.features)
        rows = rows.select(vector_to_array(VECTOR).alias("x"), F.col("__label").alias("y"))
        lost = F.col("y").isNull() | F.isnan("y") | (F.abs("y") == F.lit(math.inf))
        row = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(lost).alias("lost")).first()
        if row.lost:
            raise ValueError(f"{row.lost} rows have a null or infinite label")
        if not row.n:
            raise ValueError("no rows to train on")
        self.size = row.n
        self.most = max(1, CELLS // self.width)
        self.edges = tree_edges(rows, self.width, self.size, bins)
        self.bins = max(len(e) for e in self.edges) + 1
        self.kind = np.uint8 if self.bins <= 256 else np.uint16
        self.folder = f"{ensure_checkpoint_dir(self.spark)}/grown-{uuid.uuid4().hex}"
        self._blocks(rows, drawn, seed).write.parquet(self.folder)
        self.blocks = self.spark.read.parquet(self.folder)
        self.trunks = [Trunk() for _ in range(trees)]

    def _blocks(self, rows: DataFrame, drawn: bool, seed: int) -> DataFrame:
        edges, kind, trees, width = self.edges, self.kind, self.trees, self.width

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            draw = JavaPoisson(seed + part + 1) if drawn else None
            for number, batch in enumerate(batches):
                n = batch.num_rows
                if not n:
                    continue
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, width)
                y = np.ascontiguousarray(batch.column("y").to_numpy(zero_copy_only=False))
                draws = b"" if draw is None else np.ascontiguousarray(draw.take(n * trees).reshape(n, trees).T).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in (((part << 32) + number, pa.int64()), (n, pa.int32()), (coded(x, edges, kind).tobytes(), pa.binary()), (y.tobytes(), pa.binary()), (draws, pa.binary()))],
                    names=["spot", "n", "codes", "y", "draws"],
                )

        return rows.mapInArrow(work, BLOCKS)

    def _reader(self):
        """A function from an Arrow batch to its blocks: number, codes, labels and draws per tree."""
        kind, trees, width = self.kind, self.trees, self.width

        def read(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
            for spot, n, codes, y, draws in zip(*(batch.column(c) for c in ("spot", "n", "codes", "y", "draws"))):
                n, held = n.as_py(), draws.as_buffer()
                drawn = np.frombuffer(held, np.uint8).reshape(trees, n) if held.size else np.ones((trees, n), np.uint8)
                yield spot.as_py(), np.frombuffer(codes.as_buffer(), kind).reshape(width, n), np.frombuffer(y.as_buffer(), float), drawn

        return read

    def grow(self) -> GrownTrees:
        try:
            asked = [(t, 0) for t in range(self.trees)] if self.size > self.most else []
            together = max(1, SUM_BYTES // (4 * 8 * self.width * self.bins))
            while asked:
                fresh = []
                for at in range(0, len(asked), together):
                    fresh += self._split(asked[at : at + together])
                asked = fresh
            return self._finished()
        finally:
            remove_folder(self.spark, self.folder)

    def _split(self, asked: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Split nodes by sums of all rows; returns those children that have too many rows for a task."""
        read, width, bins, least = self._reader(), self.width, self.bins, self.least
        wanted: dict[int, dict[int, int]] = {}
        for slot, (t, node) in enumerate(asked):
            wanted.setdefault(t, {})[node] = slot
        trunks = {t: self.trunks[t].branches() for t in wanted}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(asked), width, 4, bins))
            for batch in batches:
                for _, codes, y, draws in read(batch):
                    for t, slots in wanted.items():
                        slot_of = np.full(len(trunks[t].feature), -1)
                        slot_of[list(slots)] = list(slots.values())
                        slot = slot_of[trunks[t].leaves(codes)]
                        rows = np.flatnonzero((slot >= 0) & (draws[t] > 0))
                        low, high = min(slots.values()), max(slots.values()) + 1
                        w = draws[t][rows].astype(float)
                        wy = w * y[rows]
                        measures = (None, w, wy, wy * y[rows])
                        base = (slot[rows] - low) * bins
                        for f in range(width):
                            cell = base + codes[f, rows]
                            for j, v in enumerate(measures):
                                total[low:high, f, j] += np.bincount(cell, v, (high - low) * bins).reshape(-1, bins)
            seen = [s for s in range(len(asked)) if total[s, 0, 0].any()]
            for s in seen:
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([total[s].tobytes()], pa.binary())], names=["slot", "sums"])

        numbers = [len(e) for e in self.edges]

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for slot, sums in zip(batch.column("slot").to_pylist(), batch.column("sums").to_pylist()):
                    part = np.frombuffer(sums).reshape(width, 4, bins)
                    held[slot] = held[slot] + part if slot in held else part
            for slot, sums in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([slot], pa.int32()), pa.array([best_by_sums(sums, numbers, least)], pa.list_(pa.float64()))], names=["slot", "found"]
                )

        sums = self.blocks.mapInArrow(count, "slot int, sums binary")
        found = sums.repartition("slot").mapInArrow(best, "slot int, found array<double>").toArrow().to_pylist()
        fresh = []
        for row in sorted(found, key=lambda r: r["slot"]):
            t, node = asked[row["slot"]]
            trunk = self.trunks[t]
            value, gain, feature, cut, count_all, rows, low_rows, low_value, high_value, low_spread, high_spread = row["found"]
            trunk.value[node], trunk.rows[node] = value, int(rows)
            trunk.open.discard(node)
            if gain <= 0:
                continue
            depth = trunk.depth[node] + 1
            trunk.feature[node], trunk.cut[node], trunk.gain[node] = int(feature), int(cut), gain * count_all
            trunk.left[node] = len(trunk.feature)
            for v, n, s in ((low_value, low_rows, low_spread), (high_value, rows - low_rows, high_spread)):
                child = trunk.add(v, depth, int(n))
                if depth < self.deepest and abs(s) >= PURE:
                    trunk.open.add(child)
                    if n > self.most:
                        fresh.append((t, child))
        return fresh

    def _finished(self) -> GrownTrees:
        """Finish all open nodes in tasks, packed by tree, and put the trees together."""
        packs: list[tuple[int, list[int]]] = []
        for t, trunk in enumerate(self.trunks):
            held = self.most
            for node in sorted(trunk.open):
                rows = trunk.rows[node] or self.size
                if held + rows > self.most:
                    packs.append((t, []))
                    held = 0
                packs[-1][1].append(node)
                held += rows
        found = self._packed(packs) if packs else []
        width = self.width
        parts: list[list[dict]] = [[] for _ in self.trunks]
        for row in found:
            parts[packs[row["pack"]][0]].append(row)
        trees, total = [], np.zeros(width)
        for t, trunk in enumerate(self.trunks):
            tree, own = _joined(trunk, sorted(parts[t], key=lambda r: r["pack"]), packs, self.kind, width)
            trees.append(tree)
            total += own / own.sum() if own.sum() else own
        importance = total / total.sum() if total.sum() else total
        return GrownTrees(self.spec, self.edges, trees, importance.tolist())

    def _packed(self, packs: list[tuple[int, list[int]]]) -> list[dict]:
        read, kind, width = self._reader(), self.kind, self.width
        deepest, least = self.deepest, self.least
        depths = [np.array([self.trunks[t].depth[n] for n in nodes]) for t, nodes in packs]
        trunks = {t: self.trunks[t].branches() for t, _ in packs}
        where: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for number, (t, nodes) in enumerate(packs):
            pack, unit = where.setdefault(t, (np.full(len(trunks[t].feature), -1), np.zeros(len(trunks[t].feature), np.int32)))
            pack[nodes], unit[nodes] = number, np.arange(len(nodes))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for spot, codes, y, draws in read(batch):
                    for t, (pack, unit) in where.items():
                        rows = np.flatnonzero(draws[t])
                        mine = codes[:, rows]
                        node = trunks[t].leaves(mine)
                        own = pack[node]
                        out = []
                        for p in np.unique(own[own >= 0]).tolist():
                            at = np.flatnonzero(own == p)
                            picked = rows[at]
                            out.append((p, spot, len(at), b"".join((unit[node[at]].tobytes(), draws[t][picked].tobytes(), y[picked].tobytes(), mine[:, at].tobytes()))))
                        if out:
                            columns = zip(*out)
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["pack", "spot", "n", "rows"])

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[tuple[int, int, bytes]]] = {}
            for batch in batches:
                for p, spot, n, rows in zip(*(batch.column(c).to_pylist() for c in ("pack", "spot", "n", "rows"))):
                    held.setdefault(p, []).append((spot, n, rows))
            for p in list(held):
                # In a fixed order, so that the sums do not depend on which block came first.
                pieces = [_opened(n, rows, kind, width) for _, n, rows in sorted(held.pop(p), key=lambda r: r[0])]
                unit, w, y = (np.concatenate([piece[i] for piece in pieces]) for i in range(3))
                codes = np.concatenate([piece[3] for piece in pieces], axis=1)
                feature, cut, left, value, importance = grow_units(codes, y, w.astype(float), unit, depths[p], deepest, least)
                payload = np.where(feature >= 0, left.astype(float), value)
                roots = value[: len(depths[p])]
                small = np.int8 if width < 128 else np.int32
                blobs = [feature.astype(small).tobytes(), cut.astype(kind).tobytes(), payload.tobytes(), roots.tobytes(), importance.tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p], pa.int32()), pa.array([len(depths[p])], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)],
                    names=[c.split()[0] for c in GROWN.split(", ")],
                )

        dealt = self.blocks.mapInArrow(deal, PACKS).repartition(min(len(packs), 1000), "pack")
        return dealt.mapInArrow(finish, GROWN).toArrow().to_pylist()


def _opened(n: int, rows: bytes, kind: type, width: int) -> tuple[np.ndarray, ...]:
    unit = np.frombuffer(rows, np.int32, n)
    w = np.frombuffer(rows, np.uint8, n, 4 * n)
    y = np.frombuffer(rows, float, n, 5 * n)
    return unit, w, y, np.frombuffer(rows, kind, offset=13 * n).reshape(width, n)


def best_by_sums(sums: np.ndarray, numbers: Sequence[int], least: int) -> list[float]:
    """Of a node its value, and its best split with rows, values and impurities of both sides.

    ``sums`` has per feature rows, drawn rows, sums and sums of squares by bin.
    """
    count, W, Y, Q = sums[0].sum(axis=1)
    low = np.cumsum(sums, axis=2)[:, :, :-1] if sums.shape[2] > 1 else np.zeros((len(sums), 4, 0))
    lw, ly, lq = low[:, 1], low[:, 2], low[:, 3]
    rw, ry, rq = W - lw, Y - ly, Q - lq
    with np.errstate(invalid="ignore", divide="ignore"):
        left, right = impurity(lw, ly, lq), impurity(rw, ry, rq)
        gain = impurity(W, Y, Q) - lw / W * left - rw / W * right
    fits = (lw >= max(least, 1)) & (rw >= max(least, 1)) & (np.arange(gain.shape[1]) < np.array(numbers)[:, None])
    gain = np.where(fits, gain, -np.inf)
    if not gain.size or not gain.max() > 0:
        return [Y / W, 0.0, 0, 0, W, count, 0, 0, 0, 0, 0]
    f, c = np.unravel_index(gain.argmax(), gain.shape)
    return [
        Y / W, gain[f, c], f, c, W, count, low[f, 0, c], ly[f, c] / lw[f, c], ry[f, c] / rw[f, c], left[f, c], right[f, c],
    ]


def _joined(trunk: Trunk, parts: list[dict], packs: list[tuple[int, list[int]]], kind: type, width: int) -> tuple[Branches, np.ndarray]:
    """A whole tree and its importances: the trunk, its open nodes replaced by what the tasks have grown."""
    small = np.int8 if width < 128 else np.int32
    feature, cut = [np.array(trunk.feature, np.int32)], [np.array(trunk.cut, np.int64)]
    value, left = np.array(trunk.value), np.array(trunk.left, float)
    payload, importance, made = [left], np.zeros(width), len(trunk.feature)
    done = np.zeros(len(trunk.feature), bool)
    for row in parts:
        nodes, units = packs[row["pack"]][1], row["units"]
        f, c, p = np.frombuffer(row["feature"], small), np.frombuffer(row["cut"], kind), np.frombuffer(row["payload"]).copy()
        p[f >= 0] += made - units
        feature[0][nodes], cut[0][nodes], left[nodes] = f[:units], c[:units], p[:units]
        value[nodes] = np.frombuffer(row["value"])
        done[nodes] = True
        feature.append(f[units:])
        cut.append(c[units:])
        payload.append(p[units:])
        made += len(f) - units
        importance += np.frombuffer(row["importance"])
    upper = feature[0]
    for node in reversed(range(len(upper))):
        if upper[node] < 0:
            left[node] = value[node]
        elif not done[node]:
            a = int(left[node])
            if upper[a] < 0 and upper[a + 1] < 0 and value[a] == value[a + 1]:
                upper[node], left[node] = -1, value[node]
            else:
                importance[upper[node]] += trunk.gain[node]
    return Branches(np.concatenate([v.astype(small) for v in feature]), np.concatenate([v.astype(kind) for v in cut]), np.concatenate(payload)), importance


class GrownTrees(TabularModel):
    """The mean of regression trees of any depth."""

    kind = "grown_trees"

    def __init__(self, spec: ModelSpec, edges: Sequence[Sequence[float]], trees: list[Branches], importance: list[float]) -> None:
        super().__init__(spec)
        self.edges = [np.asarray(e, dtype=float) for e in edges]
        self.trees, self.importance = trees, importance

    def transform(self, df: DataFrame) -> DataFrame:
        data = with_vector(df, self.spec.features)
        edges, width = self.edges, len(self.edges)
        kind = np.uint8 if max(len(e) for e in edges) < 256 else np.uint16
        # Sent as a broadcast: deep trees are more than a closure should carry to each task.
        shared = df.sparkSession.sparkContext.broadcast([(t.feature, t.cut, t.payload) for t in self.trees])

        @arrow_udf(T.DoubleType())
        def predicted(x: pa.Array) -> pa.Array:
            codes = coded(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), width), edges, kind)
            total = np.zeros(len(x))
            for arrays in shared.value:
                total += arrays[2][Branches(*arrays).leaves(codes)]
            return pa.array(total / len(shared.value))

        kept = [quoted(c) for c in df.columns if c != "prediction"]
        return data.select(*kept, predicted(vector_to_array(VECTOR)).alias("prediction"))

    def importances(self) -> list[float]:
        return list(self.importance)

    def _state(self, spark, path) -> Any:
        names = ["feature", "cut", "payload"]
        rows = [pa.array([getattr(t, n).tobytes() for t in self.trees], pa.binary()) for n in names]
        table = pa.Table.from_arrays([pa.array(range(len(self.trees)), pa.int32()), *rows], names=["tree", *names])
        spark.createDataFrame(table).write.mode("overwrite").parquet(f"{path}/trees")
        kinds = [getattr(self.trees[0], n).dtype.str for n in names]
        return [[e.tolist() for e in self.edges], kinds, self.importance]

    @classmethod
    def _restore(cls, spark, path, spec, state):
        edges, kinds, importance = state
        rows = sorted(spark.read.parquet(f"{path}/trees").toArrow().to_pylist(), key=lambda r: r["tree"])
        trees = [Branches(*(np.frombuffer(r[n], k) for n, k in zip(("feature", "cut", "payload"), kinds))) for r in rows]
        return cls(spec, edges, trees, importance)


def grow_trees(
    rows: DataFrame, spec: ModelSpec, trees: int, drawn: bool, deepest: int, least: int, bins: int, seed: int
) -> GrownTrees:
    """Regression trees over a kept table of vectors and labels; ``drawn`` trees draw their rows with replacement."""
    return Grower(rows, spec, trees, drawn, deepest, least, bins, seed).grow()
