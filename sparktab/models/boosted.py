"""Second-order gradient boosting of histogram trees.

Feature values become bin codes once. The table of codes, labels and margins is written to the
shared folder and read in every pass; margins are written anew every few rounds, and between
two writes a pass adds the few trees grown since. For each level of a round's trees (one tree
per class) one grouped job sums gradients, hessians and rows per (tree, node, feature, bin); no
row moves. The sums of a node meet in a task that scans them for its best split:

    score(G, H) = soft(G, l1)^2 / (H + l2),   gain = (score(left) + score(right) - score(parent)) / 2,

a leaf is worth -soft(G, l1) / (H + l2). Missing values have a bin of their own and go to the
side that gains more. Trees grow level by level to a depth, splits that gain less than the
penalty being cut back from the leaves up; or best-first to a number of leaves, where each job
looks at all nodes that the best-first order reaches by what is known so far.

Best-first trees are deep and want a job for each of many levels. Where a table's codes fit one task
it is boosted there, all rounds in one job: the same trees from the same sums, each row's node being
kept from level to level.

More than two classes share one softmax. Null features are missing values; rows without a label
are left out of training. Sampled rows are chosen by a hash of the row, sampled features by a
seed, and gains that agree to nine digits count as equal, so partitions do not change a model
whose bins lie between all values; quantile bins are those of Spark's sketch.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.columns import quoted, require_columns
from ..functions.quantiles import SKETCH_ACCURACY
from ..session import ensure_checkpoint_dir, remove_folder
from .base import ModelSpec, TabularModel, class_count

#: Rounds after which the margins are written anew.
REWRITE = 10
#: Codes (rows times features) of a table that one task boosts alone.
CELLS = 1 << 21
#: Gains that differ by less than this share are equal.
SAME = 1e-9
LEAST_GAIN = 1e-6
#: Sums that a task sends on at a time.
CELLS_SENT = 100_000
#: What comes back of a node: its leaf value, and its best split if there is one.
JUDGED = "slot int, value double, gain double, feature int, cut int, missing_left boolean, value_left double, value_right double"


@dataclass(frozen=True)
class Growth:
    """How trees grow."""

    rounds: int = 100
    rate: float = 0.1
    depth: int | None = 6
    leaves: int | None = None
    l1: float = 0.0
    l2: float = 1.0
    penalty: float = 0.0
    least_hessian: float = 1.0
    least_rows: int = 1
    row_share: float = 1.0
    feature_share: float = 1.0
    bins: int = 128
    seed: int = 42
    prior: bool = True
    softmax_factor: float | None = 2.0


@dataclass
class Tree:
    """Nodes by number; leaves have feature -1. ``cut`` is the last bin that goes left."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for column, start in zip((self.feature, self.cut, self.missing_left, self.left, self.right, self.value, self.gain), (-1, 0, False, 0, 0, value, 0.0)):
            column.append(start)
        return len(self.feature) - 1

    def split(self, node: int, found: Split) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.missing_left[node] = found.feature, found.cut, found.missing_left
        self.gain[node] = found.gain
        self.left[node], self.right[node] = self.add(found.values[0]), self.add(found.values[1])
        return self.left[node], self.right[node]


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    cut: int
    missing_left: bool
    values: tuple[float, float]


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Per feature the thresholds between bins: between all values if they are few, else quantiles."""
    x = {f"f{i}": quoted(c).cast("double") for i, c in enumerate(features)}
    values = df.select(*[F.when(~F.isnan(v), v).alias(n) for n, v in x.items()])
    about = values.agg(*[F.approx_count_distinct(n).alias(n) for n in x]).first()
    few = [n for n in x if about[n] <= bins * 1.2]
    edges: dict[str, np.ndarray] = {}
    if few:
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in few]))
        found = values.select(pairs.alias("p")).select("p.*").where("value IS NOT NULL").distinct().toArrow().to_pandas()
        for n in few:
            own = np.sort(found.value[found.name == n].to_numpy(dtype=float))
            if len(own) <= bins:
                edges[n] = (own[1:] + own[:-1]) / 2
    many = [n for n in x if n not in edges]
    shares = [i / bins for i in range(1, bins)]
    if many:
        row = values.agg(*[F.percentile_approx(n, shares, SKETCH_ACCURACY).alias(n) for n in many]).first()
        edges |= {n: np.unique(row[n]) if row[n] else np.zeros(0) for n in many}
    return [edges.get(n, np.zeros(0)) for n in x]


def bin_codes(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Codes 0..len(edges) per feature, one more for a missing value."""
    codes = np.empty(x.shape, np.uint16)
    for f, cuts in enumerate(edges):
        codes[:, f] = np.where(np.isnan(x[:, f]), len(cuts) + 1, np.searchsorted(cuts, x[:, f], "left"))
    return codes


def leaf_of(tree: Tree, codes: np.ndarray, missing: np.ndarray, node: np.ndarray | None = None) -> np.ndarray:
    """The node each row of codes comes to rest in, on from ``node`` if that is given."""
    feature, cut = np.array(tree.feature), np.array(tree.cut)
    to_left, left, right = np.array(tree.missing_left), np.array(tree.left), np.array(tree.right)
    node = np.zeros(len(codes), np.int64) if node is None else node
    rows = np.flatnonzero(feature[node] >= 0)
    while len(rows):
        at = node[rows]
        f = feature[at]
        code = codes[rows, f]
        goes_left = np.where(code == missing[f], to_left[at], code <= cut[at])
        node[rows] = np.where(goes_left, left[at], right[at])
        rows = rows[feature[node[rows]] >= 0]
    return node


def gradients(margins: np.ndarray, y: np.ndarray, kind: str, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss, one column per tree of a round."""
    if kind == "squared":
        return margins - y[:, None], np.ones_like(margins)
    if kind == "logistic":
        p = 1 / (1 + np.exp(-margins))
        return p - y[:, None], np.maximum(p * (1 - p), 1e-16)
    p = np.exp(margins - margins.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    hit = y[:, None] == np.arange(margins.shape[1])
    return p - hit, np.maximum(factor * p * (1 - p), 1e-16)


def sampled(w: np.ndarray, hashes: np.ndarray, share: float, seed: int, round_number: int) -> np.ndarray:
    """The weights of a round: 0 for rows that it leaves out."""
    if share >= 1:
        return w
    mixed = (hashes ^ np.int64(round_number * 0x9E3779B97F4A7C1 + seed)).view(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    return np.where(mixed < np.uint64(share * 2.0**64), w, 0.0)


@dataclass(frozen=True)
class Judge:
    """Finds splits in sums by feature and bin; ``missing`` is each feature's bin of missing values."""

    growth: Growth
    missing: np.ndarray
    width: int

    def _soft(self, g: np.ndarray) -> np.ndarray:
        return np.sign(g) * np.maximum(np.abs(g) - self.growth.l1, 0.0) if self.growth.l1 else g

    def _score(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return self._soft(g) ** 2 / np.maximum(h + self.growth.l2, 1e-16)

    def leaf_value(self, g: float, h: float) -> float:
        return float(-self._soft(np.float64(g)) / max(h + self.growth.l2, 1e-16))

    def best_split(self, sums: np.ndarray, used: np.ndarray) -> Split | None:
        """The best split of one node from its (feature, bin, measure) sums."""
        whole = sums[0].sum(axis=0)
        absent = sums[np.arange(len(used)), self.missing[used]]
        present = sums.copy()
        present[np.arange(len(used)), self.missing[used]] = 0.0
        right_first = np.cumsum(present, axis=1)
        # Missing right, missing left; without missing values both are one.
        sides = np.stack([right_first, right_first + absent[:, None, :]] if absent.any() else [right_first])
        other = whole - sides
        gain = 0.5 * (
            self._score(sides[..., 0], sides[..., 1]) + self._score(other[..., 0], other[..., 1])
            - self._score(whole[0], whole[1])
        )
        allowed = (sides[..., 1] >= self.growth.least_hessian) & (other[..., 1] >= self.growth.least_hessian)
        allowed &= (sides[..., 2] >= self.growth.least_rows) & (other[..., 2] >= self.growth.least_rows)
        cuts = np.arange(self.width)
        allowed &= (cuts < self.missing[used][:, None])[None]
        gain = np.where(allowed, gain, -np.inf)
        best = gain.max()
        if not best > LEAST_GAIN:
            return None
        # The first feature, cut and side among equals; missing goes right unless left is better.
        close = gain >= best - SAME * abs(best)
        feature, cut = np.argwhere(close.any(axis=0))[0]
        side = int(not close[0, feature, cut])
        values = tuple(self.leaf_value(*s[side, feature, cut, :2]) for s in (sides, other))
        return Split(float(best), int(used[feature]), int(cut), bool(side), values)


class Planter:
    """Grows the trees of a round from what ``judged`` finds of their nodes."""

    growth: Growth
    trees_each: int
    missing: np.ndarray
    judge: Judge

    def judged(self, trees: list[Tree], asked: list[list[int]], used: np.ndarray, round_number: int) -> list[tuple[float, Split | None]]:
        raise NotImplementedError

    def grow(self, round_number: int) -> list[Tree]:
        """The trees of one round."""
        rng = np.random.default_rng([self.growth.seed, round_number])
        features = np.arange(len(self.missing))
        take = max(1, round(self.growth.feature_share * len(features)))
        used = features if take == len(features) else np.sort(rng.choice(features, take, replace=False))
        trees = [Tree() for _ in range(self.trees_each)]
        asked = [[tree.add(0.0)] for tree in trees]
        splits: list[dict[int, Split | None]] = [{} for _ in trees]
        depths: list[dict[int, int]] = [{0: 0} for _ in trees]
        while any(asked):
            found = iter(self.judged(trees, asked, used, round_number))
            for k, tree in enumerate(trees):
                for node in asked[k]:
                    value, splits[k][node] = next(found)
                    if node == 0:
                        tree.value[0] = value
            for k, tree in enumerate(trees):
                asked[k] = self._next_nodes(tree, splits[k], depths[k])
        return [self._pruned(tree, found) for tree, found in zip(trees, splits)]

    def _next_nodes(self, tree: Tree, splits: dict[int, Split | None], depths: dict[int, int]) -> list[int]:
        """Split the nodes whose turn has come; their children, as far as they may split again."""
        fresh = []
        for node in self._due(tree, splits):
            if tree.feature[node] < 0:
                for child in tree.split(node, splits[node]):
                    depths[child] = depths[node] + 1
            for child in (tree.left[node], tree.right[node]):
                if child not in splits and (self.growth.depth is None or depths[child] < self.growth.depth):
                    fresh.append(child)
        return fresh

    def _due(self, tree: Tree, splits: dict[int, Split | None]) -> list[int]:
        """Nodes to split by what is known: all of them, or the first ones in best-first order."""
        if self.growth.leaves is None:
            return [n for n, s in splits.items() if s is not None and tree.feature[n] < 0]
        return self._best_first(tree, splits)

    def _best_first(self, tree: Tree, splits: dict[int, Split | None]) -> list[int]:
        heap = [(-splits[0].gain, 0)] if splits.get(0) else []
        order: list[int] = []
        while heap and len(order) < self.growth.leaves - 1:
            _, node = heapq.heappop(heap)
            order.append(node)
            if tree.feature[node] >= 0:
                for child in (tree.left[node], tree.right[node]):
                    if splits.get(child) is not None:
                        heapq.heappush(heap, (-splits[child].gain, child))
        return order

    def _pruned(self, tree: Tree, splits: dict[int, Split | None]) -> Tree:
        """Nodes out of the best-first order, or whose leaves gain too little, become leaves again."""
        keep = set(range(len(tree.feature)))
        if self.growth.leaves is not None:
            keep = set(self._best_first(tree, splits))

        def visit(node: int) -> None:
            if tree.feature[node] < 0:
                return
            visit(tree.left[node])
            visit(tree.right[node])
            ends = tree.feature[tree.left[node]] < 0 and tree.feature[tree.right[node]] < 0
            if ends and (node not in keep or tree.gain[node] < self.growth.penalty):
                tree.feature[node] = -1

        visit(0)
        return _compact(tree)


class LoneTable(Planter):
    """A whole table in one task: codes, labels, weights, hashes and current margins."""

    def __init__(self, growth: Growth, judge: Judge, kind: str, factor: float, codes: np.ndarray, y: np.ndarray, w: np.ndarray, hashes: np.ndarray, margins: np.ndarray) -> None:
        self.growth, self.judge, self.kind, self.factor, self.missing = growth, judge, kind, factor, judge.missing
        self.trees_each = margins.shape[1]
        self.codes, self.by_feature, self.y, self.w, self.hashes, self.margins = codes, np.ascontiguousarray(codes.T), y, w, hashes, margins

    def judged(self, trees: list[Tree], asked: list[list[int]], used: np.ndarray, round_number: int) -> list[tuple[float, Split | None]]:
        found: list[tuple[float, Split | None]] = []
        for k, tree in enumerate(trees):
            if not asked[k]:
                continue
            self.nodes[k] = leaf_of(tree, self.codes, self.missing, self.nodes[k])
            slot_of = np.full(len(tree.feature), -1)
            slot_of[asked[k]] = np.arange(len(asked[k]))
            slot = slot_of[self.nodes[k]]
            rows = np.flatnonzero((slot >= 0) & (self.weight > 0))
            width = self.judge.width
            base, g, h = slot[rows] * width, self.g[rows, k], self.h[rows, k]
            sums = np.empty((len(asked[k]), len(used), width, 3))
            for i, f in enumerate(used):
                cell = base + self.by_feature[f][rows]
                for j, values in enumerate((g, h, None)):
                    sums[:, i, :, j] = np.bincount(cell, values, len(asked[k]) * width).reshape(-1, width)
            for node in sums:
                whole = node[0].sum(axis=0)
                found.append((self.judge.leaf_value(whole[0], whole[1]), self.judge.best_split(node, used)))
        return found

    def boost(self) -> list[list[Tree]]:
        rounds = []
        for n in range(self.growth.rounds):
            self.weight = sampled(self.w, self.hashes, self.growth.row_share, self.growth.seed, n)
            g, h = gradients(self.margins, self.y, self.kind, self.factor)
            self.g, self.h = g * self.weight[:, None], h * self.weight[:, None]
            self.nodes = [np.zeros(len(self.y), np.int64) for _ in range(self.trees_each)]
            trees = self.grow(n)
            for k, tree in enumerate(trees):
                self.margins[:, k] += self.growth.rate * np.array(tree.value)[leaf_of(tree, self.codes, self.missing)]
            rounds.append(trees)
        return rounds


class Booster(Planter):
    """One training run over a written table of codes, labels, weights, hashes and margins."""

    def __init__(self, df: DataFrame, spec: ModelSpec, growth: Growth, weight: str | None) -> None:
        require_columns(df, [*spec.features, spec.label])
        self.growth, self.spec, self.spark = growth, spec, df.sparkSession
        known = df.where(quoted(spec.label).isNotNull())
        self.kind, self.trees_each = "squared", 1
        if spec.problem_type == "classification":
            classes = class_count(known, spec.label)
            self.kind, self.trees_each = ("logistic", 1) if classes <= 2 else ("softmax", classes)
        self.factor = growth.softmax_factor or self.trees_each / max(self.trees_each - 1, 1)
        self.edges = bin_edges(known, spec.features, growth.bins)
        self.missing = np.array([len(e) + 1 for e in self.edges])
        self.width = int(self.missing.max()) + 1
        self.judge = Judge(growth, self.missing, self.width)
        self.folder = f"{ensure_checkpoint_dir(self.spark)}/boosted-{uuid.uuid4().hex}"
        self.margin_names = [f"m{k}" for k in range(self.trees_each)]
        self.recent: list[list[Tree]] = []
        self.rounds: list[list[Tree]] = []
        x = [quoted(c).cast("double").alias(f"f{i}") for i, c in enumerate(spec.features)]
        y = quoted(spec.label).cast("double")
        w = F.lit(1.0) if weight is None else quoted(weight).cast("double")
        hashed = F.xxhash64(F.lit(growth.seed), *[quoted(c).cast("double") for c in spec.features], y)
        rows = known.select(*x, y.alias("y"), w.alias("w"), hashed.alias("row"))
        self.start = self._prior(rows) if growth.prior else np.zeros(self.trees_each)
        self.state = self._written(self._coded(rows), 0)

    def _prior(self, rows: DataFrame) -> np.ndarray:
        """Margins before the first tree: mean, log-odds or log shares."""
        if self.kind == "softmax":
            found = {int(r.y): r.w for r in rows.groupBy("y").agg(F.sum("w").alias("w")).collect()}
            shares = np.array([found.get(k, 0.0) for k in range(self.trees_each)])
            return np.log(np.maximum(shares / max(shares.sum(), 1e-300), 1e-15))
        row = rows.agg(F.sum(F.col("w") * F.col("y")).alias("y"), F.sum("w").alias("w")).first()
        mean = (row.y or 0.0) / row.w if row.w else 0.0
        if self.kind == "squared":
            return np.array([mean])
        mean = min(max(mean, 1e-15), 1 - 1e-15)
        return np.array([np.log(mean / (1 - mean))])

    def _coded(self, rows: DataFrame) -> DataFrame:
        edges, start, width = self.edges, self.start, len(self.edges)

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)])
                codes = bin_codes(x, edges)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * width), len(codes), [None, pa.py_buffer(codes.tobytes())])
                margins = [pa.array(np.full(len(codes), s)) for s in start]
                yield pa.RecordBatch.from_arrays(
                    [packed.cast(pa.binary()), *(batch.column(c) for c in ("y", "w", "row")), *margins],
                    names=["codes", "y", "w", "row", *(f"m{k}" for k in range(len(start)))],
                )

        return rows.mapInArrow(code, self._schema())

    def _schema(self) -> str:
        return "codes binary, y double, w double, row bigint, " + ", ".join(f"{m} double" for m in self.margin_names)

    def _written(self, rows: DataFrame, number: int) -> DataFrame:
        path = f"{self.folder}/{number}"
        rows.write.parquet(path)
        return self.spark.read.parquet(path).persist()

    def _reader(self, round_number: int | None):
        """A function from an Arrow batch to codes, y, sampled weight and current margins."""
        recent, missing, width, names = self.recent, self.missing, len(self.edges), self.margin_names
        rate, share, seed = self.growth.rate, self.growth.row_share, self.growth.seed

        def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint16).reshape(-1, width)
            y, w = batch.column("y").to_numpy(), batch.column("w").to_numpy()
            margins = np.column_stack([batch.column(m).to_numpy() for m in names])
            for trees in recent:
                for k, tree in enumerate(trees):
                    margins[:, k] += rate * np.array(tree.value)[leaf_of(tree, codes, missing)]
            if round_number is not None:
                w = sampled(w, batch.column("row").to_numpy(), share, seed, round_number)
            return codes, y, w, margins

        return read

    def judged(self, trees: list[Tree], asked: list[list[int]], used: np.ndarray, round_number: int) -> list[tuple[float, Split | None]]:
        """Per asked node its leaf value and best split, from sums of gradient, hessian and rows by used feature and bin.

        The sums of a node meet in one task, which returns its split: the driver gets one row per node.
        """
        slots = [{node: i for i, node in enumerate(nodes)} for nodes in asked]
        starts = np.concatenate([[0], np.cumsum([len(n) for n in asked])])
        shape = (int(starts[-1]), len(used), self.width)
        read, kind, factor, missing, width = self._reader(round_number), self.kind, self.factor, self.missing, self.width

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((3, *shape))
            for batch in batches:
                if not batch.num_rows:
                    continue
                codes, y, w, margins = read(batch)
                g, h = gradients(margins, y, kind, factor)
                for k, tree in enumerate(trees):
                    if not slots[k]:
                        continue
                    slot_of = np.full(len(tree.feature), -1)
                    slot_of[list(slots[k])] = list(slots[k].values())
                    slot = slot_of[leaf_of(tree, codes, missing)]
                    rows = np.flatnonzero((slot >= 0) & (w > 0))
                    weight = w[rows]
                    measures = (g[rows, k] * weight, h[rows, k] * weight, np.ones(len(rows)))
                    own = slice(starts[k], starts[k + 1])
                    size = len(asked[k]) * width
                    for i, f in enumerate(used):
                        cell = slot[rows] * width + codes[rows, f]
                        for j, values in enumerate(measures):
                            total[j, own, i] += np.bincount(cell, values, minlength=size).reshape(-1, width)
            flat = total.reshape(3, -1)
            cells = np.flatnonzero(flat[2])
            for at in range(0, len(cells), CELLS_SENT):
                own = cells[at : at + CELLS_SENT]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own // (shape[1] * width)), pa.array(own), *(pa.array(t[own]) for t in flat)], names=["slot", "cell", "g", "h", "n"]
                )

        judge = self.judge

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                slot = batch.column("slot").to_numpy()
                values = np.column_stack([batch.column(c).to_numpy() for c in ("cell", "g", "h", "n")])
                for s in np.unique(slot).tolist():
                    held.setdefault(s, []).append(values[slot == s])
            out = []
            for s, parts in held.items():
                # In a fixed order, so that the sums do not depend on which part came first.
                values = np.concatenate(parts)
                values = values[np.lexsort(values.T)]
                cell = values[:, 0].astype(np.int64) - s * shape[1] * width
                sums = np.column_stack([np.bincount(cell, v, shape[1] * width) for v in values[:, 1:].T]).reshape(shape[1], width, 3)
                whole, found = sums[0].sum(axis=0), judge.best_split(sums, used)
                split = (None,) * 6 if found is None else (found.gain, found.feature, found.cut, found.missing_left, *found.values)
                out.append((s, judge.leaf_value(whole[0], whole[1]), *split))
            names = [c.split()[0] for c in JUDGED.split(", ")]
            types = [pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.float64()]
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        sums = self.state.mapInArrow(count, "slot bigint, cell bigint, g double, h double, n double")
        rows = sums.repartition("slot").mapInArrow(best, JUDGED).toArrow().to_pylist()
        # A node that the sampled rows do not reach stays a leaf.
        found = [(judge.leaf_value(0.0, 0.0), None)] * shape[0]
        for r in rows:
            split = None if r["gain"] is None else Split(r["gain"], r["feature"], r["cut"], r["missing_left"], (r["value_left"], r["value_right"]))
            found[r["slot"]] = (r["value"], split)
        return found

    def _alone(self) -> list[list[Tree]]:
        """All rounds in one task."""
        growth, judge, kind, factor, read = self.growth, self.judge, self.kind, self.factor, self._reader(None)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [(*read(batch), batch.column("row").to_numpy()) for batch in batches if batch.num_rows]
            if not held:
                return
            codes, y, w, margins, hashes = (np.concatenate(parts) for parts in zip(*held))
            # In a fixed order, so that the sums do not depend on which rows came first.
            order = np.lexsort((w, hashes))
            rounds = LoneTable(growth, judge, kind, factor, *(v[order] for v in (codes, y, w, hashes, margins))).boost()
            plain = pickle.dumps([[vars(tree) for tree in trees] for trees in rounds])
            yield pa.RecordBatch.from_arrays([pa.array([plain], pa.binary())], names=["rounds"])

        found = self.state.repartition(1).mapInArrow(work, "rounds binary").toArrow().column("rounds").to_pylist()
        return [[Tree(**tree) for tree in trees] for trees in pickle.loads(found[0])]

    def train(self) -> list[list[Tree]]:
        number = 0
        try:
            if self.growth.leaves is not None and 0 < self.state.count() * len(self.edges) <= CELLS:
                self.rounds = self._alone()
                return self.rounds
            for n in range(self.growth.rounds):
                trees = self.grow(n)
                self.rounds.append(trees)
                self.recent.append(trees)
                if len(self.recent) == REWRITE and n + 1 < self.growth.rounds:
                    number += 1
                    self._rewrite(number)
        finally:
            self.state.unpersist()
            remove_folder(self.spark, self.folder)
        return self.rounds

    def _rewrite(self, number: int) -> None:
        """Write the margins with the recent trees added; the table before is removed."""
        read, names = self._reader(None), self.margin_names

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                margins = read(batch)[3] if batch.num_rows else np.zeros((0, len(names)))
                columns = [batch.column(c) for c in ("codes", "y", "w", "row")]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(m) for m in margins.T)], names=["codes", "y", "w", "row", *names])

        before = self.state
        self.state = self._written(before.mapInArrow(add, self._schema()), number)
        self.recent = []
        before.unpersist()
        remove_folder(self.spark, f"{self.folder}/{number - 1}")


def _compact(tree: Tree) -> Tree:
    """The nodes that can still be reached, renumbered from the root down."""
    out = Tree()
    pending = [(0, out.add(tree.value[0]))]
    while pending:
        old, new = pending.pop()
        if tree.feature[old] >= 0:
            found = Split(tree.gain[old], tree.feature[old], tree.cut[old], tree.missing_left[old], (tree.value[tree.left[old]], tree.value[tree.right[old]]))
            left, right = out.split(new, found)
            pending += [(tree.left[old], left), (tree.right[old], right)]
    return out


class BoostedTrees(TabularModel):
    """A sum of trees; probabilities for classes, missing values as learned."""

    kind = "boosted_trees"

    def __init__(self, spec: ModelSpec, start: Sequence[float], rate: float, edges: Sequence[Sequence[float]], rounds: list[list[Tree]]) -> None:
        super().__init__(spec)
        self.start, self.rate, self.rounds = [float(s) for s in start], rate, rounds
        self.edges = [np.asarray(e, dtype=float) for e in edges]

    def transform(self, df: DataFrame) -> DataFrame:
        require_columns(df, self.spec.features)
        classes = self.spec.problem_type == "classification"
        edges, start, rate, rounds = self.edges, np.array(self.start), self.rate, self.rounds
        missing = np.array([len(e) + 1 for e in edges])
        # Sent as a broadcast: a few hundred trees are more than a closure should carry to each task.
        shared = df.sparkSession.sparkContext.broadcast(rounds)

        @pandas_udf("array<double>")
        def margins(*columns: pd.Series) -> pd.Series:
            codes = bin_codes(np.column_stack([c.to_numpy(dtype=float) for c in columns]), edges)
            total = np.tile(start, (len(codes), 1))
            for trees in shared.value:
                for k, tree in enumerate(trees):
                    total[:, k] += rate * np.array(tree.value)[leaf_of(tree, codes, missing)]
            return pd.Series(list(total))

        out = ["prediction", "probability"] if classes else ["prediction"]
        kept = [quoted(c) for c in df.columns if c not in out]
        scored = df.select(*kept, margins(*[quoted(c).cast("double") for c in self.spec.features]).alias("__m"))
        first = F.get("__m", 0)
        if not classes:
            return scored.select(*kept, first.alias("prediction"))
        if len(start) == 1:
            p = 1 / (1 + F.exp(-first))
            return scored.select(*kept, (first > 0).cast("double").alias("prediction"), F.array(1 - p, p).alias("probability"))
        odds = F.transform("__m", lambda m: F.exp(m - F.array_max("__m")))
        total = F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)
        made = (F.array_position("__m", F.array_max("__m")) - 1).cast("double")
        return scored.select(*kept, made.alias("prediction"), F.transform(odds, lambda o: o / total).alias("probability"))

    def importances(self) -> list[float]:
        """Share of the total gain per feature (share of the splits for best-first trees)."""
        by_count = self.spec.model_type == "lightgbm"
        total = np.zeros(len(self.spec.features))
        for trees in self.rounds:
            for tree in trees:
                for feature, gain in zip(tree.feature, tree.gain):
                    if feature >= 0:
                        total[feature] += 1.0 if by_count else gain
        return (total / total.sum()).tolist() if total.sum() else total.tolist()

    def split_table(self) -> list[tuple]:
        """(round, tree, node, feature, threshold, missing_left, gain, value) of every node."""
        rows = []
        for n, trees in enumerate(self.rounds):
            for k, tree in enumerate(trees):
                for node, f in enumerate(tree.feature):
                    inner = f >= 0
                    rows.append((
                        n, k, node, self.spec.features[f] if inner else None,
                        float(self.edges[f][tree.cut[node]]) if inner and tree.cut[node] < len(self.edges[f]) else None,
                        bool(tree.missing_left[node]) if inner else None,
                        float(tree.gain[node]) if inner else None, None if inner else float(tree.value[node]),
                    ))
        return rows

    def _state(self, spark, path) -> Any:
        return [self.start, self.rate, [e.tolist() for e in self.edges], [[vars(t) for t in trees] for trees in self.rounds]]

    @classmethod
    def _restore(cls, spark, path, spec, state):
        start, rate, edges, rounds = state
        return cls(spec, start, rate, edges, [[Tree(**t) for t in trees] for trees in rounds])


def train_boosted_trees(df: DataFrame, spec: ModelSpec, growth: Growth, weight: str | None = None) -> BoostedTrees:
    booster = Booster(df, spec, growth, weight)
    rounds = booster.train()
    return BoostedTrees(spec, booster.start, growth.rate, booster.edges, rounds)
