"""Vector code compression: product codes by Lloyd rounds over cover trees.

Every component x becomes the integer floor(scale * x). A vector is cut into equal consecutive
parts, and each part has a codebook of its own, which starts as that part of the vectors with the
smallest ids. A round gives every part to the nearest entry of its codebook (squared Euclidean
distance, ties to the lower index) and replaces each entry by floor(sum / count) of its parts; an
entry without parts stays. After the rounds the parts are assigned once more.

Each Spark task builds cover trees over blocks of its own rows, one tree for each part, and
writes them to the checkpoint folder once. A round sends the codebooks (a few thousand numbers)
to the trees: subtrees that the triangle inequality leaves to one entry are taken whole through
running sums, and only the others descend to exact comparisons. Back come sums and counts per
part and entry, added up on Spark. All arithmetic that decides is on integers, so the result
does not depend on blocks, partitions or reruns.

Rows whose vector is null, empty, or holds a null, NaN or infinite component are left out. All
others must have one length, a multiple of the number of parts, and components below 2^26 once
scaled, else the job fails with a message. Of rows that share an id the one with the smaller
vector is the earlier; null ids come last. Fewer rows than entries give fewer entries. Null
labels count as one label. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import quoted
from ..session import cut_lineage
from .common import joined_by_share
from .covertree import Tree, assign, build

#: Vectors that share their trees.
BLOCK_ROWS = 2_048
#: Scaled components are below this, so that sums of squares are exact in 64 bits.
MOST = 1 << 26
FIELDS = ("points", "order", "centre", "radius", "begin", "end", "child", "children")
TYPES = dict(zip(FIELDS, ("<i4", "<i4", "<i4", "<f8", "<i4", "<i4", "<i4", "<i4")))
SUMS = "part int, entry int, n bigint, total array<bigint>, compared bigint"


def usable(vector: Column) -> Column:
    """Whether a vector has components and all of them are finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~odd


def integers(vectors: pa.Array, scale: int) -> np.ndarray:
    """The scaled components of a column of vectors, one row each."""
    sizes = np.unique(vectors.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError(f"vectors of several lengths: {sizes.tolist()}")
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(values * scale)
    if len(scaled) and np.abs(scaled).max() >= MOST:
        raise ValueError(f"a component is {MOST / scale:g} or more")
    return scaled.astype(np.int64).reshape(len(vectors), -1)


def forests(rows: DataFrame, parts: int, scale: int) -> DataFrame:
    """One row per block: its ids and labels, the rows of each vector, and the trees of all parts."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}

    def block(ids: pa.Array, labels: pa.Array, vectors: np.ndarray) -> pa.RecordBatch:
        size = vectors.shape[1]
        if size % parts:
            raise ValueError(f"{size} components cannot be cut into {parts} parts")
        trees = [build(part) for part in np.split(vectors, parts, axis=1)]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (ids, labels)]
        packed = [
            pa.array([[getattr(t, f).astype(TYPES[f]).tobytes() for t in trees]], pa.list_(pa.binary())) for f in FIELDS
        ]
        return pa.RecordBatch.from_arrays([*lists, *packed], names=["ids", "labels", *FIELDS])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                vectors = integers(part.column("vector"), scale)
                yield block(pa.concat_arrays([part.column("id")]), pa.concat_arrays([part.column("label")]), vectors)

    schema = f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, " + ", ".join(f"{f} array<binary>" for f in FIELDS)
    return rows.mapInArrow(grow, schema)


def trees_of(row: dict, parts: int) -> list[Tree]:
    """The trees of one block, read back."""
    trees = []
    for part in range(parts):
        fields = {f: np.frombuffer(row[f][part], TYPES[f]) for f in FIELDS}
        points = fields.pop("points").astype(np.int64).reshape(len(fields["order"]), -1)
        sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0)])
        trees.append(Tree(points=points, sums=sums, **fields))
    return trees


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in FIELDS} | {
                name: batch.column(name)[i].values for name in ("ids", "labels") if name in batch.schema.names
            }


def moved(forest: DataFrame, codebooks: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The codebooks after one round, and the number of parts compared one by one."""
    parts = len(codebooks)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros_like(book) for book in codebooks]
        numbers = [np.zeros(len(book), np.int64) for book in codebooks]
        compared = 0
        for row in blocks_of(batches):
            for part, tree in enumerate(trees_of(row, parts)):
                total, number, exact = assign(tree, codebooks[part])
                totals[part] += total
                numbers[part] += number
                compared += exact
        found = [(p, e) for p in range(parts) for e in range(len(codebooks[p])) if numbers[p][e]]
        rows = [
            {"part": p, "entry": e, "n": int(numbers[p][e]), "total": totals[p][e].tolist(), "compared": compared * (not i)}
            for i, (p, e) in enumerate(found)
        ]
        if rows:
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(zip(rows[0], types)))

    width = codebooks[0].shape[1]
    added = forest.select(*FIELDS).mapInArrow(sums, SUMS).groupBy("part", "entry").agg(
        F.sum("n").alias("n"),
        F.sum("compared").alias("compared"),
        *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)],
    )
    after, compared = [book.copy() for book in codebooks], 0
    for row in added.collect():
        after[row.part][row.entry] = [row[f"t{i}"] // row.n for i in range(width)]
        compared += row.compared
    return after, compared


def coded(forest: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """id, label, code (one index per part) and error of every vector."""
    parts = len(codebooks)
    kinds = {c: forest.schema[c + "s"].dataType.elementType.simpleString() for c in ("id", "label")}

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in blocks_of(batches):
            code = np.zeros((len(row["ids"]), parts), np.int32)
            error = np.zeros(len(code), np.int64)
            for part, tree in enumerate(trees_of(row, parts)):
                found = np.zeros(len(code), np.int64)
                assign(tree, codebooks[part], found)
                code[tree.order, part] = found
                error[tree.order] += ((tree.points - codebooks[part][found]) ** 2).sum(axis=1)
            offsets = pa.array(np.arange(0, code.size + 1, parts), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(code.ravel()))
            yield pa.RecordBatch.from_arrays([row["ids"], row["labels"], lists, pa.array(error)], names=["id", "label", "code", "error"])

    return forest.mapInArrow(codes, f"id {kinds['id']}, label {kinds['label']}, code array<int>, error bigint")


def compress(
    vectors: DataFrame,
    id_column: str,
    vector_column: str,
    label_column: str,
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
) -> tuple[DataFrame, list[np.ndarray], list[int]]:
    """Codes of all usable vectors, the final codebooks, and the parts compared exactly per round.

    The codes hold id, label, code, error and label_error, the error summed over equal labels.
    """
    vector = quoted(vector_column)
    rows = vectors.select(
        quoted(id_column).alias("id"), quoted(label_column).alias("label"), vector.alias("vector")
    ).where(usable(F.col("vector")))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).toArrow()
    start = integers(pa.chunked_array(first.column("vector")).combine_chunks(), scale) if first.num_rows else None
    if start is None:
        empty = rows.select("id", "label", F.lit(None).cast("array<int>").alias("code"), F.lit(0).cast("bigint").alias("error"))
        return empty.withColumn("label_error", F.col("error")), [], []
    if start.shape[1] % parts:
        raise ValueError(f"{start.shape[1]} components cannot be cut into {parts} parts")
    codebooks = np.split(start, parts, axis=1)
    forest = cut_lineage(forests(rows, parts, scale))
    compared = []
    for _ in range(rounds):
        codebooks, exact = moved(forest, codebooks)
        compared.append(exact)
    codes = cut_lineage(coded(forest, codebooks))
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    return joined_by_share(codes, totals, ["label"]), codebooks, compared


def codebook_text(codebooks: list[np.ndarray]) -> str:
    """All components by part, entry and position."""
    return ",".join(str(x) for book in codebooks for x in book.ravel().tolist())
