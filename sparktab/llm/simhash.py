"""SimHash near-duplicates by fuzzy hashing with the Golay code.

A text's fingerprint has 64 bits, each set if it is set in over half of the XXH64 hashes
(seed 42) of its shingles. Fingerprints link at ``distance`` (at most 3) or fewer differing
bits; a document's component is the smallest id it can reach over links.

Distinct fingerprints are cut into segments of 22, 21 and 21 bits. With three errors or
fewer, either every segment has at most one, or some segment has none and another at most
one. The first case needs one key of three codeword indices, the second a key of one exact
segment and one codeword index for each of the six ordered pairs of segments. Words one bit
apart share a codeword if one side offers the codeword it decodes to and the other all
codewords within 4 bits (see ``golay``), so each fingerprint gives about 11 keys on one side
and 60 on the other, whatever the table holds, and no linked pair is missed. Sides are
joined on the key, and a pair that is 3 bits apart or fewer is a link. A fingerprint that holds
more than a thousandth of the rows gets its component by broadcast. Links are turned into
components by alternating star contraction on Spark, written to the checkpoint folder after
each round.

Words are runs of anything but white space, A-Z lowered. Fewer words than a shingle make one
shingle of them all, no words give fingerprint zero, a null text has none. Rows with equal
texts or ids are all returned; null ids never name a component unless all ids in it are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.columns import quoted
from ..session import cut_lineage
from .common import SPACED_WORDS, joined_by_share, text_of, word_blocks
from .golay import NONE, Golay

SEED = 42
MOST_BITS = 3
#: Bit offsets and widths of the segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Hashes whose bits are counted at a time.
HASH_BLOCK = 100_000


def fingerprint(words: list[bytes], width: int) -> int:
    """The fingerprint of one text's words."""
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return int(xxhash.xxh64_intdigest(joined, SEED))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(ends), HASH_BLOCK):
        spans = zip(begins[at : at + HASH_BLOCK], ends[at : at + HASH_BLOCK])
        hashes = b"".join([digest(joined[b:e], SEED) for b, e in spans])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(ends)).tobytes(), "big")


def fingerprints(width: int):
    """Arrow function: the signed 64-bit fingerprint of every text."""

    def column(texts: pa.Array) -> pa.Array:
        values = [np.zeros(0, np.uint64)]
        for counts, words in word_blocks(texts, SPACED_WORDS):
            ends = np.cumsum(counts)
            spans = zip((ends - counts).tolist(), ends.tolist())
            values.append(np.array([fingerprint(words[b:e], width) for b, e in spans], np.uint64))
        return pa.array(np.concatenate(values).view(np.int64))

    return F.arrow_udf(column, "bigint")


def _keys(marks: np.ndarray, golay: Golay) -> dict[str, np.ndarray]:
    """Rows (key, fp) of both sides for unsigned fingerprints."""
    parts = [(marks >> np.uint64(at)) & np.uint64((1 << bits) - 1) for at, bits in SEGMENTS]
    near = [golay.near(part).astype(np.uint64) for part in parts]
    one = [codes[:, :1] for codes in near]
    sides: dict[str, list[np.ndarray]] = {"one": [], "many": []}

    def offer(side: str, kind: int, *codes: np.ndarray) -> None:
        key = np.full((len(marks), 1), kind, np.uint64)
        valid = np.ones((len(marks), 1), bool)
        for code, bits in zip(codes[::2], codes[1::2]):
            key = ((key << np.uint64(bits))[:, :, None] | code[:, None, :]).reshape(len(marks), -1)
            valid = (valid[:, :, None] & (code != NONE)[:, None, :]).reshape(len(marks), -1)
        rows, spots = np.nonzero(valid)
        sides[side].append(np.stack([rows.astype(np.uint64), key[rows, spots]], axis=1))

    kind = 1
    for i in range(3):
        for j in range(3):
            if i != j:
                exact = parts[i][:, None]
                offer("one", kind, exact, 22, one[j], 12)
                offer("many", kind, exact, 22, near[j], 12)
                kind += 1
    offer("one", kind, near[0], 12, one[1], 12, one[2], 12)
    offer("many", kind, one[0], 12, near[1], 12, near[2], 12)
    return {side: np.concatenate(rows) for side, rows in sides.items()}


def key_rows(marks: DataFrame, side: str) -> DataFrame:
    """(key, fp) rows of one side for the distinct fingerprints in column ``fp``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            values = batch.column("fp").to_numpy().view(np.uint64)
            pairs = _keys(values, golay)[side]
            columns = [pa.array(pairs[:, 1].view(np.int64)), pa.array(values[pairs[:, 0].astype(np.int64)].view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "fp"])

    return marks.mapInArrow(rows, "key bigint, fp bigint")


def fingerprint_links(marks: DataFrame, distance: int) -> DataFrame:
    """Distinct pairs a < b of fingerprints at ``distance`` or fewer differing bits."""
    if not 0 <= distance <= MOST_BITS:
        raise ValueError(f"distance must be 0 to {MOST_BITS}")
    left = key_rows(marks, "one").toDF("key", "a")
    right = key_rows(marks, "many").toDF("other", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = left.join(right, (F.col("key") == F.col("other")) & (F.col("a") != F.col("b")) & near)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node each linked node can reach.

    Alternating large and small stars: every node hands its neighbours to its smallest
    neighbour, until the links no longer change. Nodes are bigints; each round is a few
    grouped joins and is written before the next.
    """
    spark = links.sparkSession
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def signature(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    seen = signature(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        handed = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = handed.unionByName(small.toDF("u", "v")).where("u != v").distinct()
        edges = cut_lineage(edges)
        now = signature(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return roots.unionByName(own) if seen[0] else spark.createDataFrame([], "node bigint, root bigint")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, distance: int = MOST_BITS
) -> DataFrame:
    """One row per input row: its id, fp (signed bigint) and component_id."""
    marked = docs.select(quoted(id_column).alias("id"), fingerprints(width)(text_of(text_column)).alias("fp"))
    marked = cut_lineage(marked)
    return _with_components(marked, distance).select(F.col("id").alias(id_column), "fp", "component_id")


def _with_components(marked: DataFrame, distance: int) -> DataFrame:
    """Add the smallest id reachable over links of fingerprints to the (id, fp) rows."""
    least = cut_lineage(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = cut_lineage(components(fingerprint_links(least.select("fp"), distance)))
    linked = roots.join(least, roots["node"] == least["fp"]).select("node", "root", "least")
    smallest = linked.groupBy("root").agg(F.min("least").alias("smallest"))
    named = linked.join(smallest, "root").select(F.col("node").alias("fp"), "smallest")
    by_mark = least.join(named, "fp", "left").select("fp", F.coalesce("smallest", "least").alias("component_id"), "n")
    return joined_by_share(marked, by_mark, ["fp"])


def keep_one_each(docs: DataFrame, id_column: str, text_column: str, width: int = 3, distance: int = MOST_BITS) -> DataFrame:
    """One whole row of each component: the one with the smallest id, then the smallest row hash."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own_id, own_text = (f"c{names.index(c)}" for c in (id_column, text_column))
    row = F.struct(F.col(own_id).isNull().alias("last"), F.col(own_id).alias("id"), F.xxhash64(*[F.col(c).cast("string") for c in plain.columns]).alias("hash"))
    slim = plain.select(row.alias("id"), fingerprints(width)(text_of(own_text)).alias("fp"))
    found = _with_components(cut_lineage(slim), distance)
    winners = found.groupBy("component_id").agg(F.min("id").alias("id")).select("id").distinct()
    kept = plain.withColumn("id", row).join(winners, "id")
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.lit(1)))
    single = kept.withColumn("nth", nth).where("nth = 1")
    return single.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
