"""Text blocks, words, shingles and keys shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import quoted
from ..session import cut_lineage

#: Bytes of text that a task turns into Python words at a time; a longer text is a block of its own.
BLOCK_BYTES = 2_000_000
#: Rows of an Arrow batch whose texts a task holds as Python objects at a time.
SLICE_ROWS = 1_000
#: Rows up to which a measured side of a join is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Share of the rows above which a key is joined apart from the others.
HOT_SHARE = 0.001


def _fold(keep: set[int]) -> bytes:
    lowered = [c + 32 if 65 <= c <= 90 else c for c in range(256)]
    return bytes(c if c in keep else 32 for c in lowered)


#: Lower-case A-Z; everything but letters, digits and non-ASCII bytes becomes a space.
PLAIN_WORDS = _fold({*range(48, 58), *range(97, 123), *range(128, 256)})
#: Lower-case A-Z; only white space (space, tab to carriage return) separates.
SPACED_WORDS = _fold({*range(256)} - {*range(9, 14), 32})


def text_of(column: str) -> Column:
    """The text column as a string, a null as the empty text."""
    return F.coalesce(quoted(column).cast("string"), F.lit(""))


def text_pair(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes that stand for a text."""
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


def keyed_texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Every row's id, text and text key under fixed names, whatever else the table holds."""
    text = text_of(text_column)
    k1, k2 = text_pair(text)
    return docs.select(quoted(id_column).alias("id"), text.alias("text"), k1.alias("k1"), k2.alias("k2"))


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Write a join side, count it, and mark it for broadcast only if it is within the limit."""
    written = cut_lineage(df)
    return F.broadcast(written) if written.count() <= limit else written


def joined_by_share(rows: DataFrame, totals: DataFrame, keys: list[str], support: float = HOT_SHARE) -> DataFrame:
    """Every row with the other columns of its one partner in ``totals``; null keys meet null keys.

    ``totals`` tells in ``n`` how many rows a key has. The few keys (at most 1 / support) that
    hold more than ``support`` of all rows are broadcast, so no task gets all rows of a hot
    key; the others meet in one shuffle. Rows are read twice: write them first.
    """
    partners = cut_lineage(totals.withColumnsRenamed({k: f"__{k}" for k in keys}))
    least = (partners.agg(F.sum("n")).first()[0] or 0) * support
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    hot = F.broadcast(partners.where(F.col("n") > least))
    rest = rows.join(hot, same, "left_anti").join(partners.where(F.col("n") <= least), same)
    return rows.join(hot, same).unionByName(rest).drop("n", *[f"__{k}" for k in keys])


def blocks(texts: list, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of bounded total length, at least one text each."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def word_blocks(column: pa.Array, table: bytes) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Per block: the number of words of each text, and all words in order."""
    for at in range(0, len(column), SLICE_ROWS):
        texts = column.slice(at, SLICE_ROWS).cast(pa.binary()).to_pylist()
        for begin, end in blocks(texts):
            parts = [text.translate(table).split() for text in texts[begin:end]]
            yield np.fromiter(map(len, parts), np.int64, len(parts)), list(chain.from_iterable(parts))


def hashed_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of every word; each distinct word of the block is hashed once."""
    if not words:
        return np.zeros(0, np.uint64)
    table = pa.array(words, pa.binary()).dictionary_encode()
    distinct = table.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
    return hashes[table.indices.to_numpy()]


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every run of ``width`` words, salted with the width."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, width, np.uint64)
    for j in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    return total ^ (total >> np.uint64(32))


def shingles(words: list[bytes], counts: np.ndarray, widths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For every word and width the hash of the run that starts there, and whether it ends inside its text."""
    hashes = hashed_words(words)
    ends = np.repeat(np.cumsum(counts), counts)
    at = np.arange(len(words))
    values = np.zeros((len(words), len(widths)), np.uint64)
    inside = np.zeros((len(words), len(widths)), bool)
    for j, width in enumerate(widths):
        runs = rolling(hashes, width)
        values[: len(runs), j] = runs
        inside[:, j] = at + width <= ends
    return values, inside


def shingle_rows(texts: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """One row (k1, k2, pos, hash) for every run of words of the given widths."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per text a list with, for each word and each width, the run's hash (null if cut off)."""
        for batch in batches:
            done = 0
            for lengths, words in word_blocks(batch.column("text"), PLAIN_WORDS):
                values, inside = shingles(words, lengths, widths)
                offsets = np.concatenate([[0], np.cumsum(lengths * len(widths))])
                hashes = pa.array(values.ravel().view(np.int64), pa.int64(), mask=~inside.ravel())
                part = batch.slice(done, len(lengths))
                done += len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [part.column("k1"), part.column("k2"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), hashes)],
                    names=["k1", "k2", "hashes"],
                )

    found = texts.select("k1", "k2", "text").mapInArrow(lists, "k1 bigint, k2 bigint, hashes array<bigint>")
    rows = found.select("k1", "k2", F.posexplode("hashes").alias("spot", "hash")).where("hash IS NOT NULL")
    return rows.select("k1", "k2", F.floor(F.col("spot") / len(widths)).cast("int").alias("pos"), "hash")


def marked_texts(texts: DataFrame, hashes: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """Every row's id, key and number of words, and its words only if one of the hashes occurs in it.

    The words are what a later join on the key has to move. The hashes are sent along with
    the function up to BROADCAST_ROWS of them; beyond that every row keeps its words.
    """
    few = hashes.limit(BROADCAST_ROWS + 1).toArrow().column(0).to_numpy()
    wanted = np.unique(few) if len(few) <= BROADCAST_ROWS else None

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for lengths, words in word_blocks(batch.column("text"), PLAIN_WORDS):
                if wanted is None:
                    hit = np.ones(len(words), bool)
                else:
                    values, inside = shingles(words, lengths, widths)
                    hit = (np.isin(values.view(np.int64), wanted) & inside).any(axis=1)
                ends = np.cumsum(lengths)
                found = np.concatenate([[0], np.cumsum(hit)])
                kept = [
                    b" ".join(words[begin:end]) if found[end] > found[begin] else None
                    for begin, end in zip(ends - lengths, ends)
                ]
                part = batch.slice(done, len(lengths))
                done += len(lengths)
                columns = [part.column(c) for c in ("id", "k1", "k2")]
                columns += [pa.array(lengths), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "k1", "k2", "n_words", "words"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(mark, f"id {kind}, k1 bigint, k2 bigint, n_words bigint, words string")
