"""Substring deduplication by hashing units of lines.

A line is cut at sentence ends into units of at least ``least`` words, so that a passage is
found although the lines around it differ. Neighbouring lines without a unit of their own (verse,
lists, code) are joined into units up to the end of the paragraph, the last of them with what is
left over. In scripts without spaces two characters count as a word. A unit is normalised to its lower-cased words; its
digest (128 bits) is grouped over the whole table, the occurrence that ranks first stays, and
all others are removed from their texts. Units of fewer words are never removed. Spans are
offsets into the original text, in code points, end exclusive.

Occurrences rank by id (a null id last), row hash and offset. Of rows that agree in id and
text, one keeps its first occurrences and the others lose every unit. A null text equals an
empty one and has no units; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.columns import quoted
from .common import PLAIN_WORDS, text_of

#: Words a unit must have; shorter sentences are joined with the next of their line.
LEAST_WORDS = 8
SENTENCE_END = re.compile(r"[.!?؟।॥]+(?=\s)|[。！？｡]+")
#: Characters of scripts that put no spaces between words: Thai to Burmese, Khmer, kana, Han.
UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿𠀀-𿿿]")


def _words(text: str) -> tuple[list[bytes], int]:
    """The normalised words, and how many they count as."""
    words = text.encode().translate(PLAIN_WORDS).split()
    return words, len(words) if text.isascii() else max(len(words), len(UNSPACED.findall(text)) // 2)


def _lead(text: str) -> int:
    return len(text) - len(text.lstrip())


def line_units(line: str, least: int) -> Iterator[tuple[int, int, bytes]]:
    """(begin, end, normalised words) of the units of a line that have enough words."""
    begin = 0
    ends = [match.end() for match in SENTENCE_END.finditer(line)]
    for end in [*ends, len(line)]:
        words, size = _words(line[begin:end])
        if size >= least:
            yield begin + _lead(line[begin:end]), end, b" ".join(words)
            begin = end


def joined_units(lines: list[tuple[int, str]], least: int) -> Iterator[tuple[int, int, bytes]]:
    """Units of neighbouring lines that have none of their own; what is left over goes to the last one."""
    ready, begin, held, size, end = None, None, [], 0, 0
    for at, line in lines:
        words, more = _words(line)
        if not words:
            continue
        begin = at + _lead(line) if begin is None else begin
        held, size, end = held + words, size + more, at + len(line)
        if size >= least:
            if ready:
                yield ready[0], ready[1], b" ".join(ready[2])
            ready, begin, held, size = (begin, end, held), None, [], 0
    if ready:
        yield ready[0], end, b" ".join(ready[2] + held)


def text_units(text: str, least: int) -> Iterator[tuple[int, int, bytes]]:
    at, short = 0, []
    for line in text.split("\n"):
        found = list(line_units(line, least))
        if found or not line.strip():
            yield from joined_units(short, least)
            short = []
            for begin, end, words in found:
                yield at + begin, at + end, words
        else:
            short.append((at, line))
        at += len(line) + 1
    yield from joined_units(short, least)


def unit_rows(texts: DataFrame, least: int) -> DataFrame:
    """(id, key1, key2, begin, end, d1, d2) of every unit; d1, d2 are the halves of its digest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, begins, ends, digests = [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                for begin, end, words in text_units(text, least):
                    rows.append(row)
                    begins.append(begin)
                    ends.append(end)
                    digests.append(xxhash.xxh3_128_digest(words))
            halves = pa.py_buffer(b"".join(digests))
            both = pa.Array.from_buffers(pa.int64(), 2 * len(rows), [None, halves])
            owner = pa.array(rows, pa.int64())
            spots = pa.array(range(len(rows)), pa.int64())
            first, second = (both.take(pc.add(pc.multiply(spots, 2), i)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(owner) for c in ("id", "key1", "key2")]
                + [pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), first, second],
                names=["id", "key1", "key2", "begin", "end", "d1", "d2"],
            )

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(
        cut, f"id {kind}, key1 bigint, key2 bigint, begin int, end int, d1 bigint, d2 bigint"
    )


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take the spans out of the texts."""
    for batch in batches:
        kept = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist()):
            parts, at = [], 0
            for span in spans:
                parts.append(text[at : span["begin"]])
                at = span["end"]
            kept.append("".join([*parts, text[at:]]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("removed"), pa.array(kept, pa.string())], names=["id", "removed", "text"]
        )


SPANS = "array<struct<begin:int,end:int>>"


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST_WORDS
) -> DataFrame:
    """One row per input row: its id, ``removed`` spans (begin, end) of the original, and the text left."""
    text, own_id = text_of(text_column), quoted(id_column)
    key1, key2 = F.xxhash64(own_id, text), F.xxhash64(F.lit("second"), own_id, text)
    texts = docs.select(own_id.alias("id"), key1.alias("key1"), key2.alias("key2"), text.alias("text"))
    units = unit_rows(texts, least)
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "key1", "key2", "begin")
    first = units.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = units.join(first.drop("n"), ["d1", "d2"])
    spans = repeated.groupBy("key1", "key2").agg(
        F.sort_array(F.collect_set(F.struct("begin", "end", (rank != F.col("first")).alias("drop")))).alias("spans")
    )
    # The copy number needs the rows of a key together, as the join has left them.
    copy = F.row_number().over(Window.partitionBy("key1", "key2").orderBy(F.lit(1)))
    joined = texts.join(spans, ["key1", "key2"], "left").withColumn("copy", copy)
    chosen = F.filter("spans", lambda s: s["drop"] | (F.col("copy") > 1))
    plain = F.transform(chosen, lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end")))
    ready = joined.select(
        "id", "text", F.coalesce(plain, F.array().cast(SPANS)).alias("removed")
    )
    kind = texts.schema["id"].dataType.simpleString()
    return ready.mapInArrow(_without, f"id {kind}, removed {SPANS}, text string").select(
        F.col("id").alias(id_column), "removed", "text"
    )
