"""Secret scans: fixed patterns, and character Markov models for everything they miss.

Patterns give the base spans. They also label the training samples: the values they match
are samples of random strings; other runs of identifier characters are samples of ordinary
text, but for long ones that mix letters and digits, which are not labelled. Two first-order character models are counted over the whole table from those
samples. A run of 16 or more identifier characters outside the base spans is a secret too if
its log-likelihood ratio, random over ordinary, is above the threshold in total and per
character. Counting and scanning each read a text once where it lies; only model counts are
shuffled.

A null text equals an empty one and has no spans; an empty table gives an empty result and
smoothed, equal models. Repeated rows are all returned. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import quoted
from .common import text_of

#: The base patterns, and how many characters a match (or its value) must have.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "random")

ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
SIZE = len(ALPHABET) + 1
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
MIXED = re.compile(r"[A-Za-z][^A-Za-z0-9]*[0-9]|[0-9][^A-Za-z0-9]*[A-Za-z]")
#: Code of every byte: its place in the alphabet, or the border for all others.
CODES = np.full(256, SIZE - 1, np.int64)
CODES[np.frombuffer(ALPHABET, np.uint8)] = np.arange(len(ALPHABET))

#: A run is random from this log-likelihood ratio on, in nats: in total, and per character.
TOTAL_RATIO, MEAN_RATIO = 12.0, 0.4
#: Pairs that a character's share among all characters counts for.
MIXING = 10.0

Span = tuple[int, int, int]


def base_spans(text: str) -> tuple[list[Span], list[str]]:
    """(start, kind, end) of the base matches in order, and the values that they hold."""
    spans: list[Span] = []
    values: list[str] = []
    lowered = text.lower()
    if any(word in lowered for word in ASSIGN_WORDS):
        for match in ASSIGN.finditer(text):
            if len(match[2]) >= ASSIGN_LEAST:
                spans.append((match.start(), 0, match.end()))
                values.append(match[2])
    if "AKIA" in text:
        for match in ACCESS.finditer(text):
            spans.append((match.start(), 1, match.end()))
            values.append(match[0])
    for run in RUN.finditer(text):  # a run of 32 hex digits lies within one run
        if run.end() - run.start() >= 32:
            for match in HEX.finditer(text, run.start(), run.end()):
                spans.append((match.start(), 2, match.end()))
                values.append(match[0])
    return sorted(spans), values


def _pairs(text: bytes) -> np.ndarray:
    """Counts of neighbouring characters, border included, as a flat square."""
    codes = CODES[np.frombuffer(b" " + text + b" ", np.uint8)]
    return np.bincount(codes[:-1] * SIZE + codes[1:], minlength=SIZE * SIZE)


def pair_counts(texts: DataFrame) -> DataFrame:
    """(random, pair, n): neighbouring characters in the two kinds of samples, over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, SIZE * SIZE), np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                values = base_spans(text)[1]
                totals[0] += _pairs(text.encode())
                if values:
                    totals[1] += _pairs(" ".join(values).encode())
                if unsure := values + [run for run in RUN.findall(text) if MIXED.search(run)]:
                    totals[0] -= _pairs(" ".join(unsure).encode())
        totals = np.maximum(totals, 0)
        kind, pair = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(totals[kind, pair])],
            names=["random", "pair", "n"],
        )

    rows = texts.mapInArrow(count, "random int, pair int, n bigint")
    return rows.groupBy("random", "pair").agg(F.sum("n").alias("n"))


def ratio_table(texts: DataFrame) -> np.ndarray:
    """Log-likelihood ratio, random over ordinary, of every character after every other.

    A pair's chance is its share among the pairs with the same first character, mixed with
    the second character's share among all, which decides where little has been seen.
    """
    totals = np.zeros((2, SIZE * SIZE))
    for row in pair_counts(texts).collect():  # at most two numbers per pair of characters
        totals[row.random, row.pair] = row.n
    pairs = totals.reshape(2, SIZE, SIZE)[:, :, :-1]
    single = pairs.sum(axis=1) + 0.5
    single /= single.sum(axis=1, keepdims=True)
    chance = pairs + MIXING * single[:, None, :]
    chance = np.log(chance / chance.sum(axis=2, keepdims=True))
    return chance[1] - chance[0]


def random_spans(text: str, taken: list[Span], ratios: np.ndarray) -> list[Span]:
    """Runs outside the base spans that the random model explains better."""
    found = []
    for run in RUN.finditer(text):
        begin, end = run.span()
        if any(b < end and begin < e for b, _, e in taken):
            continue
        codes = CODES[np.frombuffer(run[0].encode(), np.uint8)]
        digits = int(((codes >= 52) & (codes < 62)).sum())
        if digits == len(codes):
            continue  # a number says nothing of its own
        total = float(ratios[np.concatenate([[SIZE - 1], codes[:-1]]), codes].sum())
        if total >= TOTAL_RATIO and total >= MEAN_RATIO * len(codes):
            found.append((begin, 3, end))
    return found


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id and ``spans``, an array of (kind, start, end) by start, then kind."""
    texts = docs.select(quoted(id_column).alias("id"), text_of(text_column).alias("text"))
    ratios = ratio_table(texts.select("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)[0]
                spans = sorted(spans + random_spans(text, spans, ratios))
                rows.append([{"kind": KINDS[k], "start": b, "end": e} for b, k, e in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(rows, pa.list_(kind))], names=["id", "spans"]
            )

    id_type = texts.schema["id"].dataType.simpleString()
    found = texts.mapInArrow(scan, f"id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return found.select(F.col("id").alias(id_column), "spans")
