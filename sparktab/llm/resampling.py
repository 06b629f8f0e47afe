"""Quality classification by importance resampling.

Texts are bags of hashed uni- and bigrams. Two generative models are counted: the target
over the documents labelled good, the raw one over all documents. A document's importance
is the log ratio of its probabilities under both; the documents kept are a sample without
replacement drawn by Gumbel top-k, that is, those with the k largest sums of log importance
and Gumbel noise. Noise comes from a hash of id and text, so reruns draw the same sample.

How many are kept follows from the labels: k is the number of documents whose log importance
reaches the level that best parts the labelled good from the labelled bad, a good document
lost counting ``care`` times as much as a bad one kept. A good document is scored by a target
model without its own counts, as if it were unlabelled. The k-th largest key is found by
radix selection on counts, never by a global sort.

Counts cover every document. Per task they are one bucket table, and the collected models
are two numbers per bucket, whatever the corpus. A null text equals an empty one and has log
importance 0. Labels may be missing, null or repeated; a document is bad if any of its labels
says a quality other than 1, good if all say quality 1 and none toxic 1. Without good
documents everything is kept.
Repeated rows share their key, so they are kept or rejected together, even if that makes
more than k rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import quoted
from ..functions.ranking import rank_cuts
from ..session import cut_lineage
from .common import SLICE_ROWS, blocks, small_side, text_of

#: Hash buckets of the n-gram models.
BUCKETS = 1 << 16
SMOOTHING = 0.5
#: How many bad documents kept weigh as much as a good one lost, both as shares of their kind.
CARE = 5.0
#: Steps of the level per unit of asinh(log importance), so that a histogram of it stays small.
STEPS = 1000
SEED = 20
TOKEN = re.compile(r"\w+|[^\w\s]+")


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all uni- and bigrams of the texts, and the number of the text each is in."""
    parts = [TOKEN.findall(text.lower()) for text in texts]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    owner = np.repeat(np.arange(len(texts)), counts)
    table = pa.array(list(chain.from_iterable(parts)), pa.large_string()).dictionary_encode()
    distinct = table.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
    one = hashes[table.indices.to_numpy()]
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]
    two ^= two >> np.uint64(31)
    within = owner[:-1] == owner[1:]
    buckets = np.concatenate([one, two[within]]) % np.uint64(BUCKETS)
    return buckets.astype(np.int64), np.concatenate([owner, owner[:-1][within]])


def text_blocks(batch: pa.RecordBatch) -> Iterator[tuple[list[str], np.ndarray]]:
    for at in range(0, len(batch), SLICE_ROWS):
        part = batch.slice(at, SLICE_ROWS)
        texts, good = part.column("text").to_pylist(), part.column("good").to_numpy(zero_copy_only=False)
        for begin, end in blocks(texts, 1_000_000):
            yield texts[begin:end], good[begin:end]


def label_kinds(labels: DataFrame, id_column: str, quality_column: str, toxic_column: str | None) -> DataFrame:
    """(label_id, label) of the labelled ids: 1 good, 0 bad, null neither."""
    worst = F.min((quoted(quality_column) == 1).cast("int"))
    kind = F.when(worst == 0, 0).when(worst == 1, 1)
    if toxic_column:
        toxic = F.coalesce(F.max(quoted(toxic_column)) == 1, F.lit(False))
        kind = F.when(worst == 0, 0).when((worst == 1) & ~toxic, 1)
    named = labels.where(quoted(id_column).isNotNull()).groupBy(quoted(id_column).alias("label_id"))
    return named.agg(kind.alias("label")).where("label IS NOT NULL")


def acceptance_level(scores: DataFrame, care: float) -> float | None:
    """The (weight, label) rows' level that keeps most good and least bad ones; None without good ones."""
    step = F.floor(F.asinh("weight") * STEPS).cast("bigint")
    rows = scores.where("label IS NOT NULL").groupBy(step.alias("step")).agg(
        F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")
    )
    bins = sorted(rows.collect(), reverse=True)  # asinh keeps them to some tens of thousands
    if not sum(row.good for row in bins):
        return None
    good, bad = (np.cumsum([row[name] for row in bins], dtype=float) for name in ("good", "bad"))
    gain = care * good / good[-1] - bad / max(bad[-1], 1.0)
    return float(np.sinh(bins[len(gain) - 1 - int(np.argmax(gain[::-1]))].step / STEPS))


def model_counts(texts: DataFrame) -> np.ndarray:
    """(2, BUCKETS) gram counts of (text, good) rows: of all texts, and of the good ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for part, good in text_blocks(batch):
                buckets, owner = grams(part)
                totals[0] += np.bincount(buckets, minlength=BUCKETS)
                totals[1] += np.bincount(buckets[good[owner]], minlength=BUCKETS)
        model, bucket = np.nonzero(totals)
        columns = [pa.array(model.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(totals[model, bucket])]
        yield pa.RecordBatch.from_arrays(columns, names=["model", "bucket", "n"])

    rows = texts.select("text", "good").mapInArrow(count, "model int, bucket int, n bigint")
    summed = rows.groupBy("model", "bucket").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros((2, BUCKETS))
    totals[summed["model"].to_numpy(), summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    return totals


def importance(totals: np.ndarray):
    """Arrow function: (log importance, number of grams) of a text, given whether it is good."""
    size = totals.sum(axis=1)
    raw = np.log(totals[0] + SMOOTHING) - np.log(size[0] + SMOOTHING * BUCKETS)
    target = totals[1]

    def column(texts: pa.Array, good: pa.Array) -> pa.Array:
        weights, numbers = [np.zeros(0)], [np.zeros(0, np.int64)]
        for part, own in text_blocks(pa.RecordBatch.from_arrays([texts, good], names=["text", "good"])):
            buckets, owner = grams(part)
            n = np.bincount(owner, minlength=len(part))
            # Distinct (text, bucket) pairs, so that a good text can be taken out of the target.
            pairs, repeats = np.unique(owner * BUCKETS + buckets, return_counts=True)
            text, bucket = pairs // BUCKETS, pairs % BUCKETS
            other = target[bucket] - np.where(own[text], repeats, 0)
            total = size[1] - np.where(own, n, 0)
            chance = np.log(other + SMOOTHING) - np.log(total + SMOOTHING * BUCKETS)[text]
            weights.append(np.bincount(text, repeats * (chance - raw[bucket]), len(part)))
            numbers.append(n)
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate(weights)), pa.array(np.concatenate(numbers))], names=["weight", "n"]
        )

    return F.arrow_udf(column, "struct<weight:double,n:bigint>")


def gumbel(*keys: Column) -> Column:
    """Standard Gumbel noise from a hash of the keys."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *keys), 11).cast("double")
    return -F.log(-F.log((bits + 0.5) / float(1 << 53)))


def resample(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    quality_column: str = "quality",
    toxic_column: str | None = "toxic",
    care: float = CARE,
) -> DataFrame:
    """Every input row as a struct ``row``, with n_grams, log_weight, sample_key and kept."""
    names = docs.columns
    kinds = small_side(label_kinds(labels, id_column, quality_column, toxic_column))
    inner = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)])
    base = docs.select(inner.alias("row"), quoted(id_column).alias("id"), text_of(text_column).alias("text"))
    rows = base.join(kinds, F.col("id") == F.col("label_id"), "left")
    rows = rows.withColumn("good", F.coalesce(F.col("label") == 1, F.lit(False))).drop("label_id")

    totals = model_counts(rows)
    if not totals[1].any():
        scored = rows.withColumn("score", F.struct(F.lit(0.0).alias("weight"), F.lit(0).cast("bigint").alias("n")))
    else:
        scored = rows.withColumn("score", importance(totals)("text", "good"))
    key = F.col("score.weight") + gumbel(F.col("id"), F.col("text"))
    # An order-preserving bigint, largest first, and a second one that breaks ties.
    keyed = scored.withColumn("sample_key", key).withColumns(
        {"first": F.round(-F.col("sample_key") * 1e6).cast("bigint"), "second": F.xxhash64("id", "text")}
    )
    slim = keyed.select(F.lit(0).alias("group"), "first", "second", "label", F.col("score.weight").alias("weight"))
    slim = cut_lineage(slim)
    level = acceptance_level(slim, care)
    kept = F.lit(True)
    if level is not None:
        k = slim.where(F.col("weight") >= level).count()
        cut = rank_cuts(slim, "group", "first", "second", {0: [k]}, shared=True)[0][0]
        first, second = F.col("first"), F.col("second")
        kept = (first < cut[0]) | ((first == cut[0]) & (second <= cut[1])) if cut else F.lit(False)
    return keyed.select(
        "row", F.col("score.n").alias("n_grams"), F.col("score.weight").alias("log_weight"), "sample_key",
        kept.alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, **options) -> DataFrame:
    """The rows that are kept, with all their columns."""
    kept = resample(docs, labels, id_column, text_column, **options).where("kept")
    return kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
