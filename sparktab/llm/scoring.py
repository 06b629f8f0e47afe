"""Language-model scores of texts, beside a base score from word counts.

Learning, from the training documents only:

1. All their words are counted (distinct per block of texts, then one grouped sum).
2. Every text is cut into subword ids once, which are written packed: training and scoring read
   these. Their counts give the model's vocabulary, output classes and P(id | class).
3. The ids of every training document are cut into the windows of subword ids that scoring cuts it into, so
   that each of its ids and its end id is predicted once. Runs of windows are grouped by hash
   into shards of bounded size, which are written once; their number grows with the documents.
   Training is one pass over all shards in several rounds: each round takes its share of the
   shards, each of these runs Adam from the parameters of the round before, and their results
   are averaged. Shards and rounds do not depend on partitions.

Scoring reads all written ids once: causal attention over overlapping windows scores each id once.
Another pass over the texts looks words up in a table of the most frequent ones, which is bounded;
the other words of a text (few distinct ones) are joined with the full counts on Spark. Both meet
by two hashes of the text.

Words are runs of anything but white space, A-Z lowered; an end token follows the last word.
A null text equals an empty one: it has the end token alone. A null id counts as the text ''.
Without training documents counts are 0 and the model is the untrained class unigram model.
Repeated rows are all returned; equal texts share their scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import quoted
from ..session import cut_lineage
from .attention import (
    STRIDE,
    WINDOW,
    Parameters,
    Vocabulary,
    first_parameters,
    flatten,
    log_probabilities,
    train,
    unflatten,
)
from .common import SLICE_ROWS, SPACED_WORDS, blocks, text_of, text_pair, word_blocks
from .pieces import MARKER, ChunkEncoder

#: Remainder modulo FOLDS of crc32(id as text) that is held out.
FOLDS, HELD_OUT = 7, 2
#: Words in the table that goes along with the scoring tasks.
FREQUENT_WORDS = 300_000
#: Most windows of a training shard.
SHARD_WINDOWS = 8192
#: Windows of a text that go to a shard together.
RUN_WINDOWS = 64
#: Tasks that shards are dealt to while they are few, and shards of a task when they are many.
FEW_TASKS, TASK_SHARDS = 200, 16
#: Step size of each round; a shard takes part in one of them.
RATES = (0.03, 0.03, 0.02, 0.015, 0.01, 0.005)
#: Partial sums that meet in one group, and ranges of counts per doubling in the search for frequent words.
FAN_IN, COUNT_STEPS = 32, 8


def is_held_out(id_column: Column) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def _counted(words: list[bytes]) -> tuple[pa.Array, pa.Array]:
    found = pa.array(words, pa.binary()).value_counts()
    return found.field("values").cast(pa.string()), found.field("counts")


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[bytes] = []
            for _, words in word_blocks(batch.column("text"), SPACED_WORDS):
                held += words
                if len(held) > 1_000_000:
                    yield pa.RecordBatch.from_arrays(list(_counted(held)), names=["word", "n"])
                    held = []
            yield pa.RecordBatch.from_arrays(list(_counted(held)), names=["word", "n"])

    rows = texts.select("text").mapInArrow(count, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def id_type(pieces: int) -> type:
    return np.uint16 if pieces <= 1 << 16 else np.int32


def encoded_texts(texts: DataFrame, model_path: str) -> DataFrame:
    """The rows with ``ids``, the packed ids of each text's words and of its end, instead of ``text``."""
    others = [name for name in texts.columns if name != "text"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(model_path, end=True)
        kind = np.dtype(id_type(encoder.processor.get_piece_size()))
        for batch in batches:
            done = 0
            for lengths, words in word_blocks(batch.column("text"), SPACED_WORDS):
                table = pa.array(words, pa.binary()).dictionary_encode()
                marked = pc.binary_join_element_wise(MARKER, table.dictionary.cast(pa.string()), "")
                codes = table.indices.to_numpy().astype(np.int64)
                ids, sizes = encoder.encode_chunks(marked.to_numpy(zero_copy_only=False).tolist(), codes, lengths)
                flat, ends = ids.astype(kind).tobytes(), (np.cumsum(sizes) * kind.itemsize).tolist()
                packed = pa.array([flat[low:high] for low, high in zip([0, *ends], ends)], pa.binary())
                part = batch.slice(done, len(lengths))
                done += len(lengths)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), packed], names=[*others, "ids"])

    kinds = [f"{name} {texts.schema[name].dataType.simpleString()}" for name in others]
    return texts.select(*others, "text").mapInArrow(encode, ", ".join([*kinds, "ids binary"]))


def id_blocks(batch: pa.RecordBatch, kind: type) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Blocks of the rows, with all their ids and each row's number of ids."""
    for at in range(0, len(batch), SLICE_ROWS):
        part = batch.slice(at, SLICE_ROWS)
        packed = part.column("ids").to_pylist()
        for begin, end in blocks(packed):
            sizes = np.fromiter(map(len, packed[begin:end]), np.int64, end - begin) // np.dtype(kind).itemsize
            yield part.slice(begin, end - begin), np.frombuffer(b"".join(packed[begin:end]), kind), sizes


def id_counts(encoded: DataFrame, pieces: int) -> np.ndarray:
    """How often each of the model's ids stands in the encoded texts."""
    kind = id_type(pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(pieces, np.int64)
        for batch in batches:
            for _, ids, _ in id_blocks(batch, kind):
                totals += np.bincount(ids, minlength=pieces)
        found = np.nonzero(totals)[0]
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(totals[found])], names=["id", "n"])

    rows = encoded.select("ids").mapInArrow(count, "id bigint, n bigint")
    summed = rows.groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros(pieces)
    totals[summed["id"].to_numpy()] = summed["n"].to_numpy()
    return totals


def window_runs(ids: np.ndarray, sizes: np.ndarray, start: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, nth, ids) of runs of up to RUN_WINDOWS windows: the id before the first target, then the targets.

    Runs overlap by the context that windows share.
    """
    step = RUN_WINDOWS * STRIDE
    ends = np.cumsum(sizes)
    for text, (begin, end) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
        windows = 1 + max(0, -(-(end - begin - WINDOW) // STRIDE))
        for nth in range(-(-windows // RUN_WINDOWS)):
            first = begin + nth * step - 1
            part = ids[max(first, begin) : min(first + step + WINDOW - STRIDE + 1, end)]
            yield text, nth, part if nth else np.concatenate([[start], part])


def run_windows(ids: np.ndarray, sizes: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(WINDOW + 1 ids, whether each of the last WINDOW is a target) of all windows of runs, as scoring cuts them.

    Only the very first window of a text has no context that the window before has as targets.
    """
    number = 1 + np.maximum(0, -(-(sizes - 1 - WINDOW) // STRIDE))
    owner = np.repeat(np.arange(len(sizes)), number)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    local = nth[:, None] * STRIDE + np.arange(WINDOW + 1)
    inside = local < sizes[owner][:, None]
    place = np.where(inside, (np.cumsum(sizes) - sizes)[owner][:, None] + local, 0)
    opening = (nth == 0) & ~later[owner]
    fresh = opening[:, None] | (np.arange(WINDOW) >= WINDOW - STRIDE)
    return ids[place], inside[:, 1:] & fresh


def training_runs(texts: DataFrame, model_path: str, shards: int) -> DataFrame:
    """(shard, shard_key, later, ids): all windows of the texts, as runs of packed ids; ``later`` but for a text's first."""
    processor = ChunkEncoder(model_path, True).processor
    encoded = encoded_texts(texts.select("shard_key", "text"), model_path)
    return encoded_runs(encoded, processor.bos_id(), processor.get_piece_size(), shards)


def encoded_runs(encoded: DataFrame, start: int, pieces: int, shards: int) -> DataFrame:
    """As ``training_runs``, of encoded texts."""
    kind = id_type(pieces)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ids, sizes in id_blocks(batch, kind):
                given = part.column("shard_key").to_pylist()
                keys, later, rows = [], [], []
                for text, nth, run in window_runs(ids, sizes, start):
                    keys.append((given[text] + nth * 0x9E3779B97F4A7C15) % (1 << 63))
                    later.append(nth > 0)
                    rows.append(run.astype(kind).tobytes())
                dealt = pa.array([key % shards for key in keys], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [dealt, pa.array(keys, pa.int64()), pa.array(later, pa.bool_()), pa.array(rows, pa.binary())],
                    names=["shard", "shard_key", "later", "ids"],
                )

    found = encoded.select("shard_key", "ids")
    return found.mapInArrow(cut, "shard int, shard_key bigint, later boolean, ids binary")


PACKED = pa.schema([("shard", pa.int32()), ("sizes", pa.binary()), ("later", pa.binary()), ("ids", pa.binary())])
MOVES = "part int, payload binary"


def _packed(shard: pa.Table) -> pa.Table:
    """A shard's runs as one row, in the order of their keys; sizes are in bytes."""
    shard = shard.sort_by("shard_key")
    rows = shard.column("ids").to_pylist()
    sizes = np.fromiter(map(len, rows), np.int32, len(rows))
    later = shard.column("later").to_numpy().astype(np.uint8)
    packed = [[shard.column("shard")[0].as_py()], [sizes.tobytes()], [later.tobytes()], [b"".join(rows)]]
    return pa.table(dict(zip(PACKED.names, packed)), PACKED)


def _round(held: np.ndarray, vocabulary: Vocabulary, rate: float):
    """Arrow function: packed shards to one payload, their number of windows and their summed weighted changes."""
    kind = id_type(len(vocabulary.row))

    def one_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(len(held) + 1)
        for batch in batches:
            for row in range(len(batch)):
                sizes, later, flat = (batch.column(name)[row].as_py() for name in PACKED.names[1:])
                sizes = np.frombuffer(sizes, np.int32).astype(np.int64) // np.dtype(kind).itemsize
                ids, scored = run_windows(np.frombuffer(flat, kind), sizes, np.frombuffer(later, np.uint8) > 0)
                order = np.random.default_rng(len(ids)).permutation(len(ids))  # neighbours of a text apart
                ids, scored = ids[order], scored[order]
                found = train(unflatten(held), vocabulary.row[ids[:, :-1]], vocabulary.group[ids[:, 1:]], scored, rate)
                total[0] += len(ids)
                total[1:] += (flatten(found) - held).astype(np.float64) * len(ids)
        if total[0]:
            yield _payload(TaskContext.get().partitionId(), total)

    return one_round


def _payload(part: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "payload"])


def _added(parts: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(p.as_py(), np.float64) for p in parts.column("payload"))
    return pa.Table.from_batches([_payload(parts.column("part")[0].as_py(), total)])


def tree_sum(parts: DataFrame) -> np.ndarray | None:
    """The sum of all payloads, at most one per partition, FAN_IN of them meeting at a time; None without any."""
    left = parts.rdd.getNumPartitions()
    while left > FAN_IN:
        dealt = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        parts, left = dealt.groupBy("part").applyInArrow(_added, MOVES), -(-left // FAN_IN)
    found = [np.frombuffer(p.as_py(), np.float64) for p in parts.orderBy("part").toArrow().column("payload")]
    return sum(found) if found else None


def learn(runs: DataFrame, vocabulary: Vocabulary, rates: tuple[float, ...] = RATES) -> Parameters:
    """One pass over all shards in as many rounds as there are rates, averaged after each round."""
    parameters = first_parameters(vocabulary)
    if not rates:
        return parameters
    packed = cut_lineage(runs.groupBy("shard").applyInArrow(_packed, "shard int, sizes binary, later binary, ids binary"))
    for nth, rate in enumerate(rates):
        held = flatten(parameters)
        own = packed.where(F.col("shard") % len(rates) == nth)
        total = tree_sum(own.mapInArrow(_round(held, vocabulary, rate), MOVES))
        if total is not None:
            parameters = unflatten(held + total[1:] / total[0])
    return parameters


def _frequent(counts: DataFrame) -> dict[bytes, int]:
    """At most FREQUENT_WORDS of the most frequent words and their counts, found by ranges of counts."""
    step = F.floor(F.log2("n") * COUNT_STEPS)
    sizes = counts.where("n > 1").groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()
    total, least = 0, None
    for nth, words in sorted(((r.step, r.words) for r in sizes), reverse=True):
        if total + words > FREQUENT_WORDS:
            break
        total, least = total + words, nth
    if least is None:
        return {}
    rows = counts.where(step >= least).toArrow()
    return dict(zip(rows["word"].cast(pa.binary()).to_pylist(), rows["n"].to_pylist()))


def _rare_lists(names: pa.Array, owner: np.ndarray, codes: np.ndarray, texts: int) -> pa.Array:
    """Per text its distinct words among the given ones, with how often each stands in it."""
    pairs, times = np.unique(owner * max(1, len(names)) + codes, return_counts=True)
    words = names.take(pa.array(pairs % max(1, len(names)))).cast(pa.string())
    rows = pa.StructArray.from_arrays([words, pa.array(times, pa.int64())], names=["word", "n"])
    offsets = np.searchsorted(pairs, np.arange(texts + 1) * max(1, len(names)))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)


def encoded_scores(encoded: DataFrame, flat: np.ndarray, vocabulary: Vocabulary, start: int) -> DataFrame:
    """(k1, k2, copies, score): each distinct text's number of rows and the log10 probability of its ids."""
    kind = id_type(len(vocabulary.row))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parameters = unflatten(flat)
        for batch in batches:
            for part, ids, sizes in id_blocks(batch, kind):
                found = log_probabilities(parameters, vocabulary, ids, sizes, start) / np.log(10.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("k1"), part.column("k2"), pa.array(found)], names=["k1", "k2", "score"]
                )

    rows = encoded.select("k1", "k2", "ids").mapInArrow(score, "k1 bigint, k2 bigint, score double")
    # Copies in other blocks may differ in the last places.
    return rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.max("score").alias("score"))


def score_texts(
    docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    spark = docs.sparkSession
    text = text_of(text_column)
    own_id = quoted(id_column)
    k1, k2 = text_pair(text)
    rows = docs.select(
        own_id.alias("id"), text.alias("text"), k1.alias("k1"), k2.alias("k2"), is_held_out(own_id).alias("held_out"),
        F.shiftrightunsigned(F.xxhash64(own_id, text), 1).alias("shard_key"),
    )
    training = rows.where(~F.col("held_out"))
    counts = cut_lineage(word_counts(training))
    n_texts = training.count()
    distinct, tokens = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    total = tokens + n_texts  # every training text has one end token
    size = distinct + (1 if n_texts else 0)
    norm = float(np.log10(total + size + 1))

    processor = ChunkEncoder(model_path, True).processor
    start, number = processor.bos_id(), processor.get_piece_size()
    encoded = cut_lineage(encoded_texts(rows.select("k1", "k2", "held_out", "shard_key", "text"), model_path))
    learned = encoded.where(~F.col("held_out"))
    pieces = id_counts(learned, number)
    vocabulary = Vocabulary.from_counts(pieces)
    shards = max(len(RATES), -(-int(pieces.sum()) // (STRIDE * SHARD_WINDOWS)))
    tasks = max(min(shards, FEW_TASKS), -(-shards // TASK_SHARDS))
    runs = encoded_runs(learned, start, number, shards).repartition(tasks, "shard")
    flat = flatten(learn(runs, vocabulary))
    frequent = spark.sparkContext.broadcast(_frequent(counts))  # at most FREQUENT_WORDS entries

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for batch in batches:
            done = 0
            for lengths, words in word_blocks(batch.column("text"), SPACED_WORDS):
                table = pa.array(words, pa.binary()).dictionary_encode()
                names, codes = table.dictionary.to_numpy(zero_copy_only=False).tolist(), table.indices.to_numpy().astype(np.int64)
                n = np.fromiter(map(known.get, names, repeat(0)), np.int64, len(names))
                owner = np.repeat(np.arange(len(lengths)), lengths)
                hit = n[codes] > 0
                base = np.bincount(owner, np.where(hit, (np.log10(n + 1.0) - norm)[codes], 0.0), len(lengths))
                found = np.bincount(owner, hit, len(lengths)).astype(np.int64)
                rare = _rare_lists(table.dictionary, owner[~hit], codes[~hit], len(lengths))
                part = batch.slice(done, len(lengths))
                done += len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("id", "k1", "k2", "held_out")]
                    + [pa.array(c) for c in (lengths + 1, found, base)]
                    + [rare],
                    names=["id", "k1", "k2", "held_out", "n_tokens", "found", "base", "rare"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, k1 bigint, k2 bigint, held_out boolean, n_tokens bigint, found bigint, base double, "
        "rare array<struct<word:string,n:bigint>>"
    )
    scanned = cut_lineage(rows.drop("shard_key").mapInArrow(scan, schema))
    # Equal texts bring equal rare words: their joined sums are divided by the number of copies.
    scored = encoded_scores(encoded, flat, vocabulary, start)
    rare = scanned.select("k1", "k2", F.explode("rare").alias("rare")).select("k1", "k2", "rare.word", "rare.n")
    met = rare.join(counts.withColumnRenamed("n", "seen"), "word", "left")
    seen = F.coalesce("seen", F.lit(0))
    sums = met.groupBy("k1", "k2").agg(
        F.sum(F.col("n") * (F.log10(seen + 1) - norm)).alias("rare_base"),
        F.sum(F.when(seen > 0, F.col("n")).otherwise(0)).alias("rare_found"),
    )
    joined = scanned.drop("rare").join(scored.join(sums, ["k1", "k2"], "left"), ["k1", "k2"], "left")
    end_known = 1 if n_texts else 0
    end_score = float(np.log10(n_texts + 1) - norm)
    return joined.select(
        F.col("id").alias(id_column),
        "held_out",
        "n_tokens",
        (F.col("found") + F.coalesce(F.col("rare_found") / F.col("copies"), F.lit(0)) + end_known)
        .cast("bigint").alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("rare_base") / F.col("copies"), F.lit(0.0)) + end_score).alias("base_score"),
        "score",
    )
