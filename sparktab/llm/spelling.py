"""Spelling variants by permuterm rotations.

Words are counted over all texts: maximal runs of letters, A-Z lowered, kept if long and frequent
enough. Two words are near if one inserted, deleted or replaced code point separates them. A
word's form is its near word with the largest count (ties: the smallest in code-point order), if
that count is ``ratio`` times its own or more; its root is where following the forms ends.

Every word w is marked with a terminator T, and wT is rotated in two ways. Whole rotations end
before their start. Skipping rotations leave out one letter x of w = a x b: they are the prefix
b T a of the rotation b T a x. So a word that has another letter for x has the same skipping
rotation, and the word without it, ab, has it as a whole rotation: each range of rotations with
one prefix holds all words that agree but for the skipped letter, and at most one word without
it. Rotations are range-partitioned and sorted on Spark and scanned group by group. A group has
no more rows than the alphabet has letters, plus one, and gives each of its words the number of
neighbours and the best one, never pairs. A letter deleted anywhere in a run of equal letters
gives the same word: only the run's first letter counts for that pair.

Prefixes of over KEY_CHARS code points are sorted by their first code points and a 127-bit rolling
hash of the whole, so the rotations of a word take room in proportion to its length.

A null text has no words, a null id is the empty id. Rows repeated count as often as they occur.
No words give an empty result. Other columns of the table are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import quoted
from ..session import cut_lineage
from .common import BLOCK_BYTES, SLICE_ROWS, text_of

#: The letters of a word after lowering A-Z.
LETTERS = "A-Za-zÀ-ÿ"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Distinct words, and bytes of text, after which a task hands on its counts.
HELD_WORDS = 200_000
HELD_BYTES = 32_000_000
#: Stands behind the last letter; not a letter itself.
END = "\0"
KEY_CHARS = 64
PRIME = (1 << 127) - 1
BASE = 0x1F3D5B79A2C4E68013579BDF2468ACE1
#: Rows of rotations handed on at a time.
BATCH_ROWS = 50_000


def _runs(text: str, pattern: re.Pattern) -> Counter:
    """The runs of a text and how often each occurs; a very long text is searched piece by piece."""
    if len(text) <= BLOCK_BYTES:
        return Counter(pattern.findall(text))
    return Counter(match.group() for match in pattern.finditer(text))


def count_words(
    docs: DataFrame, id_column: str, text_column: str, least_chars: int = 5, least_count: int = 3, slip_every: int = 0
) -> DataFrame:
    """(word, n) of the words with enough code points and occurrences.

    With ``slip_every`` = m, a run whose unsigned crc32 h of ``<id>:<run>`` is divisible by m
    loses its code point h % length (a reproducible typing error).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A lost letter makes words shorter only, so shorter runs never count.
        pattern = re.compile(f"[{LETTERS}]{{{max(least_chars, 1)},}}")
        counts: Counter = Counter()
        seen = 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                for key, text in zip(part.column("id").to_pylist(), texts):
                    runs = _runs(text.translate(LOWER).decode(), pattern)
                    seen += len(text)
                    if not slip_every:
                        counts.update(runs)
                        continue
                    start = crc32(f"{key}:".encode())
                    for run, n in runs.items():
                        h = crc32(run.encode(), start)
                        if h % slip_every == 0:
                            spot = h % len(run)
                            run = run[:spot] + run[spot + 1 :]
                            if len(run) < least_chars:
                                continue
                        counts[run] += n
                    if len(counts) > HELD_WORDS or seen > HELD_BYTES:
                        yield _counted(counts)
                        counts, seen = Counter(), 0
        yield _counted(counts)

    texts = docs.select(
        F.coalesce(quoted(id_column).cast("string"), F.lit("")).alias("id"), text_of(text_column).alias("text")
    )
    found = texts.mapInArrow(count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _counted(counts: Counter) -> pa.RecordBatch:
    words = pa.array(list(counts), pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def rotations(word: str) -> Iterator[tuple[str, int, bool]]:
    """(key, skipped code point, first of its run) of every rotation; -1 where nothing is skipped.

    All rotations are parts of the marked word written twice.
    """
    size = len(word)
    twice = (word + END) * 2
    if size < KEY_CHARS:
        for i in range(size + 1):
            yield twice[i : i + size + 1], -1, False
        for i, letter in enumerate(word):
            yield twice[i + 1 : i + size + 1], ord(letter), i == 0 or word[i - 1] != letter
        return
    sums = [0]
    for letter in twice:
        sums.append((sums[-1] * BASE + ord(letter)) % PRIME)
    powers = {length: pow(BASE, length, PRIME) for length in (size, size + 1)}

    def key(begin: int, length: int) -> str:
        if length <= KEY_CHARS:
            return twice[begin : begin + length]
        digest = (sums[begin + length] - sums[begin] * powers[length]) % PRIME
        return f"{twice[begin : begin + KEY_CHARS]}{END}{END}{length}{END}{digest:032x}"

    for i in range(size + 1):
        yield key(i, size + 1), -1, False
    for i, letter in enumerate(word):
        yield key(i + 1, size), ord(letter), i == 0 or word[i - 1] != letter


def rotation_rows(words: DataFrame) -> DataFrame:
    """(key, wid, n, skipped, first) of all rotations of the (word, wid, n) rows."""

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[str] = []
        rest: list[tuple[int, int, int, bool]] = []

        def batch_of() -> pa.RecordBatch:
            wid, n, skipped, first = zip(*rest)
            columns = [pa.array(keys, pa.string()), pa.array(wid, pa.int64()), pa.array(n, pa.int64())]
            columns += [pa.array(skipped, pa.int32()), pa.array(first, pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, names=["key", "wid", "n", "skipped", "first"])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                for word, wid, n in zip(*(part.column(c).to_pylist() for c in ("word", "wid", "n"))):
                    for key, skipped, first in rotations(word):
                        keys.append(key)
                        rest.append((wid, n, skipped, first))
                        if len(keys) >= BATCH_ROWS:
                            yield batch_of()
                            keys, rest = [], []
        if keys:
            yield batch_of()

    return words.select("word", "wid", "n").mapInArrow(
        rotate, "key string, wid bigint, n bigint, skipped int, first boolean"
    )


def _best_two(group: np.ndarray, n: np.ndarray, wid: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of each group's first and second row by falling n, then wid; -1 where there is none."""
    order = np.lexsort((wid, -n, group))
    ordered = group[order]
    sizes = np.bincount(ordered, minlength=groups)
    starts = np.cumsum(sizes) - sizes
    best = np.full((2, groups), -1, np.int64)
    for place in (0, 1):
        has = sizes > place
        best[place, has] = order[starts[has] + place]
    return best[0], best[1]


def near_in_groups(group: np.ndarray, wid: np.ndarray, n: np.ndarray, skipped: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """(wid, neighbours, n of the best, wid of the best) for every row of the groups that has neighbours.

    Of rows that skip a letter each is near all others of its group; the row that skips none
    (the word without the letter) is near those that skip the first letter of a run.
    """
    groups = int(group[-1]) + 1
    long = np.flatnonzero(skipped >= 0)
    short = np.flatnonzero(skipped < 0)
    heads = long[first[long]]
    whole = np.full(groups, -1, np.int64)
    whole[group[short]] = short
    top, second = _best_two(group[long], n[long], wid[long], groups)
    top, second = (np.where(p >= 0, long[p], -1) if len(long) else p for p in (top, second))
    head, _ = _best_two(group[heads], n[heads], wid[heads], groups)
    head = np.where(head >= 0, heads[head], -1) if len(heads) else head
    members = np.bincount(group[long], minlength=groups)
    head_count = np.bincount(group[heads], minlength=groups)

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of two positions (-1: none) the one with the larger n, then the smaller wid."""
        ahead = (n[b] > n[a]) | ((n[b] == n[a]) & (wid[b] < wid[a]))
        return np.where((a < 0) | ((b >= 0) & ahead), b, a)

    own = group[long]
    shorter = np.where(first[long], whole[own], -1)
    other = np.where(top[own] == long, second[own], top[own])
    counts = [members[own] - 1 + (shorter >= 0), head_count[group[short]]]
    best = [better(other, shorter), head[group[short]]]
    rows, count, best = np.concatenate([long, short]), np.concatenate(counts), np.concatenate(best)
    near = count > 0
    return [wid[rows[near]], count[near], n[best[near]], wid[best[near]]]


def scan_sorted(rows: DataFrame) -> DataFrame:
    """(wid, n_near, best_n, best) of every group of equal keys, from rows sorted by key."""
    names = ["wid", "n_near", "best_n", "best"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups_of(table: pa.Table) -> pa.RecordBatch | None:
            key = table.column("key").combine_chunks()
            new = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
            group = np.concatenate([[0], np.cumsum(new)])
            several = np.bincount(group)[group] > 1
            if not several.any():
                return None
            columns = [table.column(c).to_numpy()[several] for c in ("wid", "n", "skipped", "first")]
            _, group = np.unique(group[several], return_inverse=True)
            found = near_in_groups(group, *columns)
            return pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            # The last group may go on in the next batch.
            key = batch.column("key")
            last = key[len(key) - 1]
            end = int(pc.sum(pc.not_equal(key, last)).as_py())
            if end or (held and held[-1].column("key")[-1] != last):
                done = groups_of(pa.Table.from_batches([*held, batch.slice(0, end)]))
                held = []
                if done is not None:
                    yield done
            held.append(batch.slice(end))
        if held:
            done = groups_of(pa.Table.from_batches(held))
            if done is not None:
                yield done

    return rows.mapInArrow(scan, "wid bigint, n_near bigint, best_n bigint, best bigint")


def near_words(words: DataFrame) -> DataFrame:
    """(wid, n_near, best_n, best) of every word that has a near word, from (word, wid, n) rows.

    ``wid`` must follow the words' order; ties go to the smaller one.
    """
    rows = rotation_rows(words).repartitionByRange("key").sortWithinPartitions("key")
    found = scan_sorted(rows)
    ranked = F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("wid"))
    merged = found.groupBy("wid").agg(F.sum("n_near").alias("n_near"), F.min(ranked).alias("least"))
    return merged.select("wid", "n_near", (-F.col("least.n")).alias("best_n"), F.col("least.wid").alias("best"))


def follow(links: DataFrame) -> DataFrame:
    """(wid, root) for (wid, up) links without cycles, by pointer doubling."""
    state = cut_lineage(links.select("wid", F.col("up").alias("root")))
    while True:
        step = state.select(F.col("wid").alias("root"), F.col("root").alias("above"))
        moved = cut_lineage(
            state.join(step, "root", "left").select(
                "wid", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")
            )
        )
        state = moved.select("wid", "root")
        if moved.where("moved").isEmpty():
            return state


def spelling_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n and root of every (word, n) row; words must be distinct."""
    ordered = words.select("word", "n").orderBy("word")
    known = cut_lineage(ordered.withColumn("wid", F.monotonically_increasing_id()))
    near = cut_lineage(known.join(near_words(known), "wid", "left"))
    linked = near.where(F.col("best_n") >= ratio * F.col("n"))
    roots = follow(linked.select("wid", F.col("best").alias("up")))
    names = known.select("wid", "word")
    named = (
        linked.select("wid", F.col("best_n").alias("form_n"), "best")
        .join(names.toDF("best", "form"), "best")
        .join(roots, "wid")
        .join(names.toDF("root", "root_word"), "root")
        .select("wid", "form", "form_n", F.col("root_word").alias("root"))
    )
    return near.join(named, "wid", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root")
    )
