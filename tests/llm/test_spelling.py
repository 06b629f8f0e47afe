"""Spelling variants against plain Python."""

import random
import re
from collections import Counter
from zlib import crc32

from sparktab.llm import spelling
from sparktab.llm.queries import QUERIES

from .conftest import table


def edits(w, letters):
    out = set()
    for i in range(len(w) + 1):
        for x in letters:
            out.add(w[:i] + x + w[i:])
    for i in range(len(w)):
        out.add(w[:i] + w[i + 1 :])
        for x in letters:
            out.add(w[:i] + x + w[i + 1 :])
    return out - {w}


def brute(counts, ratio=2):
    letters = sorted({x for w in counts for x in w})
    rows = {}
    for w, n in counts.items():
        near = sorted((e for e in edits(w, letters) if e in counts), key=lambda e: (-counts[e], e))
        form = near[0] if near and counts[near[0]] >= ratio * n else None
        rows[w] = [w, n, len(near), form, counts[form] if form else None, w]
    for w, row in rows.items():
        while rows[row[5]][3]:
            row[5] = rows[row[5]][3]
    return {tuple(r) for r in rows.values()}


def as_rows(df):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def check(spark, counts):
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert as_rows(spelling.spelling_variants(words)) == brute(counts)


def test_variants_of_random_words(spark):
    rng = random.Random(1)
    counts = {}
    for _ in range(500):
        w = "".join(rng.choice("abé") for _ in range(rng.randint(1, 6)))
        counts[w] = rng.choice([3, 4, 6, 8, 16, 16, 40])
    check(spark, counts)


def test_chains_runs_and_ties(spark):
    counts = {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "baaaaaaa": 24, "bbaaaaaaa": 50, "bcaaaaaaa": 50, "alone": 9, "ÿaaaaaa": 6}
    check(spark, counts)


def test_long_words_keep_linear_keys(spark):
    rng = random.Random(2)
    long = ["".join(rng.choice("abc") for _ in range(size)) for size in (62, 63, 64, 65, 400)]
    counts = {}
    for w in long:
        counts[w] = 8
        counts[w[:30] + w[31:]] = 3
        counts[w[:10] + "x" + w[11:]] = 16
        counts[w + "y"] = 40
    counts["z" * 300] = 5
    counts["z" * 301] = 10
    check(spark, counts)
    keys = [key for key, _, _ in spelling.rotations("ab" * 5000)]
    assert len(keys) == 20001 and max(map(len, keys)) < 200


def test_groups_across_batches(spark):
    """All words differ in one letter: one group that spans many small batches."""
    letters = [chr(c) for c in range(0x61, 0x7B)] + [chr(c) for c in range(0xC0, 0x100)]
    counts = {"wor" + x + "d": 3 + i for i, x in enumerate(letters)} | {"word": 400}
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        check(spark, counts)
    finally:
        spark.conf.set(size, before)


def counted(rows, every=97, least=5):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(x.lower() if x.isascii() else x for x in run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= 3}


def test_counts(spark, docs, texts):
    for every in (97, 3):
        found = spelling.count_words(docs, "doc_id", "text", slip_every=every)
        assert {r.word: r.n for r in found.collect()} == counted(texts, every)


def test_query_equals_brute_force(spark, tmp_path, docs, texts):
    rng = random.Random(3)
    more = [(i, " ".join(rng.choice(["Garden", "gardén", "windowx", "window", "lanterns×", "street"]) for _ in range(60))) for i in range(400, 470)]
    table(spark, texts + more).write.parquet(f"{tmp_path}/documents.parquet")
    assert as_rows(QUERIES["op11_spelling_variants"](spark, str(tmp_path))) == brute(counted(texts + more))


def test_query_on_empty_table(spark, tmp_path, none):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op11_spelling_variants"](spark, str(tmp_path))
    assert found.collect() == [] and set(found.columns) == {"word", "form", "root", "n", "n_near", "form_n"}


def test_long_text_is_searched_whole(spark):
    text = "winter " * 400_000 + "spring spring spring"
    found = spelling.count_words(table(spark, [(1, text)]), "doc_id", "text")
    assert {r.word: r.n for r in found.collect()} == {"winter": 400_000, "spring": 3}
