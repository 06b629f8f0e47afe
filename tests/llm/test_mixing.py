"""Mixing: targets, flows and selection against plain Python."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from sparktab.llm import mixing
from sparktab.llm.queries import QUERIES

from .conftest import table


def targets_of(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    given, todo, rest = {}, set(names), share * sum(sizes.values())
    while todo:
        unit = rest / sum(weight[s] for s in todo)
        over = {s for s in todo if unit * weight[s] > most * sizes[s]}
        if not over:
            return given | {s: unit * weight[s] for s in todo}
        for s in over:
            given[s] = most * sizes[s]
            rest -= given[s]
        todo -= over
    return given


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def rows_of(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["web", "web", "web", "web", "books", "code", "é", None, "tiny"] if i % 40 else ["rare"])
        words = 0 if i % 31 == 0 else int(rng.paretovariate(1.1)) + 3
        rows.append((i, " ".join(["word"] * min(words, 3000)), source))
    rows += [(7, "again and again", "web")] * 3 + [(None, "no id", "web"), (None, None, None), (500, None, "blank"), (501, " \t", "blank")]
    return rows


def test_query(spark, tmp_path):
    rows = rows_of(1)
    table(spark, rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op13_source_mix"](spark, str(tmp_path)).collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size_of(text)
    targets = targets_of(sizes)
    want = Counter((i, size_of(t), sizes[s], round(targets[s], 6)) for i, t, s in rows)
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in found) == want
    assert all(r.taken in (0, r.size, 2 * r.size) for r in found)
    taken = defaultdict(int)
    for r in found:
        taken[round(r.target, 6), r.source_size] += r.taken
    for s, size in sizes.items():
        assert abs(taken[round(targets[s], 6), size] - targets[s]) <= 3
    again = QUERIES["op13_source_mix"](spark, str(tmp_path))
    assert Counter(again.collect()) == Counter(found)
    moved = table(spark, rows[::-1], "doc_id bigint, text string, source string").repartition(7)
    moved.write.parquet(f"{tmp_path}/turned/documents.parquet")
    assert Counter(QUERIES["op13_source_mix"](spark, f"{tmp_path}/turned").collect()) == Counter(found)


def test_query_on_empty_and_blank_tables(spark, tmp_path):
    kind = "doc_id bigint, text string, source string"
    table(spark, [(1, "x", "y")], kind).where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op13_source_mix"](spark, f"{tmp_path}/none").collect() == []
    table(spark, [(1, None, None), (2, " ", "a")], kind).write.parquet(f"{tmp_path}/blank/documents.parquet")
    found = QUERIES["op13_source_mix"](spark, f"{tmp_path}/blank").collect()
    assert sorted(tuple(r) for r in found) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_one_long_document_is_whole_or_nothing(spark):
    rows = [(1, "w " * 100_000, "long")] + [(i, "a b c d e f g h", "short") for i in range(2, 2002)]
    mixed, sources = mixing.mix_sources(table(spark, rows, "doc_id bigint, text string, source string"), "doc_id", "text", "source", [1.0, 1.0])
    taken = {r.id: r.taken for r in mixed.collect()}
    targets = {r.name: r.target for r in sources.collect()}
    assert taken[1] % 100_000 == 0 and abs(sum(taken.values()) - taken[1] - targets["ashort"]) <= 8


def cheapest(capacity, members, quotas, most):
    """Largest flow and its least cost over all ways to route single words."""
    best = (0, 0)
    ways = [list(itertools.product(*[range(min(most * c, q) + 1) for q in (quotas[s] for s in m)])) for c, m in zip(capacity, members)]
    for flow in itertools.product(*ways):
        into = [0] * len(quotas)
        for m, f in zip(members, flow):
            for s, x in zip(m, f):
                into[s] += x
        out = [sum(f) for f in flow]
        if any(i > q for i, q in zip(into, quotas)) or any(o > most * c for o, c in zip(out, capacity)):
            continue
        cost = sum(sum(w // c for w in range(o)) for o, c in zip(out, capacity) if o)
        best = max(best, (sum(out), -cost))
    return best


def test_flow_is_largest_and_cheapest():
    rng = random.Random(8)
    for _ in range(25):
        k = rng.randint(2, 3)
        members = [sorted(rng.sample(range(k), rng.randint(1, 2))) for _ in range(rng.randint(2, 3))]
        capacity = [rng.randint(1, 3) for _ in members]
        quotas = [rng.randint(0, 5) for _ in range(k)]
        flows = mixing.route(capacity, members, quotas, 2)
        out = [sum(f) for f in flows]
        cost = sum(sum(w // c for w in range(o)) for o, c in zip(out, capacity))
        assert (sum(out), -cost) == cheapest(capacity, members, quotas, 2)
        into = [sum(f[m.index(s)] for m, f in zip(members, flows) if s in m) for s in range(k)]
        assert all(i <= q for i, q in zip(into, quotas)) and all(o <= 2 * c for o, c in zip(out, capacity))


def test_overlapping_sources(spark):
    """A small source that shares half its documents with a large one: shared words are routed once."""
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(1, 30), ["big"]) for i in range(300)]
    rows += [(300 + i, "w " * rng.randint(1, 30), ["small", "big", "big"]) for i in range(100)]
    rows += [(400 + i, "w " * rng.randint(1, 30), ["small"]) for i in range(100)]
    rows += [(500, "w w w", []), (501, "w w", None), (502, "w w", [None])]
    df = table(spark, rows, "doc_id bigint, text string, names array<string>")
    mixed, sources = mixing.mix_sources(df, "doc_id", "text", "names", [2.0, 1.0, 1.0], share=0.8)
    targets = {r.name: r.target for r in sources.collect()}
    found = mixed.collect()
    assert len(found) == len(rows) and set(targets) == {"abig", "asmall", "b"}
    taken = Counter()
    for r in found:
        taken[tuple(r.pattern)] += r.taken
        assert r.taken in (0, r.size, 2 * r.size)
    assert abs(sum(taken.values()) - sum(targets.values())) <= 40
    assert taken[("abig",)] <= targets["abig"] + 30 and taken[()] == 0
    # Quotas within reach of single passes cost nothing: no document is taken twice.
    assert all(r.taken <= r.size for r in found if tuple(r.pattern) != ("b",))


def test_too_many_patterns_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 1)
    rows = [(1, "w", ["a", "b"]), (2, "w", ["a", "c"])]
    with pytest.raises(ValueError, match="patterns"):
        mixing.mix_sources(table(spark, rows, "doc_id bigint, text string, names array<string>"), "doc_id", "text", "names", [1.0])
