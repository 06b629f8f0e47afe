"""Exact, SimHash and unit deduplication against plain Python."""

from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from sparktab.llm import exact, golay, simhash, units

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def test_exact_decisions(docs, texts):
    found = exact.decide_copies(docs, "doc_id", "text").collect()
    groups = defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    assert len(found) == len(texts)
    want = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        want.update((i, max(known) if known else None, len(ids)) for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in found) == want
    kept = [r for r in found if r.kept]
    assert len(kept) == len(groups) and len({r.text_sha256 for r in kept}) == len(groups)
    assert all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("support", [0.001, 0.9])
def test_exact_rows_that_stay(docs, texts, support):
    """Whether texts count as frequent (low support finds all of these) or not, the result is the same."""
    found = exact.drop_copies(docs, "doc_id", "text", support)
    assert found.columns == docs.columns
    best = {}
    for i, t in texts:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    rows = found.select("doc_id", "text").collect()
    assert {(r.text or ""): (-1 if r.doc_id is None else r.doc_id) for r in rows} == best
    assert len(rows) == len(best)


def test_exact_hot_group(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'hot', concat('t', id)) AS text")
    found = exact.decide_copies(rows, "doc_id", "text")
    assert found.where("group_size = 1000").count() == 1000
    assert found.where("kept").count() == 2001
    assert exact.drop_copies(rows, "doc_id", "text").count() == 2001


def test_golay_covers_neighbours():
    code = golay.Golay()
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 3000)
    near = code.near(words)
    assert set(np.sum(near != golay.NONE, axis=1)) <= {1, 6}
    for bit in range(23):
        other = code.near(words ^ (1 << bit))
        assert (near[:, :1] == other).any(axis=1).all() and (other[:, :1] == near).any(axis=1).all()


def test_fingerprints_and_components(spark, docs, texts):
    def mark(t):
        w = (t or "").encode().translate(LOWER).split()
        grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    marks = {t: mark(t) for _, t in texts}
    found = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fp % 2**64) for r in found) == Counter((i, marks[t]) for i, t in texts)
    roots = {m: m for m in marks.values()}

    def root(m):
        while roots[m] != m:
            m = roots[m]
        return m

    for a in roots:
        for b in roots:
            if (a ^ b).bit_count() <= 3:
                roots[root(a)] = root(b)
    least = {}
    for i, t in texts:
        r = root(marks[t])
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    assert Counter((r.doc_id, r.component_id) for r in found) == Counter((i, least[root(marks[t])]) for i, t in texts)
    kept = simhash.keep_one_each(docs, "doc_id", "text")
    assert kept.columns == docs.columns and kept.count() == len(least)


def test_links_of_random_marks(spark):
    """All pairs up to 3 bits apart are found, whichever segments the bits fall in."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    marks = list(base)
    for m in base:
        for n in (1, 2, 3, 4):
            bits = rng.choice(64, n, replace=False)
            marks.append(m ^ np.uint64(sum(1 << int(b) for b in bits)))
    values = np.unique(np.array(marks, np.uint64))
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp bigint")
    for distance in (3, 1):
        found = {(r.a, r.b) for r in simhash.fingerprint_links(frame, distance).collect()}
        want = set()
        for x in values:
            for y in values[np.bitwise_count(values ^ x) <= distance]:
                a, b = sorted((int(x.view(np.int64)), int(y.view(np.int64))))
                if a != b:
                    want.add((a, b))
        assert found == want
    with pytest.raises(ValueError):
        simhash.fingerprint_links(frame, 4)


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).selectExpr("id AS a", "id + 1 AS b").union(spark.createDataFrame([(900, 901)], "a long, b long"))
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert found == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}


def test_unit_removal(docs, texts):
    order = sorted({(i is None, i or 0, t or "") for i, t in texts}, key=lambda r: r[:2])
    seen, want = set(), {}
    for null, i, t in order:
        spans = []
        for b, e, w in units.text_units(t, 8):
            if w in seen:
                spans.append((b, e))
            seen.add(w)
        want.setdefault((None if null else i, t), spans)
    found = units.remove_repeats(docs).collect()
    assert len(found) == len(texts)
    times = Counter((i, t or "") for i, t in texts)
    sources = {(i, t or "") for i, t in texts}
    for i in {r.doc_id for r in found if r.doc_id is not None}:
        rows = [r for r in found if r.doc_id == i]
        (t,) = [t for j, t in sources if j == i]
        removed = sorted([tuple(s) for s in r.removed] for r in rows)
        first = want[i, t]
        every = [(b, e) for b, e, _ in units.text_units(t, 8)]
        assert removed == sorted([first] + [every] * (times[i, t] - 1))
        for r in rows:
            assert len(r.text) == len(t) - sum(e - b for b, e in r.removed)


def test_units_find_a_passage_inside_lines():
    passage = "The old bridge over the river was closed in winter. Nobody had been told of it before that day came."
    one = [w for _, _, w in units.text_units("Short start. " + passage + " Something else follows here in this first line of text.", 8)]
    two = [w for _, _, w in units.text_units("Another line begins in its own way with these words. " + passage, 8)]
    assert set(one) & set(two)
    text = "  First sentence has enough words to be a unit. Tail"
    assert [(b, e) for b, e, _ in units.text_units(text, 8)] == [(2, 47)]


def test_units_of_short_lines_and_unspaced_scripts():
    verse = "The river runs\nunder the bridge\nand the cold moon\nlooks down on it\nall night"
    text = f"A heading\n\n{verse}\n\nThis line after the verse has words enough to be one unit"
    found = [text[b:e] for b, e, _ in units.text_units(text, 8)]
    assert "\n".join(found[:-1]) == verse and found[-1].startswith("This line")
    other = f"Here is a quite different opening with more than eight words in it\n{verse}"
    assert {w for _, _, w in units.text_units(text, 8)} & {w for _, _, w in units.text_units(other, 8)}
    first, second = "古い橋は冬の間ずっと閉ざされていた。", "誰もそのことを前もって知らされなかった。"
    assert [(first + second)[b:e] for b, e, _ in units.text_units(first + second, 8)] == [first, second]


def test_empty_tables(none):
    assert exact.decide_copies(none, "doc_id", "text").count() == 0
    assert exact.drop_copies(none, "doc_id", "text").count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one_each(none, "doc_id", "text").count() == 0
    assert units.remove_repeats(none).count() == 0
