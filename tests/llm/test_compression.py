"""Vector codes against plain Lloyd rounds, and cover trees against their own rules."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from sparktab.llm import compression, covertree
from sparktab.llm.queries import QUERIES


@pytest.mark.parametrize("kind", ["random", "clusters", "equal", "grid", "one"])
def test_trees_cover_and_assign_exactly(kind):
    rng = np.random.default_rng(5)
    points = {
        "random": rng.integers(-2000, 2000, (700, 8)),
        "clusters": rng.integers(-20, 20, (900, 8)) + rng.integers(-4000, 4000, (6, 8))[rng.integers(0, 6, 900)],
        "equal": np.tile(rng.integers(-9, 9, (1, 8)), (200, 1)),
        "grid": rng.integers(0, 2, (500, 8)),
        "one": rng.integers(-9, 9, (1, 8)),
    }[kind].astype(np.int64)
    tree = covertree.build(points)
    assert (tree.points == points[tree.order]).all() and sorted(tree.order) == list(range(len(points)))
    for node in range(len(tree.begin)):
        b, e = tree.begin[node], tree.end[node]
        away = np.sqrt(((tree.points[b:e] - tree.points[tree.centre[node]]) ** 2).sum(axis=1))
        assert tree.centre[node] == b and away.max() <= tree.radius[node] + 1e-9
        if tree.children[node]:
            brothers = range(tree.child[node], tree.child[node] + tree.children[node])
            assert [tree.begin[c] for c in brothers] == [b, *[tree.end[c] for c in brothers[:-1]]]
            assert tree.end[brothers[-1]] == e
            centres = tree.points[tree.centre[list(brothers)]].astype(float)
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))
            assert apart[~np.eye(len(centres), dtype=bool)].min() > tree.radius[node] / 2 * (1 - 1e-6)
    entries = np.concatenate([points[:10], points[:3], points[-3:] + 1])
    codes = np.zeros(len(points), np.int64)
    total, number, compared = covertree.assign(tree, entries, codes)
    want = covertree.squared(tree.points, entries).argmin(axis=1)
    assert (codes == want).all() and number.tolist() == np.bincount(want, minlength=len(entries)).tolist()
    for e in range(len(entries)):
        assert (total[e] == tree.points[want == e].sum(axis=0)).all()
    if kind in ("clusters", "equal"):
        assert compared < len(points)


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [
        (i, [math.floor(4096 * float(np.float32(x))) for x in v], label)
        for i, v, label in rows
        if v and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    for step in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e)) for p in range(parts)] for _, v, _ in kept]
        if step == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), c in zip(kept, codes) if c[p] == e]
                if mine:
                    books[p][e] = [sum(xs) // len(mine) for xs in zip(*mine)]
    errors = [sum(far(cut(v, p), books[p][c[p]]) for p in range(parts)) for (_, v, _), c in zip(kept, codes)]
    by_label = defaultdict(int)
    for (_, _, label), e in zip(kept, errors):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(
        [(i, "".join(f"{x:02x}" for x in c), e, by_label[label], sha) for (i, _, label), c, e in zip(kept, codes, errors)],
        key=str,
    )


def planted(n=260):
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 16)], int(rng.integers(0, 3))) for i in rng.permutation(n)]
    rows += [(900 + i, rows[3][1], None) for i in range(90)]
    rows += [(2, rows[5][1], 1), (2, rows[5][1], 1), (None, rows[7][1], None), (None, rows[8][1], 2)]
    for i, bad in enumerate((None, float("nan"), float("inf"), float("-inf"))):
        rows.append((-5 - i, [bad if j == 4 else 0.1 for j in range(16)], 1))
    return rows + [(-9, None, 1), (-10, [], 1)]


KIND = "vec_id bigint, embedding array<float>, label int, id string, code string, n bigint"


def written(spark, tmp_path, rows, parts=3):
    df = spark.createDataFrame([(*r, None, "x", 7) for r in rows], KIND)
    df.repartition(parts).write.parquet(f"{tmp_path}/embeddings.parquet")
    return QUERIES["op12_vector_codes"](spark, str(tmp_path))


def test_query_equals_plain_lloyd(spark, tmp_path):
    found = written(spark, tmp_path, planted())
    rows = [(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found.collect()]
    assert sorted(rows, key=str) == brute(planted())


def test_blocks_and_partitions_change_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(compression, "BLOCK_ROWS", 37)
    found = written(spark, tmp_path, planted(), parts=7)
    assert sorted([(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found.collect()], key=str) == brute(planted())


def test_fewer_rows_than_entries_and_none(spark, tmp_path):
    rows = [(i, [float(i)] * 8, 0) for i in range(3)]
    found = written(spark, tmp_path / "few", rows)
    assert sorted((r.code, r.error) for r in found.collect()) == [("00" * 8, 0), ("01" * 8, 0), ("02" * 8, 0)]
    for name, none in (("bad", [(1, None, 1)]), ("none", [])):
        found = written(spark, tmp_path / name, none)
        assert found.collect() == [] and len(found.columns) == 5


def test_unfit_vectors_are_refused(spark):
    for vectors in ([[1.0] * 8, [1.0] * 16], [[1.0] * 9], [[1e9] * 8]):
        df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "i int, v array<float>, label int")
        with pytest.raises(Exception, match="lengths|cut into|or more"):
            compression.compress(df, "i", "v", "label")[0].collect()
