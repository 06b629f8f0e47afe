"""Pruned neighbour search against all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from sparktab.functions import pivots
from sparktab.models.neighbors import neighbor_search


def rows_of(rng, n, width, clusters):
    middles = rng.uniform(-50, 50, (clusters, width))
    x = middles[rng.integers(0, clusters, n)] + rng.normal(0, 1, (n, width))
    return np.round(x, 2)


def frame(spark, x, key):
    rows = [(i, float(i % 3), *map(float, v)) for i, v in enumerate(x)]
    names = [f"a.{i}" for i in range(x.shape[1])]
    return spark.createDataFrame(rows, f"{key} bigint, __label double, " + ", ".join(f"`{n}` double" for n in names)), names


def brute(q, x, k, p):
    d = (np.abs(q[:, None, :] - x[None, :, :]) ** p).sum(axis=2) ** (1.0 / p)
    return {i: [int(j) for j in np.lexsort((np.arange(len(x)), d[i]))[:k]] for i in range(len(q))}


def lists(found):
    return {r["__q"]: [n["id"] for n in r["neighbors"]] for r in found.lists.collect()}


@pytest.mark.parametrize("p", [1.0, 2.0, 3.0])
def test_clusters_are_searched_in_part_only(spark, p):
    rng = np.random.default_rng(11)
    x, q = rows_of(rng, 900, 5, 12), None
    q = np.concatenate([x[:60] + 0.005, rows_of(rng, 20, 5, 3)])
    points, names = frame(spark, x, "__id")
    queries, _ = frame(spark, q, "__q")
    found = neighbor_search(queries, points, names, 4, p, broadcast_bytes=0, block_rows=40)
    assert lists(found) == brute(q, x, 4, p)
    assert found.pairs == 900 * 80 and found.compared < 0.6 * found.pairs


def test_ties_copies_and_few_points(spark):
    """A third of the points are equal, and there are ties at every distance."""
    x = np.array([[float(i % 4), float(i // 40)] for i in range(120)] + [[1.0, 1.0]] * 60)
    q = np.array([[0.5, 0.5], [1.0, 1.0], [3.0, 9.0], [-2.0, 0.0]])
    points, names = frame(spark, x, "__id")
    queries, _ = frame(spark, q, "__q")
    for k in (1, 7, 75, 500):
        for limits in ({"broadcast_bytes": 0, "block_rows": 11}, {}):
            assert lists(neighbor_search(queries, points, names, k, 2.0, **limits)) == brute(q, x, k, 2.0)


def test_nulls_and_empty_sides(spark):
    x = np.arange(20, dtype=float).reshape(10, 2)
    points, names = frame(spark, x, "__id")
    queries = spark.createDataFrame([(0, 0.0, 1.0, None), (1, 0.0, 1.0, float("nan")), (2, 0.0, 4.0, 5.0)], points.withColumnRenamed("__id", "__q").schema)
    for limits in ({"broadcast_bytes": 0}, {}):
        assert lists(neighbor_search(queries, points, names, 1, 2.0, **limits)) == {0: [], 1: [], 2: [2]}
        assert lists(neighbor_search(queries, points.where("false"), names, 1, 2.0, **limits)) == {0: [], 1: [], 2: []}
        assert lists(neighbor_search(queries.where("false"), points, names, 1, 2.0, **limits)) == {}
    odd = neighbor_search(queries, points, names, 2, 0.5, broadcast_bytes=0, block_rows=3)
    assert lists(odd) == {0: [], 1: [], 2: brute(np.array([[4.0, 5.0]]), x, 2, 0.5)[0]}


def test_pivots_do_not_change_the_result(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(0, 1, (300, 3))
    points, names = frame(spark, x, "__id")
    from pyspark.sql import functions as F

    def vectors(df, *keep):
        return df.select(*keep, F.array(*[F.col(f"`{n}`") for n in names]).alias("x"))

    from sparktab.models.neighbors import NEIGHBORS, nearest_in_block

    want = brute(x, x, 3, 2.0)
    for count in (1, 40):
        queries = vectors(points.withColumnRenamed("__id", "__q"), "__q")
        found = pivots.nearest_by_pivots(queries, vectors(points, "__id", "__label"), 3, 3, 2.0, nearest_in_block, NEIGHBORS, pivots=count)
        assert lists(found) == want and (found.compared == found.pairs) == (count == 1)


def test_pairs_of_queries_and_cells_leave_in_bounded_batches(spark, monkeypatch):
    """A batch of queries that want every cell is not multiplied by all cells at once."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([[float(i), 1.0] for i in range(50)])], names=["__q", "x"])
    wanted = np.ones((50, 30), bool)
    wanted[7] = False
    parts = list(pivots.pairs_of(batch, wanted, 64))
    assert max(p.num_rows for p in parts) == 64
    got = [(q, tuple(x), c) for p in parts for q, x, c in zip(*(p.column(n).to_pylist() for n in ("__q", "x", "cell")))]
    assert got == [(q, (float(q), 1.0), c) for q in range(50) if q != 7 for c in range(30)]
    assert not list(pivots.pairs_of(batch, np.zeros((50, 30), bool), 64))
    monkeypatch.setattr(pivots, "PAIR_NUMBERS", 40)
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(300, 4)), rng.normal(size=(40, 4))
    points, names = frame(spark, x, "__id")
    queries, _ = frame(spark, q, "__q")
    found = neighbor_search(queries, points, names, 3, broadcast_bytes=0, block_rows=100)
    assert lists(found) == brute(q, x, 3, 2)


@pytest.mark.parametrize("p", [1.0, 2.0, 3.0])
def test_bounded_search_finds_what_is_no_farther(p, monkeypatch):
    """Ties at the bound and copies are kept, queries out of reach find nothing, in few rough distances."""
    from sparktab.models import neighbors

    rng = np.random.default_rng(3)
    x = np.concatenate([rows_of(rng, 2000, 3, 40), np.repeat([[1.0, 2.0, 3.0]], 50, axis=0)])
    q = np.concatenate([x[::20], [[1.0, 2.0, 3.0], [500.0, 0.0, 0.0]]])
    ids = rng.permutation(len(x))
    d = (np.abs(q[:, None, :] - x[None, :, :]) ** p).sum(axis=2) ** (1.0 / p)
    bound = np.sort(d, axis=1)[:, 4]
    bound[-2:] = 0.0, 3.0
    bound[0] = np.inf
    want = []
    for i in range(len(q)):
        order = np.lexsort((ids, d[i]))[:6]
        want += [(i, int(ids[j])) for j in order if d[i, j] <= bound[i] * (1 + 1e-12)]
    looked = []
    close = neighbors._close
    monkeypatch.setattr(neighbors, "_close", lambda a, own, b, members, *rest: looked.append(len(own) * len(members)) or close(a, own, b, members, *rest))
    rows, cols, _ = neighbors.nearest_in_block(q, x, ids, 6, p, bound)
    assert list(zip(rows.tolist(), ids[cols].tolist())) == want
    assert p != 2 or sum(looked) < 0.2 * d.size


def test_cells_return_only_lists_within_the_bound(spark, monkeypatch):
    """What the second round brings back does not grow with the cells it looks into."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 6))
    points, names = frame(spark, x, "__id")
    queries, _ = frame(spark, x[:200], "__q")
    given = []
    whole = pivots.merged
    monkeypatch.setattr(pivots, "merged", lambda lists, k: given.append(lists) or whole(lists, k))
    found = neighbor_search(queries, points, names, 3, broadcast_bytes=0)
    assert lists(found) == brute(x[:200], x, 3, 2.0)
    assert found.compared > 200 * 300  # most cells are asked, few answer
    assert given[1].count() < 200 * 8


def test_cells_share_groups_of_bounded_points():
    holds = np.array([3, 0, 4, 25, 2, 9, 1])
    cells, first, number = pivots.grouped(holds, 10)
    assert [c.tolist() for c in cells] == [[0, 1, 2], [3], [3], [3], [4], [5, 6]]
    assert first.tolist() == [0, 0, 0, 1, 4, 5, 5] and number.tolist() == [1, 1, 1, 3, 1, 1, 1]


def test_a_query_goes_to_a_group_once():
    """However many of its cells it wants, in batches of a bounded number of rows."""
    rng = np.random.default_rng(2)
    wanted = rng.random((30, 12)) < 0.4
    wanted[:4] = True
    cells = [np.arange(0, 10), np.array([10, 11])]
    batch = pa.RecordBatch.from_arrays([pa.array(range(30), pa.int64())], names=["__q"])
    parts = list(pivots.by_group(batch, wanted, cells, 7))
    assert max(len(p) for p in parts) <= 7
    rows = [r for p in parts for r in p.to_pylist()]
    assert len({(r["__q"], r["group"]) for r in rows}) == len(rows) == sum(wanted[:, own].any(axis=1).sum() for own in cells)
    for r in rows:
        own = cells[r["group"]]
        assert (np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=len(own)).astype(bool) == wanted[r["__q"], own]).all()


def test_many_wanted_cells_and_a_hot_one(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(500, 8)), np.full((150, 8), 0.25) + rng.normal(0, 1e-4, (150, 8))])
    q = rng.normal(size=(40, 8))
    points, names = frame(spark, x, "__id")
    queries, _ = frame(spark, q, "__q")
    found = neighbor_search(queries, points, names, 6, 2.0, broadcast_bytes=0, block_rows=20)
    assert lists(found) == brute(q, x, 6, 2.0)
