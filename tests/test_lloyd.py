"""Shared k-means passes against one run at a time in plain numpy."""

import numpy as np
import pytest

from sparktab.models import clustering, lloyd


def frame(spark, x, parts):
    return spark.createDataFrame([tuple(map(float, v)) for v in x], ", ".join(f"c{i} double" for i in range(x.shape[1]))).repartition(parts)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    return np.round(np.concatenate([rng.normal(m, 0.5, (60, 3)) for m in (-4, 0, 4, 9)]), 3)


def test_runs_end_at_fixed_points_whatever_the_partitions(spark, points):
    names = ["c0", "c1", "c2"]
    found = []
    for parts in (1, 5):
        runs, passes = lloyd.run_all(frame(spark, points, parts), names, range(1, 7), 3, seed=9, tol=0.0)
        assert len(runs) == 18 and all(r.done and len(r.centres) == r.k for r in runs)
        assert passes <= 6 + max(r.moves for r in runs)
        found.append([sorted(map(tuple, np.round(r.centres, 6))) for r in runs])
        for run in runs:
            centres = np.array(run.centres)
            away = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
            nearest = away.argmin(axis=1)
            assert run.cost == pytest.approx(away.min(axis=1).sum())
            for c in np.unique(nearest):
                assert np.allclose(points[nearest == c].mean(axis=0), centres[c])
    assert found[0] == found[1]
    best = {k: min(r.cost for r in runs if r.k == k) for k in range(1, 7)}
    assert best[1] == pytest.approx(points.var(axis=0).sum() * len(points)) and all(best[k] > best[k + 1] for k in range(1, 6))
    assert best[4] < 0.05 * best[1]


def test_starts_prefer_far_rows(spark):
    """Of two groups, the second centre nearly always lies in the other one."""
    x = np.concatenate([np.zeros((50, 1)) + np.arange(50)[:, None] * 1e-3, np.full((50, 1), 100.0) + np.arange(50)[:, None] * 1e-3])
    runs = [lloyd.Run(2, s) for s in range(40)]
    rows = frame(spark, x, 3).selectExpr("c0 AS f0", "xxhash64(c0) AS hash")
    for step in range(2):
        lloyd.draw_next(rows, runs, 5, step)
    sides = [{float(c[0]) > 50 for c in r.centres} for r in runs]
    assert all(len(s) == 2 for s in sides)
    firsts = sum(float(r.centres[0][0]) > 50 for r in runs)
    assert 8 <= firsts <= 32


def test_fewer_distinct_rows_than_clusters_and_none(spark):
    df = frame(spark, np.array([[1.0], [1.0], [2.0]]), 2)
    table = {r.k: r.inertia for r in clustering.elbow_table(df, ["c0"], largest=4, starts=2, standardise=False).collect()}
    assert table[1] == pytest.approx(2 / 3) and table[2] == table[3] == table[4] == 0
    with pytest.raises(ValueError, match="no rows"):
        lloyd.run_all(df.where("false"), ["c0"], [1], 1)


@pytest.mark.parametrize(("numbers", "most"), [(10, 16), (50_000, 1)])
def test_long_payloads_are_added_on_spark(spark, monkeypatch, numbers, most):
    """The driver takes over few payloads, and of long ones only their sum."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    from sparktab.models import network

    taken, plain = [], Classic.toArrow

    def watched(self):
        table = plain(self)
        taken.append(table.num_rows)
        return table

    monkeypatch.setattr(Classic, "toArrow", watched)
    parts = spark.range(0, 9, 1, 9).selectExpr("CAST(id AS INT) AS part", "array(0.1D * id, 1D) AS payload")
    assert network._summed(parts, numbers) == pytest.approx([3.6, 9.0])
    assert taken and max(taken) <= most
