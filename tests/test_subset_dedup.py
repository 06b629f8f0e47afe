"""Removal of rows that repeat a subset of columns, decided on hashes."""

import random

import pytest
from pyspark.sql import functions as F

from sparktab.operators import duplicates


def plain(rows, keep):
    """Rows are (a, b, when, extra); combinations are (a, b), ordered by when, then extra."""
    groups = {}
    for r in rows:
        groups.setdefault(r[:2], []).append(r)
    low = lambda v: (v is not None, v)  # noqa: E731  nulls first, as Spark orders them
    rank = lambda r: (low(r[2]), low(r[3]))
    if keep is False:
        return sorted((g[0] for g in groups.values() if len(g) == 1), key=str)
    return sorted((min(g, key=rank) if keep == "first" else max(g, key=rank) for g in groups.values()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [("hot", None, rng.randint(0, 400), f"e{i}") for i in range(200)]
    out += [(rng.choice(["x", "y", None]), rng.choice(["x", "y", None]), rng.choice([1, 2, None]), rng.choice(["p", "q", None])) for _ in range(150)]
    return out + [(f"one{i}", "z", i, "single") for i in range(60)] + [("copy", "copy", 5, "same")] * 4


@pytest.mark.parametrize("keep", ["first", "last", False])
@pytest.mark.parametrize("few", [True, False])
def test_same_rows_as_plain_python(spark, rows, keep, few, monkeypatch):
    if not few:
        monkeypatch.setattr(duplicates, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame(rows, "a string, b string, `when` int, extra string").repartition(4)
    found = duplicates.drop_duplicates_by(df, ["a", "b"], keep, "when")
    assert found.columns == df.columns
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows, keep)


def test_null_places_are_told_apart(spark):
    df = spark.createDataFrame([(None, "x", 1), ("x", None, 2), (None, None, 3)], "a string, b string, n int")
    assert duplicates.drop_duplicates_by(df, ["a", "b"], "first", "n").count() == 3
    zeros = spark.createDataFrame([(0.0, 4), (-0.0, 5), (float("nan"), 6), (float("nan"), 7)], "a double, n int")
    assert sorted(r.n for r in duplicates.drop_duplicates_by(zeros, ["a"], "last", "n").collect()) == [5, 7]


def test_maps_and_empty_tables(spark):
    df = spark.sql("SELECT id % 3 AS a, id AS n, map('k', id % 2, 'j', id) AS m FROM range(12)")
    assert sorted((r.a, r.n, r.m["j"]) for r in duplicates.drop_duplicates_by(df, ["a"], "first", "n").collect()) == [(0, 0, 0), (1, 1, 1), (2, 2, 2)]
    tied = df.withColumn("n", F.lit(1)).withColumn("m", F.map_from_arrays(F.array(F.lit("k")), F.array(F.col("a"))))
    assert sorted((r.a, r.m["k"]) for r in duplicates.drop_duplicates_by(tied, ["a"], "first", "n").collect()) == [(0, 0), (1, 1), (2, 2)]
    by_map = df.select("n", F.map_from_arrays(F.array(F.lit("k")), F.array(F.col("a"))).alias("m"))
    assert sorted(r.n for r in duplicates.drop_duplicates_by(by_map, ["m"], "last", "n").collect()) == [9, 10, 11]
    for keep in ("first", False):
        assert duplicates.drop_duplicates_by(df.where("false"), ["a"], keep, "n").collect() == []


def test_texts_are_not_sorted(spark, rows):
    """Whole rows take no part in a sort but for those that share combination and order keys."""
    df = spark.createDataFrame(rows[:260], "a string, b string, `when` int, extra string").dropDuplicates(["a", "b", "when"])
    plan = duplicates.drop_duplicates_by(df, ["a", "b"], "first", "when")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan
