"""Splits, folds and weights for labels of very many classes."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparktab.functions.joins import joined_by_share
from sparktab.models import search, weights
from sparktab.operators import splitting, strata


@pytest.fixture(scope="module")
def rows(spark):
    """A class of a third of all rows, many small ones and a null one; a column named like the helpers' own."""
    rng = random.Random(4)
    labels = ["hot"] * 130 + [None] * 9 + [f"c{rng.randint(0, 30):02d}" for _ in range(260)]
    data = [(i, label, "x" if i % 2 else None) for i, label in enumerate(labels)]
    return spark.createDataFrame(data, "id bigint, `my label` string, n string").repartition(5).cache()


@pytest.mark.parametrize("test, val", [(0.2, 0.2), (0.3, 0.1), (0.1, 0.0)])
def test_split_is_the_same_with_few_and_many(spark, rows, monkeypatch, test, val):
    options = {"label": "my label", "test_size": test, "val_size": val, "key": ["id"], "dedup": False, "limits": "request", "min_class_rows": 1}
    few = splitting.split_table(rows, **options)
    monkeypatch.setattr(splitting, "MAX_STRATA", 3)
    many = splitting.split_table(rows, **options)
    assert many.columns == few.columns
    a, b = ({r.id: (r["my label"], r.n, r.split) for r in df.collect()} for df in (few, many))
    assert len(b) == rows.count()
    if val:
        assert a == b
    else:  # the repaired validation part is drawn from another order, with the same sizes
        assert Counter((v[0], v[2] == "test") for v in a.values()) == Counter((v[0], v[2] == "test") for v in b.values())
        assert Counter(v[2] for v in a.values()) == Counter(v[2] for v in b.values())


def test_small_classes_still_fall_back(rows, monkeypatch):
    monkeypatch.setattr(splitting, "MAX_STRATA", 3)
    tiny = rows.union(rows.limit(1).selectExpr("-1L", "'alone'", "'y'"))
    parts = splitting.split_table(tiny, "my label", key=["id"], dedup=False)
    assert Counter(r.split for r in parts.collect())["test"] == 80


def test_shared_keys_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(splitting, "MAX_STRATA", 3)
    df = spark.createDataFrame([(i % 8, i // 8) for i in range(160)], "c bigint, v bigint")
    parts = splitting.split_table(df, "c", key=["c"], dedup=True)
    counted = Counter((r.c, r.split) for r in parts.collect())
    assert all(counted[c, "test"] == 4 and counted[c, "val"] == 4 for c in range(8))


def test_shared_sizes_equal_the_driver(spark):
    rng = random.Random(6)
    for _ in range(3):
        counts = {f"k{i}": rng.randint(0, 50) for i in range(40)} | {None: 7}
        total = rng.randint(0, sum(counts.values()))
        df = spark.createDataFrame(list(counts.items()), "label string, n bigint")
        found = {r.label: r.got for r in strata.shared_sizes(df, "n", total, "got").collect()}
        assert found == splitting.largest_remainder(counts, total)
    huge = spark.createDataFrame([("a", 4 * 10**17), ("b", 10**17 + 1)], "label string, n bigint")
    want = splitting.largest_remainder({"a": 4 * 10**17, "b": 10**17 + 1}, 10**17)
    assert {r.label: r.got for r in strata.shared_sizes(huge, "n", 10**17, "got").collect()} == want
    none = strata.shared_sizes(huge.where("false"), "n", 0, "got")
    assert none.collect() == []


def test_folds_are_even(rows, monkeypatch):
    monkeypatch.setattr(search, "MAX_STRATA", 3)
    folds = search.assign_folds(rows, 4, "my label", ["id"])
    assert folds.columns == [*rows.columns, "fold"]
    sizes = defaultdict(Counter)
    for r in folds.collect():
        sizes[r["my label"]][r.fold] += 1
    assert len(sizes) > 20
    for counted in sizes.values():
        assert max(counted[f] for f in range(4)) - min(counted[f] for f in range(4)) <= 1


def test_weights_are_the_same_with_few_and_many(rows, monkeypatch):
    few = weights.add_class_weights(rows, "my label", out="n")
    monkeypatch.setattr(weights, "MAX_STRATA", 3)
    many = weights.add_class_weights(rows, "my label", out="n")
    assert Counter((r.id, round(r.n, 9)) for r in few.collect()) == Counter((r.id, round(r.n, 9)) for r in many.collect())


def test_joined_by_share(spark):
    df = spark.range(300).selectExpr("id", "IF(id % 3 = 0, null, IF(id % 3 = 1, 'hot', concat('k', id))) AS k")
    totals = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    for support in (0.0, 0.1, 1.0):
        found = joined_by_share(df, totals, ["k"], "n", support)
        assert found.columns == ["id", "k", "n", "top"] and found.count() == 300
        assert {r.k: r.top for r in found.collect()} == {r.k: r.top for r in totals.collect()}
