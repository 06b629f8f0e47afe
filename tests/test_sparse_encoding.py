"""One-hot positions for any number of categories."""

import pytest

from sparktab.functions import dictionary
from sparktab.operators.encoding import FeatureTransformer
from sparktab.operators.sparse_encoding import SparseOneHot


@pytest.fixture()
def rows(spark):
    data = [(i, ["b", "a", None, "c"][i % 4], i % 3, None) for i in range(40)] + [(99, "hot", 7, None)] * 30
    return spark.createDataFrame(data, "id int, `a b` string, k int, none string")


def expected(value, values, offset, has_null):
    """Position of a value among sorted categories, the first one dropped."""
    if value is None:
        return offset + len(values) - 1 if has_null and values else None
    code = values.index(value) if value in values else -1
    return offset + code - 1 if code >= 1 else None


@pytest.mark.parametrize("limit", [10_000, 2])
def test_positions_vectors_and_categories(spark, rows, tmp_path, limit, monkeypatch):
    """The same whether the dictionaries are short lists or tables that are joined."""
    monkeypatch.setattr(dictionary.fit_dictionaries, "__defaults__", (limit, None))
    encoder = SparseOneHot.fit(rows, ["a b", "k", "none"])
    encoder.save(spark, str(tmp_path / "e"))
    encoder = SparseOneHot.load(spark, str(tmp_path / "e"))
    assert encoder.sizes == {"a b": 5, "k": 4, "none": 1} and encoder.total == 7
    names, keys = ["a", "b", "c", "hot"], [0, 1, 2, 7]
    new = rows.union(spark.createDataFrame([(100, "unseen", 1, "x"), (101, "a", None, None)], rows.schema))
    found = encoder.positions(new.withColumnRenamed("id", "positions").withColumnRenamed("positions", "id")).collect()
    assert len(found) == 72
    for r in found:
        want = [expected(r["a b"], names, 0, True), expected(r.k, keys, 4, False)]
        assert r.positions == [p for p in want if p is not None], r
    for r in encoder.vectors(new).collect():
        want = [expected(r["a b"], names, 0, True), expected(r.k, keys, 4, False)]
        assert r.features.size == 7 and sorted(r.features.indices) == [p for p in want if p is not None]
    table = {(r.column, r.category): r.position for r in encoder.categories(spark).collect()}
    assert table == {("a b", "b"): 0, ("a b", "c"): 1, ("a b", "hot"): 2, ("a b", None): 3, ("k", "1"): 4, ("k", "2"): 5, ("k", "7"): 6}


def test_same_ones_as_the_wide_encoder(rows):
    wide = FeatureTransformer.fit(rows, ["a b", "k"], onehot=["a b", "k"])
    sparse = SparseOneHot.fit(rows, ["a b", "k"])
    both = sparse.positions(wide.transform(rows, keep_raw=True)).collect()
    for r in both:
        assert r.positions == [i for i, c in enumerate(wide.output_columns) if r[c] == 1.0]


def test_empty_and_constant_columns(spark, rows):
    with pytest.raises(ValueError, match="two categories"):
        SparseOneHot.fit(rows, ["none"]).vectors(rows)
    empty = SparseOneHot.fit(rows.where("false"), ["k"])
    assert empty.total == 0 and {len(r.positions) for r in empty.positions(rows).collect()} == {0}
