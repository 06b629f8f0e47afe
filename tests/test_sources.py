import json

import pytest

from sparktab.operators.profile import duplicate_column_names
from sparktab.sources.readers import column_table, load_table, read_csv
from sparktab.sources.workspace import Workspace


def test_csv_types_and_missing_tokens(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        '﻿id,x,flag,note,empty,big\n1,1.5,True,"a, b",,7\n2,NA,False,NaN,NULL,8\n3,-2e3,true,"q ""x""",n/a,9d\n', "utf-8"
    )
    df = load_table(spark, str(path))
    assert dict(df.dtypes) == {
        "id": "bigint", "x": "double", "flag": "boolean", "note": "string", "empty": "double", "big": "string",
    }
    rows = [tuple(r) for r in df.orderBy("id").collect()]
    assert rows[0] == (1, 1.5, True, "a, b", None, "7")
    assert rows[1][1] is None and rows[1][3] is None
    assert rows[2][3] == 'q "x"'


def test_csv_with_schema(spark, tmp_path):
    from pyspark.sql import types as T

    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,x\n,y\n")
    df = read_csv(spark, str(path), T.StructType.fromDDL("a int, b string"))
    assert [tuple(r) for r in df.collect()] == [(1, "x"), (None, "y")]


def test_json_forms(spark, tmp_path):
    array = tmp_path / "a.json"
    array.write_text(json.dumps([{"x": 1, "t": "a"}, {"x": 2, "t": None}], indent=1))
    lines = tmp_path / "b.jsonl"
    lines.write_text('{"x": 1, "t": "a"}\n{"x": 2, "t": null}\n')
    for path in (array, lines):
        assert sorted((r.x, r.t) for r in load_table(spark, str(path)).collect()) == [(1, "a"), (2, None)]
    columns = tmp_path / "c.json"
    columns.write_text('{"x": {"0": 1, "1": 2}, "t": {"0": "a", "1": "b"}}')
    with pytest.raises(ValueError):
        load_table(spark, str(columns))


def test_missing_and_unknown_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_table(spark, str(tmp_path / "none.csv"))
    with pytest.raises(FileNotFoundError):
        load_table(spark, str(tmp_path / "none.json"))
    with pytest.raises(ValueError):
        load_table(spark, "table.xlsx")


def test_column_table_and_duplicate_names(spark):
    df = spark.createDataFrame([(1, "a")], "n int, `A/B c` string")
    assert [tuple(r) for r in column_table(df).collect()] == [(0, "n", "int"), (1, "A/B c", "string")]
    assert duplicate_column_names(["a", "b", "a", "c", "b", "a"]) == ["a", "b"]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_processed_tables(spark, tmp_path, fmt):
    space = Workspace(spark, str(tmp_path / "w"))
    first = space.write_processed(spark.range(20).selectExpr("id", "id * 0.5 AS x"), "d", fmt)
    second = space.write_processed(spark.range(30).selectExpr("id", "id * 0.5 AS x"), "d", fmt)
    assert space.read_processed("d", first).count() == 20
    assert space.read_processed("d").count() == 30
    assert first != second
    small = space.write_processed(spark.range(5), "e")
    with pytest.raises(ValueError, match="under 10"):
        space.read_processed("e", small)
    empty = space.write_processed(spark.range(0), "f")
    with pytest.raises(ValueError, match="empty"):
        space.read_processed("f", empty)
    with pytest.raises(FileNotFoundError):
        space.read_processed("g")


def test_splits_metadata_and_runs(spark, tmp_path):
    space = Workspace(spark, str(tmp_path / "w"))
    parts = spark.range(10).selectExpr("id", "CASE WHEN id < 7 THEN 'train' ELSE 'test' END AS split")
    name = space.write_splits(parts, "d")
    assert space.read_splits(name, "train").count() == 7
    assert space.read_splits(name, "val").count() == 0
    space.write_metadata(name, {"classes": ["a", "中"], "shape": [10, 1]})
    assert space.read_metadata(name) == {"classes": ["a", "中"], "shape": [10, 1]}
    for i in range(2):
        space.log_run("d", name, "knn", {"k": i}, {"accuracy": 1.0}, "p")
    space.log_run("other", name, "knn", {}, {}, "p")
    assert [json.loads(r.params) for r in space.runs("d").collect()] == [{"k": 0}, {"k": 1}]
    assert space.runs().count() == 3
    assert Workspace(spark, str(tmp_path / "none")).runs().count() == 0


def test_predictions_as_csv(spark, tmp_path):
    space = Workspace(spark, str(tmp_path / "w"))
    path = space.write_predictions(spark.sql("SELECT 1 AS id, array(0.25D, 0.75D) AS predict_proba"), "d")
    assert spark.read.csv(path, header=True, escape='"').first().predict_proba == "[0.25,0.75]"
