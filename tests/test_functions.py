import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktab.functions.blocks import against_all
from sparktab.functions.dictionary import Dictionary
from sparktab.functions.frequencies import column_modes, distinct_lists
from sparktab.functions.quantiles import exact_quantiles
from sparktab.functions.ranking import order_keys, rank_cuts, ranked_dictionary, running_totals
from sparktab.session import cut_lineage, ensure_checkpoint_dir, local_table

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def _column(kind):
    rng = np.random.default_rng(3)
    return {
        "normal": rng.normal(size=4000),
        "ties": rng.integers(0, 5, 4000).astype(float),
        "hot": np.concatenate([np.full(2000, 7.25), rng.normal(7, 2, 2000)]),
        "huge": np.concatenate([rng.normal(size=3999), [1e300]]),
        "constant": np.full(50, 2.5),
        "one": np.array([4.0]),
        "two": np.array([1.0, 2.0]),
    }[kind]


@pytest.mark.parametrize("kind", ["normal", "ties", "hot", "huge", "constant", "one", "two"])
@pytest.mark.parametrize("settings", [{}, {"accuracy": 50, "gather_limit": 20}])
def test_quantiles_equal_numpy(spark, kind, settings):
    values = _column(kind)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    found = exact_quantiles(df, {"x": PROBS}, **settings)["x"]
    assert np.allclose(found, np.quantile(values, PROBS), rtol=1e-12, atol=1e-12)


def test_quantiles_skip_null_and_nan_and_share_passes(spark):
    df = spark.createDataFrame([(1.0, 5), (float("nan"), None), (None, 7), (3.0, 9)], "a double, b int")
    found = exact_quantiles(df.withColumn("c", F.lit(None).cast("double")), {"a": [0.5], "b": [0.5], "c": [0.5]})
    assert found == {"a": [2.0], "b": [7.0], "c": [None]}


def test_modes_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame(
        [("b", 2.0, None), ("a", 1.0, None), ("a", None, None), ("b", None, None)], "t string, x double, e string"
    )
    assert column_modes(df, ["t", "x", "e"]) == {"t": "a", "x": 1.0, "e": None}


def test_distinct_lists_know_nulls_and_limits(spark):
    df = spark.createDataFrame([(i, i % 3, None if i == 0 else "v") for i in range(20)], "a int, b int, c string")
    found = distinct_lists(df, ["a", "b", "c"], 5)
    assert found == {"a": None, "b": ([0, 1, 2], False), "c": (["v"], True)}


@pytest.mark.parametrize("rows", [50, 30_000])
def test_rank_cuts_match_a_sort(spark, rows):
    # One group holds two thirds of the rows; keys are squeezed into few leading bits.
    df = (
        spark.range(rows)
        .withColumn("g", F.when(F.col("id") % 3 == 0, F.lit("rare")).otherwise("hot"))
        .withColumns(dict(zip(("a", "b"), order_keys(["id"], 5))))
        .withColumn("a", F.col("a") % 1000)
    )
    local = df.toPandas()
    quotas = {}
    for g, part in local.groupby("g"):
        quotas[g] = [0, 1, len(part) // 2, len(part)]
    found = rank_cuts(df, "g", "a", "b", quotas)
    for g, part in local.groupby("g"):
        ordered = part.sort_values(["a", "b"])[["a", "b"]].to_numpy().tolist()
        assert found[g][0] is None
        assert [list(f) for f in found[g][1:]] == [ordered[q - 1] for q in quotas[g][1:]]


def test_rank_cuts_refuse_shared_keys(spark):
    df = spark.range(20_000).selectExpr("0 AS g", "CAST(7 AS BIGINT) AS a", "CAST(7 AS BIGINT) AS b")
    with pytest.raises(ValueError, match="unique key"):
        rank_cuts(df, "g", "a", "b", {0: [10]})


def test_rank_cuts_refuse_too_large_quota(spark):
    df = spark.range(10).selectExpr("0 AS g", "id AS a", "id AS b")
    with pytest.raises(ValueError):
        rank_cuts(df, "g", "a", "b", {0: [11]})


def test_running_totals_cross_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
        found = running_totals(df.repartition(7), [F.col("k").desc()], {"s": F.col("v"), "n": F.lit(1)})
        rows = {r.k: (r.s, r.n) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert rows[999] == (1998, 1)
    assert rows[0] == (sum(2 * i for i in range(1000)), 1000)


def test_ranked_dictionary_is_sorted(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "t string")
    assert {r.value: r.code for r in ranked_dictionary(df, "t").collect()} == {"a": 0, "b": 1, "c": 2}


@pytest.mark.parametrize("limit", [1000, 300, 2])
def test_dictionary_forms_agree(spark, limit):
    df = spark.range(400).selectExpr("id", "CAST(id % 300 AS STRING) AS t")
    codes = Dictionary.fit(df, "t", limit)
    assert (codes.values is None) == (limit < 300)
    order = sorted(str(i) for i in range(300))
    back = codes.decode(codes.encode(df, "code", unseen=-1), "code", "text").collect()
    assert all(order[r.code] == r.t == r.text for r in back)
    strange = spark.createDataFrame([("zz",), (None,)], "t string")
    assert [r.code for r in codes.encode(strange, "code", unseen=-1).orderBy(F.col("t").desc_nulls_last()).collect()] == [-1, None]


def test_dictionary_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b",), ("a",)], "t string")
    for name, limit in (("small", 10), ("large", 1)):
        path = str(tmp_path / name)
        Dictionary.fit(df, "t", limit).save(path)
        again = Dictionary.load(spark, path)
        assert sorted((r.t, r.c) for r in again.encode(df, "c").collect()) == [("a", 0), ("b", 1)]


def test_dictionary_of_dates_round_trip(spark, tmp_path):
    df = spark.sql("SELECT DATE'2024-01-02' AS d UNION ALL SELECT DATE'2023-05-06'")
    Dictionary.fit(df, "d").save(str(tmp_path / "d"))
    again = Dictionary.load(spark, str(tmp_path / "d"))
    assert [r.c for r in again.encode(df, "c").orderBy("d").collect()] == [0, 1]


def test_against_all_meets_every_pair_once(spark):
    import pandas as pd

    left = spark.range(57).selectExpr("id AS l")
    right = spark.range(41).selectExpr("id AS r")

    def kernel(a, b):
        return pd.DataFrame({"l": a["l"].to_numpy(), "total": [int(b["r"].sum())] * len(a), "n": [len(b)] * len(a)})

    for limits in ({}, {"broadcast_bytes": 0, "block_rows": 10}):
        found, several = against_all(left, right, "l", "r", kernel, "l bigint, total bigint, n bigint", **limits)
        merged = found.groupBy("l").agg(F.sum("total").alias("t"), F.sum("n").alias("n")).collect()
        assert several == bool(limits)
        assert len(merged) == 57 and all((r.t, r.n) == (sum(range(41)), 41) for r in merged)


def test_checkpoint_folder_comes_from_the_session(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert named in ensure_checkpoint_dir(spark)
    assert cut_lineage(spark.range(3)).count() == 3


def test_local_table_types(spark):
    table = local_table(spark, [("a", 1, None), ("b", 2, 0.5)], "t string, n bigint, x double")
    assert [tuple(r) for r in table.collect()] == [("a", 1, None), ("b", 2, 0.5)]
    assert local_table(spark, [], "t string").count() == 0


def test_hot_values_of_a_large_dictionary(spark):
    # One value holds a third of the rows, the others are too many to broadcast.
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id AS STRING) END AS t")
    codes = Dictionary.fit(df, "t", limit=10)
    assert [r.value for r in codes.table.where("share > 0.3").collect()] == ["hot"]
    order = sorted({r.t for r in df.collect()})
    rows = codes.decode(codes.encode(df, "code"), "code", "back").collect()
    assert len(rows) == 3000 and all(order[r.code] == r.t == r.back for r in rows)


def test_mostly_null_column_is_spread(spark):
    """The shuffled lookup: neither nulls nor a frequent value that the dictionary lacks fill a task."""
    values = spark.range(20_000).selectExpr("concat('v', id) AS value", "id AS code", "0.00005D AS share")
    table = Dictionary("value", "string", None, cut_lineage(values))
    rows = spark.range(40_000).selectExpr(
        "id", "CASE WHEN id % 10 < 6 THEN NULL WHEN id % 10 < 9 THEN 'unseen' ELSE concat('v', id % 20000) END AS value"
    )
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = table.encode(rows, "code").withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sizes = np.unique([r.part for r in done], return_counts=True)[1]
    assert len(done) == 40_000 and sizes.max() <= 2 * sizes.mean()
    assert all((r.code is None) if not (r.value or "").startswith("v") else r.code == int(r.value[1:]) for r in done)
