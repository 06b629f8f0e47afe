import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sparktab.operators import encoding, labels, metrics, splitting
from sparktab.operators.encoding import FeatureTransformer

from conftest import FLOWER_FEATURES

# ------------------------------------------------------------------ labels


def test_problem_type_rules(spark):
    rows = [(i, float(i) if i < 30 else None, i % 3, None, "a", i % 2 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "many int, x double, few int, nothing int, t string, b boolean")
    found = {r.label: r.problem_type for r in labels.problem_types(df, df.columns).collect()}
    assert found == {
        "many": "regression", "x": "regression", "few": "classification", "nothing": "unknown",
        "t": "classification", "b": "classification",
    }
    small = spark.createDataFrame([(1,), (2,), (3,)], "y int")
    assert labels.detect_problem_type(small, "y") == "regression"


def test_split_label_rule(spark):
    rows = [(float(i % 4), float(i % 4) + 0.5, "t", None if i == 0 else 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "whole double, half double, t string, hole double")
    found = {r.label: r.kind for r in labels.split_label_kinds(df, df.columns).collect()}
    assert found == {"whole": "class", "half": "continuous", "t": "class", "hole": "continuous"}


def test_validate_label(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "y string")
    row = labels.validate_label(df, "y").first()
    assert (row.total_samples, row.non_null_samples, row.null_samples, row.unique_values) == (3, 2, 1, 2)
    many = spark.range(101).selectExpr("CAST(id AS STRING) AS y")
    for bad, name in ((many, "y"), (many, "nope"), (spark.createDataFrame([(None,)], "y string"), "y"),
                      (spark.createDataFrame([(1.0,)], "y double"), "y")):
        with pytest.raises(ValueError):
            labels.validate_label(bad, name)


def test_suggested_features(spark):
    df = spark.createDataFrame([(1,) * 6], ["user_id", "width", "Index", "序号", "age", "y"])
    assert labels.suggest_features(df, "y") == ["age"]
    assert labels.suggest_features(df, "y", "token") == ["width", "age"]


def test_feature_kinds(spark):
    rows = [(f"2024-01-{i % 28 + 1:02d}", f"{i % 24}:00", "20240101", f"word {i}", "ab"[i % 2], float(i), True) for i in range(60)]
    df = spark.createDataFrame(rows, "day string, hour string, compact string, words string, kind string, x double, flag boolean")
    df = df.withColumn("year_made", F.lit("old")).withColumn("at", F.current_timestamp()).withColumn("list", F.array("x"))
    found = {r["column"]: r.kind for r in labels.feature_kinds(df, "y").collect()}
    assert found == {
        "day": "datetime", "hour": "datetime", "compact": "datetime", "words": "text", "kind": "categorical",
        "x": "numeric", "flag": "categorical", "year_made": "datetime", "at": "datetime", "list": "text",
    }


def test_label_codes_and_back(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b")], "id int, y string")
    codes = labels.fit_label_codes(df, "y")
    assert codes.values == ["UNKNOWN", "a", "b"]
    coded = labels.encode_label(df, "y", codes)
    assert [r.y for r in coded.orderBy("id").collect()] == [2, 1, 0, 2]
    guess = coded.withColumn("p", F.col("y").cast("double") + 1)
    assert [r.s for r in labels.decode_label(guess, "p", codes, "s").orderBy("id").collect()] == ["3.0", "b", "a", "3.0"]
    assert {r.name: r.n for r in labels.label_distribution(coded, "y", codes).collect()} == {"0(UNKNOWN)": 1, "1(a)": 1, "2(b)": 2}
    both = labels.collapse_to_binary(coded, "y", "z")
    assert [r.z for r in both.orderBy("id").collect()] == [1, 1, 0, 1]


def test_feature_column_choice(spark):
    df = spark.range(1).selectExpr("1 AS a", "2 AS b")
    assert labels.feature_columns(df, ["b", "x", "a"]) == ["b", "a"]
    for wanted, strict in ((["x"], False), (["a", "x"], True)):
        with pytest.raises(ValueError):
            labels.feature_columns(df, wanted, strict)


# ------------------------------------------------------------------ encoding


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame(
        [(1, "b", "x", 1.0, None, "y1"), (2, "a", "z", 3.0, None, "y2"), (3, None, "x", None, None, "y1"), (4, "c", None, 5.0, None, "y2")],
        "id int, color string, size string, n double, e double, label string",
    )


def test_roles(mixed):
    roles = encoding.classify_columns(mixed, ["color", "size", "n", "e"], ["color", "label"], ["size"])
    assert (roles.onehot, roles.ordinal, roles.numeric, roles.text) == (["color"], ["size"], ["n"], ["e"])


def test_transform_values(spark, mixed):
    fitted = FeatureTransformer.fit(mixed, ["color", "size", "n"], ["color"], ["size"], standardise=True)
    assert fitted.output_columns == ["onehot__color_b", "onehot__color_c", "onehot__color_nan", "ordinal__size", "numeric__n"]
    done = fitted.transform(mixed)
    assert done.columns == ["id", "e", "label", *fitted.output_columns]
    rows = [tuple(r)[3:] for r in done.orderBy("id").collect()]
    std = np.std([1, 3, 5])
    assert rows[0] == (1.0, 0.0, 0.0, 0.0, pytest.approx(-2 / std))
    assert rows[1] == (0.0, 0.0, 0.0, 1.0, 0.0)
    assert rows[2] == (0.0, 0.0, 1.0, 0.0, None)
    assert rows[3][3] is None
    strange = spark.createDataFrame([(9, "zz", "zz", 3.0, None, "y")], mixed.schema)
    assert tuple(fitted.transform(strange).first())[3:] == (0.0, 0.0, 0.0, -1.0, 0.0)


def test_saved_encoder_gives_the_same(spark, mixed, tmp_path):
    fitted = FeatureTransformer.fit(mixed, ["color", "size", "n"], ["color"], ["size"], standardise=True)
    fitted.save(spark, str(tmp_path / "enc"))
    again = FeatureTransformer.load(spark, str(tmp_path / "enc"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(again.transform(mixed)) == key(fitted.transform(mixed))
    found = {(r["column"], r.category, r.target) for r in again.encoding_map(spark).collect()}
    assert ("color", "nan", "onehot__color_nan") in found and ("size", "UNKNOWN", "-1") in found


def test_constant_column_is_not_divided_by_zero(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "c double")
    assert [r[0] for r in FeatureTransformer.fit(df, ["c"], standardise=True).transform(df).collect()] == [0.0, 0.0]


def test_encoder_refusals(mixed):
    with pytest.raises(ValueError):
        FeatureTransformer.fit(mixed, ["label"])
    with pytest.raises(ValueError):
        FeatureTransformer.fit(mixed, ["n"], remainder="drop")
    with pytest.raises(ValueError):
        FeatureTransformer.fit(mixed, ["nope"])


def test_pca_is_centred_and_matches_numpy(flowers):
    fitted = encoding.fit_pca(flowers, FLOWER_FEATURES, 3)
    rows = fitted.transform(flowers).select(*FLOWER_FEATURES, vector_to_array("pca").alias("p")).collect()
    x = np.array([[r[c] for c in FLOWER_FEATURES] for r in rows])
    x = x - x.mean(axis=0)
    _, _, directions = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(np.array([r.p for r in rows])), np.abs(x @ directions[:3].T), atol=1e-8)


# ------------------------------------------------------------------ splits


def sizes(df, *more):
    return Counter(tuple(r) if more else r[0] for r in df.select("split", *more).collect())


def test_worked_example_149_rows(flowers):
    parts = splitting.split_table(flowers, "species", 0.2, 0.2)
    assert sizes(parts) == {"train": 89, "val": 30, "test": 30}
    by_class = sizes(parts, "species")
    assert all(by_class["test", s] == 10 for s in ("setosa", "versicolor", "virginica"))
    again = splitting.split_table(flowers.repartition(5), "species", 0.2, 0.2)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in parts.collect()}
    other = splitting.split_table(flowers, "species", 0.2, 0.2, seed=7)
    assert {tuple(r) for r in other.collect()} != {tuple(r) for r in parts.collect()}


@pytest.mark.parametrize("n", [3, 7, 12, 101])
@pytest.mark.parametrize("test,val", [(0.2, 0.1), (0.15, 0.15), (0.3, 0.5)])
def test_random_sizes(spark, n, test, val):
    held = math.ceil(test * n)
    left = math.ceil((n - held) * (val / (1 - test)))
    if n - held - left <= 0:
        with pytest.raises(ValueError, match="train part"):
            splitting.split_table(spark.range(n), None, test, val, stratified=False)
        return
    found = sizes(splitting.split_table(spark.range(n), None, test, val, stratified=False))
    assert (found["test"], found["val"], found["train"]) == (held, left, n - held - left)


def test_quota_shares_and_hot_class(spark):
    counts = {"hot": 667, "b": 200, "c": 133}
    assert splitting.largest_remainder(counts, 800) == {"hot": 534, "b": 160, "c": 106}
    assert sum(splitting.largest_remainder({1: 1, 2: 1, 3: 1}, 2).values()) == 2
    df = spark.range(1000).selectExpr("id", "CASE WHEN id < 667 THEN 'hot' WHEN id < 867 THEN 'b' ELSE 'c' END AS y")
    found = sizes(splitting.split_table(df, "y", 0.2, 0.2), "y")
    assert sum(n for (s, _), n in found.items() if s == "test") == 200
    assert found["test", "hot"] == 667 - 534


def test_small_class_falls_back_to_random(spark):
    df = spark.range(100).selectExpr("id", "CASE WHEN id < 4 THEN 'rare' ELSE 'b' END AS y")
    assert sizes(splitting.split_table(df, "y")) == {"train": 60, "val": 20, "test": 20}
    assert splitting.stratify_check(df, "y").first().eligible is False
    with pytest.raises(ValueError):
        splitting.require_stratifiable(df, "y")
    with pytest.raises(ValueError):
        splitting.require_stratifiable(df.withColumn("y", F.lit("one")), "y")
    assert splitting.require_stratifiable(df.withColumn("y", F.rand(1)), "y") is False


def test_ratio_limits():
    for test, val, limits in [(0.05, 0.2, "table"), (0.35, 0.2, "table"), (0.2, 0.6, "table"), (0.2, 0.4, "script"),
                              (0.5, 0.4, "request"), (0.6, 0.1, "request")]:
        with pytest.raises(ValueError):
            splitting.check_ratios(test, val, limits)
    splitting.check_ratios(0.5, 0.0, "request")
    splitting.check_ratios(0.3, 0.5)


def test_no_validation_share_is_repaired(spark):
    found = sizes(splitting.split_table(spark.range(100), None, 0.2, 0.0, stratified=False, limits="request"))
    assert found == {"test": 20, "val": 8, "train": 72}


def test_repairs(spark):
    df = spark.range(50).selectExpr("id", "id % 2 AS y", "CASE WHEN id < 40 THEN 'train' ELSE 'val' END AS split")
    assert sizes(splitting.repair_splits(df, "y")) == {"test": 5, "val": 9, "train": 36}
    with pytest.raises(ValueError):
        splitting.repair_splits(df.where("split = 'val'"))
    few = spark.range(6).selectExpr("id", "CASE WHEN id < 5 THEN 'train' ELSE 'test' END AS split")
    assert sizes(splitting.repair_splits(few)) == {"train": 5, "test": 1}


def test_split_refusals(spark):
    with pytest.raises(ValueError):
        splitting.split_table(spark.range(0), stratified=False)
    with pytest.raises(ValueError):
        splitting.split_table(spark.range(10), stratified=False, dedup=False)


# ------------------------------------------------------------------ metrics


@pytest.fixture(scope="module")
def judged(spark):
    pairs = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 0), (2, 1), (None, 1)]
    return spark.createDataFrame([(*p, "train" if i < 3 else "test") for i, p in enumerate(pairs)], "y int, p int, split string")


def test_confusion_and_accuracy(judged):
    grid = {(r.label, r.prediction): r.n for r in metrics.confusion_matrix(judged, "y", "p").collect()}
    assert len(grid) == 9 and grid[0, 0] == 2 and grid[2, 1] == 1 and grid[2, 2] == 0
    assert metrics.accuracy(judged, "y", "p").first().accuracy == 0.5


def test_weighted_metrics_by_hand(judged):
    row = metrics.classification_metrics(judged, "y", "p").first()
    precision = (3 * (2 / 3) + 2 * (1 / 3) + 0) / 6
    f1 = (3 * (2 / 3) + 2 * (2 / 5) + 0) / 6
    assert (row.accuracy, row.precision, row.recall, row.f1, row.rows) == (0.5, round(precision, 4), 0.5, round(f1, 4), 6)
    parts = {r.split: r.accuracy for r in metrics.metric_bundle(judged, "y", "p", "classification").collect()}
    assert parts == {"train": round(2 / 3, 4), "test": round(1 / 3, 4)}


def test_report_lines(judged):
    lines = {r["class"]: r for r in metrics.classification_report(judged, "y", "p").collect()}
    assert lines["1"].precision == round(1 / 3, 4) and lines["1"].support == 2
    assert lines["macro avg"].recall == round((2 / 3 + 1 / 2 + 0) / 3, 4)
    assert lines["weighted avg"].support == 6


def test_regression_metrics_round_twice(spark):
    df = spark.createDataFrame([(1.0, 1.01), (2.0, 2.02), (4.0, 3.9)], "y double, p double")
    row = metrics.regression_metrics(df, "y", "p").first()
    mse = (0.01**2 + 0.02**2 + 0.1**2) / 3
    assert row.mse == round(mse, 4) and row.rmse == round(math.sqrt(round(mse, 4)), 4)
    plain = metrics.regression_metrics(df, "y", "p", digits=None, compat=False).first()
    assert plain.rmse == pytest.approx(math.sqrt(mse))
    same = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert metrics.regression_metrics(same, "y", "p").first().r2 == 1.0


def test_auc_and_average_precision_brute_force(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.normal(size=300) + y, 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    wins = [(1.0 if a > b else 0.5 if a == b else 0.0) for a in s[y == 1] for b in s[y == 0]]
    assert metrics.roc_auc(df, "y", "s").first().auc == pytest.approx(np.mean(wins))
    ap, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = ((s >= t) & (y == 1)).sum()
        recall = hit / y.sum()
        ap += (recall - last) * hit / (s >= t).sum()
        last = recall
    assert metrics.average_precision(df, "y", "s").first().average_precision == pytest.approx(ap)
    curve = metrics.roc_curve(df, "y", "s").orderBy(F.col("threshold").desc()).collect()
    assert (curve[-1].fpr, curve[-1].tpr) == (1.0, 1.0)
    assert all(a.tpr <= b.tpr and a.fpr <= b.fpr for a, b in zip(curve, curve[1:]))


def test_one_sided_scores(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first().auc == 0.0


def test_actual_vs_predicted(spark):
    df = spark.range(300).selectExpr("id", "id * 1.0D AS y", "id + 1.0D AS p")
    assert metrics.actual_vs_predicted(df, ["id"], "y", "p").count() == 300
    first = metrics.actual_vs_predicted(df, ["id"], "y", "p", 200).collect()
    assert len(first) == 200 and first[0].residual == -1.0


@pytest.mark.parametrize("stratified", [True, False])
def test_sizes_are_exact_on_a_repeated_key(spark, stratified):
    rows = spark.range(1000).selectExpr("id", "id % 7 AS key", "id % 2 AS kind")
    parts = splitting.split_table(rows, "kind", 0.2, 0.2, stratified, key=["key"])
    sizes = {r.split: r["count"] for r in parts.groupBy("split").count().collect()}
    assert sizes == {"train": 600, "val": 200, "test": 200}


def test_sizes_are_exact_on_one_key(spark):
    """More rows on one key than are gathered: the cut is searched by the second key."""
    rows = spark.range(30_000).selectExpr("id", "1 AS key")
    parts = splitting.split_table(rows, None, 0.2, 0.2, key=["key"], dedup=False)
    sizes = {r.split: r["count"] for r in parts.groupBy("split").count().collect()}
    assert sizes == {"train": 18_000, "val": 6_000, "test": 6_000}


def test_equal_rows_at_a_cut_are_refused(spark):
    rows = spark.range(100).selectExpr("1 AS key", "2 AS value")
    with pytest.raises(ValueError, match="agree in every column"):
        splitting.split_table(rows, None, 0.2, 0.2, key=["key"], dedup=False)


def test_confusion_of_very_many_classes_lists_only_pairs_that_occur(spark, monkeypatch):
    from sparktab.operators import metrics

    df = spark.createDataFrame([(i, i // 2) for i in range(20)], "y int, p int")
    assert metrics.confusion_matrix(df, "y", "p").count() == 400
    monkeypatch.setattr(metrics, "GRID_CLASSES", 19)
    rows = metrics.confusion_matrix(df, "y", "p").collect()
    assert sorted((r.label, r.prediction, r.n) for r in rows) == [(i, i // 2, 1) for i in range(20)]
