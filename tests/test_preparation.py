import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktab.operators import cleaning, duplicates, nulls, outliers, profile


@pytest.fixture(scope="module")
def holes(spark):
    return spark.createDataFrame(
        [(1, 1, 10.0, "b"), (2, None, None, "a"), (3, 2, float("nan"), None), (4, 2, 40.0, "a"), (5, None, None, "b")],
        "id int, n int, x double, t string",
    )


def values(df, column, key="id"):
    return [r[column] for r in df.orderBy(key).collect()]


# ------------------------------------------------------------------ profiles


def test_profile_of_holes(spark, holes):
    rows = {r["column"]: r for r in profile.column_profile(holes).collect()}
    assert rows["x"].non_null_count == 2 and rows["x"].null_count == 3
    assert rows["x"].mean == 25.0 and rows["x"].median == 25.0
    assert rows["t"].unique_ratio == 0.5 and rows["t"].mean is None
    assert rows["n"].unique_values == 2


def test_profile_of_all_null_and_constant(spark):
    df = spark.createDataFrame([(None, None, 3.0), (None, None, 3.0)], "a double, t string, c double")
    rows = {r["column"]: r for r in profile.column_profile(df).collect()}
    assert rows["a"].median is None and rows["a"].outliers_count == 0
    assert rows["t"].unique_ratio == 0.0
    assert rows["c"].outlier_lower == rows["c"].outlier_upper == 3.0


def test_table_profile_counts_repeats(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "a")], "a int, b string")
    assert tuple(profile.table_profile(df).first()) == (4, 2, 2)
    assert tuple(profile.table_profile(df.where("a > 5")).first()) == (0, 2, 0)


def test_column_lists(holes):
    assert profile.validate_columns(holes, [" x ", "nope"]) == (["x"], ["nope"])
    assert profile.validate_columns(holes, None)[0] == ["id", "n", "x", "t"]
    assert profile.validate_columns(holes, "t") == (["t"], [])
    assert profile.split_columns_by_type(holes) == (["id", "n", "x"], ["t"])


def test_missing_summary(holes):
    assert {r["column"]: r.null_count for r in profile.missing_summary(holes).collect()} == {"n": 2, "x": 3, "t": 1}


def test_samples_and_comparison(holes):
    assert [r.t for r in profile.sample_values(holes, "t", "id", 2).collect()] == ["b", "a"]
    after = nulls.handle_nulls(holes, ["x"], "missing_50%_cols")
    both = profile.compare_profiles(profile.column_profile(holes), profile.column_profile(after))
    gone = both.where("column = 'x'").first()
    assert gone.non_null_count_before == 2 and gone.non_null_count_after is None


def test_box_plot_whiskers(spark):
    data = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 100.0]
    df = spark.createDataFrame([(v,) for v in data], "x double")
    row = profile.box_plot_summary(df, ["x"], whis=1.5).first()
    assert (row.q1, row.median, row.q3) == (3.0, 5.0, 7.0)
    assert (row.whisker_low, row.whisker_high, row.fliers) == (1.0, 8.0, 1)


# ------------------------------------------------------------------ nulls


def test_drop_rows_and_columns(holes):
    assert values(nulls.handle_nulls(holes, ["x"], "missing_all_cols"), "id") == [1, 4]
    assert nulls.handle_nulls(holes, ["x", "n", "t"], "missing_50%_cols").columns == ["id", "n", "t"]


def test_half_missing_is_kept(spark):
    df = spark.createDataFrame([(1,), (None,)], "a int")
    assert nulls.handle_nulls(df, ["a"], "missing_50%_cols").columns == ["a"]


def test_mean_of_whole_numbers_is_not_cut(holes):
    done = nulls.handle_nulls(holes, ["n", "t"], "mean_cols")
    assert dict(done.dtypes)["n"] == "double"
    assert values(done, "n") == [1.0, pytest.approx(5 / 3), 2.0, 2.0, pytest.approx(5 / 3)]
    assert values(done, "t")[2] is None


def test_column_without_nulls_keeps_its_type(holes):
    assert dict(nulls.handle_nulls(holes, ["id"], "mean_cols").dtypes)["id"] == "int"


def test_mode_and_median(holes):
    assert values(nulls.handle_nulls(holes, ["t"], "mode_cols"), "t") == ["b", "a", "a", "a", "b"]
    assert values(nulls.handle_nulls(holes, ["x"], "median_cols"), "x") == [10.0, 25.0, 25.0, 40.0, 25.0]


def test_mode_of_all_null(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, t string")
    assert values(nulls.handle_nulls(df, ["t"], "mode_cols"), "t") == [None, None]
    assert values(nulls.handle_nulls(df, ["t"], "mode_cols", unknown_text="?"), "t") == ["?", "?"]


def test_constant_fill(holes):
    assert values(nulls.handle_nulls(holes, ["n"], "fill_cols", "1.5"), "n") == [1.0, 1.5, 2.0, 2.0, 1.5]
    assert values(nulls.handle_nulls(holes, ["t"], "fill_cols", 7), "t")[2] == "7"
    with pytest.raises(ValueError):
        nulls.handle_nulls(holes, ["n"], "fill_cols", "word")
    with pytest.raises(ValueError):
        nulls.handle_nulls(holes, ["n"], "fill_cols")
    with pytest.raises(ValueError):
        nulls.handle_nulls(holes, ["n"], "other")
    with pytest.raises(ValueError):
        dates = holes.withColumn("d", F.when(F.col("id") > 1, F.to_date(F.lit("2024-01-02"))))
        nulls.handle_nulls(dates, ["d"], "fill_cols", "soon")


def test_unknown_column_is_a_no_op(holes):
    assert nulls.handle_nulls(holes, ["nope"], "mean_cols").columns == holes.columns


def test_null_report_marks_dropped(holes):
    after = nulls.handle_nulls(holes, ["x", "n"], "missing_50%_cols")
    rows = {r["column"]: r for r in nulls.null_report(holes, after, ["x", "n"], "missing_50%_cols").collect()}
    assert rows["x"].dropped and not rows["n"].dropped
    assert rows["n"].null_before == rows["n"].null_after == 2


# ------------------------------------------------------------------ outliers


@pytest.fixture(scope="module")
def skewed(spark):
    data = [(i, float(i)) for i in range(1, 20)] + [(20, 500.0), (21, None)]
    return spark.createDataFrame(data, "id int, x double")


def test_bounds_equal_numpy(skewed):
    data = np.array([*range(1, 20), 500.0])
    q1, q3 = np.quantile(data, [0.25, 0.75])
    b = outliers.fit_bounds(skewed, ["x"])["x"]
    assert b.lower == pytest.approx(q1 - 1.5 * (q3 - q1)) and b.upper == pytest.approx(q3 + 1.5 * (q3 - q1))
    s = outliers.fit_bounds(skewed, ["x"], "std", 3)["x"]
    assert s.upper == pytest.approx(data.mean() + 3 * data.std(ddof=1))


@pytest.mark.parametrize("method,threshold", [("iqr", 1.5), ("std", 3), ("z_score", 3)])
def test_flag_and_info(skewed, method, threshold):
    bounds = outliers.fit_bounds(skewed, ["x"], method, threshold)
    flags = values(outliers.flag_outliers(skewed, bounds), "x_is_outlier")
    assert flags == [False] * 19 + [True, False]
    info = outliers.outlier_info(skewed, bounds).first()
    assert info.outlier_count == 1 and info.outlier_ratio == pytest.approx(1 / 21)


def test_treatments(skewed):
    bounds = outliers.fit_bounds(skewed, ["x"])
    assert values(outliers.treat_outliers(skewed, bounds, "del_outlier"), "id") == [*range(1, 20), 21]
    clipped = values(outliers.treat_outliers(skewed, bounds, "fill_outlier"), "x")
    assert clipped[19] == bounds["x"].upper and clipped[20] is None
    assert values(outliers.treat_outliers(skewed, bounds, "fill_outlier", 3), "x")[19] == 3.0
    assert outliers.treat_outliers(skewed, bounds, "save_outlier") is skewed
    report = outliers.outlier_report(skewed, outliers.treat_outliers(skewed, bounds, "fill_outlier"), bounds, "fill_outlier")
    assert (report.first().original_count, report.first().remaining_count) == (1, 0)


def test_outlier_guards(spark, skewed):
    texts = spark.createDataFrame([("a", None)], "t string, e double")
    assert outliers.fit_bounds(texts, ["t", "e", "missing"]) == {}
    for bad in ({"method": "mad"}, {"threshold": "3"}, {"threshold": True}):
        with pytest.raises(ValueError):
            outliers.fit_bounds(skewed, ["x"], **bad)
    bounds = outliers.fit_bounds(skewed, ["x"])
    with pytest.raises(ValueError):
        outliers.treat_outliers(skewed, bounds, "hide")
    with pytest.raises(TypeError):
        outliers.treat_outliers(skewed, bounds, "fill_outlier", "word")


def test_constant_column_has_no_outliers(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, x double")
    b = outliers.fit_bounds(df, ["x"], "z_score", 3)["x"]
    assert b.lower == b.upper == 5.0
    assert values(outliers.flag_outliers(df, {"x": b}), "x_is_outlier") == [False, False]
    single = spark.createDataFrame([(1, 5.0)], "id int, x double")
    assert values(outliers.treat_outliers(single, outliers.fit_bounds(single, ["x"], "std", 3), "fill_outlier"), "x") == [5.0]


# ------------------------------------------------------------------ cleaning


def test_later_columns_see_earlier_drops(spark):
    rows = [(i, float(i % 5), float(i % 7)) for i in range(30)] + [(30, 100.0, 1000.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    plans = [
        cleaning.ColumnPlan("a", treatment="del_outlier"),
        cleaning.ColumnPlan("b", outlier_method="std", outlier_threshold=2, treatment="del_outlier"),
    ]
    ordered = cleaning.clean_columns(df, plans)
    at_once = cleaning.clean_columns(df, plans, sequential=False)
    assert ordered.bounds["b"].upper < 20 < at_once.bounds["b"].upper
    assert ordered.data.count() == 30
    assert tuple(cleaning.run_summary(df, ordered.data, ["a", "b"]).first())[:4] == (2, 31, 30, 1)


def test_batches_share_passes():
    plans = [cleaning.ColumnPlan(c, t) for c, t in [("a", "mean_cols"), ("b", "missing_all_cols"), ("c", "mode_cols"), ("c", "mean_cols")]]
    assert [[p.column for p in b] for b in cleaning._batches(plans)] == [["a", "b"], ["c"], ["c"]]


def test_plan_defaults_and_refusals(holes):
    plan = cleaning.ColumnPlan("x", None, outlier_method=None, treatment=None)
    assert cleaning.clean_columns(holes, [plan]).data.count() == 2
    with pytest.raises(ValueError):
        cleaning.clean_columns(holes, [cleaning.ColumnPlan("t", treatment="del_outlier")])
    with pytest.raises(ValueError):
        cleaning.clean_columns(holes, [cleaning.ColumnPlan("nope")])


def test_dropped_column_is_skipped_later(holes):
    result = cleaning.clean_columns(
        holes, [cleaning.ColumnPlan("x", "missing_50%_cols", treatment="fill_outlier"), cleaning.ColumnPlan("n", "mean_cols")]
    )
    assert result.data.columns == ["id", "n", "t"] and "x" not in result.bounds


def test_uniform_run(holes):
    result = cleaning.clean_uniform(holes, ["n", "x", "n"], "fill_cols", 0, treatment="fill_outlier", outlier_fill=None)
    assert result.data.where("x IS NULL OR n IS NULL").count() == 0


# ------------------------------------------------------------------ duplicates


@pytest.fixture(scope="module")
def repeats(spark):
    return spark.createDataFrame(
        [(1, "a", None), (2, "a", None), (3, "b", 1.0), (4, "b", 2.0), (5, "c", 1.0), (6, "a", None)], "id int, t string, x double"
    )


def test_keep_first_last_none(repeats):
    assert values(duplicates.drop_duplicates_by(repeats, ["t", "x"], "first", "id"), "id") == [1, 3, 4, 5]
    assert values(duplicates.drop_duplicates_by(repeats, ["t", "x"], "last", ["id"]), "id") == [3, 4, 5, 6]
    assert values(duplicates.drop_duplicates_by(repeats, ["t"], False), "id") == [5]
    assert duplicates.drop_duplicates_by(repeats, ["t"], "first", "id").columns == repeats.columns
    assert duplicates.drop_duplicate_rows(repeats.drop("id")).count() == 4


def test_dedup_needs_an_order(repeats):
    with pytest.raises(ValueError):
        duplicates.drop_duplicates_by(repeats, ["t"], "first")
    with pytest.raises(ValueError):
        duplicates.drop_duplicates_by(repeats, ["t"], "middle", "id")


def test_duplicate_report(repeats):
    assert tuple(duplicates.duplicate_report(repeats, ["t"]).first()) == (6, 3, 3, 0.5)
    assert duplicates.duplicate_report(repeats, ["t"], False).first().rows_after == 1


def test_whole_documents_are_profiled_and_split(spark, tmp_path):
    """Rows that differ only in columns beside text and language are no duplicates."""
    from sparktab.catalog import QUERIES

    rows = [(i, "same", "en", f"s{i}", 4) for i in range(10)] + [(0, "same", "en", "s0", 4)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["whole_table_profile"](spark, str(tmp_path)).first()
    assert (found.total_rows, found.total_columns, found.duplicate_rows) == (11, 5, 1)
    parts = {r.split: r.n for r in QUERIES["whole_split_after_dedup"](spark, str(tmp_path)).collect()}
    assert parts == {"test": 2, "val": 1, "train": 7}


def test_sequential_deletion_over_many_columns(spark):
    """Each column's bounds come from the rows that the columns before have left."""
    import numpy as np

    from sparktab.operators.cleaning import clean_uniform

    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (400, 9)) ** 3
    names = [f"c.{i}" for i in range(9)]
    df = spark.createDataFrame([(*map(float, r), "t") for r in x], ", ".join(f"`{n}` double" for n in names) + ", other string")
    found = clean_uniform(df, names, treatment="del_outlier")
    left = x
    for i in range(9):
        q1, q3 = np.quantile(left[:, i], [0.25, 0.75])
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        left = left[(left[:, i] >= low) & (left[:, i] <= high)]
    got = sorted(tuple(r)[:-1] for r in found.data.collect())
    assert found.data.columns == df.columns and got == sorted(map(tuple, left))
