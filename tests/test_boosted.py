"""Second-order boosted trees against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktab.models import boosted, registry
from sparktab.models.base import load_model
from sparktab.session import ensure_checkpoint_dir


def frame(spark, x, y, parts=3):
    names = [f"x{i}" for i in range(x.shape[1])]
    rows = [(*[None if np.isnan(v) else float(v) for v in r], float(t)) for r, t in zip(x, y)]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", y double").repartition(parts), names


def score(g, h, l1, l2):
    return np.sign(g) * max(abs(g) - l1, 0) * max(abs(g) - l1, 0) * np.sign(g) / (h + l2)


def plain_tree(x, g, h, depth, l1, l2, least, penalty):
    """Nested tuples (feature, threshold, missing left, left, right) or leaf values."""

    def leaf(rows):
        s = g[rows].sum()
        return -np.sign(s) * max(abs(s) - l1, 0) / (h[rows].sum() + l2)

    def grow(rows, level):
        best = (1e-6, None)
        if level < depth:
            whole = score(g[rows].sum(), h[rows].sum(), l1, l2)
            for f in range(x.shape[1]):
                v = x[rows, f]
                known = np.unique(x[~np.isnan(x[:, f]), f])
                for t in [*((known[1:] + known[:-1]) / 2), np.inf]:
                    for missing_left in (False, True):
                        left = np.where(np.isnan(v), missing_left, v <= t)
                        a, b = rows[left], rows[~left]
                        if len(a) and len(b) and min(h[a].sum(), h[b].sum()) >= least:
                            gain = 0.5 * (score(g[a].sum(), h[a].sum(), l1, l2) + score(g[b].sum(), h[b].sum(), l1, l2) - whole)
                            if gain > best[0] * (1 + 1e-9):
                                best = (gain, (f, t, missing_left, a, b))
        if best[1] is None:
            return leaf(rows)
        f, t, missing_left, a, b = best[1]
        left, right = grow(a, level + 1), grow(b, level + 1)
        if not isinstance(left, tuple) and not isinstance(right, tuple) and best[0] < penalty:
            return leaf(rows)
        return (f, t, missing_left, left, right)

    return grow(np.arange(len(g)), 0)


def value(tree, row):
    while isinstance(tree, tuple):
        f, t, missing_left, left, right = tree
        tree = left if (missing_left if np.isnan(row[f]) else row[f] <= t) else right
    return tree


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (160, 3)).astype(float)
    y = 2 * x[:, 0] - (x[:, 1] > 6) * 5 + rng.normal(0, 0.3, 160)
    x[rng.random((160, 3)) < 0.1] = np.nan
    return x, np.round(y, 3)


@pytest.mark.parametrize("params", [
    {"max_depth": 3}, {"max_depth": 2, "reg_alpha": 3.0, "reg_lambda": 0.5}, {"max_depth": 4, "gamma": 30.0, "min_child_weight": 4},
])
def test_rounds_equal_plain_loops(spark, numbers, params):
    x, y = numbers
    df, names = frame(spark, x, y)
    rounds = 12  # beyond one rewriting of the margins
    model = registry.train(df, "regression", "xgboost", names, "y", {"n_estimators": rounds, "learning_rate": 0.3, **params})
    margin = np.full(len(y), y.mean())
    for _ in range(rounds):
        tree = plain_tree(x, margin - y, np.ones(len(y)), params["max_depth"], params.get("reg_alpha", 0), params.get("reg_lambda", 1), params.get("min_child_weight", 1), params.get("gamma", 0))
        margin += 0.3 * np.array([value(tree, r) for r in x])
    found = {(*[r[n] for n in names], r.y): r.prediction for r in model.transform(df).collect()}
    for row, t, m in zip(x, y, margin):
        assert found[(*[None if np.isnan(v) else v for v in row], t)] == pytest.approx(m, abs=1e-6)


def test_partitions_and_storage_change_nothing(spark, numbers, tmp_path):
    x, y = numbers
    tables = []
    for parts in (1, 6):
        df, names = frame(spark, x, y, parts)
        model = registry.train(df, "regression", "xgboost", names, "y", {"n_estimators": 4, "subsample": 0.6, "colsample_bytree": 0.7, "max_depth": 3})
        tables.append(model.split_table())
    for a, b in zip(*tables):
        assert a[:6] == b[:6] and [round(v or 0, 7) for v in a[6:]] == pytest.approx([round(v or 0, 7) for v in b[6:]])
    again = load_model(spark, model.save(spark, str(tmp_path / "m")))
    assert again.split_table() == model.split_table()
    assert sum(model.importances()) == pytest.approx(1)
    from pathlib import Path

    assert not list(Path(ensure_checkpoint_dir(spark).replace("file:", "")).glob("boosted-*/*"))


def test_softmax_learns_and_probabilities_add_up(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (300, 2))
    y = (x[:, 0] > 0.3).astype(int) + (x[:, 1] > 0.1)
    df, names = frame(spark, x, y)
    for name in ("xgboost", "lightgbm"):
        model = registry.train(df, "classification", name, names, "y", {"n_estimators": 12})
        rows = model.transform(df).collect()
        assert sum(r.prediction == r.y for r in rows) >= 285
        assert all(abs(sum(r.probability) - 1) < 1e-9 and len(r.probability) == 3 for r in rows)
        assert all(r.probability[int(r.prediction)] == max(r.probability) for r in rows)


def leaves_of(model, n=0):
    return sum(r[3] is None for r in model.split_table() if r[0] == n)


def test_best_first_takes_the_largest_gains(spark):
    """One branch is worth splitting deeply; a tree of few leaves spends them all there."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 2, 400), rng.integers(0, 32, 400)]).astype(float)
    y = np.where(x[:, 0] == 1, x[:, 1] * 10, x[:, 1] * 0.1)
    df, names = frame(spark, x, y)
    params = {"n_estimators": 1, "learning_rate": 1.0, "min_child_samples": 1, "num_leaves": 6}
    model = registry.train(df, "regression", "lightgbm", names, "y", params)
    table = model.split_table()
    assert leaves_of(model) == 6
    # Plain best-first growth on the same rows.
    def best(rows):
        found = (0.0, None)
        for f in range(2):
            known = np.unique(x[rows, f])
            for t in (known[1:] + known[:-1]) / 2:
                a, b = rows[x[rows, f] <= t], rows[x[rows, f] > t]
                g = y.mean() - y
                gain = 0.5 * (g[a].sum() ** 2 / len(a) + g[b].sum() ** 2 / len(b) - g[rows].sum() ** 2 / len(rows))
                if gain > found[0] * (1 + 1e-9):
                    found = (gain, (a, b))
        return found

    leaves = [(best(np.arange(400)), np.arange(400))]
    while len(leaves) < 6:
        leaves.sort(key=lambda item: -item[0][0])
        (gain, (a, b)), _ = leaves.pop(0)
        leaves += [(best(a), a), (best(b), b)]
    want = sorted(round(y[rows].mean(), 6) for _, rows in leaves)
    got = sorted({round(r.prediction, 6) for r in model.transform(df).collect()})
    assert got == pytest.approx(sorted(set(want)))
    assert len(table) == 11


def test_many_values_use_quantile_bins_and_labels_may_lack(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (2000, 1))
    df, names = frame(spark, x, x[:, 0] ** 2)
    df = df.withColumn("y", F.when(F.col("x0") < 2.5, F.col("y")))
    edges = boosted.bin_edges(df, names, 16)
    assert len(edges[0]) == 15 and np.allclose(edges[0], np.quantile(x[:, 0], np.arange(1, 16) / 16, method="inverted_cdf"))
    model = registry.train(df, "regression", "xgboost", names, "y", {"n_estimators": 30, "max_bins": 64})
    errors = [abs(r.prediction - r.y) for r in model.transform(df).collect() if r.y is not None]
    assert np.mean(errors) < 0.1


def test_constant_and_empty_labels(spark):
    df, names = frame(spark, np.zeros((5, 1)), np.full(5, 7.0))
    model = registry.train(df, "regression", "lightgbm", names, "y", {"n_estimators": 3})
    assert {r.prediction for r in model.transform(df).collect()} == {7.0}
    with pytest.raises(ValueError, match="only nulls"):
        registry.train(df.withColumn("y", F.lit(None).cast("double")), "classification", "xgboost", names, "y")


def test_splits_are_found_on_spark(spark, monkeypatch):
    """The driver gets one row per node, not the sums of its bins."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), float(a > b)) for a, b in rng.normal(size=(400, 2))]
    data = spark.createDataFrame(rows, "a double, b double, y double").repartition(3).cache()
    taken, plain = [], Classic.toArrow

    def watched(self):
        table = plain(self)
        taken.append((table.num_rows, self.columns))
        return table

    monkeypatch.setattr(Classic, "toArrow", watched)
    model = registry.train(data, "classification", "xgboost", ["a", "b"], "y", {"n_estimators": 3, "max_depth": 3, "max_bins": 64})
    sent = [n for n, columns in taken if "slot" in columns or "cell" in columns]
    assert sent and max(sent) <= 4
    assert sum(f >= 0 for trees in model.rounds for t in trees for f in t.feature) > 3


@pytest.mark.parametrize("params", [
    {"n_estimators": 6, "num_leaves": 6, "subsample": 0.7, "reg_alpha": 0.1, "min_child_samples": 5},
    {"n_estimators": 4, "num_leaves": 9, "max_depth": 4, "colsample_bytree": 0.7},
])
def test_one_task_grows_the_trees_of_a_job_for_each_level(spark, monkeypatch, params):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 3)).round(2)
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)
    rows = [(None if i % 11 == 0 else float(a), float(b), float(c), float(k), float(1 + i % 2)) for i, ((a, b, c), k) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, w double").repartition(3).cache()
    jobs = []
    judged = boosted.Booster.judged
    monkeypatch.setattr(boosted.Booster, "judged", lambda *a: jobs.append(1) or judged(*a))
    for label, problem in (("y", "classification"), ("c", "regression")):
        found = []
        for cells in (1 << 21, 0):
            monkeypatch.setattr(boosted, "CELLS", cells)
            jobs.clear()
            found.append(registry.train(df, problem, "lightgbm", ["a", "b"], label, params, weight="w").split_table())
            assert bool(jobs) == (cells == 0)
        assert len(found[0]) == len(found[1])
        for one, other in zip(*found):
            assert one[:6] == other[:6] and one[6:] == pytest.approx(other[6:])
