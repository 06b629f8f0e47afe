"""Deep regression trees are those of pyspark.ml, whether nodes are split by sums or finished in a task."""

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from sparktab.models import grown, registry, trees
from sparktab.models.base import assembled, load_model

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(5)
    a, b, c = rng.poisson(30, 900), rng.normal(size=900), rng.integers(0, 3, 900)
    y = a * 10 + (b * 20).round() * (c - 1) + rng.integers(0, 9, 900)
    rows = [(i, float(p), float(q), float(r), float(s)) for i, (p, q, r, s) in enumerate(zip(a, b, c, y))]
    return spark.createDataFrame(rows + rows[:100], "id int, a double, b double, c double, y double").repartition(3, "id").cache()


def _expected(numbers, estimator):
    model = estimator.fit(assembled(numbers, FEATURES, "y"))
    scored = model.transform(assembled(numbers, FEATURES, "y")).select("__prediction").toPandas()["__prediction"].to_numpy()
    return scored, model.featureImportances.toArray()


def _made(model, numbers):
    return model.transform(numbers).toPandas()["prediction"].to_numpy()


def test_draws_are_those_of_the_library(spark):
    for seed in (1, 43, -7, (5 << 33) + 3):
        law = spark._jvm.org.apache.commons.math3.distribution.PoissonDistribution(1.0)
        law.reseedRandomGenerator(seed)
        own = grown.JavaPoisson(seed)
        found = np.concatenate([own.take(n) for n in (1, 700, 300)])
        assert found.tolist() == [law.sample() for _ in range(1001)]


@pytest.mark.parametrize("cells", [1 << 21, 600, 30])
def test_deep_forest(spark, numbers, monkeypatch, cells):
    monkeypatch.setattr(grown, "CELLS", cells)
    model = registry.train(numbers, "regression", "random_forest", FEATURES, "y", {"n_estimators": 6, "min_samples_leaf": 2})
    assert isinstance(model, grown.GrownTrees)
    scored, importance = _expected(numbers, RandomForestRegressor(numTrees=6, minInstancesPerNode=2, maxDepth=30, maxBins=128, seed=42, featureSubsetStrategy="all", **trees.COLUMNS))
    assert np.allclose(_made(model, numbers), scored, rtol=1e-12)
    assert np.allclose(model.importances(), importance, rtol=1e-9)


def test_saved_forest_predicts_the_same(spark, numbers, tmp_path):
    model = registry.train(numbers, "regression", "random_forest", FEATURES, "y", {"n_estimators": 3})
    again = load_model(spark, model.save(spark, str(tmp_path / "model")))
    assert _made(again, numbers).tolist() == _made(model, numbers).tolist()
    assert again.importances() == model.importances()


def test_a_null_label_is_refused(numbers):
    with pytest.raises(ValueError, match="label"):
        registry.train(numbers.withColumn("y", F.when(F.col("id") > 5, F.col("y"))), "regression", "random_forest", FEATURES, "y", {"n_estimators": 2})


@pytest.mark.parametrize("cells", [1 << 21, 600, 30])
def test_deep_tree(numbers, monkeypatch, cells):
    monkeypatch.setattr(grown, "CELLS", cells)
    model = registry.train(numbers, "regression", "decision_tree", FEATURES, "y")
    assert isinstance(model, grown.GrownTrees)
    scored, _ = _expected(numbers, DecisionTreeRegressor(maxDepth=30, maxBins=128, seed=42, **trees.COLUMNS))
    assert np.allclose(_made(model, numbers), scored, rtol=1e-12)


@pytest.mark.parametrize("cells", [1 << 21, 600, 30])
def test_importances_of_a_deep_tree(spark, numbers, monkeypatch, cells):
    monkeypatch.setattr(grown, "CELLS", cells)
    model = registry.train(numbers, "regression", "decision_tree", FEATURES, "y")
    assert isinstance(model, grown.GrownTrees)
    _, importance = _expected(numbers, DecisionTreeRegressor(maxDepth=30, maxBins=128, seed=42, **trees.COLUMNS))
    assert np.allclose(model.importances(), importance, rtol=1e-9)
    found = {r.feature: r.importance for r in registry.importance_table(spark, model).collect()}
    assert found == {c: round(float(v), 4) for c, v in zip(FEATURES, importance)}
