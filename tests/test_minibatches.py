import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktab.models import network
from sparktab.models.base import ModelSpec


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(320, 2))
    rows = [(float(a), float(b), float(a + b > 0)) for a, b in x]
    return spark.createDataFrame(rows, "a double, b double, y double").cache()


def _spec(**params):
    return ModelSpec("classification", "mlp", ["a", "b"], "y", {"hidden_layer_sizes": (4,), "batch_size": 16, "max_iter": 2, **params})


def test_an_epoch_takes_all_its_minibatches(points, monkeypatch):
    taken = []
    whole = network.run_epoch
    monkeypatch.setattr(network, "run_epoch", lambda data, shape, state, *a: taken.append((state.steps, a[2])) or whole(data, shape, state, *a))
    network.train_network(points, _spec())
    assert [steps for _, steps in taken] == [20, 20] and taken[1][0] == 20
    taken.clear()
    network.train_network(points, _spec(epoch_steps=3))
    assert [steps for _, steps in taken] == [3, 3]


def test_chains_take_the_steps_of_single_jobs(points, monkeypatch):
    found = [network.train_network(points.repartition(3), _spec(dropout=0.2))]
    monkeypatch.setattr(network, "CHAIN_ROWS", 50)
    found.append(network.train_network(points.repartition(5), _spec(dropout=0.2)))
    monkeypatch.setattr(network, "BLOCK", 5)
    found.append(network.train_network(points, _spec(dropout=0.2)))
    for other in found[1:]:
        assert np.allclose(found[0].weights, other.weights, rtol=0, atol=1e-9)
        assert np.allclose([h[2] for h in found[0].history], [h[2] for h in other.history])


def test_equal_rows_go_to_different_minibatches(spark, points):
    twice = points.limit(3).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(50)))).drop("n")
    told = network._told_apart(twice.withColumn("row", F.xxhash64("a", "b", "y")))
    assert told.count() == 150 and told.select("row").distinct().count() == 150
    assert told.groupBy("a", "b", "y").count().where("count <> 50").count() == 0
