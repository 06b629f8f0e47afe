"""Probabilities of margin machines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktab.models import calibration, registry
from sparktab.models.base import load_model
from sparktab.plans.runner import from_flat, run_config

from conftest import FLOWER_FEATURES


def test_sigmoid_equals_a_fit_on_all_rows():
    """Newton steps on a fine histogram against a search on the rows themselves."""
    rng = np.random.default_rng(1)
    margin = rng.normal(0, 2, 4000)
    y = rng.random(4000) < 1 / (1 + np.exp(-1.7 * margin + 0.4))
    low, step = margin.min(), (margin.max() - margin.min()) / calibration.BINS
    counts, sums = np.zeros((calibration.BINS, 2)), np.zeros((calibration.BINS, 2))
    spot = np.clip((margin - low) / step, 0, calibration.BINS - 1).astype(int)
    np.add.at(counts, (spot, y.astype(int)), 1.0)
    np.add.at(sums, (spot, y.astype(int)), margin)
    a, b = calibration.fit_sigmoid(counts, sums)
    n1 = y.sum()
    target = np.where(y, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    p = 1 / (1 + np.exp(a * margin + b))
    assert abs(((target - p) * margin).sum()) < 0.5 and abs((target - p).sum()) < 0.5
    assert a == pytest.approx(-1.7, abs=0.15) and b == pytest.approx(0.4, abs=0.15)


def test_one_sided_and_separated_margins():
    counts, sums = np.zeros((calibration.BINS, 2)), np.zeros((calibration.BINS, 2))
    counts[3, 0], sums[3, 0], counts[9, 1], sums[9, 1] = 50, -50.0, 50, 50.0
    a, b = calibration.fit_sigmoid(counts, sums)
    assert a < 0 and 1 / (1 + np.exp(a + b)) == pytest.approx(51 / 52, abs=1e-3)
    counts[9], sums[9] = 0, 0
    a, b = calibration.fit_sigmoid(counts, sums)
    assert np.isfinite([a, b]).all()


@pytest.fixture(scope="module")
def coded(flowers):
    from sparktab.operators import labels

    return labels.encode_label(flowers, "species", labels.fit_label_codes(flowers, "species")).withColumnRenamed("species", "y").cache()


def test_probabilities_follow_the_margins(spark, coded, tmp_path):
    model = registry.train(coded, "classification", "svm", FLOWER_FEATURES, "y", {"probability": True, "landmarks": 40})
    rows = model.transform(coded.withColumn("probability", F.lit("old"))).collect()
    assert all(abs(sum(r.probability) - 1) < 1e-9 and len(r.probability) == 3 for r in rows)
    right = sum(r.prediction == r.y for r in rows)
    assert right >= 140 and sum(r.probability[int(r.y)] > 0.5 for r in rows) >= 138
    assert all(a < 0 for a, _ in model.sigmoids)
    again = load_model(spark, model.save(spark, str(tmp_path / "m")))
    assert [r.probability for r in again.transform(coded).orderBy(*FLOWER_FEATURES).collect()] == [
        r.probability for r in model.transform(coded).orderBy(*FLOWER_FEATURES).collect()
    ]


def test_two_classes_are_calibrated(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, 1500)
    y = (rng.random(1500) < 1 / (1 + np.exp(-2 * x))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)] + [(None, None)], "x double, y int")
    model = registry.train(df, "classification", "svm", ["x"], "y", {"kernel": "linear", "probability": True})
    rows = model.transform(df).collect()
    assert [r.probability for r in rows if r.x is None] == [None]
    known = [r for r in rows if r.x is not None]
    ordered = sorted(known, key=lambda r: r.x)
    shares = [r.probability[1] for r in ordered]
    assert shares == sorted(shares)
    assert np.mean(shares) == pytest.approx(y.mean(), abs=0.03)
    assert np.mean([abs(r.probability[1] - 1 / (1 + np.exp(-2 * r.x))) for r in known]) < 0.06


def test_flat_configuration_with_probabilities(spark, flowers, tmp_path):
    config = from_flat(
        {"IRIS_FEATURE_COLS": FLOWER_FEATURES, "IRIS_LABEL_COL": "species", "TEST_SIZE": 0.15, "VAL_SIZE": 0.15, "USE_STRATIFIED": True,
         "RANDOM_SEED": 42, "KERNEL": "rbf", "C": 1.0, "PROBABILITY": True, "DEGREE": 4, "GAMMA": "scale", "MAX_ITER": "max_iter"},
        "svm",
    )
    assert "max_iter" not in config["model"]["params"]
    result = run_config(spark, config, flowers)
    assert {r.split: r.accuracy for r in result.training.metrics.collect()}["test"] >= 0.8
    assert result.training.model.sigmoids is not None
