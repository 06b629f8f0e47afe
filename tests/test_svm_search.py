"""Shared-pass training and search of margin machines against one machine at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktab.models import kernel, margins, search, svm_search
from sparktab.models.base import ModelSpec
from sparktab.operators import labels
from sparktab.operators.metrics import accuracy

from conftest import FLOWER_FEATURES

GRID = {"C": [0.1, 10], "kernel": ["linear", "rbf", "poly"], "gamma": ["scale", 0.1], "degree": [2, 3], "max_iter": [-1, 2], "landmarks": [25]}


@pytest.fixture(scope="module")
def coded(flowers):
    codes = labels.fit_label_codes(flowers, "species")
    rows = labels.encode_label(flowers, "species", codes).withColumnRenamed("species", "y")
    return rows.withColumn("id", F.monotonically_increasing_id()).cache()


def alone(data, params, held):
    """Accuracy on fold ``held`` of a machine trained by itself on the other folds."""
    spec = ModelSpec("classification", "svm", FLOWER_FEATURES, "y", dict(params))
    lift = None if params["kernel"] == "linear" else kernel.fit_landmarks(data, spec)
    size = (4 if lift is None else lift.whiten.shape[1]) + 1
    rows = data.where(F.col("fold") != held).select(*[F.col(c).cast("double") for c in FLOWER_FEATURES], F.col("y").cast("double").alias("y"), F.lit(1.0).alias("w"))
    fitted = kernel.fit_machines(rows, lift or kernel._identity, size, "hinge", [np.zeros(size) for _ in range(3)], spec, 1.0)
    model = kernel.MarginModel(spec, lift, np.array(fitted))
    return accuracy(model.transform(data.where(F.col("fold") == held)), "y", "prediction", digits=12).first().accuracy


@pytest.mark.filterwarnings("ignore:.*not settled")
def test_shared_search_equals_single_machines(coded):
    data = search.assign_folds(coded, 3, "y", ["id"]).cache()
    candidates = search.parameter_grid(GRID)
    scores, counts = svm_search.score_candidates(data, FLOWER_FEATURES, "y", candidates, 3, "fold")
    assert scores.shape == (48, 3) and counts["groups"] == 1 + 2 + 4 and counts["machines"] == 7 * 2 * 3 * 3
    assert counts["distinct"] <= 2 * 2 * 7
    for number in (0, 1, 9, 22, 29, 35, 46):
        for held in (0, 2):
            assert scores[number, held] == pytest.approx(alone(data, candidates[number], held), abs=0.021), candidates[number]
    # Settings that a kernel does not read change nothing.
    for i, a in enumerate(candidates):
        for j, b in enumerate(candidates):
            same = {k: v for k, v in a.items() if k not in ("gamma", "degree")} == {k: v for k, v in b.items() if k not in ("gamma", "degree")}
            if same and a["kernel"] == "linear":
                assert (scores[i] == scores[j]).all()


def test_search_ranks_all_candidates_and_refits(coded):
    result = search.grid_search(coded, "classification", "svm", FLOWER_FEATURES, "y", {k: v for k, v in GRID.items() if k != "max_iter"}, folds=3, key=["id"])
    table = result.table.orderBy("rank").collect()
    assert len(table) == 24 and [r["rank"] for r in table] == list(range(1, 25))
    assert search.top_candidates(result).count() == 10
    assert table[0].mean_score >= 0.9
    right = result.best_model.transform(coded).where("prediction = y").count()
    assert right >= 135


def test_two_classes_weights_and_unlabelled_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (120, 2))
    rows = [(float(a), float(b), (1 if a + b > 0 else 0) if i % 10 else None, i % 4) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, y int, fold int")
    scores, counts = svm_search.score_candidates(df, ["a", "b"], "y", [{"kernel": "linear", "C": 10.0}], 4, "fold")
    assert scores.min() >= 0.85 and counts["machines"] == 4
    with pytest.raises(ValueError, match="no parameters"):
        svm_search.score_candidates(df, ["a", "b"], "y", [{"nope": 1}], 4, "fold")
    with pytest.raises(ValueError, match="max_iter"):
        svm_search.score_candidates(df, ["a", "b"], "y", [{"max_iter": 0}], 4, "fold")


def test_packing_is_bounded(monkeypatch):
    monkeypatch.setattr(margins, "PAYLOAD_NUMBERS", 100)
    groups = [margins.MachineGroup(None, 3, [margins.Machine(1.0, 0)] * 13), margins.MachineGroup(None, 40, [margins.Machine(1.0, 0)] * 2)]
    jobs = margins.packed(groups)
    seen = [(g, int(i)) for job in jobs for g, which in job for i in which]
    assert sorted(seen) == [(0, i) for i in range(13)] + [(1, 0), (1, 1)]
    for job in jobs:
        assert sum(len(w) * groups[g].width for g, w in job) <= 100 or (len(job) == 1 and len(job[0][1]) == 1)


def test_landmark_error(coded):
    errors = []
    for kind, landmarks in (("rbf", 3), ("rbf", 12), ("rbf", 200), ("poly", 200)):
        params = {"landmarks": landmarks, "kernel": kind, "max_iter": 3}
        with pytest.warns(RuntimeWarning):
            model = kernel.train_svm(coded, ModelSpec("regression", "svm", FLOWER_FEATURES, "petal_width", params))
        errors.append(model.landmark_error)
    assert errors[0] > errors[1] > errors[2] and errors[0] <= 1 and errors[2] < 1e-6 and errors[3] < 1e-6
