import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktab.models import boosting, clustering, kernel, linear, network, registry, search, weights
from sparktab.models.base import ModelSpec, load_model
from sparktab.models.neighbors import nearest_in_block
from sparktab.operators import labels, splitting
from sparktab.operators.encoding import FeatureTransformer
from sparktab.operators.scoring import Scorer
from sparktab.plans.runner import from_flat, run_config
from sparktab.sources.workspace import Workspace

from conftest import FLOWER_FEATURES


@pytest.fixture(scope="module")
def parts(flowers):
    codes = labels.fit_label_codes(flowers, "species")
    coded = labels.encode_label(flowers, "species", codes).withColumn("y", F.col("species"))
    return splitting.split_table(coded, "species").cache()


@pytest.fixture(scope="module")
def curve(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-2, 2, (240, 2))
    y = 3 * x[:, 0] - 2 * x[:, 1] + np.sin(2 * x[:, 0]) + rng.normal(0, 0.05, 240)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id bigint, a double, b double, y double")
    return df.withColumn("split", F.when(F.col("id") % 5 == 0, "test").when(F.col("id") % 5 == 1, "val").otherwise("train")).cache()


CLASS_PARAMS = {
    "adaboost": {"n_estimators": 8}, "gboost": {"n_estimators": 5}, "xgboost": {"n_estimators": 5, "max_depth": 3},
    "lightgbm": {"n_estimators": 5}, "mlp": {"max_iter": 60, "batch_size": 8, "learning_rate_init": 0.005, "epoch_steps": 4},
    "random_forest": {"n_estimators": 20}, "svm": {"landmarks": 60}, "logistic_regression": {"max_iter": 60},
}
WITHOUT_PROBABILITY = {"svm"}


@pytest.mark.parametrize("name", sorted(set(registry.CLASSIFICATION) - {"Be_naive_bayes", "Mu_naive_bayes"}))
def test_classifiers_learn_save_and_reload(spark, parts, tmp_path, name):
    run = registry.train_and_score(parts, "classification", name, FLOWER_FEATURES, "y", CLASS_PARAMS.get(name))
    scores = {r.split: r.accuracy for r in run.metrics.collect()}
    assert scores["test"] >= 0.85 and scores["train"] >= 0.85
    model = load_model(spark, run.model.save(spark, str(tmp_path / "m")))
    test = parts.where("split = 'test'")
    key = lambda rows: sorted((*[r[c] for c in FLOWER_FEATURES], r.prediction) for r in rows)
    assert key(model.transform(test).collect()) == key(run.model.transform(test).collect())
    scored = model.transform(test)
    if name in WITHOUT_PROBABILITY:
        assert "probability" not in scored.columns
    else:
        sums = scored.select(F.aggregate("probability", F.lit(0.0), lambda a, b: a + b).alias("s"), F.size("probability").alias("k"))
        assert all(abs(r.s - 1) < 1e-9 and r.k == 3 for r in sums.collect())


REGRESSION_PARAMS = {
    "adaboost": {"n_estimators": 8}, "decision_tree": {"max_depth": 6}, "gboost": {"n_estimators": 30},
    "xgboost": {"n_estimators": 30}, "lightgbm": {"n_estimators": 20}, "random_forest": {"n_estimators": 10, "max_depth": 8},
    "mlp": {"max_iter": 80, "batch_size": 16, "learning_rate_init": 0.01, "epoch_steps": 4}, "lasso": {"alpha": 0.01}, "svm": {"landmarks": 60},
}


@pytest.mark.parametrize("name", sorted(registry.REGRESSION))
def test_regressors_learn_save_and_reload(spark, curve, tmp_path, name):
    run = registry.train_and_score(curve, "regression", name, ["a", "b"], "y", REGRESSION_PARAMS.get(name))
    scores = {r.split: r.r2 for r in run.metrics.collect()}
    assert scores["test"] > 0.8
    model = load_model(spark, run.model.save(spark, str(tmp_path / "m")))
    pairs = run.model.transform(curve).select("id", F.col("prediction").alias("p")).join(
        model.transform(curve).select("id", F.col("prediction").alias("q")), "id"
    )
    assert pairs.where("abs(p - q) > 1e-9").count() == 0
    summary = run.summary.first()
    assert (summary.train_rows, summary.val_rows, summary.test_rows, summary.features) == (144, 48, 48, 2)


def _least_squares(df, columns, label):
    pdf = df.toPandas()
    x = np.column_stack([pdf[columns].to_numpy(), np.ones(len(pdf))])
    return np.linalg.lstsq(x, pdf[label].to_numpy(), rcond=None)[0]


def test_linear_equals_least_squares(curve):
    model = registry.train(curve, "regression", "LR", ["a", "b"], "y")
    assert np.allclose([v for _, v in linear.coefficients(model)], _least_squares(curve, ["a", "b"], "y"), atol=1e-8)
    row = linear.simple_regression(curve, "a", "y").first()
    assert np.allclose([row.slope, row.intercept], _least_squares(curve, ["a"], "y"), atol=1e-9)


def test_lasso_meets_its_optimality_conditions(curve):
    alpha = 0.5
    model = registry.train(curve, "regression", "lasso", ["a", "b"], "y", {"alpha": alpha})
    pdf = model.transform(curve).toPandas()
    slope = (pdf[["a", "b"]] - pdf[["a", "b"]].mean()).T @ (pdf["y"] - pdf["prediction"]) / len(pdf)
    w = np.array([v for _, v in linear.coefficients(model)][:2])
    assert np.allclose(slope[w != 0], alpha * np.sign(w[w != 0]), atol=1e-4)


def test_logistic_penalty_matches_total_loss_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=200)
    y = (x + rng.normal(size=200) > 0).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    model = registry.train(df, "classification", "logistic_regression", ["x"], "y", {"C": 0.1})
    p = np.array([r.probability[1] for r in model.transform(df).orderBy("x").collect()])
    xs, ys = np.sort(x), y[np.argsort(x)]
    w = model.stage.coefficientMatrix.toArray()
    # Gradient of C * sum of losses + |w|^2 / 2 is zero at the solution.
    assert abs(0.1 * float(((p - ys) * xs).sum()) + w[1, 0]) < 1e-3
    assert abs(float((p - ys).sum())) < 1e-2


def test_neighbors_match_brute_force_with_ties(spark):
    rng = np.random.default_rng(4)
    points = rng.integers(0, 4, (300, 3)).astype(float)
    points[:100] = points[0]
    queries = rng.integers(0, 4, (40, 3)).astype(float)
    ids = rng.permutation(300)
    for p in (1.0, 2.0, 3.0):
        rows, cols, dist = nearest_in_block(queries, points, ids, 5, p)
        for q in range(40):
            d = (np.abs(points - queries[q]) ** p).sum(axis=1) ** (1 / p)
            want = np.lexsort((ids, d))[:5]
            assert list(cols[rows == q]) == list(want) and np.allclose(dist[rows == q], d[want])


@pytest.mark.parametrize("weighting", ["uniform", "distance"])
def test_block_neighbors_equal_broadcast_neighbors(spark, weighting):
    rng = np.random.default_rng(6)
    rows = [(i, *map(float, rng.integers(0, 5, 2)), int(rng.integers(0, 3))) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, y int")
    known, new = df.where("id < 300"), df.where("id >= 300")
    model = registry.train(known, "classification", "knn", ["a", "b"], "y", {"id_column": "id", "weights": weighting})
    one = {r.id: (r.prediction, [round(p, 12) for p in r.probability]) for r in model.transform(new, key="id").collect()}
    two = {r.id: (r.prediction, [round(p, 12) for p in r.probability]) for r in model.transform(new, key="id", broadcast_bytes=0, block_rows=40).collect()}
    three = model.transform(new).select("id", "prediction").collect()
    assert one == two and {r.id: r.prediction for r in three} == {k: v[0] for k, v in one.items()}


def test_naive_bayes_by_hand(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0), (0, 2.0, 1.0), (1, 0.0, 3.0), (1, 1.0, 4.0), (1, 0.0, 2.0)], "y int, a double, b double")
    bern = registry.train(df, "classification", "Be_naive_bayes", ["a", "b"], "y")
    # Presence shares with one added: class 0 a 3/4, b 2/4; class 1 a 2/5, b 4/5.
    odds = np.array([2 / 5 * 3 / 4 * 1 / 2, 3 / 5 * 2 / 5 * 1 / 5])
    got = bern.transform(df.where("y = 0 AND b = 0")).first().probability
    assert np.allclose(got, odds / odds.sum())
    multi = registry.train(df, "classification", "Mu_naive_bayes", ["a", "b"], "y", {"fit_prior": False})
    odds = np.array([(4 / 6) ** 1, (2 / 12) ** 1])
    assert np.allclose(multi.transform(df.where("y = 0 AND b = 0")).first().probability, odds / odds.sum())
    with pytest.raises(ValueError):
        registry.train(df.withColumn("a", -F.col("a")), "classification", "Mu_naive_bayes", ["a", "b"], "y")
    with pytest.raises(ValueError):
        registry.train(df.where("y = 1"), "classification", "Ga_naive_bayes", ["a", "b"], "y")


def test_all_landmarks_are_the_exact_kernel(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(30, 3))
    for kind in ("rbf", "linear"):
        lift = kernel.LandmarkMap(kind, 0.3, 3, 0.0, x)
        phi = lift(x)
        assert np.allclose(phi @ phi.T, kernel.kernel_values(x, x, kind, 0.3, 3, 0.0), atol=1e-6)


def test_scale_gamma(flowers):
    x = flowers.select(*FLOWER_FEATURES).toPandas().to_numpy()
    assert kernel.scale_gamma(flowers, FLOWER_FEATURES) == pytest.approx(1 / (4 * x.var()))


@pytest.mark.parametrize("kind", ["linear", "rbf"])
def test_svr_objective_is_lowest_nearby(curve, kind):
    spec = ModelSpec("regression", "svm", ["a", "b"], "y", {"kernel": kind, "C": 1.0, "epsilon": 0.1, "landmarks": 50})
    model = kernel.train_svm(curve, spec)
    pdf = curve.toPandas()
    x = pdf[["a", "b"]].to_numpy()
    phi = np.column_stack([model.lift(x) if model.lift else x, np.ones(len(pdf))])

    def objective(beta):
        return 0.5 * beta[:-1] @ beta[:-1] + np.maximum(np.abs(pdf["y"].to_numpy() - phi @ beta) - 0.1, 0).sum()

    best = objective(model.weights[0])
    rng = np.random.default_rng(0)
    assert all(
        best <= objective(model.weights[0] + rng.normal(0, size, phi.shape[1])) + 1e-3 * best
        for size in (0.001, 0.01, 0.1) for _ in range(50)
    )


def test_svm_machines_are_lowest_nearby(parts):
    train = parts.where("split = 'train'")
    spec = ModelSpec("classification", "svm", FLOWER_FEATURES, "y", {"kernel": "linear", "C": 0.5})
    model = kernel.train_svm(train, spec)
    pdf = train.toPandas()
    phi = np.column_stack([pdf[FLOWER_FEATURES].to_numpy(), np.ones(len(pdf))])
    rng = np.random.default_rng(0)
    for code, beta in enumerate(model.weights):
        goal = np.where(pdf["y"] == code, 1.0, -1.0)

        def objective(b, goal=goal):
            return 0.5 * b[:-1] @ b[:-1] + 0.5 * np.maximum(1 - goal * (phi @ b), 0).sum()

        best = objective(beta)
        assert all(
            best <= objective(beta + rng.normal(0, size, 5)) + 1e-3 * best for size in (0.001, 0.01, 0.1) for _ in range(50)
        )
    two = train.where("y < 2")
    both = kernel.train_svm(two, spec)
    assert both.weights.shape == (1, 5) and both.transform(two).where("prediction <> y").count() == 0


def test_network_gradient_is_right():
    rng = np.random.default_rng(3)
    for classes, y in ((3, rng.integers(0, 3, 7).astype(float)), (None, rng.normal(size=7))):
        for activation in ("tanh", "logistic", "relu"):
            shape = network.Shape((4, 5, 3, classes or 1), classes, activation)
            flat, x = shape.start(1), rng.normal(size=(7, 4))
            grad, loss, _ = network.gradient(shape, flat, x, y, 0.0, 0.0, rng)
            for i in range(0, len(flat), 7):
                step = np.zeros_like(flat)
                step[i] = 1e-6
                up = network.loss_and_hits(shape, network.forward(shape, flat + step, x), y)[0]
                down = network.loss_and_hits(shape, network.forward(shape, flat - step, x), y)[0]
                assert grad[i] == pytest.approx((up - down) / 2e-6 / 7, abs=1e-5)


def test_network_history_keeps_the_best_epoch(spark, parts):
    spec = ModelSpec("classification", "mlp", FLOWER_FEATURES, "y", {"max_iter": 12, "batch_size": 8, "decay_every": 5, "decay_factor": 0.5, "dropout": 0.1})
    model = network.train_network(parts.where("split = 'train'"), spec, validation=parts.where("split = 'val'"))
    rows = model.history_table(spark).orderBy("epoch").collect()
    assert len(rows) == 12 and sum(r.best for r in rows) == 1
    best = next(r for r in rows if r.best)
    assert best.val_accuracy == max(r.val_accuracy for r in rows)
    assert [rows[i].learning_rate for i in (0, 5, 10)] == [0.001, 0.0005, 0.00025]
    assert rows[-1].train_loss < rows[0].train_loss


def test_network_does_not_depend_on_partitions(spark, curve):
    """The same weights, with dropout, stopping and minibatches, for 1, 4 and 32 partitions."""
    params = {"hidden_layer_sizes": (6, 4), "max_iter": 5, "batch_size": 40, "dropout": 0.2, "early_stopping": True, "learning_rate_init": 0.01}
    found = []
    for parts in (1, 4, 32):
        spec = ModelSpec("regression", "mlp", ["a", "b"], "y", dict(params))
        found.append(network.train_network(curve.repartition(parts, "id"), spec))
    for other in found[1:]:
        assert np.allclose(found[0].weights, other.weights, rtol=0, atol=1e-9)
        assert np.allclose([h[2] for h in found[0].history], [h[2] for h in other.history])


def test_network_step_is_the_gradient_of_all_rows(spark, curve):
    shape = network.Shape((2, 3, 1), None)
    start = shape.start(0)
    rows = curve.select("a", "b", "y").withColumn("row", F.xxhash64("a", "b"))
    state = network.AdamState(start, start * 0, start * 0, 0)
    state, seen, loss, _ = network.run_epoch(rows.repartition(70), shape, state, 0.001, 0.5, 1, 0.0, 1)
    pdf = curve.toPandas()
    grad, total, _ = network.gradient(shape, start, pdf[["a", "b"]].to_numpy(), pdf["y"].to_numpy(), 0.5, 0.0, None)
    assert seen == 240 and loss == pytest.approx(total) and np.allclose(state.first, 0.1 * grad)
    # Every row is in exactly one of the minibatches.
    _, seen, _, _ = network.run_epoch(rows, shape, state, 0.001, 0.0, 3, 0.0, 2)
    assert seen == 240


def test_network_runs_all_epochs_if_told_so(curve):
    params = {"hidden_layer_sizes": (2,), "max_iter": 14, "learning_rate_init": 1e-9, "tol": 1.0}
    for patience, epochs in ((2, 3), (None, 14)):
        spec = ModelSpec("regression", "mlp", ["a", "b"], "y", {**params, "n_iter_no_change": patience})
        assert len(network.train_network(curve, spec).history) == epochs


def test_boosting_is_better_than_one_tree(curve):
    one = boosting.train_adaboost(curve, ModelSpec("regression", "adaboost", ["a", "b"], "y", {"n_estimators": 1}))
    many = boosting.train_adaboost(curve, ModelSpec("regression", "adaboost", ["a", "b"], "y", {"n_estimators": 12}))
    error = lambda m: m.transform(curve).agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    assert error(many) < error(one) and len(many.stages) > 5


def test_importance_table(spark, curve):
    model = registry.train(curve, "regression", "random_forest", ["a", "b"], "y", {"n_estimators": 5, "max_depth": 4})
    rows = registry.importance_table(spark, model).collect()
    assert [r.feature for r in rows] == ["a", "b"] and sum(r.importance for r in rows) == pytest.approx(1, abs=1e-3)
    assert registry.importance_table(spark, model, top=1, names=["only"]).first().feature == "feature_1"
    with pytest.raises(ValueError):
        registry.importance_table(spark, registry.train(curve, "regression", "LR", ["a"], "y"))


@pytest.mark.parametrize("problem,name,params", [
    ("regression", "nope", {}), ("ranking", "LR", {}), ("regression", "xgboost", {"leaf_penalty": 1}),
    ("regression", "decision_tree", {"min_samples_split": 5}), ("regression", "LR", {"alpha": 1}),
    ("regression", "svm", {"kernel": "odd"}), ("regression", "mlp", {"solver": "sgd"}), ("regression", "knn", {"weights": "odd"}),
])
def test_training_refusals(curve, problem, name, params):
    with pytest.raises(ValueError):
        registry.train(curve, problem, name, ["a"], "y", params)


# ------------------------------------------------------------------ clusters


def test_kmeans_finds_the_kinds(spark, flowers, tmp_path):
    model = clustering.fit_kmeans(flowers, FLOWER_FEATURES, 3, starts=3)
    found = model.transform(flowers).groupBy("cluster", "species").count().collect()
    assert sum(max((r["count"] for r in found if r.cluster == c), default=0) for c in range(3)) >= 140
    centers = sorted(r.petal_length for r in model.centers(spark).collect())
    assert centers[0] == pytest.approx(1.5, abs=0.2) and centers[2] == pytest.approx(5.6, abs=0.4)
    again = load_model(spark, model.save(spark, str(tmp_path / "k")))
    assert again.transform(flowers).groupBy("cluster").count().count() == 3


def test_elbow_and_inertia(spark, flowers):
    table = clustering.elbow_table(flowers, FLOWER_FEATURES, largest=6, starts=2).cache()
    rows = {r.k: r.inertia for r in table.collect()}
    assert rows[1] == pytest.approx(150 * 4) and rows[2] < rows[1]
    best = clustering.choose_k(table)
    assert best in (2, 3) and clustering.choose_k(table, 2) == best + 1


def test_silhouette_brute_force(spark, flowers):
    df = flowers.withColumn("id", F.monotonically_increasing_id()).withColumn(
        "c", F.when(F.col("petal_length") < 2.5, 0).when(F.col("petal_length") < 5, 2).otherwise(3)
    ).cache()
    pdf = df.toPandas()
    x, c = pdf[FLOWER_FEATURES].to_numpy(), pdf["c"].to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    values = []
    for i in range(len(x)):
        inside = d[i, (c == c[i])].sum() / ((c == c[i]).sum() - 1)
        outside = min(d[i, c == o].mean() for o in set(c) - {c[i]})
        values.append((outside - inside) / max(inside, outside))
    for limits in ({}, {"broadcast_bytes": 0, "block_rows": 40}):
        row = clustering.silhouette(df, FLOWER_FEATURES, "c", "id", **limits).first()
        assert row.silhouette == pytest.approx(np.mean(values)) and (row.rows, row.clusters) == (150, 3)
    assert clustering.silhouette(df.withColumn("c", F.lit(0)), FLOWER_FEATURES, "c", "id").first().silhouette is None
    assert 0 < clustering.silhouette_squared(df, FLOWER_FEATURES, "c") <= 1


# ------------------------------------------------------------------ search, weights


def test_folds_are_level(flowers):
    folds = search.assign_folds(flowers.dropDuplicates(), 5, "species")
    counts = folds.groupBy("fold").count().collect()
    assert sorted(r["count"] for r in counts) == [29, 30, 30, 30, 30]
    assert folds.groupBy("fold", "species").count().agg(F.min("count"), F.max("count")).first()[:] == (9, 10)


def test_grid_search_ranks_and_refits(parts):
    result = search.grid_search(
        parts.drop("split"), "classification", "decision_tree", FLOWER_FEATURES, "y", {"max_depth": [1, 3]}, folds=3
    )
    rows = search.top_candidates(result).collect()
    assert [r.rank for r in rows] == [1, 2] and result.best_params == {"max_depth": 3}
    assert rows[0].mean_score > rows[1].mean_score
    assert len(search.parameter_grid([{"a": [1, 2], "b": [3]}, {"c": [4]}])) == 3


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "y string")
    found = {r.y: r.weight for r in weights.add_class_weights(df, "y").collect()}
    assert found == {"a": pytest.approx(4 / 6), "b": 2.0}
    assert {r.w for r in weights.add_class_weights(df, "y", {"a": 5}, "w").collect()} == {5.0, 1.0}
    assert {r.w for r in weights.add_class_weights(df, "y", "none", "w").collect()} == {1.0}
    with pytest.raises(ValueError):
        weights.add_class_weights(df, "y", "odd")


# ------------------------------------------------------------------ scoring, runs


def test_scorer_round_trip(spark, flowers, tmp_path):
    codes = labels.fit_label_codes(flowers, "species")
    encoder = FeatureTransformer.fit(flowers, FLOWER_FEATURES, standardise=True)
    data = encoder.transform(labels.encode_label(flowers, "species", codes))
    model = registry.train(data, "classification", "random_forest", encoder.output_columns, "species", {"n_estimators": 10})
    scorer = Scorer.load(spark, Scorer(model, encoder, codes).save(spark, str(tmp_path / "s")))
    rows = [{"sepal_length": 5.1, "sepal_width": 3.5, "petal_length": 1.4, "petal_width": 0.2}]
    schema = "sepal_length double, sepal_width double, petal_length double, petal_width double"
    row = scorer.score_rows(spark, rows, schema).first()
    assert row.predict_label == "setosa" and row.predict_result == 0.0 and len(row.predict_proba) == 3
    path = str(tmp_path / "new.csv")
    flowers.drop("species").coalesce(1).write.csv(path, header=True)
    scored = scorer.score_file(spark, path)
    assert scored.count() == 150 and scored.columns == [*FLOWER_FEATURES, "predict_result", "predict_proba", "predict_label"]


def test_configured_run(spark, flowers, tmp_path):
    config = from_flat({
        "IRIS_FEATURE_COLS": FLOWER_FEATURES, "IRIS_LABEL_COL": "species", "TEST_SIZE": 0.2, "VAL_SIZE": 0.2,
        "USE_STRATIFIED": True, "RANDOM_SEED": 42, "N_ESTIMATORS": 20, "MAX_DEPTH": 3, "FILL_PROCESS": "None",
        "ISNULL_PROCESS": "mean_cols", "METHOD": "iqr", "THRESHOLD": 3, "PROCESE_OUTLIERS_METHOD": "fill_outlier",
    }, "random_forest")
    config |= {"standardise": True, "class_weight": "balanced", "output": str(tmp_path / "out"), "dataset_id": "flowers"}
    result = run_config(spark, config, flowers)
    scores = {r.split: (r.accuracy, r.rows) for r in result.training.metrics.collect()}
    assert {k: v[1] for k, v in scores.items()} == {"train": 89, "val": 30, "test": 30}
    assert scores["test"][0] >= 0.9 and scores["train"][0] >= 0.95
    space = Workspace(spark, config["output"])
    assert space.runs("flowers").count() == 1
    assert space.read_metadata(result.ids["split"])["classes"] == ["setosa", "versicolor", "virginica"]
    again = Scorer.load(spark, result.ids["model"])
    assert again.score(flowers).where("predict_label = species").count() >= 140


def test_configured_regression(spark, curve):
    result = run_config(
        spark, {"label": "y", "features": ["a", "b"], "fit_on": "all", "model": {"type": "LR"}}, curve.drop("split")
    )
    assert {r.split for r in result.training.metrics.where("r2 > 0.8").collect()} == {"train", "val", "test"}
    assert result.scorer.codes is None


def test_unknown_settings_are_refused():
    with pytest.raises(ValueError, match="UNRELATED"):
        from_flat({"UNRELATED": 1, "C": 2})


def test_flat_model_names():
    config = from_flat({"MODEL": "BernoulliNB", "ALPHA": 1, "FIT_PRIOR": False, "CLASS_PRIOR": None, "BINARIZE": None})
    assert config["model"] == {"type": "Be_naive_bayes", "params": {"alpha": 1, "fit_prior": False}}
    assert from_flat({"MODEL": "GaussianNB", "ALPHA": 1})["model"]["params"] == {}
    assert from_flat({"IRIS_FEATURE_COL": "a", "IRIS_LABEL_COL": "b"}, "LR")["features"] == ["a"]


def test_configured_clustering(spark, flowers):
    config = from_flat({"IRIS_FEATURE_COLS": FLOWER_FEATURES, "FINAL_K": 3, "INIT": "k-means++", "N_INIT": 3, "RANDOM_STATE": 42})
    result = run_config(spark, config, flowers)
    assert sorted(r.n for r in result.summary.collect())[0] > 30 and result.splits is None
    assert result.data.count() == 150 and result.clusters.cost > 0


def test_configuration_without_model_type_or_label(spark, curve):
    with pytest.raises(ValueError, match="model type"):
        run_config(spark, {"label": "y", "features": ["a"], "model": {"params": {}}}, curve)
    with pytest.raises(ValueError, match="label"):
        run_config(spark, {"features": ["a"]}, curve)


def test_subset_without_an_order(spark, curve):
    twice = curve.drop("split").union(curve.drop("split").withColumn("id", F.col("id") + 1000))
    result = run_config(
        spark, {"label": "y", "features": ["a", "b"], "duplicates": {"subset": ["a", "b"], "keep": "first"}, "model": {"type": "LR"}}, twice
    )
    assert result.data.count() == 240 and result.data.agg(F.max("id")).first()[0] < 1000


@pytest.mark.parametrize("limit", [-1, 100])
def test_svm_without_round_limit(parts, limit):
    model = registry.train(
        parts.where("split = 'train'"), "classification", "svm", FLOWER_FEATURES, "species", {"kernel": "linear", "max_iter": limit}
    )
    right = model.transform(parts).where("prediction = species").count()
    assert right >= 140 and abs(model.weights).max() > 0


def test_svm_says_when_rounds_end_too_soon(parts):
    with pytest.warns(RuntimeWarning, match="not settled"):
        registry.train(parts, "classification", "svm", FLOWER_FEATURES, "species", {"kernel": "linear", "max_iter": 2})
    with pytest.raises(ValueError, match="max_iter"):
        registry.train(parts, "classification", "svm", FLOWER_FEATURES, "species", {"max_iter": 0})


@pytest.mark.parametrize("name", ["svm", "mlp", "knn"])
def test_null_features(parts, name):
    """Refused in training with one clear message, a null prediction in scoring."""
    params = {"mlp": {"max_iter": 3}, "svm": {"kernel": "linear", "max_iter": 3}}.get(name, {})
    holes = parts.withColumn("petal_width", F.when(F.col("petal_width") > 1.8, F.lit(None)).otherwise(F.col("petal_width")))
    with pytest.raises(ValueError, match="cannot train on nulls.*petal_width"):
        registry.train(holes, "classification", name, FLOWER_FEATURES, "species", params)
    model = registry.train(parts, "classification", name, FLOWER_FEATURES, "species", params)
    scored = model.transform(holes)
    assert scored.count() == parts.count()
    assert scored.where("(prediction IS NULL) <> (petal_width IS NULL)").count() == 0


def test_boosting_with_any_number_of_jobs(parts):
    model = registry.train(parts, "classification", "gboost", FLOWER_FEATURES, "species", {"n_estimators": 2, "n_jobs": -1})
    assert model.transform(parts).where("prediction = species").count() > 130


def test_neighbours_take_no_weights(parts):
    with pytest.raises(ValueError, match="weights"):
        registry.train(parts, "classification", "knn", FLOWER_FEATURES, "species", weight="sepal_length")


def test_many_payloads_are_summed(spark):
    rows = spark.range(5000, numPartitions=700).selectExpr("spark_partition_id() AS part", "array(1.0D, double(id)) AS payload")
    assert list(network._summed(rows)) == [5000.0, 5000 * 4999 / 2]


def test_configured_clustering_takes_every_dimension(spark, tmp_path):
    """Five groups that differ in the last dimension alone come out with their own sizes."""
    from sparktab.catalog import checks

    rows = [(i, [0.0] * 63 + [100.0 * (i % 5)], 0) for i in range(40)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = checks.configured_clustering(spark, str(tmp_path)).first()
    assert (found.clusters, found.rows) == (5, 40)


def test_boosting_writes_weights_only(spark, curve):
    """The rows meet their weights again without a shuffle, and only keys and weights are written."""
    from pyspark.ml.functions import vector_to_array

    start = boosting.assembled(curve, ["a", "b"], "y").withColumn("__weight", F.lit(1.0))
    rows = boosting.WeightedRows(start)
    again = rows.with_weights(rows.data.withColumn("__weight", F.col("__label") * 2))
    assert again.count() == 240 and again.where("__weight != __label * 2").count() == 0
    assert again.select(vector_to_array("__features").alias("x")).where("size(x) = 2").count() == 240
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
