"""AdaBoost for classes (SAMME) and numbers (R2) over Spark decision trees."""

from __future__ import annotations

import math
from typing import Any

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import quoted
from ..session import cut_lineage
from .base import VECTOR, ModelSpec, TabularModel, assembled, class_count, reject_unknown, with_vector

ROUNDS_PER_CUT = 5
PARAMETERS = ["n_estimators", "learning_rate", "loss", "max_depth", "max_bins", "random_state"]


class BoostedModel(TabularModel):
    """A list of small trees with a say each."""

    kind = "adaboost"

    def __init__(self, spec: ModelSpec, stages: list[Transformer], says: list[float], classes: int | None) -> None:
        super().__init__(spec)
        self.stages = stages
        self.says = says
        self.classes = classes

    def transform(self, df: DataFrame) -> DataFrame:
        scored = with_vector(df, self.spec.features)
        for i, stage in enumerate(self.stages):
            scored = stage.copy({stage.predictionCol: f"__h{i}"}).transform(scored)
        votes = [F.col(f"__h{i}") for i in range(len(self.stages))]
        made = self._classes(votes) if self.classes else {"prediction": self._median(votes)}
        kept = [quoted(c) for c in df.columns if c not in made]
        return scored.select(*kept, *[e.alias(n) for n, e in made.items()])

    def _classes(self, votes: list[Column]) -> dict[str, Column]:
        total = sum(self.says) or 1.0
        against = 1.0 / max(self.classes - 1, 1)
        scores = []
        for k in range(self.classes):
            parts = [
                F.when(v == k, F.lit(say / total)).otherwise(F.lit(-against * say / total))
                for v, say in zip(votes, self.says)
            ]
            scores.append(F.aggregate(F.array(*parts), F.lit(0.0), lambda a, b: a + b))
        decided = F.array(*scores)
        odds = F.transform(decided, lambda s: F.exp(s * against))
        whole = F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)
        return {
            "prediction": (F.array_position(decided, F.array_max(decided)) - 1).cast("double"),
            "probability": F.transform(odds, lambda o: o / whole),
        }

    def _median(self, votes: list[Column]) -> Column:
        """The smallest vote that has half of the total say at or below it."""
        half = 0.5 * sum(self.says)
        pairs = F.array_sort(
            F.array(*[F.struct(v.alias("v"), F.lit(s).alias("s")) for v, s in zip(votes, self.says)])
        )
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("v"))
        return F.aggregate(
            pairs,
            start,
            lambda acc, p: F.struct(
                (acc["sum"] + p["s"]).alias("sum"),
                F.when(acc["v"].isNull() & (acc["sum"] + p["s"] >= half), p["v"]).otherwise(acc["v"]).alias("v"),
            ),
            lambda acc: acc["v"],
        )

    def _state(self, spark, path) -> Any:
        PipelineModel(self.stages).write().overwrite().save(f"{path}/stages")
        return [self.says, self.classes]

    @classmethod
    def _restore(cls, spark, path, spec, state):
        return cls(spec, PipelineModel.load(f"{path}/stages").stages, state[0], state[1])


def _start(df: DataFrame, spec: ModelSpec, weight: str | None) -> DataFrame:
    data = assembled(df, spec.features, spec.label, weight)
    return data if weight is not None else data.withColumn("__weight", F.lit(1.0))


class WeightedRows:
    """Vectors and labels, written once, and beside them slim weights that are written anew.

    Both are dealt by the same key, so meeting again takes no shuffle.
    """

    def __init__(self, start: DataFrame) -> None:
        parts = int(start.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        keyed = start.withColumn("__key", F.monotonically_increasing_id())
        self.data = cut_lineage(keyed.repartition(parts, "__key"))
        self.fixed = self.data.drop("__weight")

    def with_weights(self, data: DataFrame) -> DataFrame:
        """The rows with the weights of ``data``, which has the same keys."""
        return self.fixed.join(cut_lineage(data.select("__key", "__weight")), "__key")


def _tree_options(spec: ModelSpec, depth: int, round_no: int) -> dict[str, Any]:
    return {
        "featuresCol": VECTOR, "labelCol": "__label", "predictionCol": "__h", "weightCol": "__weight",
        "maxDepth": int(spec.params.get("max_depth", depth)), "maxBins": int(spec.params.get("max_bins", 128)),
        "seed": int(spec.params.get("random_state", 42)) + round_no,
    }


def train_adaboost(df: DataFrame, spec: ModelSpec, weight: str | None = None) -> BoostedModel:
    """One tree per round on re-weighted rows.

    Weights are rescaled to mean 1 in every round, and every few rounds a key and a weight per
    row are written to the checkpoint folder, so that neither numbers nor lineage run away.
    """
    reject_unknown(spec.params, PARAMETERS, spec.model_type)
    rows = WeightedRows(_start(df, spec, weight))
    if spec.problem_type == "classification":
        return _samme(rows, spec)
    return _r2(rows, spec)


def _samme(rows: WeightedRows, spec: ModelSpec) -> BoostedModel:
    data = rows.data
    classes = class_count(data, "__label")
    rate = float(spec.params.get("learning_rate", 1.0))
    stages, says = [], []
    for i in range(int(spec.params.get("n_estimators", 50))):
        tree = DecisionTreeClassifier(
            rawPredictionCol="", probabilityCol="", **_tree_options(spec, 1, i)
        ).fit(data)
        missed = (F.col("__h") != F.col("__label")).cast("double")
        judged = tree.transform(data)
        row = judged.agg(
            (F.sum(missed * F.col("__weight")) / F.sum("__weight")).alias("error"),
            F.avg("__weight").alias("mean"),
        ).first()
        if row.error <= 0:
            stages.append(tree)
            says.append(1.0)
            break
        if row.error >= 1 - 1 / classes:
            if not stages:
                raise ValueError("the first tree is no better than chance")
            break
        say = rate * (math.log((1 - row.error) / row.error) + math.log(max(classes - 1, 1)))
        stages.append(tree)
        says.append(say)
        data = judged.withColumn("__weight", F.col("__weight") / row["mean"] * F.exp(say * missed)).drop("__h")
        if (i + 1) % ROUNDS_PER_CUT == 0:
            data = rows.with_weights(data)
    return BoostedModel(spec, stages, says, classes)


def _r2(rows: WeightedRows, spec: ModelSpec) -> BoostedModel:
    data = rows.data
    rate = float(spec.params.get("learning_rate", 1.0))
    loss = spec.params.get("loss", "linear")
    if loss not in ("linear", "square", "exponential"):
        raise ValueError(f"unknown loss {loss!r}")
    stages, says = [], []
    for i in range(int(spec.params.get("n_estimators", 50))):
        tree = DecisionTreeRegressor(**_tree_options(spec, 3, i)).fit(data)
        judged = tree.transform(data).withColumn("__off", F.abs(F.col("__h") - F.col("__label")))
        largest = judged.where("__weight > 0").agg(F.max("__off").alias("m")).first().m
        if not largest:
            stages.append(tree)
            says.append(1.0)
            break
        share = F.col("__off") / largest
        if loss == "square":
            share = share * share
        elif loss == "exponential":
            share = 1 - F.exp(-share)
        row = judged.agg(
            (F.sum(share * F.col("__weight")) / F.sum("__weight")).alias("error"),
            F.avg("__weight").alias("mean"),
        ).first()
        if row.error <= 0:
            stages.append(tree)
            says.append(1.0)
            break
        if row.error >= 0.5:
            if not stages:
                stages.append(tree)
                says.append(1.0)
            break
        beta = row.error / (1 - row.error)
        stages.append(tree)
        says.append(rate * math.log(1 / beta))
        factor = F.pow(F.lit(beta), (1 - share) * rate)
        data = judged.withColumn("__weight", F.col("__weight") / row["mean"] * factor).drop("__h", "__off")
        if (i + 1) % ROUNDS_PER_CUT == 0:
            data = rows.with_weights(data)
    return BoostedModel(spec, stages, says, None)
