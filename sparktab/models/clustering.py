"""k-means, choice of k, silhouette."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import blocks
from ..functions.columns import quoted, require_columns
from ..operators.encoding import FeatureTransformer
from ..session import local_table
from .base import VECTOR, ModelSpec, TabularModel, any_null, refuse_nulls, with_vector
from .lloyd import run_all, squares_to

CELLS = 4_000_000


class ClusterModel(TabularModel):
    """Standardised k-means; ``transform`` adds ``cluster``, null for a row with a null feature."""

    kind = "kmeans"

    def __init__(self, spec: ModelSpec, scaler: FeatureTransformer | None, centres: np.ndarray, cost: float) -> None:
        super().__init__(spec)
        self.scaler = scaler
        self.centres = centres
        self.cost = cost

    @property
    def _inputs(self) -> list[str]:
        return self.scaler.output_columns if self.scaler else self.spec.features

    def scaled(self, df: DataFrame) -> DataFrame:
        """The table with the columns the distances are taken on."""
        return self.scaler.transform(df, keep_raw=True) if self.scaler else df

    def transform(self, df: DataFrame) -> DataFrame:
        centres = self.centres

        @pandas_udf("int")
        def nearest(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            return pd.Series(squares_to(x, centres).argmin(axis=1))

        inputs = [quoted(c).cast("double") for c in self._inputs]
        found = F.when(~any_null(inputs), nearest(*inputs)).alias("cluster")
        return self.scaled(df).select(*[quoted(c) for c in df.columns if c != "cluster"], found)

    def centers(self, spark) -> DataFrame:
        """One row per cluster on the original scale."""
        rows = []
        for i, center in enumerate(self.centres):
            values = [float(v) for v in center]
            if self.scaler:
                values = [
                    v * self.scaler.scaling[c][1] + self.scaler.scaling[c][0]
                    for v, c in zip(values, self.spec.features)
                ]
            rows.append((i, *values))
        ddl = ", ".join(["cluster int", *[f"`{c}` double" for c in self.spec.features]])
        return local_table(spark, rows, ddl)

    def _state(self, spark, path) -> Any:
        if self.scaler:
            self.scaler.save(spark, f"{path}/scaler")
        return [self.scaler is not None, self.centres.tolist(), self.cost]

    @classmethod
    def _restore(cls, spark, path, spec, state):
        scaler = FeatureTransformer.load(spark, f"{path}/scaler") if state[0] else None
        return cls(spec, scaler, np.asarray(state[1]), state[2])


def fit_kmeans(
    df: DataFrame, features: Sequence[str], k: int, starts: int = 10, seed: int = 42,
    standardise: bool = True, max_iter: int = 300,
) -> ClusterModel:
    """Best of several k-means++ starts by within-cluster squares, all in shared passes."""
    features = list(features)
    require_columns(df, features)
    refuse_nulls(df, features, "kmeans")
    scaler = FeatureTransformer.fit(df, features, standardise=True) if standardise else None
    scaled = scaler.transform(df.select(*[quoted(c) for c in features])) if scaler else df
    runs, _ = run_all(scaled, scaler.output_columns if scaler else features, [k], starts, seed, max_iter)
    best = min(runs, key=lambda run: run.cost)
    spec = ModelSpec("clustering", "kmeans", features, "", {"k": k, "starts": starts, "random_state": seed})
    return ClusterModel(spec, scaler, np.array(best.centres), best.cost)


def elbow_table(
    df: DataFrame, features: Sequence[str], largest: int = 19, starts: int = 10, seed: int = 42,
    standardise: bool = True, max_iter: int = 300,
) -> DataFrame:
    """``(k, inertia, bend)``; the bend is the second difference of the inertia.

    The best of ``starts`` runs counts for each k. All runs go through the table together.
    """
    features = list(features)
    scaler = FeatureTransformer.fit(df, features, standardise=True) if standardise else None
    names = scaler.output_columns if scaler else features
    data = scaler.transform(df.select(*[quoted(c) for c in features])) if scaler else df
    runs, _ = run_all(data, names, range(1, largest + 1), starts, seed, max_iter)
    rows = [(k, min(r.cost for r in runs if r.k == k)) for k in range(1, largest + 1)]
    table = local_table(df.sparkSession, rows, "k int, inertia double")
    order = Window.orderBy("k")  # at most a few dozen rows
    bend = F.lead("inertia").over(order) - 2 * F.col("inertia") + F.lag("inertia").over(order)
    return table.withColumn("bend", bend)


def choose_k(elbow: DataFrame, offset: int = 1) -> int:
    """The k with the largest bend; ``offset=2`` gives the next one."""
    best = elbow.where("bend IS NOT NULL").orderBy(F.col("bend").desc(), "k").first()
    return best.k + offset - 1


def _distance_sums(a: np.ndarray, b: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Per row of ``a`` the summed Euclidean distance to the points of each cluster."""
    member = np.zeros((len(b), k))
    member[np.arange(len(b)), labels] = 1.0
    out = np.empty((len(a), k))
    step = max(1, CELLS // max(1, len(b)))
    middle = b.mean(axis=0)
    a, b = a - middle, b - middle
    squares = (b**2).sum(axis=1)
    for at in range(0, len(a), step):
        part = a[at : at + step]
        own = (part**2).sum(axis=1)[:, None]
        gap = own + squares[None, :] - 2.0 * part @ b.T
        # Where the product has cancelled, the distance is computed directly.
        rows, cols = np.nonzero(gap < 1e-6 * (own + squares[None, :]))
        gap[rows, cols] = ((part[rows] - b[cols]) ** 2).sum(axis=1)
        out[at : at + step] = np.sqrt(gap) @ member
    return out


def silhouette(
    df: DataFrame, features: Sequence[str], cluster: str, key: str, **limits: int
) -> DataFrame:
    """Mean exact silhouette over Euclidean distances: ``(rows, clusters, silhouette)``.

    Distances are summed per cluster inside bounded blocks, so that only one short row per
    point and block is shuffled. A point alone in its cluster counts 0. No value is given
    for a single cluster.
    """
    sizes = {
        r.c: r.n
        for r in df.groupBy(quoted(cluster).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
    }
    k = max(sizes) + 1
    names = [f"f{i}" for i in range(len(features))]
    points = df.select(
        quoted(key).cast("bigint").alias("__id"), quoted(cluster).cast("int").alias("__c"),
        *[quoted(c).cast("double").alias(n) for n, c in zip(names, features)],
    )

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        sums = _distance_sums(a[names].to_numpy(float), b[names].to_numpy(float), b["__c"].to_numpy(int), k)
        out = pd.DataFrame(sums, columns=[f"s{i}" for i in range(k)])
        out.insert(0, "__id", a["__id"].to_numpy())
        out.insert(1, "__c", a["__c"].to_numpy())
        return out

    schema = ", ".join(["__id bigint", "__c int", *[f"s{i} double" for i in range(k)]])
    sums, several = blocks.against_all(points, points, "__id", "__id", kernel, schema, **limits)
    if several:
        sums = sums.groupBy("__id", "__c").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])
    own_size = F.lit(0)
    own_sum = F.lit(0.0)
    others = []
    for i, n in sorted(sizes.items()):
        own_size = F.when(F.col("__c") == i, F.lit(n)).otherwise(own_size)
        own_sum = F.when(F.col("__c") == i, F.col(f"s{i}")).otherwise(own_sum)
        others.append(F.when(F.col("__c") != i, F.col(f"s{i}") / n))
    inside = own_sum / (own_size - 1)
    outside = F.array_min(F.array(*others))
    value = F.when(own_size == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(outside - inside, F.greatest(inside, outside)), F.lit(0.0))
    )
    valued = sums.select(F.when(own_size == 1, 0.0).otherwise(value).alias("v") if len(sizes) > 1 else F.lit(None).cast("double").alias("v"))
    return valued.agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(sizes)).alias("clusters"), F.avg("v").alias("silhouette")
    )


def silhouette_squared(df: DataFrame, features: Sequence[str], cluster: str) -> float:
    """Mean silhouette over squared distances, linear in the rows."""
    data = with_vector(df, list(features)).withColumn("__c", quoted(cluster).cast("double"))
    return ClusteringEvaluator(featuresCol=VECTOR, predictionCol="__c").evaluate(data)
