"""Class weights."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import data_type, quoted
from ..functions.joins import joined_by_share
from ..operators.splitting import MAX_STRATA, class_counts
from ..session import cut_lineage, local_table


def class_weight_table(df: DataFrame, label: str) -> DataFrame:
    """``(label, n, weight)``: rows over classes times class rows."""
    counts = class_counts(df, label).where("label IS NOT NULL")
    totals = counts.agg(F.sum("n").alias("__all"), F.count(F.lit(1)).alias("__k")).withColumn("__one", F.lit(1))
    return (
        counts.withColumn("__one", F.lit(1))
        .join(F.broadcast(totals), "__one")
        .select("label", "n", (F.col("__all") / (F.col("__k") * F.col("n"))).alias("weight"))
    )


def add_class_weights(
    df: DataFrame, label: str, class_weight: str | Mapping[Any, float] | None = "balanced", out: str = "weight"
) -> DataFrame:
    """Add a row weight by class: balanced, from a mapping (others 1), or 1 for all."""
    if class_weight is None or class_weight == "none":
        return df.withColumn(out, F.lit(1.0))
    if class_weight == "balanced":
        weights = cut_lineage(class_weight_table(df, label))
        found = weights.limit(MAX_STRATA + 1).collect()
        if len(found) > MAX_STRATA:
            return _weights_of_many(df, label, weights, out)
        rows = [(r.label, r.weight) for r in found]
    elif isinstance(class_weight, Mapping):
        rows = list(class_weight.items())
    else:
        raise ValueError("class_weight must be 'balanced', a mapping, 'none' or None")
    kind = data_type(df, label).simpleString()
    table = local_table(df.sparkSession, [(k, float(w)) for k, w in rows], f"__l {kind}, __w double")
    joined = df.join(F.broadcast(table), quoted(label) == F.col("__l"), "left")
    return joined.withColumn(out, F.coalesce("__w", F.lit(1.0))).drop("__l", "__w")


def _weights_of_many(df: DataFrame, label: str, weights: DataFrame, out: str) -> DataFrame:
    """Weights by a join in which frequent classes are spread; rows without a label weigh 1."""
    pairs = weights.select(F.col("label").alias(label), F.col("n").alias("__n"), F.col("weight").alias("__w"))
    joined = joined_by_share(df.where(quoted(label).isNotNull()), pairs, [label], "__n")
    known = joined.withColumn(out, F.col("__w")).select(*[quoted(c) for c in df.columns if c != out], out)
    return known.unionByName(df.where(quoted(label).isNull()).withColumn(out, F.lit(1.0)).select(*known.columns))
