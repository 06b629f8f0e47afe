"""Classification and regression metrics, ROC and precision-recall curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import quoted
from ..functions.ranking import running_totals
from ..session import cut_lineage

#: Classes up to which a confusion matrix lists the pairs that do not occur.
GRID_CLASSES = 1_000


def _ratio(top: Column, bottom: Column) -> Column:
    """Division that gives 0 where it is undefined."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def _pair_counts(df: DataFrame, label: str, prediction: str, by: str | None) -> DataFrame:
    """Rows per (part, label, prediction); everything else is derived from this."""
    groups = [quoted(by).alias("part")] if by else [F.lit("all").alias("part")]
    return (
        df.select(*groups, quoted(label).alias("label"), quoted(prediction).alias("prediction"))
        .where("label IS NOT NULL AND prediction IS NOT NULL")
        .groupBy("part", "label", "prediction")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``(label, prediction, n)`` for every pair of classes seen in either column.

    Beyond GRID_CLASSES classes only the pairs that occur are given.
    """
    counts = cut_lineage(_pair_counts(df, label, prediction, None).drop("part"))
    seen = counts.select("label").union(counts.select("prediction")).distinct()
    if seen.limit(GRID_CLASSES + 1).count() > GRID_CLASSES:
        return counts
    classes = counts.agg(F.array_union(F.collect_set("label"), F.collect_set("prediction")).alias("c"))
    grid = classes.select(F.explode("c").alias("label"), "c").select(
        "label", F.explode("c").alias("prediction")
    )
    return grid.join(counts, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).alias("n")
    )


def _per_class(counts: DataFrame) -> DataFrame:
    """Per (part, class): hits, support, predicted, precision, recall, F1."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = counts.select(
        "part",
        F.inline(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).alias("predicted"), hit.alias("hits")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).alias("support"), F.col("n").alias("predicted"), F.lit(0).alias("hits")),
            )
        ),
    )
    sums = sides.groupBy("part", "class").agg(
        F.sum("hits").alias("hits"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted")
    )
    return sums.select(
        "*",
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1"),
    )


def classification_metrics(
    df: DataFrame, label: str, prediction: str, by: str | None = None, digits: int = 4
) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1, per part if ``by`` is given.

    An undefined ratio counts as 0. A part without rows has no row in the result.
    """
    classes = _per_class(_pair_counts(df, label, prediction, by))
    weighted = lambda m: _ratio(F.sum(F.col(m) * F.col("support")), F.sum("support"))
    measured = classes.groupBy("part").agg(
        F.round(_ratio(F.sum("hits"), F.sum("support")), digits).alias("accuracy"),
        *[F.round(weighted(m), digits).alias(m) for m in ("precision", "recall", "f1")],
        F.sum("support").alias("rows"),
    )
    return measured.withColumnRenamed("part", by) if by else measured.drop("part")


def accuracy(df: DataFrame, label: str, prediction: str, digits: int = 4) -> DataFrame:
    """One row with the share of equal pairs."""
    return df.where(quoted(label).isNotNull() & quoted(prediction).isNotNull()).agg(
        F.round(
            F.coalesce(F.avg((quoted(label) == quoted(prediction)).cast("double")), F.lit(0.0)), digits
        ).alias("accuracy")
    )


def classification_report(df: DataFrame, label: str, prediction: str, digits: int = 4) -> DataFrame:
    """Per class, macro and weighted precision, recall, F1 and support."""
    classes = _per_class(_pair_counts(df, label, prediction, None))
    measures = ("precision", "recall", "f1")
    # Expand each class row into its own line and the two averages, then one aggregate.
    lines = classes.select(
        *measures, "support",
        F.explode(
            F.array(
                F.struct(F.col("class").cast("string").alias("line"), F.lit(1.0).alias("w")),
                F.struct(F.lit("macro avg").alias("line"), F.lit(1.0).alias("w")),
                F.struct(F.lit("weighted avg").alias("line"), F.col("support").cast("double").alias("w")),
            )
        ).alias("e"),
    ).select(*measures, "support", "e.line", "e.w")
    return lines.groupBy(F.col("line").alias("class")).agg(
        *[
            F.round(
                F.when(
                    F.col("class").isin("macro avg", "weighted avg"),
                    _ratio(F.sum(F.col(m) * F.col("w")), F.sum("w")),
                ).otherwise(F.max(m)),
                digits,
            ).alias(m)
            for m in measures
        ],
        F.sum("support").alias("support"),
    )


def regression_metrics(
    df: DataFrame, label: str, prediction: str, by: str | None = None,
    digits: int | None = 4, compat: bool = True,
) -> DataFrame:
    """MAE, MSE, RMSE and R2 in one pass, per part if ``by`` is given.

    With ``compat`` the RMSE is the root of the rounded MSE. R2 of a constant label is 1
    for a perfect fit and 0 otherwise.
    """
    y, p = quoted(label).cast("double"), quoted(prediction).cast("double")
    error = y - p
    groups = [quoted(by).alias("part")] if by else [F.lit("all").alias("part")]
    sums = (
        df.where(y.isNotNull() & p.isNotNull())
        .groupBy(*groups)
        .agg(
            F.avg(F.abs(error)).alias("mae"),
            F.avg(error * error).alias("mse"),
            F.var_pop(y).alias("__var"),
            F.count(F.lit(1)).alias("rows"),
        )
    )
    shown = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    mse = F.col("mse")
    r2 = F.when(F.col("__var") > 0, 1 - mse / F.col("__var")).otherwise(
        F.when(mse == 0, 1.0).otherwise(0.0)
    )
    measured = sums.select(
        "part",
        shown(F.col("mae")).alias("mae"),
        shown(mse).alias("mse"),
        shown(F.sqrt(shown(mse) if compat else mse)).alias("rmse"),
        shown(r2).alias("r2"),
        "rows",
    )
    return measured.withColumnRenamed("part", by) if by else measured.drop("part")


def metric_bundle(
    df: DataFrame, label: str, prediction: str, problem_type: str, split: str = "split"
) -> DataFrame:
    """Metrics of every split from one grouped pass."""
    if problem_type == "classification":
        return classification_metrics(df, label, prediction, by=split)
    if problem_type == "regression":
        return regression_metrics(df, label, prediction, by=split)
    raise ValueError(f"unknown problem type {problem_type!r}")


def score_steps(df: DataFrame, label: str, score: str) -> DataFrame:
    """Per distinct score, high to low: positives and negatives here and so far.

    Rows are first counted per score, so only distinct scores are ordered.
    """
    positive = (quoted(label) == 1).cast("bigint")
    steps = (
        df.select(quoted(score).cast("double").alias("threshold"), positive.alias("__p"))
        .where("threshold IS NOT NULL AND __p IS NOT NULL")
        .groupBy("threshold")
        .agg(F.sum("__p").alias("positives"), (F.count(F.lit(1)) - F.sum("__p")).alias("negatives"))
    )
    return running_totals(
        steps, [F.col("threshold").desc()], {"tp": F.col("positives"), "fp": F.col("negatives")}
    )


def _with_totals(steps: DataFrame) -> DataFrame:
    totals = steps.agg(F.sum("positives").alias("all_pos"), F.sum("negatives").alias("all_neg"))
    return steps.withColumn("__k", F.lit(1)).join(
        F.broadcast(totals.withColumn("__k", F.lit(1))), "__k"
    ).drop("__k")


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """``(threshold, fpr, tpr)`` for a 0/1 label, one row per distinct score."""
    return _with_totals(score_steps(df, label, score)).select(
        "threshold",
        _ratio(F.col("fp"), F.col("all_neg")).alias("fpr"),
        _ratio(F.col("tp"), F.col("all_pos")).alias("tpr"),
    )


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve; equal scores count half."""
    steps = score_steps(df, label, score)
    area = F.sum(
        F.col("negatives").cast("double")
        * (F.col("tp") - F.col("positives") + F.col("positives") / 2)
    )
    return steps.agg(
        _ratio(area, F.sum("positives").cast("double") * F.sum("negatives")).alias("auc")
    )


def precision_recall_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """``(threshold, precision, recall)``, one row per distinct score."""
    return _with_totals(score_steps(df, label, score)).select(
        "threshold",
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("all_pos")).alias("recall"),
    )


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Precision weighted by the recall gained at each distinct score."""
    steps = score_steps(df, label, score)
    gained = F.sum(F.col("positives") * _ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    return steps.agg(_ratio(gained, F.sum("positives")).alias("average_precision"))


def actual_vs_predicted(
    df: DataFrame, key: Sequence[str], label: str, prediction: str, first: int | None = None
) -> DataFrame:
    """Key, label, prediction and residual of all rows, or of the first ones by key."""
    pairs = df.select(
        *[quoted(c) for c in key],
        quoted(label).alias("label"),
        quoted(prediction).alias("prediction"),
        (quoted(label) - quoted(prediction)).alias("residual"),
    )
    return pairs if first is None else pairs.orderBy(*[quoted(c) for c in key]).limit(first)
