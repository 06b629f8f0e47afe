"""Shares and places within classes, for labels of any number of classes.

Sizes are shared over the classes by largest remainder on Spark: remainders are ranked by running
totals over a range-partitioned order of the classes. A row's place in its class is its place in
the order of all rows (class, then keys), found in the same way, less the rows of the classes
before. Nothing per class reaches the driver, and neither a class of a third of all rows nor
millions of small ones fill a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import quoted
from ..functions.joins import joined_by_share
from ..functions.ranking import running_totals
from ..session import cut_lineage


def shared_sizes(classes: DataFrame, size: str, total: int, out: str) -> DataFrame:
    """Add ``out``: each class's part of ``total`` by size, floors first, then largest remainders.

    Equal remainders go to the class that comes first, a null label being the last. Whole-number
    arithmetic, so no rounding can tip a remainder. ``classes`` holds ``label`` and sizes.
    """
    everything = classes.agg(F.sum(size).alias("n")).first().n or 0
    if not everything:
        return classes.withColumn(out, F.lit(0).cast("bigint"))
    product = F.col(size).cast("decimal(38,0)") * F.lit(int(total)).cast("decimal(19,0)")
    placed = classes.withColumn("__product", product)
    whole = F.expr(f"CAST(__product DIV CAST({everything} AS DECIMAL(19,0)) AS BIGINT)")
    left = F.expr(f"__product % CAST({everything} AS DECIMAL(19,0))")
    placed = cut_lineage(placed.withColumns({"__whole": whole, "__left": left}).drop("__product"))
    missing = total - (placed.agg(F.sum("__whole").alias("n")).first().n or 0)
    order = [F.col("__left").desc(), F.col("label").asc_nulls_last()]
    ranked = running_totals(placed, order, {"__nth": F.lit(1).cast("bigint")})
    return ranked.withColumn(out, F.col("__whole") + (F.col("__nth") <= missing).cast("bigint")).drop("__whole", "__left", "__nth")


def numbered_classes(df: DataFrame, label: str) -> DataFrame:
    """(label, n, base, code): rows of each class, rows of the classes before it, and its number from 0."""
    counts = df.groupBy(quoted(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("label").asc_nulls_last()]
    ranked = running_totals(counts, order, {"__upto": F.col("n"), "__nth": F.lit(1).cast("bigint")})
    return cut_lineage(
        ranked.select("label", "n", (F.col("__upto") - F.col("n")).alias("base"), (F.col("__nth") - 1).alias("code"))
    )


def placed_in_classes(df: DataFrame, label: str, classes: DataFrame, first_key: str, second_key: str) -> DataFrame:
    """The rows with the columns of their class under ``__c_`` names, and ``__place`` from 1 within it.

    ``classes`` comes from ``numbered_classes`` of the same rows, with any further columns.
    """
    order = [quoted(label).asc_nulls_last(), quoted(first_key).asc(), quoted(second_key).asc()]
    ordered = cut_lineage(running_totals(df, order, {"__nth": F.lit(1).cast("bigint")}))
    renamed = classes.select(F.col("label").alias(label), *[F.col(c).alias(f"__c_{c}") for c in classes.columns if c != "label"])
    joined = joined_by_share(ordered, renamed, [label], "__c_n")
    return joined.withColumn("__place", F.col("__nth") - F.col("__c_base")).drop("__nth")


def split_in_classes(df: DataFrame, label: str, test: int, val: int, first_key: str, second_key: str, out: str) -> DataFrame:
    """Add ``out``: the first rows of each class are its share of the test part, the next ones of the validation part."""
    classes = numbered_classes(df, label)
    n = classes.agg(F.sum("n").alias("n")).first().n or 0
    kept = shared_sizes(classes, "n", n - test, "kept")
    shared = cut_lineage(shared_sizes(kept, "kept", n - test - val, "train") if val else kept.withColumn("train", F.col("kept")))
    placed = placed_in_classes(df, label, shared, first_key, second_key)
    in_test = F.col("__c_n") - F.col("__c_kept")
    part = F.when(F.col("__place") <= in_test, "test").when(F.col("__place") <= F.col("__c_n") - F.col("__c_train"), "val")
    return placed.withColumn(out, part.otherwise("train")).select(*[quoted(c) for c in df.columns], out)


def folds_in_classes(df: DataFrame, label: str, folds: int, first_key: str, second_key: str, out: str) -> DataFrame:
    """Add ``out``: rows of each class dealt to the folds in turn, each class beginning at another fold."""
    placed = placed_in_classes(df, label, numbered_classes(df, label), first_key, second_key)
    fold = ((F.col("__place") - 1 + F.col("__c_code")) % folds).cast("int")
    return placed.withColumn(out, fold).select(*[quoted(c) for c in df.columns], out)
