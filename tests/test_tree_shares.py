"""Training rows of trees lie in partitions of bounded size."""

from pyspark.sql import functions as F

from sparktab.models import registry, trees
from sparktab.models.base import assembled


def rows_of(spark, n):
    return spark.range(n).coalesce(1).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).alias("y"))


def sizes(data):
    return [r.n for r in data.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]


def test_many_rows_of_one_partition_are_dealt_out(spark, monkeypatch):
    data = assembled(rows_of(spark, 1000), ["a"], "y")
    monkeypatch.setattr(trees, "TASK_BYTES", 100 * (trees.ROW_BYTES + 4 * 20 + 8))
    with trees.kept_in_shares(data, 1, 20) as rows:
        found = sizes(rows)
        assert len(found) == 10 and max(found) <= 110 and rows.exceptAll(data).isEmpty() and sum(found) == 1000
    with trees.kept_in_shares(data.limit(0), 1, 20) as rows:
        assert rows.count() == 0


def test_few_rows_stay_where_they_are(spark):
    data = assembled(rows_of(spark, 1000), ["a"], "y")
    with trees.kept_in_shares(data, 1, 20) as rows:
        assert sizes(rows) == [1000]


def test_every_tree_trainer_reads_bounded_partitions(spark, monkeypatch):
    monkeypatch.setattr(trees, "TASK_BYTES", 40 * (trees.ROW_BYTES + 8 * 2))
    read = []

    class Seen:
        def fit(self, data):
            read.append(max(sizes(data)))

    trees._fit(Seen(), assembled(rows_of(spark, 300), ["a"], "y"), 2)
    assert read[0] <= 44
    for kind in ("random_forest", "decision_tree", "gboost"):
        model = registry.train(rows_of(spark, 300), "classification", kind, ["a"], "y", {"max_depth": 2} | ({} if kind == "decision_tree" else {"n_estimators": 2}))
        assert model.transform(rows_of(spark, 300)).where("prediction IS NOT NULL").count() == 300
