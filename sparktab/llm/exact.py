"""Exact deduplication: frequent digests apart, all others through one ordinary shuffle.

Misra-Gries counting (``freqItems``) names every digest that holds more than ``support`` of
the rows, at most ``1 / support`` of them. An exact recount verifies them and finds the row
that stays; those few winners are broadcast, so the copies of a hot text are settled where
they are read. What is left has no group above ``support`` of the rows and is grouped and
joined on its digest. Everything runs on built-in functions.

Texts are equal when their SHA-256 is; a null text equals an empty one. Of equal texts the
row with the largest id stays, a null id being the smallest. Of rows that also share the id,
one stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.columns import quoted
from ..session import cut_lineage
from .common import text_of

#: Share of all rows above which a digest is certain to be found by the frequent-item pass.
SUPPORT = 0.001


def digest_of(text_column: str) -> Column:
    return F.sha2(text_of(text_column), 256)


def frequent_winners(rows: DataFrame, rank: Column, support: float = SUPPORT) -> DataFrame:
    """digest, keep, group_size of the frequent digests: at most 1/support rows, counted exactly."""
    frequent = rows.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    chosen = rows.join(F.broadcast(cut_lineage(frequent)), "digest", "left_semi")
    counted = chosen.groupBy("digest").agg(F.max(rank).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    return cut_lineage(counted.where("group_size > 1"))


def decide_copies(docs: DataFrame, id_column: str, text_column: str, support: float = SUPPORT) -> DataFrame:
    """One row per input row: its id, keep_id, group_size, kept and text_sha256.

    The slim (id, digest, row number) table is written once, so that both sides of the
    later joins see the same row numbers; texts are read once and never shuffled.
    """
    slim = docs.select(quoted(id_column).alias("id"), digest_of(text_column).alias("digest"))
    rows = cut_lineage(slim.withColumn("row", F.monotonically_increasing_id()))
    rank = F.struct("id", "row")
    winners = frequent_winners(rows, rank, support)
    hot = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.max(rank).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    settled = hot.unionByName(rest.join(groups, "digest"))
    return settled.select(
        F.col("id").alias(id_column),
        F.col("keep.id").alias("keep_id"),
        F.col("group_size").cast("bigint").alias("group_size"),
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_column: str, text_column: str, support: float = SUPPORT) -> DataFrame:
    """The rows that stay, with all their columns (which must be of comparable types).

    Rows that agree in every column cannot be told apart; one of them stays.
    """
    names = docs.columns
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own_id, own_text = (f"c{names.index(c)}" for c in (id_column, text_column))
    others = F.xxhash64(*[F.col(c).cast("string") for c in numbered.columns])
    rows = numbered.withColumns(
        {"digest": digest_of(own_text), "rank": F.struct(F.col(own_id).alias("id"), others.alias("other"))}
    )
    slim = rows.select("digest", "rank")
    winners = frequent_winners(slim, F.col("rank"), support)
    same = F.col("rank") == F.col("keep")
    hot = rows.join(F.broadcast(winners), "digest").where(same).drop("group_size").dropDuplicates()
    rest = rows.join(F.broadcast(winners), "digest", "left_anti")
    keep = slim.join(F.broadcast(winners), "digest", "left_anti").groupBy("digest").agg(F.max("rank").alias("keep"))
    first = F.row_number().over(Window.partitionBy("digest").orderBy("rank"))
    single = rest.join(keep, "digest").where(same).withColumn("nth", first).where("nth = 1").drop("nth")
    kept = hot.unionByName(single)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
