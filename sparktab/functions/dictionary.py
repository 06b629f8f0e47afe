"""Sorted value-to-code dictionaries of any size."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage, local_table
from .columns import data_type, quoted
from .frequencies import distinct_lists
from .ranking import ranked_dictionary
from .state import read_state, write_state

INLINE_LIMIT = 256
BROADCAST_LIMIT = 10_000
HOT_SHARE = 0.001
SPREAD = 1000
JSON_TYPES = ("string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double")


@dataclass
class Dictionary:
    """Codes 0..k-1 for the sorted distinct values of one column.

    Up to ``INLINE_LIMIT`` values the lookup is a literal array inside the projection,
    up to ``BROADCAST_LIMIT`` a broadcast join, beyond that a shuffle join against a
    dictionary that never leaves the executors.
    """

    column: str
    type_name: str
    values: list[Any] | None
    table: DataFrame

    @classmethod
    def from_values(cls, spark, column: str, type_name: str, values: Sequence[Any]) -> Dictionary:
        if type_name not in JSON_TYPES and any(isinstance(v, str) for v in values):
            # Dates and the like come back from saved state as text.
            texts = local_table(spark, [(str(v), i) for i, v in enumerate(values)], "v string, i bigint")
            values = [r.v for r in texts.select(F.col("v").cast(type_name), "i").orderBy("i").collect()]
        rows = [(v, i) for i, v in enumerate(values)]
        table = local_table(spark, rows, f"value {type_name}, code bigint")
        return cls(column, type_name, list(values), table)

    @classmethod
    def fit(cls, df: DataFrame, column: str, limit: int = BROADCAST_LIMIT) -> Dictionary:
        return fit_dictionaries(df, [column], limit)[column]

    @property
    def size(self) -> int:
        return len(self.values) if self.values is not None else self.table.count()

    def encode(self, df: DataFrame, out: str, unseen: int | None = None) -> DataFrame:
        """Add ``out`` as bigint: code, ``unseen`` for an unknown value, null for null."""
        value = quoted(self.column)
        if self.values is not None and len(self.values) <= INLINE_LIMIT:
            spot = F.array_position(self._literal(), value)
            code = F.when(spot > 0, spot - 1).otherwise(F.lit(unseen).cast("bigint"))
            return df.withColumn(out, F.when(value.isNotNull(), code))
        joined = self._looked_up(df, value, "value", "code")
        code = F.col("__found")
        if unseen is not None:
            code = F.when(value.isNotNull(), F.coalesce(code, F.lit(unseen)))
        return joined.withColumn(out, code).drop("__found")

    def decode(self, df: DataFrame, code_column: str, out: str) -> DataFrame:
        """Add ``out`` as text: the value behind a code, or the code itself if unknown."""
        code = quoted(code_column)
        fallback = code.cast("string")
        if self.values is not None and len(self.values) <= INLINE_LIMIT:
            found = F.get(self._literal(), code.cast("int")).cast("string")
            whole = code == F.floor(code)
            return df.withColumn(out, F.coalesce(F.when(whole & (code >= 0), found), fallback))
        joined = self._looked_up(df, code, "code", "value")
        return joined.withColumn(out, F.coalesce(F.col("__found").cast("string"), fallback)).drop("__found")

    def _looked_up(self, df: DataFrame, key: Column, given: str, wanted: str) -> DataFrame:
        """Add ``__found``: the ``wanted`` side of the dictionary for each key.

        In an oversized dictionary the values that hold more than a thousandth of the rows
        (so at most a thousand) are looked up by broadcast; in the shuffle join their rows
        carry no key and are spread by a hash of the row, so no value fills a task; so are the
        rows without a value. Frequent values that the dictionary lacks are found in the table
        itself and spread as well.
        """
        pairs = self.table.select(F.col(given).alias("__key"), F.col(wanted).alias("__found"))
        if self.values is not None:
            return df.join(F.broadcast(pairs), key == F.col("__key"), "left").drop("__key")
        hot = self.table.where(F.col("share") > HOT_SHARE).select(
            F.col(given).alias("__hot_key"), F.col(wanted).alias("__hot")
        )
        unseen = _frequent(df, key).join(pairs.select("__key"), F.col("__often") == F.col("__key"), "left_anti")
        unseen = cut_lineage(unseen.withColumn("__lacking", F.lit(True)))  # at most 1 / HOT_SHARE rows
        spread = F.pmod(F.xxhash64(*[quoted(c) for c in df.columns]), F.lit(SPREAD)) + 1
        marked = df.join(F.broadcast(hot), key == F.col("__hot_key"), "left").join(
            F.broadcast(unseen), key == F.col("__often"), "left"
        )
        looked_up = F.col("__hot").isNull() & F.col("__lacking").isNull() & key.isNotNull()
        marked = marked.withColumns(
            {"__own": F.when(looked_up, key), "__spot": F.when(looked_up, F.lit(0)).otherwise(spread)}
        )
        joined = marked.join(
            # Always 0, but not a constant that the optimizer would take out of the join key.
            pairs.withColumn("__zero", F.pmod(F.xxhash64("__key"), F.lit(1))),
            (F.col("__own") == F.col("__key")) & (F.col("__spot") == F.col("__zero")),
            "left",
        )
        return joined.withColumn("__found", F.coalesce("__hot", "__found")).drop(
            "__hot_key", "__hot", "__own", "__spot", "__key", "__zero", "__often", "__lacking"
        )

    def save(self, path: str) -> None:
        spark = self.table.sparkSession
        write_state(spark, f"{path}/state", [self.column, self.type_name, self.values])
        if self.values is None:
            self.table.write.mode("overwrite").parquet(f"{path}/table")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Dictionary:
        column, type_name, values = read_state(spark, f"{path}/state")
        if values is None:
            return cls(column, type_name, None, spark.read.parquet(f"{path}/table"))
        return cls.from_values(spark, column, type_name, values)

    def _literal(self) -> Column:
        return F.array(*[F.lit(v) for v in self.values]).cast(f"array<{self.type_name}>")


def _frequent(df: DataFrame, key: Column) -> DataFrame:
    """``__often``: a superset of the keys that hold more than HOT_SHARE of the rows."""
    keys = df.select(key.alias("__often")).where("__often IS NOT NULL")
    return keys.freqItems(["__often"], HOT_SHARE).select(F.explode("__often_freqItems").alias("__often"))


def fit_dictionaries(
    df: DataFrame, columns: Sequence[str], limit: int = BROADCAST_LIMIT, lists: dict | None = None
) -> dict[str, Dictionary]:
    """Dictionaries of several columns from one scan (plus one per oversized column).

    ``lists`` reuses distinct lists already found.
    """
    lists = distinct_lists(df, columns, limit) if lists is None else lists
    out = {}
    for c in columns:
        type_name = data_type(df, c).simpleString()
        if lists[c] is not None:
            out[c] = Dictionary.from_values(df.sparkSession, c, type_name, lists[c][0])
        else:
            out[c] = Dictionary(c, type_name, None, ranked_dictionary(df, c))
    return out
