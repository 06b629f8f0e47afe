"""One-hot encoding of columns with any number of categories, as positions or sparse vectors.

Each category has a position; the first one of a column in sorted order is dropped, and null, if
it occurs, is a column's last category. A row's result is the short list of positions that hold a
one (``positions``), or a sparse vector of them. Dictionaries of any size are looked up as in
``functions.dictionary``: as a literal, by broadcast, or by a shuffle join in which frequent values
are spread.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import quoted, require_columns
from ..functions.dictionary import Dictionary, fit_dictionaries
from ..functions.state import read_state, write_state
from ..session import local_table


@dataclass
class SparseOneHot:
    """Fitted dictionaries, the number of categories of each column and whether null is one."""

    columns: list[str]
    dictionaries: dict[str, Dictionary]
    sizes: dict[str, int]
    nulls: dict[str, bool]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> SparseOneHot:
        """Learn the categories of the columns; a column without any value has none but null."""
        columns = list(columns)
        require_columns(df, columns)
        dictionaries = fit_dictionaries(df, columns)
        row = df.agg(*[F.count_if(quoted(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)]).first()
        nulls = {c: row[f"n{i}"] > 0 for i, c in enumerate(columns)}
        sizes = {
            c: (len(d.values) if d.values is not None else d.table.count()) + nulls[c] for c, d in dictionaries.items()
        }
        return cls(columns, dictionaries, sizes, nulls)

    def width(self, column: str) -> int:
        """Positions of a column: one for each category but the first."""
        return max(self.sizes[column] - 1, 0)

    @property
    def total(self) -> int:
        return sum(self.width(c) for c in self.columns)

    def _spots(self, df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
        """Per column its position within the column, null for the first and for unseen categories."""
        spots = {}
        for i, c in enumerate(self.columns):
            df = self.dictionaries[c].encode(df, f"__code{i}", unseen=-1)
            code = F.col(f"__code{i}")
            null_code = F.lit(self.sizes[c] - 1 if self.nulls[c] else -1)
            code = F.when(quoted(c).isNull(), null_code).otherwise(code)
            spots[c] = F.when(code >= 1, code - 1)
        return df, spots

    def positions(self, df: DataFrame, out: str = "positions") -> DataFrame:
        """Add the sorted positions that hold a one, as ``array<bigint>``."""
        require_columns(df, self.columns)
        names = [c for c in df.columns if c != out]
        coded, spots = self._spots(df)
        offset, found = 0, []
        for c in self.columns:
            found.append(spots[c].cast("bigint") + F.lit(offset).cast("bigint"))
            offset += self.width(c)
        return coded.select(*[quoted(c) for c in names], F.array_compact(F.array(*found)).alias(out))

    def vectors(self, df: DataFrame, out: str = "features") -> DataFrame:
        """Add one sparse vector over all columns, as ``pyspark.ml`` takes it."""
        require_columns(df, self.columns)
        names = [c for c in df.columns if c != out]
        coded, spots = self._spots(df)
        used = [c for c in self.columns if self.width(c)]
        if not used:
            raise ValueError("no column has two categories")
        # The encoder drops the last of its categories; the first of ours and unseen ones stand for it.
        indices = {f"__i{i}": F.coalesce(spots[c], F.lit(self.width(c))).cast("double") for i, c in enumerate(used)}
        coded = coded.withColumns(indices)
        encoder = OneHotEncoder(inputCols=list(indices), outputCols=[f"__v{i}" for i in range(len(used))], dropLast=True)
        largest = local_table(df.sparkSession, [tuple(float(self.width(c)) for c in used)], ", ".join(f"{n} double" for n in indices))
        joined = VectorAssembler(inputCols=[f"__v{i}" for i in range(len(used))], outputCol="__vector")
        made = joined.transform(encoder.fit(largest).transform(coded))
        return made.select(*[quoted(c) for c in names], F.col("__vector").alias(out))

    def categories(self, spark: SparkSession) -> DataFrame:
        """(column, category, position) of every position."""
        offset, parts = 0, None
        for c in self.columns:
            own = self.dictionaries[c].table.where("code >= 1").select(
                F.lit(c).alias("column"), F.col("value").cast("string").alias("category"), (F.col("code") - 1 + offset).alias("position")
            )
            if self.nulls[c] and self.sizes[c] > 1:
                last = local_table(spark, [(c, None, offset + self.sizes[c] - 2)], "column string, category string, position bigint")
                own = own.unionByName(last)
            parts = own if parts is None else parts.unionByName(own)
            offset += self.width(c)
        return parts

    def save(self, spark: SparkSession, path: str) -> None:
        write_state(spark, f"{path}/state", [self.columns, self.sizes, self.nulls])
        for i, c in enumerate(self.columns):
            self.dictionaries[c].save(f"{path}/dictionary_{i}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SparseOneHot:
        columns, sizes, nulls = read_state(spark, f"{path}/state")
        found = {c: Dictionary.load(spark, f"{path}/dictionary_{i}") for i, c in enumerate(columns)}
        return cls(columns, found, sizes, nulls)
