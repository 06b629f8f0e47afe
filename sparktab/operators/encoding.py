"""Feature encoding: one-hot, ordinal, standardised and passed-through columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import data_type, is_numeric, quoted, require_columns
from ..functions.dictionary import Dictionary, fit_dictionaries
from ..functions.frequencies import distinct_lists
from ..functions.state import read_state, write_state
from ..session import local_table

MAX_ONEHOT = 10_000


@dataclass(frozen=True)
class ColumnRoles:
    """How each feature column is used, each list in feature order."""

    onehot: list[str] = field(default_factory=list)
    ordinal: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)


def classify_columns(
    df: DataFrame, features: Sequence[str], onehot: Sequence[str] = (), ordinal: Sequence[str] = ()
) -> ColumnRoles:
    """Roles of the feature columns; an all-null number counts as text.

    Encode lists are restricted to feature columns, and ordinal wins over one-hot.
    """
    return _roles_and_scaling(df, features, onehot, ordinal, False)[0]


def _roles_and_scaling(df, features, onehot, ordinal, standardise):
    """Roles, and mean and population deviation of the numbers, from one aggregate."""
    require_columns(df, features)
    ordinal = [c for c in ordinal if c in features]
    onehot = [c for c in onehot if c in features and c not in ordinal]
    rest = [c for c in features if c not in ordinal and c not in onehot]
    numbers = [c for c in rest if is_numeric(df, c)]
    scaling: dict[str, tuple[float, float]] = {}
    if numbers:
        wanted = {"n": F.count}
        if standardise:
            wanted |= {"m": F.avg, "s": F.stddev_pop}
        row = df.agg(
            *[f(quoted(c)).alias(f"{k}{i}") for i, c in enumerate(numbers) for k, f in wanted.items()]
        ).first()
        filled = [(i, c) for i, c in enumerate(numbers) if row[f"n{i}"] > 0]
        if standardise:
            scaling = {c: (float(row[f"m{i}"]), float(row[f"s{i}"]) or 1.0) for i, c in filled}
        numbers = [c for _, c in filled]
    return ColumnRoles(onehot, ordinal, numbers, [c for c in rest if c not in numbers]), scaling


def _name(value: Any) -> str:
    return "nan" if value is None else str(value)


@dataclass
class FeatureTransformer:
    """Fitted encoders; ``transform`` is one projection (plus joins for huge dictionaries).

    Output order is one-hot, ordinal, numeric. The raw columns are replaced, all other
    columns stay.
    """

    roles: ColumnRoles
    standardise: bool
    keep_numeric: bool
    categories: dict[str, list[Any]]
    dictionaries: dict[str, Dictionary]
    scaling: dict[str, tuple[float, float]]

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        features: Sequence[str],
        onehot: Sequence[str] = (),
        ordinal: Sequence[str] = (),
        standardise: bool = False,
        remainder: str = "passthrough",
    ) -> FeatureTransformer:
        """Learn categories, codes, means and deviations from ``df`` (usually the train part)."""
        if remainder not in ("passthrough", "drop"):
            raise ValueError("remainder must be 'passthrough' or 'drop'")
        roles, scaling = _roles_and_scaling(df, features, onehot, ordinal, standardise)
        keep_numeric = standardise or remainder == "passthrough"
        if not (roles.onehot or roles.ordinal or (roles.numeric and keep_numeric)):
            raise ValueError("no usable feature column is left")
        lists = distinct_lists(df, [*roles.onehot, *roles.ordinal], MAX_ONEHOT)
        categories: dict[str, list[Any]] = {}
        for c in roles.onehot:
            if lists[c] is None:
                raise ValueError(
                    f"{c} has more than {MAX_ONEHOT} categories, one column each; use ordinal codes"
                )
            values, has_nulls = lists[c]
            categories[c] = values + ([None] if has_nulls else [])
        return cls(
            roles, standardise, keep_numeric, categories,
            fit_dictionaries(df, roles.ordinal, MAX_ONEHOT, lists), scaling,
        )

    @property
    def output_columns(self) -> list[str]:
        names = [f"onehot__{c}_{_name(v)}" for c in self.roles.onehot for v in self.categories[c][1:]]
        names += [f"ordinal__{c}" for c in self.roles.ordinal]
        if self.keep_numeric:
            prefix = "numeric" if self.standardise else "numeric_passthrough"
            names += [f"{prefix}__{c}" for c in self.roles.numeric]
        return names

    def transform(self, df: DataFrame, keep_raw: bool = False) -> DataFrame:
        """Encode; an unseen one-hot category is all zeros, an unseen ordinal one is -1."""
        used = [*self.roles.onehot, *self.roles.ordinal, *self.roles.numeric]
        require_columns(df, used)
        others = list(df.columns) if keep_raw else [c for c in df.columns if c not in used]
        for c in self.roles.ordinal:
            df = self.dictionaries[c].encode(df, f"ordinal__{c}", unseen=-1)
        encoded = [
            F.when(quoted(c).eqNullSafe(F.lit(v).cast(data_type(df, c))), 1.0)
            .otherwise(0.0)
            .alias(f"onehot__{c}_{_name(v)}")
            for c in self.roles.onehot
            for v in self.categories[c][1:]
        ]
        encoded += [quoted(f"ordinal__{c}").cast("double").alias(f"ordinal__{c}") for c in self.roles.ordinal]
        for c in self.roles.numeric if self.keep_numeric else ():
            value = quoted(c).cast("double")
            if self.standardise:
                mean, std = self.scaling[c]
                encoded.append(((value - F.lit(mean)) / F.lit(std)).alias(f"numeric__{c}"))
            else:
                encoded.append(value.alias(f"numeric_passthrough__{c}"))
        return df.select(*[quoted(c) for c in others], *encoded)

    def encoding_map(self, spark: SparkSession) -> DataFrame:
        """``(column, category, target)``: target column, code, or the kind of number."""
        rows = [
            (c, _name(v), f"onehot__{c}_{_name(v)}")
            for c in self.roles.onehot
            for v in self.categories[c][1:]
        ]
        rows += [(c, None, "standardised" if self.standardise else "passthrough") for c in self.roles.numeric]
        rows += [(c, "UNKNOWN", "-1") for c in self.roles.ordinal]
        table = local_table(spark, rows, "column string, category string, target string")
        for c in self.roles.ordinal:
            codes = self.dictionaries[c].table
            table = table.unionByName(
                codes.select(
                    F.lit(c).alias("column"),
                    F.col("value").cast("string").alias("category"),
                    F.col("code").cast("string").alias("target"),
                )
            )
        return table

    def save(self, spark: SparkSession, path: str) -> None:
        """State as one JSON text, oversized dictionaries as Parquet beside it."""
        inline = {c: d for c, d in self.dictionaries.items() if d.values is not None}
        state = {
            "roles": self.roles.__dict__,
            "standardise": self.standardise,
            "keep_numeric": self.keep_numeric,
            "categories": self.categories,
            "dictionaries": {c: [d.type_name, d.values] for c, d in inline.items()},
            "large": {c: d.type_name for c, d in self.dictionaries.items() if d.values is None},
            "scaling": self.scaling,
        }
        write_state(spark, f"{path}/state", state)
        for i, c in enumerate(state["large"]):
            self.dictionaries[c].table.write.mode("overwrite").parquet(f"{path}/dictionary_{i}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureTransformer:
        state = read_state(spark, f"{path}/state")
        dictionaries = {
            c: Dictionary.from_values(spark, c, kind, values)
            for c, (kind, values) in state["dictionaries"].items()
        }
        for i, (c, kind) in enumerate(state["large"].items()):
            dictionaries[c] = Dictionary(c, kind, None, spark.read.parquet(f"{path}/dictionary_{i}"))
        return cls(
            ColumnRoles(**state["roles"]), state["standardise"], state["keep_numeric"],
            state["categories"], dictionaries,
            {c: tuple(v) for c, v in state["scaling"].items()},
        )


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Feature columns as one vector column; rows with a null feature are refused by Spark."""
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)


def fit_pca(df: DataFrame, columns: Sequence[str], k: int = 3, out: str = "pca") -> PipelineModel:
    """Centre the columns, then project on the first ``k`` principal directions."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(columns), outputCol="__raw"),
            StandardScaler(withMean=True, withStd=False, inputCol="__raw", outputCol="__centred"),
            PCA(k=k, inputCol="__centred", outputCol=out),
        ]
    ).fit(df)
