"""What every fitted model offers: transform, save, load."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any, ClassVar

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import quoted, require_columns
from ..functions.state import read_state, write_state

VECTOR = "__features"


@dataclass
class ModelSpec:
    """What was asked for when the model was trained."""

    problem_type: str
    model_type: str
    features: list[str]
    label: str
    params: dict[str, Any]


class TabularModel:
    """A fitted model; ``transform`` adds ``prediction`` and, for some, ``probability``."""

    kind: ClassVar[str]
    kinds: ClassVar[dict[str, type[TabularModel]]] = {}

    def __init__(self, spec: ModelSpec) -> None:
        self.spec = spec

    def __init_subclass__(cls, **kwargs: Any) -> None:
        super().__init_subclass__(**kwargs)
        TabularModel.kinds[cls.kind] = cls

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def importances(self) -> list[float] | None:
        """Feature importances of tree models, in feature order."""
        return None

    def _state(self, spark: SparkSession, path: str) -> Any:
        """JSON-ready state; larger parts are written below ``path``."""
        return None

    @classmethod
    def _restore(cls, spark: SparkSession, path: str, spec: ModelSpec, state: Any) -> TabularModel:
        raise NotImplementedError

    def save(self, spark: SparkSession, path: str) -> str:
        state = self._state(spark, path)
        write_state(spark, f"{path}/spec", [self.kind, self.spec.__dict__, state])
        return path


def load_model(spark: SparkSession, path: str) -> TabularModel:
    """Load any saved model."""
    kind, spec, state = read_state(spark, f"{path}/spec")
    return TabularModel.kinds[kind]._restore(spark, path, ModelSpec(**spec), state)


def assembled(
    df: DataFrame, features: Sequence[str], label: str | None = None, weight: str | None = None
) -> DataFrame:
    """Only what a trainer reads: vector, label as double, weight."""
    require_columns(df, features)
    extra = []
    if label is not None:
        extra.append(quoted(label).cast("double").alias("__label"))
    if weight is not None:
        extra.append(quoted(weight).cast("double").alias("__weight"))
    # Plain names for the assembler, whatever characters the columns have.
    plain = df.select(*[quoted(c).alias(f"__f{i}") for i, c in enumerate(features)], *extra)
    inputs = [f"__f{i}" for i in range(len(features))]
    vector = VectorAssembler(inputCols=inputs, outputCol=VECTOR).transform(plain)
    return vector.drop(*inputs)


def with_vector(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The table plus its feature vector."""
    require_columns(df, features)
    inputs = [f"__f{i}" for i in range(len(features))]
    plain = df.withColumns({n: quoted(c) for n, c in zip(inputs, features)})
    return VectorAssembler(inputCols=inputs, outputCol=VECTOR).transform(plain).drop(*inputs)


class SparkModel(TabularModel):
    """A model fitted by ``pyspark.ml``: one stage, or one stage per class against the rest."""

    kind = "spark_ml"

    def __init__(self, spec: ModelSpec, *stages: Transformer, margin_scale: float | None = None) -> None:
        super().__init__(spec)
        self.stages = list(stages)
        self.margin_scale = margin_scale

    @property
    def stage(self) -> Transformer:
        return self.stages[0]

    def apply(self, data: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
        """Run the stages on a table with the feature vector; result columns by name.

        Several stages are compared by their margins with array functions, so scoring
        stays on the JVM (the built-in one-versus-rest model calls a Python function per row).
        """
        if len(self.stages) == 1:
            scored = self.stage.transform(data)
            out = {"prediction": F.col("__prediction")}
            if "__probability" in scored.columns:
                out["probability"] = vector_to_array("__probability")
            return scored, out
        for i, stage in enumerate(self.stages):
            names = {stage.rawPredictionCol: f"__raw{i}", stage.predictionCol: f"__class{i}"}
            if stage.hasParam("probabilityCol"):
                names[stage.probabilityCol] = ""
            data = stage.copy(names).transform(data)
        margins = F.array(*[F.get(vector_to_array(f"__raw{i}"), 1) for i in range(len(self.stages))])
        scored = data.withColumn("__margins", margins)
        best = F.array_position("__margins", F.array_max("__margins")) - 1
        out = {"prediction": best.cast("double")}
        if self.margin_scale is not None:
            # Margins as normalised logistic scores.
            odds = F.transform("__margins", lambda m: 1 / (1 + F.exp(-m * self.margin_scale)))
            total = F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)
            out["probability"] = F.transform(odds, lambda o: o / total)
        return scored, out

    def transform(self, df: DataFrame) -> DataFrame:
        scored, out = self.apply(with_vector(df, self.spec.features))
        kept = [quoted(c) for c in df.columns if c not in out]
        return scored.select(*kept, *[e.alias(n) for n, e in out.items()])

    def importances(self) -> list[float] | None:
        found = getattr(self.stage, "featureImportances", None) if len(self.stages) == 1 else None
        return None if found is None else [float(v) for v in found.toArray()]

    def _state(self, spark: SparkSession, path: str) -> Any:
        PipelineModel(self.stages).write().overwrite().save(f"{path}/stages")
        return self.margin_scale

    @classmethod
    def _restore(cls, spark, path, spec, state):
        return cls(spec, *PipelineModel.load(f"{path}/stages").stages, margin_scale=state)


def any_null(columns: Sequence[Column]) -> Column:
    """Whether any of the numeric columns is null or NaN."""
    # One predicate over an array: a chain of tests per column would be taken apart by the
    # optimizer into constraints on every one of them.
    return F.exists(F.array(*columns), lambda v: v.isNull() | F.isnan(v))


def refuse_nulls(df: DataFrame, features: Sequence[str], model: str) -> None:
    """Raise if a feature is null or NaN in any row, naming how many rows and which columns."""
    values = {c: quoted(c).cast("double") for c in features}
    row = df.agg(
        F.count_if(any_null(list(values.values()))).alias("rows"),
        *[F.count_if(v.isNull() | F.isnan(v)).alias(f"n{i}") for i, v in enumerate(values.values())],
    ).first()
    if row["rows"]:
        named = [c for i, c in enumerate(values) if row[f"n{i}"]]
        raise ValueError(f"{model} cannot train on nulls: {row['rows']} rows lack {named[:10]}; fill or drop them first")


def class_count(df: DataFrame, label: str) -> int:
    """Number of classes of a label coded 0..k-1."""
    top = df.agg(F.max(quoted(label)).alias("m")).first().m
    if top is None:
        raise ValueError("the label column holds only nulls")
    return int(top) + 1


def reject_unknown(params: Mapping[str, Any], known: Sequence[str], model: str) -> None:
    """Raise on parameters a model does not have."""
    extra = [p for p in params if p not in known]
    if extra:
        raise ValueError(f"{model} has no parameters {extra}; known: {sorted(known)}")
