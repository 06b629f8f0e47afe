"""A folder of processed tables, splits, metadata, models, predictions and run logs."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime, timezone
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import quoted
from ..functions.state import read_state, write_state

REGISTRY_SCHEMA = "dataset_id string, kind string, id string, path string, created string, info string"
RUN_SCHEMA = (
    "dataset_id string, split_id string, model_type string, params string, metrics string, "
    "path string, trained_at string"
)
MIN_ROWS = 10


class Workspace:
    """Outputs below one root, listed in an append-only registry table."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    @staticmethod
    def _stamp() -> str:
        return datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")

    def _register(self, dataset_id: str, kind: str, name: str, path: str, info: Mapping[str, Any]) -> None:
        row = (dataset_id, kind, name, path, self._stamp(), json.dumps(info, default=str))
        self.spark.createDataFrame([row], REGISTRY_SCHEMA).coalesce(1).write.mode("append").parquet(
            f"{self.root}/registry"
        )

    def registry(self) -> DataFrame:
        """Everything written so far."""
        try:
            return self.spark.read.schema(REGISTRY_SCHEMA).parquet(f"{self.root}/registry")
        except AnalysisException:
            return self.spark.createDataFrame([], REGISTRY_SCHEMA)

    def _find(self, kind: str, dataset_id: str | None = None, name: str | None = None):
        found = self.registry().where(F.col("kind") == kind)
        if dataset_id is not None:
            found = found.where(F.col("dataset_id") == dataset_id)
        if name is not None:
            found = found.where(F.col("id") == name)
        row = found.orderBy(F.col("created").desc()).first()
        if row is None:
            raise FileNotFoundError(f"no {kind} for dataset {dataset_id!r}, id {name!r}")
        return row

    def write_processed(self, df: DataFrame, dataset_id: str, fmt: str = "parquet") -> str:
        """Write a cleaned table and return its id."""
        name = f"{dataset_id}_processed_{self._stamp()}"
        path = f"{self.root}/processed/{name}"
        if fmt == "csv":
            df.write.csv(path, header=True, escape='"')
        elif fmt == "parquet":
            df.write.parquet(path)
        else:
            raise ValueError("a cleaned table is written as parquet or csv")
        self._register(dataset_id, "processed", name, path, {"format": fmt, "columns": df.columns})
        return name

    def read_processed(self, dataset_id: str, processed_id: str | None = None) -> DataFrame:
        """A cleaned table by id, else the dataset's latest; too small tables are refused."""
        row = self._find("processed", dataset_id, processed_id)
        if json.loads(row.info)["format"] == "csv":
            from .readers import read_csv

            df = read_csv(self.spark, row.path)
        else:
            df = self.spark.read.parquet(row.path)
        rows = df.limit(MIN_ROWS).count()
        if rows == 0:
            raise ValueError(f"processed table {row.id} is empty")
        if rows < MIN_ROWS:
            raise ValueError(f"processed table {row.id} has under {MIN_ROWS} rows")
        return df

    def write_splits(self, df: DataFrame, dataset_id: str, split: str = "split") -> str:
        """Write one folder per split; an empty split leaves no folder."""
        name = f"{dataset_id}_split_{self._stamp()}"
        path = f"{self.root}/splits/{name}"
        df.write.partitionBy(split).parquet(path)
        self._register(dataset_id, "split", name, path, {"split_column": split, "columns": df.columns})
        return name

    def read_splits(self, split_id: str, part: str | None = None) -> DataFrame:
        """All splits, or one of them by partition pruning."""
        row = self._find("split", name=split_id)
        df = self.spark.read.parquet(row.path)
        column = json.loads(row.info)["split_column"]
        return df if part is None else df.where(quoted(column) == part)

    def write_metadata(self, split_id: str, metadata: Mapping[str, Any]) -> str:
        path = f"{self.root}/metadata/{split_id}"
        write_state(self.spark, path, dict(metadata))
        return path

    def read_metadata(self, split_id: str) -> dict[str, Any]:
        return read_state(self.spark, f"{self.root}/metadata/{split_id}")

    def write_predictions(self, df: DataFrame, dataset_id: str, fmt: str = "csv") -> str:
        """Input columns and results; arrays become JSON text in CSV."""
        name = f"{dataset_id}_predictions_{self._stamp()}"
        path = f"{self.root}/predictions/{name}"
        if fmt == "csv":
            flat = df.select(
                *[
                    F.to_json(quoted(c)).alias(c) if t.startswith(("array", "struct", "map")) else quoted(c)
                    for c, t in df.dtypes
                ]
            )
            flat.write.csv(path, header=True, escape='"')
        else:
            df.write.parquet(path)
        self._register(dataset_id, "predictions", name, path, {"format": fmt})
        return path

    def log_run(
        self, dataset_id: str, split_id: str, model_type: str, params: Mapping[str, Any],
        metrics: Mapping[str, Any], path: str,
    ) -> None:
        """Append one training run."""
        row = (
            dataset_id, split_id, model_type, json.dumps(params, default=str),
            json.dumps(metrics, default=str), path, self._stamp(),
        )
        self.spark.createDataFrame([row], RUN_SCHEMA).coalesce(1).write.mode("append").parquet(
            f"{self.root}/runs"
        )

    def runs(self, dataset_id: str | None = None) -> DataFrame:
        """The run log, oldest first."""
        try:
            log = self.spark.read.schema(RUN_SCHEMA).parquet(f"{self.root}/runs")
        except AnalysisException:
            return self.spark.createDataFrame([], RUN_SCHEMA)
        if dataset_id is not None:
            log = log.where(F.col("dataset_id") == dataset_id)
        return log.orderBy("trained_at")
