"""Small fitted state as JSON text on any file system Spark can reach."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


def write_state(spark: SparkSession, path: str, state: Any) -> None:
    text = json.dumps(state, default=str, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_state(spark: SparkSession, path: str) -> Any:
    return json.loads(spark.read.text(path, wholetext=True).first().value)
