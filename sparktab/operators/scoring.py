"""Scoring new rows with fitted encoders, model and label codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import nan_to_null, quoted
from ..functions.dictionary import Dictionary
from ..functions.state import read_state, write_state
from ..models.base import TabularModel, load_model
from ..sources.readers import load_table
from .encoding import FeatureTransformer


@dataclass
class Scorer:
    """Everything needed to turn raw rows into predictions."""

    model: TabularModel
    encoder: FeatureTransformer | None = None
    codes: Dictionary | None = None

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``predict_result``, ``predict_proba`` if there is one, and ``predict_label``.

        One pass: the input columns are kept, nothing is gathered.
        """
        data = nan_to_null(df)
        encoded = self.encoder.transform(data, keep_raw=True) if self.encoder else data
        scored = self.model.transform(encoded)
        added = [F.col("prediction").alias("predict_result")]
        if "probability" in scored.columns:
            added.append(F.col("probability").alias("predict_proba"))
        out = scored.select(*[quoted(c) for c in df.columns], *added)
        if self.codes is None:
            return out
        return self.codes.decode(out, "predict_result", "predict_label")

    def score_file(self, spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
        """Score a file of any readable type."""
        return self.score(load_table(spark, path, schema))

    def score_rows(
        self, spark: SparkSession, rows: Sequence[Mapping[str, Any]], schema: T.StructType | str
    ) -> DataFrame:
        """Score a few rows given as dictionaries; a missing key is a null."""
        struct = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        tuples = [tuple(row.get(name) for name in struct.fieldNames()) for row in rows]
        return self.score(spark.createDataFrame(tuples, struct))

    def score_requests(
        self, requests: DataFrame, body: str, schema: T.StructType | str, keep: Sequence[str] = ()
    ) -> DataFrame:
        """Score a table of requests, each a JSON array of row objects in the column ``body``.

        One result row per given row, with the request's ``keep`` columns and the row's place
        in its request (``request_row``, from 0). A missing key is a null; a body that is no
        array of objects gives one row without values or prediction, its place null.
        """
        struct = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        parsed = F.from_json(quoted(body), T.ArrayType(struct), {"mode": "PERMISSIVE"})
        rows = requests.select(*[quoted(c) for c in keep], F.posexplode_outer(parsed).alias("request_row", "__given"))
        flat = rows.select(
            *[quoted(c) for c in keep],
            F.when(F.col("__given").isNotNull(), F.col("request_row")).alias("request_row"),
            *[F.col("__given")[name].alias(name) for name in struct.fieldNames()],
        )
        return self.score(flat)

    def save(self, spark: SparkSession, path: str) -> str:
        self.model.save(spark, f"{path}/model")
        if self.encoder:
            self.encoder.save(spark, f"{path}/encoder")
        if self.codes:
            self.codes.save(f"{path}/codes")
        write_state(spark, f"{path}/parts", [self.encoder is not None, self.codes is not None])
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Scorer:
        has_encoder, has_codes = read_state(spark, f"{path}/parts")
        return cls(
            load_model(spark, f"{path}/model"),
            FeatureTransformer.load(spark, f"{path}/encoder") if has_encoder else None,
            Dictionary.load(spark, f"{path}/codes") if has_codes else None,
        )
