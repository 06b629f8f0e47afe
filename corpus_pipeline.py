"""From raw documents to token ids: five stages, each over all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.

1. quality: documents that the importance-resampling classifier rejects go.
2. exact: of equal texts the row with the largest doc_id stays.
3. near: of each group of linked SimHash fingerprints (3-word shingles, 3 bits) the document
   with the smallest doc_id stays.
4. decontaminate: documents that hold a 10-word window of a benchmark item go.
5. encode: texts become SentencePiece ids with an end id, checked by decoding.

Nulls count as empty texts throughout; an empty table stays empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparktab.llm.contamination import drop_contaminated
from sparktab.llm.exact import drop_copies
from sparktab.llm.pieces import encode_texts
from sparktab.llm.queries import piece_digests, piece_model, table
from sparktab.llm.resampling import keep_good
from sparktab.llm.simhash import keep_one_each
from sparktab.session import ensure_checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"), "doc_id", "text")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs, "doc_id", "text")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_each(docs, "doc_id", "text", width=3, distance=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), "doc_id", "text")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = encode_texts(docs, "doc_id", "text", piece_model())
    return piece_digests(encoded, F.col("ids"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("exact", exact),
    ("near", near),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: The classifier, fingerprints and ids are beyond SQL; tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; stages meet in the session's shared folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
