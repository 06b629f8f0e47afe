"""Session helpers shared by every module."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHECKPOINT_KEY = "spark.checkpoint.dir"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.

    The folder the cluster names in ``spark.checkpoint.dir`` is always used as is.
    Only a local master without that setting gets a fresh folder under /tmp; any
    other master must name a shared folder, because a machine-local one is lost
    together with its executor.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="sparktab-checkpoint-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small report table from driver-side values (one row per column, class, ...)."""
    struct = T.StructType.fromDDL(schema)
    names = struct.fieldNames()
    arrow_schema = to_arrow_schema(struct)
    arrays = [
        pa.array([row[i] for row in rows], type=arrow_schema.field(i).type)
        for i in range(len(names))
    ]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow_schema), schema=struct)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library has written, on whatever file system it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
