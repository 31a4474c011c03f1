"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a table is broadcast.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir if set. On a single machine a new local folder serves; on a cluster that would not be shared,
    so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: computed once, whatever is lost afterwards."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, to be broadcast if its rows of so many bytes are few enough; else left to a shuffled join."""
    return limited(df, df.count(), row_bytes)


def limited(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """The same for a number of rows that is known."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
