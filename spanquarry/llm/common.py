"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words: space and the five ASCII controls from tab to carriage return.
BLANKS = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir if set, else the context's checkpoint folder. On a single
    machine (tests) a new local one serves; on a cluster that would not be shared, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: columnar, compressed, prunable."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes up to which a table is broadcast.
BROADCAST_BYTES = 64 << 20


def bounded(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, to be broadcast if its rows of so many bytes are few enough; else left to a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def crc32_mod(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def lowest_share(h: Column, share: float) -> Column:
    """Whether a 64-bit hash is among the lowest such share of all hashes, however small the share is."""
    return F.lit(True) if share >= 1 else h < F.lit(-(2**63) + int(share * 2**64))


#: Rows in an Arrow batch of texts, which are some kilobytes each and now and then far longer.
BATCH_ROWS = 1000


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches small enough for texts: the session's limit of rows is lowered to
    BATCH_ROWS, as Arrow's buffers are outside the executor's heap and beside its Python workers."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return df.mapInArrow(run, schema)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few texts are Python objects at once. At the end the worker, which lives on
    beside its executor's JVM, hands free memory back."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
    give_back()


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
