"""Structured Streaming forms of the windowed features: event-time bins with a watermark, and live traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def bins(spans: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and failures by event-time window and service; what is later than the watermark is left out."""
    rows = spans.withColumn("at", F.timestamp_micros("start_us")).withWatermark("at", late)
    out = rows.groupBy(F.window("at", width), "service").agg(F.count("*").alias("n"), F.count_if("failed").alias("errors"))
    return out.select(F.unix_seconds("window.start").alias("start"), "service", "n", "errors")


def sessions(spans: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Traces as sessions: a trace's spans until none comes for the gap; start_us, end_us, span_count, has_error."""
    rows = spans.withColumn("at", F.timestamp_micros("start_us")).withWatermark("at", late)
    out = rows.groupBy(F.session_window("at", gap), "trace_id").agg(F.min("start_us").alias("start_us"), F.max("start_us").alias("end_us"), F.count("*").alias("span_count"), F.max("failed").alias("has_error"))
    return out.select("trace_id", "start_us", "end_us", "span_count", "has_error")


def run_once(out: DataFrame, path: str, checkpoint: str, mode: str = "update") -> DataFrame:
    """Take in what there is and read the windows that the watermark has closed, and those still open (with mode
    ``append``, as sessions need it, the closed ones). Each batch writes what it updated under its number, so a batch that
    is run again replaces its own rows; a window's rows of later batches hold more, so the last one counts. State ends
    with the watermark; a restart goes on from the checkpoint."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    keys = [c for c in ("start", "service", "trace_id", "start_us") if c in out.columns]
    rows = out.sparkSession.read.schema(StructType([*out.schema.fields, StructField("batch", LongType())])).parquet(path)
    others = [c for c in out.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("last"))
    return last.select(*keys, "last.*").select(*out.columns)
