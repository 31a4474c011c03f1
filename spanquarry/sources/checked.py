"""Readers that return what they could not use beside what they could, with the reason, and count both as the rows pass.

A file is read once: each record gets a reason (null: usable) in the same pass that parses it, and the tagged records are
stored, so rows and rejects come from one reading however often they are used.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import stored
from .spans import OTLP, SPAN_CSV, otlp_rows, rankings, span_rows, whole


@dataclasses.dataclass
class Read:
    """rows; rejects (file, reason, record: the record's first 1,000 characters); accepted and rejected records by count."""

    rows: DataFrame
    rejects: DataFrame
    accepted: int
    rejected: int


def _tagged(records: DataFrame, reason: Column, record: Column) -> tuple[DataFrame, DataFrame, int, int]:
    seen = Observation("records")
    tagged = records.withColumn("_reason", reason).withColumn("_record", F.substring(record, 1, 1000)).observe(seen, F.count("_reason").alias("bad"), F.count(F.lit(1)).alias("n"))
    table = stored(tagged, "checked")
    bad, n = seen.get["bad"], seen.get["n"]
    return table.where("_reason is null"), table.where("_reason is not null").select(F.col("_file").alias("file"), F.col("_reason").alias("reason"), F.col("_record").alias("record")), n - bad, bad


def otlp(spark: SparkSession, path: str) -> Read:
    """OTLP JSON lines. A line is rejected whole if it is blank, not JSON or without spans; a span without a trace id or start
    is rejected for itself, and the others of its line are taken."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("_file"))
    parsed = F.from_json("value", f"{OTLP}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    lines = lines.withColumn("_o", parsed)
    reason = F.when(F.trim("value") == "", "blank").when(F.col("_o._broken").isNotNull(), "not JSON").when(F.coalesce(F.size("_o.resourceSpans"), F.lit(0)) <= 0, "no spans")
    good, rejects, _, bad = _tagged(lines, reason, F.col("value"))
    spans = otlp_rows(good.select("value")).withColumn("_file", F.lit(None).cast("string"))
    reason = F.when(F.coalesce("trace_id", F.lit("")) == "", "no trace id").when(F.coalesce("start_ns", F.lit(0)) <= 0, "no start")
    rows, more, n, worse = _tagged(spans, reason, F.to_json(F.struct("trace_id", "span_id", "start_ns", "service")))
    return Read(rows.drop("_file", "_reason", "_record"), rejects.unionByName(more), n, bad + worse)


def span_csv(spark: SparkSession, path: str, duration_unit: str = "us") -> Read:
    """Spans of CSV files; rows with another number of fields, without a trace id or without a start are rejected."""
    raw = spark.read.csv(path, header=True, schema=f"{SPAN_CSV}, _broken string", columnNameOfCorruptRecord="_broken", mode="PERMISSIVE").select("*", F.col("_metadata.file_name").alias("_file"))
    reason = F.when(F.col("_broken").isNotNull(), "fields").when(F.coalesce(F.trim("TraceID"), F.lit("")) == "", "no trace id").when(F.coalesce(whole(F.col("StartTimeUnixNano")), F.lit(0)) <= 0, "no start")
    record = F.coalesce("_broken", F.concat_ws(",", *[c.split()[0] for c in SPAN_CSV.split(", ")]))
    good, rejects, n, bad = _tagged(raw, reason, record)
    return Read(span_rows(good.drop("_file", "_reason", "_record", "_broken"), duration_unit), rejects, n, bad)


def ranking_json(spark: SparkSession, path: str) -> Read:
    """Ranking files; those that are malformed or empty are rejected, not ranked."""
    found = rankings(spark, path).withColumn("_file", F.col("sid"))
    reason = F.when(F.col("status") != "ok", F.col("status"))
    good, rejects, n, bad = _tagged(found, reason, F.col("sid"))
    return Read(good.drop("_file", "_reason", "_record", "status"), rejects, n, bad)
