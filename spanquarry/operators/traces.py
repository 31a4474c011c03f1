"""From spans to traces: one row per trace, its path, and the incidents it falls into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import bounded, stored


def spans_of_events(events: DataFrame) -> DataFrame:
    """Events as spans: a user's day is a trace, an event a span, its type the service, its value the span's weight."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("trace_id"), F.col("event_id").alias("span_id"),
        F.col("event_type").alias("service"), at.alias("start_us"), F.floor(at / 1_000_000).cast("long").alias("sec"), F.col("value").alias("weight"), (F.col("event_type") == "error").alias("failed"), "props",
    )


def trace_points(spans: DataFrame, longest_path: int = 12) -> DataFrame:
    """One row per trace. Ties in time go by span id; a trace that holds a failed span has an error.

    The only shuffle is by trace; times, counts and flags are combined before it.
    """
    seq = F.array_sort(F.collect_list(F.struct("start_us", "span_id", "service")))
    rows = spans.groupBy("trace_id").agg(
        F.min("start_us").alias("start_us"), F.max("start_us").alias("end_us"), F.count("*").alias("span_count"), F.max("failed").alias("has_error"),
        F.array_sort(F.collect_set("service")).alias("services"), F.transform(seq, lambda s: s["service"]).alias("seq"), F.sum("weight").alias("weight"),
    )
    runs = F.filter("seq", lambda s, i: (i == 0) | (s != F.get("seq", i - 1)))
    return rows.select(
        "trace_id", (F.col("start_us") * 1000).alias("start_ns"), F.floor(F.col("start_us") / 1_000_000).cast("long").alias("sec"), ((F.col("end_us") - F.col("start_us")) / 1000).alias("duration_ms"),
        "span_count", "has_error", F.get("seq", F.lit(0)).alias("root_service"), "services", F.slice(runs, 1, longest_path).alias("service_path"), "weight",
    )


def incidents(spans: DataFrame) -> DataFrame:
    """Incident windows found in the data: of each day the hour with most failed spans (the earliest of equals), and as
    cause the service with most other spans in it. sid, st, ed (inclusive seconds), service."""
    hours = spans.withColumn("h", F.floor(F.col("sec") / 3600).cast("long"))
    counts = hours.groupBy("h", "service").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("failed"))
    whole = counts.groupBy("h").agg(F.sum("failed").alias("failed"), F.min_by("service", F.struct(F.when(F.col("failed") > 0, 1).otherwise(0), -F.col("n"), "service")).alias("cause"))
    day = Window.partitionBy("d").orderBy(F.desc("failed"), "h")
    top = whole.withColumn("d", F.floor(F.col("h") / 24)).withColumn("r", F.row_number().over(day)).where("r = 1")
    sid = F.concat(F.lit("scn-"), F.date_format(F.timestamp_seconds(F.col("h") * 3600), "yyyyMMdd"))
    return top.select(sid.alias("sid"), (F.col("h") * 3600).alias("st"), (F.col("h") * 3600 + 3599).alias("ed"), F.col("cause").alias("service"))


def by_slots(low: Column, high: Column, width: int) -> Column:
    """The numbers of the time slots that an interval touches."""
    return F.sequence(F.floor(low / width), F.floor(high / width))


def label_errors(points: DataFrame, windows: DataFrame, width: int = 3600) -> DataFrame:
    """trace_id of traces that overlap a window and touch its service: an equi-join on (service, time slot), then the
    overlap test, so it stays a hash join however many windows there are."""
    end = F.col("sec") + F.ceil(F.col("duration_ms") / 1000).cast("long")
    left = points.select("trace_id", "sec", end.alias("end"), F.explode("services").alias("service")).withColumn("slot", F.explode(by_slots(F.col("sec"), F.col("end"), width)))
    right = windows.select("service", "st", "ed", F.explode(by_slots(F.col("st"), F.col("ed"), width)).alias("slot"))
    return left.join(right, ["service", "slot"]).where("sec <= ed and end >= st").select("trace_id").distinct()


def membership(points: DataFrame, windows: DataFrame, width: int = 3600) -> DataFrame:
    """trace_id, sids: the windows that hold the trace's start."""
    right = windows.select("sid", "st", "ed", F.explode(by_slots(F.col("st"), F.col("ed"), width)).alias("slot"))
    left = points.select("trace_id", "sec", F.floor(F.col("sec") / width).alias("slot"))
    return left.join(right, "slot").where("sec between st and ed").groupBy("trace_id").agg(F.array_sort(F.collect_set("sid")).alias("sids"))


def intervals(metrics: DataFrame, lookback: int, width: int = 3600) -> DataFrame:
    """service, slot, until, m (m_sec and the other columns) of metric rows (service, sec, ...): each row for the time slots
    of the stretch, m_sec to until, in which it is the latest of its service and at most lookback seconds old. The stretches
    of a service don't overlap; of several rows of a second the largest counts."""
    others = [c for c in metrics.columns if c not in ("service", "sec")]
    rows = metrics.groupBy("service", F.col("sec").alias("_sec")).agg(F.max(F.struct(F.col("sec").alias("m_sec"), *others)).alias("m"))
    following = F.lead("_sec").over(Window.partitionBy("service").orderBy("_sec"))
    rows = rows.withColumn("until", F.least(following - 1, F.col("_sec") + lookback))  # the last has none after it
    return rows.select("service", F.explode(by_slots(F.col("_sec"), F.col("until"), width)).alias("slot"), "until", "m")


def as_of(points: DataFrame, metrics: DataFrame, lookback: int, width: int = 3600) -> DataFrame:
    """points (trace_id, sec, service) with the latest metric row of the service at or before sec, at most lookback
    seconds old; null if there is none. An equi-join on (service, time slot) with the stretches in which rows are the
    latest, of which one at most fits, so nothing is grouped after it."""
    spread = stored(intervals(metrics, lookback, width).withColumnRenamed("service", "_service").withColumnRenamed("slot", "_slot"), "as_of")
    here = (F.col("service") == F.col("_service")) & (F.floor(F.col("sec") / width) == F.col("_slot")) & F.col("sec").between(F.col("m.m_sec"), F.col("until"))
    return points.join(bounded(spread, 128), here, "left").select("trace_id", "sec", "service", "m.*")
