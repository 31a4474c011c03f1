"""Registration of queries, and the SQL that their counterparts start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import traces

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Traces, services and incidents as SQL.
TRACES = """
sp AS (SELECT user_id::VARCHAR || '-' || strftime(ts, '%Y-%m-%d') AS trace_id, event_id AS span_id, event_type AS service, epoch_us(ts) AS start_us,
  epoch_us(ts) // 1000000 AS sec, value AS weight, event_type = 'error' AS failed, props FROM events),
tp AS (SELECT trace_id, min(start_us) * 1000 AS start_ns, min(start_us) // 1000000 AS sec, (max(start_us) - min(start_us)) / 1000 AS duration_ms, count(*) AS span_count,
  bool_or(failed) AS has_error, arg_min(service, (start_us, span_id)) AS root_service, list_sort(list(DISTINCT service)) AS services,
  list(service ORDER BY start_us, span_id) AS seq, sum(weight) AS weight FROM sp GROUP BY trace_id)"""
INCIDENTS = """
hs AS (SELECT sec // 3600 AS h, service, count(*) AS n, sum(failed::INT) AS failed FROM sp GROUP BY 1, 2),
hw AS (SELECT h, sum(failed) AS failed, arg_min(service, ((failed > 0)::INT, -n, service)) AS cause FROM hs GROUP BY h),
hd AS (SELECT *, row_number() OVER (PARTITION BY h // 24 ORDER BY failed DESC, h) AS r FROM hw),
inc AS (SELECT 'scn-' || strftime(make_timestamp(h * 3600000000), '%Y%m%d') AS sid, h * 3600 AS st, h * 3600 + 3599 AS ed, cause AS service FROM hd WHERE r = 1)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def uniform(*parts: str) -> str:
    """SQL of scalars.hash_uniform."""
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.spans_of_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.trace_points(spans(spark, sf_dir))
