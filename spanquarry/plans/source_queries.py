"""Queries through the OTLP reader and through Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import storage
from ..operators import folds, sampling, traces
from ..sources import checked
from ..sources.spans import otlp_rows
from ..streaming import live, sampler
from .base import TRACES, query, spans, uniform
from .window_queries import FOLDED, LOOKBACK, keep_sql, probabilities

#: Rows of a file of the live sampler's stream.
FILE_ROWS = 500_000
#: Milliseconds of a stretch of the live sampler.
STRETCH = 21_600_000


@query(f"WITH {TRACES} SELECT service, count(*) AS spans, count(DISTINCT trace_id) AS traces, sum(failed::INT)::BIGINT AS errors, min(start_us) * 1000 AS first_ns, max(start_us) * 1000 AS last_ns FROM sp GROUP BY service")
def otlp_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as OTLP lines (one for each trace), read back by the OTLP reader."""
    lines = otlp_lines(spans(spark, sf_dir)).select("value")
    return otlp_rows(lines).groupBy("service").agg(F.count("*").alias("spans"), F.count_distinct("trace_id").alias("traces"), F.count_if("failed").alias("errors"), F.min("start_ns").alias("first_ns"), F.max("start_ns").alias("last_ns"))


def otlp_lines(s: DataFrame) -> DataFrame:
    """trace_id, value: a line for each trace."""
    text = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.cast("string").alias("stringValue")).alias("value"))
    one = F.struct(F.col("trace_id").alias("traceId"), F.col("span_id").cast("string").alias("spanId"), (F.col("start_us") * 1000).cast("string").alias("startTimeUnixNano"), F.struct(F.when(F.col("failed"), "2").otherwise("0").alias("code")).alias("status"), F.array(text("service.name", F.col("service"))).alias("attributes"))
    return s.groupBy("trace_id").agg(F.collect_list(one).alias("spans")).select("trace_id", F.to_json(F.struct(F.array(F.struct(F.array(F.struct("spans")).alias("scopeSpans"))).alias("resourceSpans"))).alias("value"))


@query(f"""WITH {TRACES}, b AS (SELECT trace_id, count(*) AS n, {uniform("trace_id", "'bad'")} AS u FROM sp GROUP BY trace_id)
  SELECT 'accepted' AS reason, sum(n)::BIGINT AS n FROM b WHERE u >= 0.2 UNION ALL SELECT 'not JSON', count(*) FROM b WHERE u < 0.05 UNION ALL SELECT 'blank', count(*) FROM b WHERE u >= 0.05 AND u < 0.1
  UNION ALL SELECT 'no spans', count(*) FROM b WHERE u >= 0.1 AND u < 0.15 UNION ALL SELECT 'no trace id', sum(n)::BIGINT FROM b WHERE u >= 0.15 AND u < 0.2""")
def otlp_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as OTLP files of which a fifth of the lines is cut off, blank, without spans or without ids: what the
    checked reader takes, and what it rejects for which reason."""
    path = f"{storage.shared_dir(spark)}/otlp-{uuid.uuid4().hex}"
    u = S.hash_uniform(F.col("trace_id"), "bad")
    value = F.when(u < 0.05, F.substring("value", 1, 60)).when(u < 0.1, " ").when(u < 0.15, '{"resourceSpans": []}').when(u < 0.2, F.regexp_replace("value", '"traceId":"[^"]*"', '"traceId":""')).otherwise(F.col("value"))
    otlp_lines(spans(spark, sf_dir)).select(value.alias("value")).write.text(path)
    found = checked.otlp(spark, path)
    return found.rows.groupBy(F.lit("accepted").alias("reason")).agg(F.count("*").alias("n")).unionByName(found.rejects.groupBy("reason").agg(F.count("*").alias("n")))


@query(f"WITH {TRACES} SELECT sec // 3600 * 3600 AS start, service, count(*) AS n, sum(failed::INT)::BIGINT AS errors FROM sp GROUP BY 1, 2")
def stream_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bins of the events taken as a stream of files."""
    shared = storage.shared_dir(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    run = uuid.uuid4().hex
    return live.run_once(live.bins(traces.spans_of_events(events)), f"{shared}/bins-{run}", f"{shared}/state-{run}")


def sampler_rows(rows: DataFrame, seed: int) -> DataFrame:
    """What the live sampler takes of scored traces: tokens, probability, draws; all in one group."""
    draws = [S.hash_uniform(F.col("trace_id"), seed, k).alias(c) for k, c in enumerate(folds.DRAWS, 1)]
    alarm, tokens = (F.col("z") >= 3).alias("alarm"), sampling.tokens().alias("tokens")
    return rows.select(F.lit("all").alias("g"), "trace_id", "start_ns", "sec", tokens, F.col("p").alias("p_s"), "has_error", "incident", "near", alarm, *draws)


@query(f"{FOLDED}, {keep_sql('', 7)} SELECT trace_id, cluster, mass, kept FROM kf JOIN lc USING (i, trace_id)")
def live_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The traces as a stream of files in order of time, clustered and kept or not on Spark's state; a last row far behind
    them moves the watermark past all others. Each file is a range of time and a batch of its own: a batch that ran ahead
    of a file of the same time would make that one's rows late. The files hold blocks of traces, packed by all tasks, so
    writing them one after the other only copies. All traces are one group, so two partitions hold the state."""
    shared, run = storage.shared_dir(spark), uuid.uuid4().hex
    rows = storage.stored(sampler_rows(probabilities(spark, sf_dir), 7), "scored")
    high, n = rows.agg(F.max("sec"), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], "trace_id string, cluster long, mass long, kept boolean")
    parts, path = max(3, -(-n // FILE_ROWS)), f"{shared}/arriving-{run}"
    borders = F.array(*[F.lit(b) for b in sorted(set(rows.approxQuantile("sec", [k / parts for k in range(1, parts)], 0.1 / parts)))])
    dealt = rows.withColumn("_part", F.size(F.filter(borders, lambda b: b < F.col("sec")))).repartition(parts, "_part").sortWithinPartitions("_part", "start_ns")
    blocks = sampler.packed(dealt, ["_part", "g"], STRETCH)
    blocks.write.partitionBy("_part").parquet(f"{shared}/dealt-{run}")
    schema = blocks.drop("_part").schema
    for k in sorted(r._part for r in spark.read.parquet(f"{shared}/dealt-{run}").select("_part").distinct().collect()):  # one number a file
        spark.read.schema(schema).parquet(f"{shared}/dealt-{run}/_part={k}").coalesce(1).write.parquet(f"{path}/part={k:05}")
    last = rows.limit(1).withColumn("g", F.lit("end")).withColumn("start_ns", F.lit((high + 86_400) * 1_000_000_000))
    sampler.packed(last, ["g"], STRETCH).coalesce(1).write.parquet(f"{path}/part=end")
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    with sampler.rocks(spark, 2):
        found = live.run_once(sampler.sampled_blocks(arriving, "g", 0.025, LOOKBACK, stretch=STRETCH), f"{shared}/live-{run}", f"{shared}/state-{run}", "append")
    return found.select("trace_id", "cluster", "mass", "kept")
