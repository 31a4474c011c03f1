"""Queries over traces: summaries, labels, retention, quantiles, naming, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ordering, retention, traces
from .base import INCIDENTS, TRACES, points, query, spans, uniform

KEPT = f"kept AS (SELECT trace_id FROM tp WHERE {uniform('trace_id', chr(39) + 'keep' + chr(39))} < 0.3)"


def kept(tp: DataFrame) -> DataFrame:
    return tp.where(S.hash_uniform(F.col("trace_id"), "keep") < 0.3).select("trace_id")


@query(f"WITH {TRACES} SELECT trace_id, start_ns, round(duration_ms, 6) AS duration_ms, span_count, has_error, root_service, array_to_string(services, '|') AS services FROM tp")
def trace_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("trace_id", "start_ns", S.sixth(F.col("duration_ms")).alias("duration_ms"), "span_count", "has_error", "root_service", F.array_join("services", "|").alias("services"))


@query(f"WITH {TRACES} SELECT trace_id, array_to_string(list_filter(seq, lambda x, i: i = 1 OR x <> seq[i - 1])[1:12], '>') AS path FROM tp")
def trace_service_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("trace_id", F.array_join("service_path", ">").alias("path"))


@query(f"WITH {TRACES}, {INCIDENTS} SELECT * FROM inc")
def incident_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.incidents(spans(spark, sf_dir))


@query(f"""WITH {TRACES}, {INCIDENTS} SELECT DISTINCT trace_id FROM tp, inc
  WHERE sec <= ed AND sec + ceil(duration_ms / 1000)::BIGINT >= st AND list_contains(services, inc.service)""")
def label_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.label_errors(points(spark, sf_dir), traces.incidents(spans(spark, sf_dir)))


@query(f"WITH {TRACES}, {INCIDENTS} SELECT trace_id, string_agg(sid, '|' ORDER BY sid) AS sids FROM tp JOIN inc ON sec BETWEEN st AND ed GROUP BY trace_id")
def scenario_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.membership(points(spark, sf_dir), traces.incidents(spans(spark, sf_dir))).select("trace_id", F.array_join("sids", "|").alias("sids"))


PODS = """pods AS (SELECT DISTINCT CASE user_id % 3 WHEN 0 THEN event_type || '-' || substr(md5(user_id::VARCHAR), 1, 9) || '-' || substr(md5(user_id::VARCHAR), 10, 5)
  WHEN 1 THEN event_type || '_Svc-' || substr(md5(user_id::VARCHAR), 1, 5) ELSE 'ts-' || event_type || '-service' END AS pod FROM events)"""


@query(f"""WITH {PODS}, n AS (SELECT pod, regexp_replace(lower(trim(pod)), '_', '-', 'g') AS a FROM pods), m AS (SELECT *, regexp_replace(regexp_replace(a, '[^a-z0-9-]', '', 'g'), '-+', '-', 'g') AS b FROM n)
  SELECT pod, regexp_replace(pod, '-[^-]*-[^-]*$', '') AS drop_two, regexp_replace(a, '-[a-z0-9]{{5,20}}-[a-z0-9]{{5,20}}$', '') AS drop_hashes,
  CASE WHEN regexp_replace(b, '-[a-f0-9]{{8,10}}-[a-z0-9]{{5}}$', '') <> b THEN regexp_replace(b, '-[a-f0-9]{{8,10}}-[a-z0-9]{{5}}$', '') ELSE regexp_replace(b, '-[a-z0-9]{{5}}$', '') END AS drop_replica,
  split_part(pod, '-', 1) AS first_part FROM m""")
def pod_service_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    code = F.md5(F.col("user_id").cast("string").cast("binary"))
    pod = F.when(F.col("user_id") % 3 == 0, F.concat("event_type", F.lit("-"), F.substring(code, 1, 9), F.lit("-"), F.substring(code, 10, 5))).when(F.col("user_id") % 3 == 1, F.concat("event_type", F.lit("_Svc-"), F.substring(code, 1, 5))).otherwise(F.concat(F.lit("ts-"), "event_type", F.lit("-service")))
    rows = e.select(pod.alias("pod")).distinct()
    pod = F.col("pod")
    return rows.select("pod", S.drop_two_parts(pod).alias("drop_two"), S.drop_two_hashes(pod).alias("drop_hashes"), S.drop_replica(pod).alias("drop_replica"), S.first_part(pod).alias("first_part"))


@query(f"""WITH {TRACES}, {KEPT}, e AS (SELECT DISTINCT trace_id, service || '/' || coalesce(props->>'$.k', 'unknown') AS endpoint FROM sp)
  SELECT endpoint, count(*) AS total, count(kept.trace_id) AS kept, round(100.0 * count(kept.trace_id) / count(*), 6) AS pct FROM e LEFT JOIN kept USING (trace_id)
  GROUP BY endpoint ORDER BY pct DESC, total DESC, endpoint LIMIT 12""")
def endpoint_retention_top12(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    endpoint = F.concat_ws("/", "service", F.coalesce(F.get_json_object("props", "$.k"), F.lit("unknown")))
    return retention.by_endpoint(s.select("trace_id", endpoint.alias("endpoint")), kept(traces.trace_points(s))).orderBy(F.desc("pct"), F.desc("total"), "endpoint").limit(12)


@query(f"""WITH {TRACES}, {INCIDENTS}, {KEPT}, s AS (SELECT DISTINCT service FROM inc), c AS (SELECT trace_id, len(list_filter(services, lambda x: x IN (SELECT service FROM s))) > 0 AS hit FROM tp)
  SELECT 1 AS one, count(*) FILTER (WHERE hit) AS total FROM c""".replace("len(list_filter(services, lambda x: x IN (SELECT service FROM s))) > 0", "list_has_any(services, (SELECT list(service) FROM s))").replace("1 AS one, count(*) FILTER (WHERE hit) AS total FROM c", "count(*) AS traces, count(*) FILTER (WHERE hit) AS incident_traces, count(k.trace_id) FILTER (WHERE hit) AS incident_kept, round(100.0 * count(k.trace_id) FILTER (WHERE hit) / count(*) FILTER (WHERE hit), 6) AS coverage_pct FROM c LEFT JOIN kept k USING (trace_id)"))
def incident_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    tp = traces.trace_points(s)
    causes = traces.incidents(s).select("service").distinct()
    hit = tp.select("trace_id", F.explode("services").alias("service")).join(causes, "service", "left_semi").select("trace_id").distinct().withColumn("hit", F.lit(True))
    rows = tp.select("trace_id").join(hit, "trace_id", "left").join(kept(tp).withColumn("k", F.lit(True)), "trace_id", "left")
    n, k = F.count_if(F.col("hit")), F.count_if(F.col("hit") & F.col("k"))
    return rows.agg(F.count("*").alias("traces"), n.alias("incident_traces"), k.alias("incident_kept"), S.sixth(100.0 * k / n).alias("coverage_pct"))


@query(f"""WITH {TRACES}, {INCIDENTS}, {KEPT} SELECT sid, count(*) AS early, count(kept.trace_id) AS early_kept, round(100.0 * count(kept.trace_id) / count(*), 6) AS pct
  FROM inc JOIN tp ON sec BETWEEN st - 300 AND st + 9 LEFT JOIN kept USING (trace_id) GROUP BY sid""")
def early_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    tp = traces.trace_points(s)
    early = traces.incidents(s).select("sid", (F.col("st") - 300).alias("st"), (F.col("st") + 9).alias("ed"))
    rows = traces.membership(tp, early).select("trace_id", F.explode("sids").alias("sid"))
    return retention.share_kept(rows, kept(tp), "sid", "early")


@query(f"""WITH {TRACES}, {KEPT} SELECT root_service, count(*) AS traces, count(kept.trace_id) AS kept, sum(span_count)::BIGINT AS spans, coalesce(sum(span_count) FILTER (WHERE kept.trace_id IS NOT NULL), 0)::BIGINT AS spans_kept,
  count(*) FILTER (WHERE has_error) AS errors, count(kept.trace_id) FILTER (WHERE has_error) AS errors_kept FROM tp LEFT JOIN kept USING (trace_id) GROUP BY root_service""")
def retention_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tp = points(spark, sf_dir)
    return retention.summary(tp, kept(tp), "root_service")


@query(f"""WITH {TRACES} SELECT CASE WHEN duration_ms < 100 THEN '<100' WHEN duration_ms < 500 THEN '<500' WHEN duration_ms < 2000 THEN '<2000' ELSE '>=2000' END AS duration,
  CASE WHEN span_count <= 3 THEN '<=3' WHEN span_count <= 8 THEN '<=8' WHEN span_count <= 20 THEN '<=20' ELSE '>20' END AS spans, count(*) AS n, sum(has_error::INT)::BIGINT AS errors FROM tp GROUP BY 1, 2""")
def duration_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tp = points(spark, sf_dir)
    return tp.groupBy(retention.bucket(F.col("duration_ms"), (100, 500, 2000), "<", ">=").alias("duration"), retention.bucket(F.col("span_count"), (3, 8, 20), "<=", ">").alias("spans")).agg(F.count("*").alias("n"), F.count_if("has_error").alias("errors"))


@query(f"""WITH {TRACES}, l AS (SELECT root_service, list_sort(list(duration_ms)) AS d, list(duration_ms) AS u FROM tp GROUP BY root_service)
  SELECT root_service, round(list_aggregate(u, 'quantile_cont', 0.5), 6) AS p50, round(list_aggregate(u, 'quantile_cont', 0.95), 6) AS p95, round(list_aggregate(u, 'quantile_cont', 0.99), 6) AS p99,
  round(d[floor(0.95 * (len(d) - 1))::INT + 1], 6) AS rank95, round(d[len(d) // 2 + 1], 6) AS upper_median FROM l""")
def quantile_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = {"p50": ("linear", 0.5), "p95": ("linear", 0.95), "p99": ("linear", 0.99), "rank95": ("rank", 0.95), "upper_median": ("upper", 0.0)}
    found = ordering.quantiles(points(spark, sf_dir).select("root_service", "duration_ms"), ["root_service"], "duration_ms", asked)
    return found.select("root_service", *[S.sixth(F.col(k)).alias(k) for k in asked])


@query(f"""WITH {TRACES}, m AS (SELECT root_service, median(duration_ms) AS med, stddev_pop(duration_ms) AS pop, coalesce(stddev_samp(duration_ms), 0) AS samp, quantile_cont(duration_ms, 0.75) - quantile_cont(duration_ms, 0.25) AS iqr FROM tp GROUP BY root_service),
  d AS (SELECT root_service, median(abs(duration_ms - med)) AS mad FROM tp JOIN m USING (root_service) GROUP BY root_service)
  SELECT root_service, round(med, 6) AS med, round(mad, 6) AS mad, round(iqr / 1.349, 6) AS iqr_scale, round(pop, 6) AS std_pop, round(samp, 6) AS std_samp, round(greatest(1e-6, pop, 1.4826 * mad), 6) AS robust FROM m JOIN d USING (root_service)""")
def robust_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.robust_scales(points(spark, sf_dir), "root_service", "duration_ms")


@query(f"""WITH {TRACES}, w AS (SELECT trace_id, list(weight ORDER BY weight DESC)[1:3] AS v FROM sp GROUP BY trace_id)
  SELECT trace_id, round(0.5 * v[1] + 0.3 * coalesce(v[2], 0) + 0.2 * coalesce(v[3], 0), 6) AS projection FROM w""")
def projection_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir).groupBy("trace_id").agg(F.collect_list("weight").alias("v"))
    return rows.select("trace_id", S.sixth(S.top_weighted(F.col("v"))).alias("projection"))


@query(f"""WITH {TRACES}, b AS (SELECT min(duration_ms) AS lo, max(duration_ms) AS hi, min(span_count) AS slo, max(span_count) AS shi FROM tp)
  SELECT trace_id, round(0.7 * CASE WHEN hi > lo THEN (duration_ms - lo) / (hi - lo) ELSE 0.5 END + 0.3 * CASE WHEN shi > slo THEN (span_count - slo) / (shi - slo)::DOUBLE ELSE 0.5 END, 6) AS latency FROM tp, b""")
def minmax_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.latency(points(spark, sf_dir)).select("trace_id", S.sixth(F.col("latency")).alias("latency"))


@query(f"""WITH {TRACES}, p AS (SELECT trace_id, services AS b, lag(services) OVER (PARTITION BY split_part(trace_id, '-', 1) ORDER BY start_ns) AS a FROM tp)
  SELECT trace_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM p WHERE a IS NOT NULL""")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("services").over(Window.partitionBy(F.substring_index("trace_id", "-", 1)).orderBy("start_ns"))
    rows = points(spark, sf_dir).select("trace_id", "services", before.alias("before")).where("before is not null")
    return rows.select("trace_id", S.sixth(S.jaccard(F.col("before"), F.col("services"))).alias("similarity"))


@query("""WITH c AS (SELECT label, pos, avg(v::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos),
  l AS (SELECT label, list(m ORDER BY pos) AS m FROM c GROUP BY label), x AS (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS e, m FROM embeddings JOIN l USING (label))
  SELECT vec_id, round(greatest(0, list_cosine_similarity(e, m)), 6) AS similarity FROM x""")
def cosine_to_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    means = e.select("label", F.posexplode("embedding").alias("pos", "v")).groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    centroids = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("m"))
    return e.join(centroids, "label").select("vec_id", S.sixth(S.cosine(F.col("embedding"), F.col("m"))).alias("similarity"))


@query(f"""WITH {TRACES}, {KEPT} SELECT service, count(*) AS spans, round(sum(weight), 6) AS weight FROM sp WHERE trace_id IN (SELECT trace_id FROM kept) GROUP BY service""")
def semi_join_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    return s.join(kept(traces.trace_points(s)), "trace_id", "left_semi").groupBy("service").agg(F.count("*").alias("spans"), S.sixth(F.sum("weight")).alias("weight"))


@query("""SELECT coalesce(event_type, 'TOTAL') AS dataset, count(*) AS n_rows, count(DISTINCT user_id) AS users FROM events GROUP BY ROLLUP (event_type)""")
def rollup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.rollup("event_type").agg(F.count("*").alias("n_rows"), F.count_distinct("user_id").alias("users")).select(F.coalesce("event_type", F.lit("TOTAL")).alias("dataset"), "n_rows", "users")


@query("""SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events""")
def json_props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


METRICS = """mt AS (SELECT service, sec // 3600 * 3600 AS sec, avg(weight) AS cpu, count(*) AS load FROM sp GROUP BY 1, 2)"""


@query(f"""WITH {TRACES}, {METRICS}, j AS (SELECT trace_id, tp.sec, root_service, mt.sec AS m_sec, cpu, load FROM tp ASOF LEFT JOIN mt ON root_service = mt.service AND tp.sec >= mt.sec)
  SELECT trace_id, CASE WHEN sec - m_sec <= 7200 THEN m_sec END AS m_sec, CASE WHEN sec - m_sec <= 7200 THEN round(cpu, 6) END AS cpu, CASE WHEN sec - m_sec <= 7200 THEN load END AS load,
  CASE WHEN sec - m_sec <= 7200 THEN round(exp(-(sec - m_sec) / 7200.0), 6) END AS freshness FROM j""")
def asof_metric_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    metrics = retention.hourly_metrics(s)
    found = traces.as_of(traces.trace_points(s).select("trace_id", "sec", F.col("root_service").alias("service")), metrics, 7200)
    return found.select("trace_id", "m_sec", S.sixth(F.col("cpu")).alias("cpu"), "load", S.sixth(F.exp(-(F.col("sec") - F.col("m_sec")) / 7200)).alias("freshness"))
