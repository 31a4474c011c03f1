"""Queries that join metrics to traces, and rankings built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import metrics, ordering, retention, traces, windows
from .base import INCIDENTS, TRACES, points, query, spans, uniform
from .trace_queries import METRICS, PODS

Z = """ms AS (SELECT service, median(cpu) AS cm, stddev_pop(cpu) AS cs, median(load) AS lm, stddev_pop(load) AS ls FROM mt GROUP BY service),
md AS (SELECT service, median(abs(cpu - cm)) AS cd, median(abs(load - lm)) AS ld FROM mt JOIN ms USING (service) GROUP BY service),
mz AS (SELECT service, sec, least(abs(cpu - cm) / greatest(1e-6, cs, 1.4826 * cd), 10) AS cpu_z, least(abs(load - lm) / greatest(1e-6, ls, 1.4826 * ld), 10) AS load_z FROM mt JOIN ms USING (service) JOIN md USING (service))"""


def deviations_of(s: DataFrame) -> DataFrame:
    return metrics.deviations(retention.hourly_metrics(s), ["cpu", "load"])


@query(f"WITH {TRACES}, {METRICS}, {Z} SELECT service, sec, round(cpu_z, 6) AS cpu_z, round(load_z, 6) AS load_z FROM mz")
def metric_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deviations_of(spans(spark, sf_dir)).select("service", "sec", S.sixth(F.col("cpu_z")).alias("cpu_z"), S.sixth(F.col("load_z")).alias("load_z"))


@query(f"""WITH {TRACES}, {METRICS}, w AS (SELECT service, sec, load, list_sort(list(load) OVER (PARTITION BY service ORDER BY sec ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)) AS l FROM mt)
  SELECT service, sec, round(least(load / l[floor(0.95 * (len(l) - 1))::INT + 1], 1), 6) AS load_share FROM w""")
def rolling_normalizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rolling_scale(retention.hourly_metrics(spans(spark, sf_dir)), "load").select("service", "sec", S.sixth(F.col("load_share")).alias("load_share"))


@query(f"""WITH {PODS}, v AS (SELECT DISTINCT event_type AS service FROM events), t AS (SELECT service, list_filter(string_split_regex(lower(service), '[-_]'), lambda x: x <> '') AS a FROM v),
  p AS (SELECT pod, list_distinct(list_filter(string_split_regex(lower(pod), '[-_]'), lambda x: x <> '')) AS b FROM pods),
  m AS (SELECT service, pod, greatest(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, CASE WHEN contains(lower(pod), service) THEN 0.75 ELSE 0 END) AS match FROM t, p WHERE list_has_any(a, b)),
  r AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY match DESC, pod) AS place FROM m) SELECT service, pod, round(match, 6) AS match, place FROM r WHERE place <= 8""")
def service_pod_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    code = F.md5(F.col("user_id").cast("string").cast("binary"))
    pod = F.when(F.col("user_id") % 3 == 0, F.concat("event_type", F.lit("-"), F.substring(code, 1, 9), F.lit("-"), F.substring(code, 10, 5))).when(F.col("user_id") % 3 == 1, F.concat("event_type", F.lit("_Svc-"), F.substring(code, 1, 5))).otherwise(F.concat(F.lit("ts-"), "event_type", F.lit("-service")))
    return metrics.registry(e.select(F.col("event_type").alias("service")), e.select(pod.alias("pod"))).withColumn("match", S.sixth(F.col("match")))


PODS_AT = """pd AS (SELECT CASE user_id % 3 WHEN 0 THEN event_type || '-' || substr(md5(user_id::VARCHAR), 1, 9) || '-' || substr(md5(user_id::VARCHAR), 10, 5) WHEN 1 THEN event_type || '_Svc-' || substr(md5(user_id::VARCHAR), 1, 5) ELSE 'ts-' || event_type || '-service' END AS pod,
  event_type AS service, epoch_us(ts) // 1000000 AS sec FROM events)"""


def _pods(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    code = F.md5(F.col("user_id").cast("string").cast("binary"))
    pod = F.when(F.col("user_id") % 3 == 0, F.concat("event_type", F.lit("-"), F.substring(code, 1, 9), F.lit("-"), F.substring(code, 10, 5))).when(F.col("user_id") % 3 == 1, F.concat("event_type", F.lit("_Svc-"), F.substring(code, 1, 5))).otherwise(F.concat(F.lit("ts-"), "event_type", F.lit("-service")))
    return e.select(pod.alias("pod"), F.col("event_type").alias("service"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("sec"))


@query(f"""WITH {PODS_AT}, ls AS (SELECT DISTINCT service, sec // 3600 AS slot FROM pd), lp AS (SELECT pod, sec // 3600 AS slot, count(*) AS n FROM pd GROUP BY 1, 2), a AS (SELECT service, count(*) AS a, list_distinct(list_filter(string_split_regex(lower(service), '[-_]'), lambda x: x <> '')) AS pa FROM ls GROUP BY service),
  b AS (SELECT pod, count(*) AS b, sum(n) AS seen, list_distinct(list_filter(string_split_regex(lower(pod), '[-_]'), lambda x: x <> '')) AS pb FROM lp GROUP BY pod), sh AS (SELECT service, pod, count(*) AS shared FROM ls JOIN lp USING (slot) GROUP BY 1, 2),
  m AS (SELECT service, pod, CASE WHEN lower(service) = lower(pod) THEN 1 ELSE greatest(len(list_intersect(pa, pb)) / len(list_distinct(list_concat(pa, pb)))::DOUBLE, CASE WHEN contains(lower(pod), lower(service)) OR contains(lower(service), lower(pod)) THEN 0.75 ELSE 0 END) END AS name,
    coalesce(shared, 0) / least(a, b) AS overlap, seen / (SELECT max(seen) FROM b) AS coverage FROM (SELECT * FROM a, b) LEFT JOIN sh USING (service, pod)),
  k AS (SELECT *, 0.45 * name + 0.35 * overlap + 0.20 * coverage AS confidence FROM m WHERE name > 0.05 OR overlap > 0.05), r AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY round(confidence, 9) DESC, pod) AS place FROM k)
  SELECT service, pod, round(name, 6) AS name, round(overlap, 6) AS overlap, round(coverage, 6) AS coverage, round(confidence, 6) AS confidence, place FROM r WHERE place <= 8""")
def registry_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pods(spark, sf_dir)
    found = metrics.registry_confidence(rows.select("service", "sec"), rows.select("pod", "sec"))
    return found.select("service", "pod", *[S.sixth(F.col(c)).alias(c) for c in ("name", "overlap", "coverage", "confidence")], "place")


@query(f"""WITH {PODS_AT}, s AS (SELECT DISTINCT service FROM pd UNION SELECT DISTINCT 'ts-' || service FROM pd), p AS (SELECT DISTINCT pod FROM pd),
  c AS (SELECT service, pod, CASE WHEN service = pod THEN 1.0 WHEN starts_with(pod, service || '-') THEN 0.85 WHEN regexp_replace(service, '-service$', '') = regexp_replace(regexp_replace(pod, '-[^-]*-[^-]*$', ''), '-service$', '') THEN 0.65 END AS score FROM s, p) SELECT service, pod, score::DOUBLE AS score FROM c WHERE score IS NOT NULL""")
def name_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pods(spark, sf_dir)
    services = rows.select("service").distinct()
    return metrics.name_scores(services.unionByName(services.select(F.concat(F.lit("ts-"), "service").alias("service"))), rows)


@query(f"""WITH {TRACES}, {METRICS}, {Z}, q AS (SELECT trace_id, sec, unnest(services) AS service FROM tp), j AS (SELECT q.trace_id, q.sec, mz.sec AS m_sec, cpu_z, load_z FROM q ASOF LEFT JOIN mz ON q.service = mz.service AND q.sec >= mz.sec),
  k AS (SELECT trace_id, CASE WHEN sec - m_sec <= 7200 THEN exp(-(sec - m_sec) / 7200.0) END AS fresh, 0.24 * cpu_z + 0.12 * load_z AS strength FROM j),
  l AS (SELECT trace_id, list(strength * fresh ORDER BY strength * fresh DESC) FILTER (WHERE fresh IS NOT NULL) AS v, count(fresh) AS known, count(*) AS asked, coalesce(avg(fresh), 0) AS reliability FROM k GROUP BY trace_id)
  SELECT trace_id, round(coalesce(0.5 * v[1] + 0.3 * coalesce(v[2], 0) + 0.2 * coalesce(v[3], 0), 0), 6) AS intensity, round(known / asked, 6) AS coverage, round(reliability, 6) AS reliability FROM l""")
def metric_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    found = metrics.evidence(traces.trace_points(s), deviations_of(s).drop("cpu", "load"), 7200)
    return found.select("trace_id", *[S.sixth(F.col(c)).alias(c) for c in ("intensity", "coverage", "reliability")])


@query(f"""WITH {TRACES}, h AS (SELECT trace_id, services, duration_ms, count(*) OVER w AS n, list(duration_ms) OVER w AS l FROM tp WINDOW w AS (PARTITION BY root_service ORDER BY start_ns, trace_id ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
  m AS (SELECT *, list_aggregate(l, 'median') AS med FROM h), d AS (SELECT *, list_aggregate(list_transform(l, lambda x: abs(x - med)), 'median') AS mad FROM m),
  z AS (SELECT trace_id, len(services) AS k, CASE WHEN n > 10 THEN 0.5 * least(greatest((duration_ms - med) / (mad + 1), 0), 10) ELSE 0 END AS metric, n > 10 AS known FROM d)
  SELECT trace_id, round(metric, 6) AS metric, round(CASE WHEN known THEN least(0.4, 0.2 / k * exp(-1) / (1 + exp(-2 * (metric - 1.5))) * 0.2 * metric) ELSE 0 END, 6) AS boost FROM z""")
def service_history_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    tp = points(spark, sf_dir)
    history = windows.service_history(tp.select("trace_id", F.col("root_service").alias("service"), "start_ns", F.col("duration_ms").alias("value")), "value")
    return metrics.history_boost(tp, history).select("trace_id", S.sixth(F.col("metric")).alias("metric"), S.sixth(F.col("boost")).alias("boost"))


BIAS = """an AS (SELECT min(st) AS at_s FROM inc), bv AS (SELECT sum(cpu_z) AS c, sum(load_z) AS l FROM mz, an WHERE abs(mz.sec - at_s) <= 5400),
bs AS (SELECT c, l, c + l AS mass, c / (c + l) AS cs, l / (c + l) AS ls FROM bv),
bc AS (SELECT *, least(greatest(0.10 + 0.60 * (1 + (cs * ln(cs) + ls * ln(ls)) / ln(2)) + 0.30 * least(greatest(ln(1 + mass) / ln(6), 0), 1), 0), 1) AS confidence FROM bs)"""


def _bias(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    z = deviations_of(s)
    first = traces.incidents(s).agg(F.min("st").alias("at"))
    return z, metrics.bias(z.crossJoin(F.broadcast(first)), F.col("at"), 5400)  # one row


@query(f"WITH {TRACES}, {INCIDENTS}, {METRICS}, {Z}, {BIAS} SELECT round(cs, 6) AS cpu_share, round(ls, 6) AS load_share, round(mass, 6) AS mass, round(confidence, 6) AS confidence FROM bc")
def bias_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bias(spans(spark, sf_dir))[1].select(*[S.sixth(F.col(c)).alias(c) for c in ("cpu_share", "load_share", "mass", "confidence")])


@query(f"""WITH {TRACES}, {INCIDENTS}, {METRICS}, {Z}, {BIAS}, j AS (SELECT trace_id, tp.sec, mz.sec AS m_sec, cpu_z, load_z FROM tp ASOF LEFT JOIN mz ON root_service = mz.service AND tp.sec >= mz.sec),
  n AS (SELECT trace_id, sqrt(cpu_z ** 2 + load_z ** 2) * sqrt(cs ** 2 + ls ** 2) AS n, (cpu_z * cs + load_z * ls) AS dot, confidence FROM j, bc WHERE sec - m_sec <= 7200)
  SELECT trace_id, round(confidence * CASE WHEN n > 0 THEN dot / n ELSE 0 END, 6) AS alignment FROM n""")
def bias_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    z, facts = _bias(s)
    found = traces.as_of(traces.trace_points(s).select("trace_id", "sec", F.col("root_service").alias("service")), z.drop("cpu", "load"), 7200).where("m_sec is not null")
    rows = found.crossJoin(F.broadcast(facts.select("cpu_share", "load_share", "confidence")))  # one row
    return rows.select("trace_id", S.sixth(F.col("confidence") * S.cosine(F.array("cpu_z", "load_z"), F.array("cpu_share", "load_share"))).alias("alignment"))


@query(f"""WITH {TRACES}, a AS (SELECT trace_id, span_count FROM tp WHERE {uniform("trace_id", "'a'")} < 0.5), b AS (SELECT trace_id, has_error FROM tp WHERE {uniform("trace_id", "'b'")} < 0.5)
  SELECT CASE WHEN a.trace_id IS NULL THEN 'sampled' WHEN b.trace_id IS NULL THEN 'baseline' ELSE 'both' END AS side, count(*) AS n, coalesce(sum(span_count), 0)::BIGINT AS spans, count(*) FILTER (WHERE has_error) AS errors FROM a FULL JOIN b ON a.trace_id = b.trace_id GROUP BY 1""")
def ab_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    tp = points(spark, sf_dir)
    a = tp.where(S.hash_uniform(F.col("trace_id"), "a") < 0.5).select("trace_id", "span_count", F.lit(1).alias("in_a"))
    b = tp.where(S.hash_uniform(F.col("trace_id"), "b") < 0.5).select("trace_id", "has_error", F.lit(1).alias("in_b"))
    side = F.when(F.col("in_a").isNull(), "sampled").when(F.col("in_b").isNull(), "baseline").otherwise("both")
    return a.join(b, "trace_id", "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"), F.coalesce(F.sum("span_count"), F.lit(0)).alias("spans"), F.count_if("has_error").alias("errors"))


@query(f"""WITH {TRACES}, o AS (SELECT trace_id, row_number() OVER (PARTITION BY sec // 86400 ORDER BY start_ns, trace_id) AS r, count(*) OVER (PARTITION BY sec // 86400) AS n FROM tp)
  SELECT CASE WHEN r <= greatest(1, n // 3) THEN 'first' ELSE 'rest' END AS part, count(*) AS n FROM o GROUP BY 1""")
def first_third_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).select(F.floor(F.col("sec") / 86400).alias("day"), "start_ns", "trace_id")
    sizes = rows.groupBy("day").agg(F.count("*").alias("n"))
    placed = ordering.numbered(rows, ["day"], F.col("start_ns"), F.col("trace_id"), name="r").join(sizes, "day")
    return placed.groupBy(F.when(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") / 3)), "first").otherwise("rest").alias("part")).agg(F.count("*").alias("n"))


@query(f"""WITH {TRACES}, x AS (SELECT trace_id FROM tp WHERE has_error INTERSECT SELECT trace_id FROM tp WHERE span_count > 2), y AS (SELECT trace_id FROM tp WHERE has_error EXCEPT SELECT trace_id FROM tp WHERE span_count > 2)
  SELECT 'both' AS kind, count(*) AS n FROM x UNION ALL SELECT 'errors only', count(*) FROM y""")
def id_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tp = points(spark, sf_dir)
    errors, large = tp.where("has_error").select("trace_id"), tp.where("span_count > 2").select("trace_id")
    both = errors.intersect(large).agg(F.count("*").alias("n")).select(F.lit("both").alias("kind"), "n")
    return both.unionByName(errors.exceptAll(large).agg(F.count("*").alias("n")).select(F.lit("errors only").alias("kind"), "n"))
