"""Queries on six metrics of pods: deviations, evidence for each trace, the bias of an incident, and the rescue by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import storage
from ..operators import rerank, traces
from .base import INCIDENTS, ORACLES, TRACES, query, spans
from .metric_queries import registry_confidence
from .window_queries import FOLDED, clustered, probabilities

AGE, REACH, SHARE = 7200, 5400, 0.025

_each = lambda form: ", ".join(form.format(m=m) for m in rerank.METRICS)
_sum = lambda weights: " + ".join(f"{w} * {m}_z" for m, w in weights.items())

#: Pods' six metrics by hour (pm) and their deviations (pz).
POD_Z = f"""pq AS (SELECT *, CASE u % 3 WHEN 0 THEN service || '-' || substr(md5(u::VARCHAR), 1, 9) || '-' || substr(md5(u::VARCHAR), 10, 5) WHEN 1 THEN service || '_Svc-' || substr(md5(u::VARCHAR), 1, 5) ELSE 'ts-' || service || '-service' END AS pod
  FROM (SELECT *, split_part(trace_id, '-', 1)::BIGINT AS u FROM sp)),
pm AS MATERIALIZED (SELECT pod, pq.sec // 3600 * 3600 AS sec, avg(pq.weight) AS cpu, max(pq.weight) AS mem, max((start_us - start_ns // 1000) / 1000.0) AS latency, count(*)::DOUBLE AS workload, count(DISTINCT trace_id)::DOUBLE AS node, avg(failed::INT) AS error_rate
  FROM pq JOIN tp USING (trace_id) GROUP BY 1, 2),
pa AS (SELECT pod, {_each("median({m}) AS {m}_m, stddev_pop({m}) AS {m}_s")} FROM pm GROUP BY pod), pe AS (SELECT pod, {_each("median(abs({m} - {m}_m)) AS {m}_d")} FROM pm JOIN pa USING (pod) GROUP BY pod),
pz AS MATERIALIZED (SELECT pod, sec, {_each("least(abs({m} - {m}_m) / greatest(1e-6, {m}_s, 1.4826 * {m}_d), 10) AS {m}_z")} FROM pm JOIN pa USING (pod) JOIN pe USING (pod))"""
#: Snapshots of the services' pods (sn).
SNAPSHOTS = f"""rg AS MATERIALIZED (SELECT service, pod, confidence FROM ({ORACLES["registry_confidence"]})), aq AS (SELECT trace_id, sec, service, pod, confidence FROM (SELECT trace_id, sec, unnest(services) AS service FROM tp) JOIN rg USING (service)),
sn AS MATERIALIZED (SELECT aq.*, pz.sec AS m_sec, {_each("{m}_z")} FROM aq ASOF JOIN pz ON aq.pod = pz.pod AND aq.sec >= pz.sec WHERE aq.sec - pz.sec <= {AGE})"""
VECTOR = "cpu, mem, latency, error, node, workload"
POD_BIAS = f"""an2 AS (SELECT min(st) AS at_s FROM inc), bd AS (SELECT {_each("coalesce(avg({m}_z), 0) AS {m}")} FROM pz, an2 WHERE abs(sec - at_s) <= {REACH}),
be AS (SELECT coalesce(avg(has_error::INT) FILTER (WHERE abs(sec - at_s) <= {REACH}), avg(has_error::INT)) AS error FROM tp, an2), bv AS (SELECT [{VECTOR}] AS bias, list_sum([{VECTOR}]) AS mass FROM bd, be),
bi AS (SELECT bias, mass, least(greatest(0.10 + 0.60 * (1 + list_sum(list_transform(list_filter(bias, lambda x: x > 1e-12), lambda x: x / mass * ln(x / mass))) / ln(6)) + 0.30 * least(ln(1 + mass) / ln(6), 1), 0), 1) AS confidence FROM bv)"""


def _norm(x: str) -> str:
    return f"CASE WHEN max({x}) OVER () <= min({x}) OVER () + 1e-12 THEN 0.5 ELSE ({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) END"


def with_pods(s: DataFrame) -> DataFrame:
    """Spans with a pod: names of three forms, by user."""
    user = F.substring_index("trace_id", "-", 1)
    code, form = F.md5(user.cast("binary")), user.cast("long") % 3
    one = F.concat("service", F.lit("-"), F.substring(code, 1, 9), F.lit("-"), F.substring(code, 10, 5))
    return s.withColumn("pod", F.when(form == 0, one).when(form == 1, F.concat("service", F.lit("_Svc-"), F.substring(code, 1, 5))).otherwise(F.concat(F.lit("ts-"), "service", F.lit("-service"))))


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans, points and the pods' deviations, the last two stored."""
    s = spans(spark, sf_dir)
    tp = storage.stored(traces.trace_points(s), "points")
    return s, tp, storage.stored(rerank.pod_deviations(rerank.pod_metrics(with_pods(s), tp)), "pods")


def _snapshots(spark: SparkSession, sf_dir: str, tp: DataFrame, pods: DataFrame) -> DataFrame:
    registry = storage.stored(registry_confidence(spark, sf_dir).select("service", "pod", "confidence"), "registry")
    return rerank.snapshot_lists(tp, pods, registry, AGE)


@query(f"WITH {TRACES}, {POD_Z} SELECT pod, sec, {_each('round({m}_z, 6) AS {m}_z')} FROM pz")
def pod_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inputs(spark, sf_dir)[2].select("pod", "sec", *[S.sixth(F.col(f"{m}_z")).alias(f"{m}_z") for m in rerank.METRICS])


@query(f"""WITH {TRACES}, {POD_Z}, {SNAPSHOTS}, r AS (SELECT trace_id, service, confidence * exp(-(sec - m_sec) / {AGE}.0) AS rel, {_sum(rerank.INTENSITY)} AS strength FROM sn),
  e AS (SELECT trace_id, service, list(strength * rel ORDER BY strength * rel DESC) AS v, avg(rel) AS rel FROM r GROUP BY 1, 2), f AS (SELECT trace_id, service, rel, 0.5 * v[1] + 0.3 * coalesce(v[2], 0) + 0.2 * coalesce(v[3], 0) AS x FROM e),
  g AS (SELECT trace_id, list(x ORDER BY x DESC) AS v, avg(rel) AS reliability, count(*) AS known FROM f GROUP BY 1), h AS (SELECT trace_id, coalesce(0.5 * v[1] + 0.3 * coalesce(v[2], 0) + 0.2 * coalesce(v[3], 0), 0) AS intensity, coalesce(known, 0) / len(services) AS coverage, coalesce(reliability, 0) AS reliability, len(services) - coalesce(known, 0) AS unmatched FROM tp LEFT JOIN g USING (trace_id))
  SELECT trace_id, round(intensity, 6) AS intensity, round(coverage, 6) AS coverage, round(reliability, 6) AS reliability, round(intensity * coverage, 6) AS evidence, unmatched FROM h""")
def pod_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, tp, pods = _inputs(spark, sf_dir)
    found = rerank.pod_evidence(tp, _snapshots(spark, sf_dir, tp, pods), AGE)
    return found.select("trace_id", *[S.sixth(F.col(c)).alias(c) for c in ("intensity", "coverage", "reliability", "evidence")], F.col("unmatched").cast("long").alias("unmatched"))


@query(f"""{FOLDED}, {POD_Z}, {SNAPSHOTS}, {POD_BIAS}, sb AS (SELECT *, row_number() OVER (PARTITION BY trace_id, service ORDER BY round(confidence * ({_sum(rerank.QUALITY)}), 6) DESC, pod) AS r FROM sn),
  sm AS (SELECT trace_id, {", ".join(f"avg(confidence * {m}_z) AS {m}" for m in rerank.QUALITY)} FROM sb WHERE r = 1 GROUP BY 1),
  ss AS (SELECT trace_id, {", ".join(f"coalesce({m}, 0) AS {m}" for m in rerank.QUALITY)}, has_error::INT::DOUBLE AS error FROM tp LEFT JOIN sm USING (trace_id)), sv AS (SELECT trace_id, [{VECTOR}] AS v FROM ss),
  sf AS (SELECT lc.trace_id, lc.p_d, 0.75 * lc.p + 0.25 * lc.p_d AS mixed, confidence, CASE WHEN list_inner_product(v, v) > 0 AND list_inner_product(bias, bias) > 0 THEN least(greatest(list_inner_product(v, bias) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(bias, bias))), 0), 1) ELSE 0 END AS fit FROM lc JOIN sv USING (trace_id), bi),
  sn2 AS (SELECT trace_id, fit, {_norm("fit")} AS fit_n, confidence, {_norm("mixed")} AS mixed_n, {_norm("p_d")} AS d_n FROM sf),
  fs AS MATERIALIZED (SELECT trace_id, fit, fit_n, round((0.60 * mixed_n + 0.15 * d_n + 0.25 * confidence * fit_n) / (0.75 + 0.25 * confidence), 6) AS first FROM sn2),
  tg AS (SELECT count(*) AS n, greatest(1, least(count(*), round_even(count(*) * {SHARE}, 0)))::BIGINT AS target FROM fs), tl AS (SELECT n, target, greatest(target, least(n, round_even(target * 1.6, 0)))::BIGINT AS pool FROM tg),
  dn AS (SELECT a.trace_id, avg(b.has_error::INT) AS density FROM tp a JOIN tp b ON b.sec BETWEEN a.sec - 60 AND a.sec + 60 GROUP BY 1), cs AS (SELECT list(DISTINCT service) AS causes FROM inc), dr AS (SELECT trace_id, {_norm("duration_ms")} AS slow FROM tp),
  pr AS (SELECT trace_id, has_error, 0.40 * density + 0.30 * slow + 0.20 * len(list_intersect(services, causes)) / len(services) + 0.10 * exp(-abs(sec - at_s) / 60.0) AS prior FROM tp JOIN dn USING (trace_id) JOIN dr USING (trace_id), cs, an2),
  rk AS (SELECT trace_id, has_error, fit, first, row_number() OVER (ORDER BY first DESC, trace_id) <= pool AS pooled, round(0.55 * {_norm("first")} + 0.25 * fit_n + 0.20 * prior, 6) AS second FROM fs JOIN pr USING (trace_id), tl),
  sc AS (SELECT *, CASE WHEN pooled THEN second ELSE first END AS score, row_number() OVER (ORDER BY pooled DESC, second DESC, first DESC, trace_id) <= target AS k FROM rk, tl),
  lk AS (SELECT round_even(any_value(target) * least(greatest(0.08, 1.2 * count(*) FILTER (WHERE has_error) / count(*)), 0.40), 0) - count(*) FILTER (WHERE has_error AND k) AS lacking FROM sc),
  en AS (SELECT trace_id, row_number() OVER (ORDER BY score DESC, first DESC, trace_id) AS q FROM sc WHERE has_error AND NOT k), le AS (SELECT trace_id, row_number() OVER (ORDER BY score, first, trace_id DESC) AS q FROM sc WHERE k AND NOT has_error),
  mv AS (SELECT en.trace_id AS a, le.trace_id AS b FROM en JOIN le USING (q), lk WHERE q <= lacking)
  SELECT trace_id, round(fit, 5) AS fit, score, pooled, (k AND trace_id NOT IN (SELECT b FROM mv)) OR trace_id IN (SELECT a FROM mv) AS kept FROM sc""")
def bias_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, tp, pods = _inputs(spark, sf_dir)
    found = traces.incidents(s).agg(F.min("st").alias("at"), F.collect_set("service").alias("causes")).first()  # services
    state = rerank.states(tp, _snapshots(spark, sf_dir, tp, pods))
    scored = clustered(probabilities(spark, sf_dir, tp)).select("trace_id", F.col("p").alias("p_s"), "p_d")
    rows = storage.stored(rerank.aligned(scored, state, rerank.bias(tp, pods, found["at"] or 0, REACH)), "aligned")
    causes = spark.createDataFrame([(found["causes"],)], "causes array<string>")
    return rerank.rescued(tp, rows, causes, found["at"] or 0, SHARE).join(rows.select("trace_id", "fit"), "trace_id").select("trace_id", F.round("fit", 5).alias("fit"), "score", "pooled", "kept")
