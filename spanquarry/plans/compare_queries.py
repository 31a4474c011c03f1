"""Queries that compare two runs, report what a sample keeps, and tell text rules apart. A trace's run is drawn by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import compare, evaluation, ordering, retention, traces, windows
from ..sources.spans import parsed_operation
from .base import INCIDENTS, TRACES, points, query, spans, uniform
from .window_queries import BINS, bins_of

RUNS = f"""rs AS (SELECT *, CASE WHEN {uniform("trace_id", "'run'")} < 0.5 THEN 'base' ELSE 'next' END AS run, service || '/' || coalesce(props->>'$.k', 'none') AS route, props->>'$.k' AS k FROM sp),
rt AS (SELECT run, trace_id, min(start_us) AS start_us, (max(start_us) - min(start_us)) / 1000 AS duration_ms, count(*) AS span_count, bool_or(failed) AS has_error,
  arg_min(k, (start_us, span_id)) FILTER (WHERE k IS NOT NULL) AS k, arg_min(service, (start_us, span_id)) AS service FROM rs GROUP BY run, trace_id)"""


def run_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    run = F.when(S.hash_uniform(F.col("trace_id"), "run") < 0.5, "base").otherwise("next")
    return spans(spark, sf_dir).withColumn("run", run).withColumn("route", F.concat_ws("/", "service", F.coalesce(k, F.lit("none")))).withColumn("k", k)


@query(f"WITH {TRACES}, {RUNS} SELECT trace_id, start_us, round(duration_ms, 6) AS duration_ms, span_count, has_error, k, service FROM rt WHERE run = 'next'")
def otlp_trace_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare.trace_fold(run_spans(spark, sf_dir), F.col("run") == "next", ("k", "service"))
    return found.select("trace_id", "start_us", S.sixth(F.col("duration_ms")).alias("duration_ms"), "span_count", "has_error", "k", "service")


@query(f"""WITH {TRACES}, {RUNS}, a AS (SELECT run, count(*)::DOUBLE AS traces, count(*) FILTER (WHERE has_error)::DOUBLE AS trace_errors, sum(span_count)::DOUBLE AS trace_spans, quantile_cont(duration_ms, 0.5) AS p50, quantile_cont(duration_ms, 0.95) AS p95, quantile_cont(duration_ms, 0.99) AS p99 FROM rt GROUP BY run),
  b AS (SELECT run, count(*)::DOUBLE AS spans, count(DISTINCT trace_id)::DOUBLE AS ids, count(*) FILTER (WHERE failed)::DOUBLE AS errors, min(start_us)::DOUBLE AS first_us, max(start_us)::DOUBLE AS last_us FROM rs GROUP BY run),
  c AS (SELECT run, 'route:' || route AS metric, count(*)::DOUBLE AS value FROM rs GROUP BY 1, 2), d AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY value DESC, metric) AS r FROM c),
  u AS (SELECT run, metric, value FROM (SELECT * FROM a JOIN b USING (run)) UNPIVOT (value FOR metric IN (traces, trace_errors, trace_spans, p50, p95, p99, spans, ids, errors, first_us, last_us))
    UNION ALL SELECT run, 'service:' || service, count(*)::DOUBLE FROM rs GROUP BY 1, 2 UNION ALL SELECT run, metric, value FROM d WHERE r <= 10),
  w AS (SELECT metric, coalesce(max(value) FILTER (WHERE run = 'base'), 0) AS a, coalesce(max(value) FILTER (WHERE run = 'next'), 0) AS b FROM u GROUP BY metric)
  SELECT metric, round(a, 4) AS a, round(b, 4) AS b, round(b - a, 4) AS delta, CASE WHEN a <> 0 THEN round(b / a, 6) END AS ratio FROM w""")
def otlp_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = run_spans(spark, sf_dir)
    rows = s.groupBy("run", "trace_id").agg(((F.max("start_us") - F.min("start_us")) / 1000).alias("duration_ms"), F.max("failed").alias("has_error"), F.count("*").alias("span_count"))
    found = compare.side_by_side(compare.run_stats(rows, s), "base", "next")
    return found.select("metric", *[F.round(c, 4).alias(c) for c in ("a", "b", "delta")], S.sixth(F.col("ratio")).alias("ratio"))


KEEP = uniform("trace_id", "'keep'") + " < 0.3"


def _kept() -> Column:
    return S.hash_uniform(F.col("trace_id"), "keep") < 0.3


@query(f"""WITH {TRACES}, x AS (SELECT count(*) AS traces, count(*) FILTER (WHERE {KEEP}) AS kept, count(*) FILTER (WHERE has_error) AS errors, count(*) FILTER (WHERE has_error AND {KEEP}) AS errors_kept,
  avg(duration_ms) FILTER (WHERE has_error) AS f, avg(duration_ms) FILTER (WHERE NOT has_error) AS c, count(*) FILTER (WHERE root_service = 'purchase') AS critical, count(*) FILTER (WHERE root_service = 'purchase' AND {KEEP}) AS critical_kept FROM tp)
  SELECT traces, kept, errors, errors_kept, critical, critical_kept, round(errors / traces, 6) AS error_rate, round(errors_kept / kept, 6) AS kept_error_rate, round((errors_kept / kept) / (errors / traces), 6) AS error_lift, round(f - c, 4) AS separation_ms, round(critical_kept / critical, 6) AS critical_coverage FROM x""")
def ab_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).withColumn("kept", _kept())
    found = compare.retention_report(rows, F.col("root_service") == "purchase")
    return found.select("traces", "kept", "errors", "errors_kept", "critical", "critical_kept", *[S.sixth(F.col(c)).alias(c) for c in ("error_rate", "kept_error_rate", "error_lift", "critical_coverage")], F.round("separation_ms", 4).alias("separation_ms"))


@query(f"""WITH {TRACES}, {BINS}, r AS (SELECT bin, round_even(p95 / 1000, 0) AS v FROM bins)
  SELECT bin, median(v) OVER (ORDER BY bin RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) AS short, median(v) OVER (ORDER BY bin RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) AS long FROM r""")
def threshold_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bins_of(spark, sf_dir).select("bin", (F.col("p95") / 1000).alias("p95"))
    return compare.rounded_medians(rows, "p95", 5, 30).select("bin", "short", "long")


@query(f"""WITH {TRACES}, {BINS}, f AS (SELECT min(bin) FILTER (WHERE errors > 0.65 * n OR p95 > 80000000) AS first_bin FROM bins),
  h AS (SELECT bin, errors > 0.4 * n AND lead(errors > 0.4 * n, 1) OVER (ORDER BY bin) AND lead(errors > 0.4 * n, 2) OVER (ORDER BY bin) AS hit FROM bins)
  SELECT first_bin, (SELECT min(bin) FROM h WHERE hit AND bin >= first_bin) AS detected_bin, greatest(0, (SELECT min(bin) FROM h WHERE hit AND bin >= first_bin) - first_bin) AS latency FROM f""")
def capture_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bins_of(spark, sf_dir)
    first = compare.first_incident(rows, 0.65, 80_000_000)
    hits = windows.held(rows, F.col("errors") > 0.4 * F.col("n"), 3).where("detected").select("bin")
    found = first.join(hits, F.col("bin") >= F.col("first_bin"), "left").groupBy("first_bin").agg(F.min("bin").alias("detected_bin"))  # one row meets the bins
    return found.select("first_bin", "detected_bin", F.greatest(F.lit(0), F.col("detected_bin") - F.col("first_bin")).cast("long").alias("latency"))


@query(f"""WITH {TRACES}, {RUNS} SELECT run, CASE WHEN duration_ms < 10 THEN '<10' WHEN duration_ms < 100 THEN '<100' WHEN duration_ms < 500 THEN '<500' ELSE '>=500' END AS duration, count(*) AS n, count(*) FILTER (WHERE has_error) AS errors FROM rt GROUP BY 1, 2""")
def run_duration_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = run_spans(spark, sf_dir)
    rows = s.groupBy("run", "trace_id").agg(((F.max("start_us") - F.min("start_us")) / 1000).alias("duration_ms"), F.max("failed").alias("has_error"))
    return rows.groupBy("run", retention.bucket(F.col("duration_ms"), (10, 100, 500), "<", ">=").alias("duration")).agg(F.count("*").alias("n"), F.count_if("has_error").alias("errors"))


NAMES = """nm AS (SELECT DISTINCT CASE user_id % 4 WHEN 0 THEN '/' || event_type || '/' || (user_id % 7) WHEN 1 THEN 'GET  /' || event_type || '/' || (user_id % 5) WHEN 2 THEN '  ' ELSE event_type || ' ' || (user_id % 3) || '.5%' END AS name FROM events)"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("user_id")
    text = lambda n: (u % n).cast("string")
    name = F.when(u % 4 == 0, F.concat(F.lit("/"), "event_type", F.lit("/"), text(7))).when(u % 4 == 1, F.concat(F.lit("GET  /"), "event_type", F.lit("/"), text(5))).when(u % 4 == 2, "  ").otherwise(F.concat("event_type", F.lit(" "), text(3), F.lit(".5%")))
    return e.select(name.alias("name")).distinct()


@query(f"""WITH {NAMES}, t AS (SELECT name, trim(name) AS t, regexp_extract(trim(name), '[^\\s]*$') AS last FROM nm)
  SELECT name, CASE WHEN t = '' THEN 'unknown' WHEN t LIKE '/%' THEN t WHEN last LIKE '/%' THEN last ELSE t END AS operation,
  replace(replace(replace(lower(t), '%', 'pct'), '.', 'p'), ' ', '-') AS slug FROM t""")
def operation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("name", parsed_operation(F.col("name")).alias("operation"), S.slug(F.col("name")).alias("slug"))


@query(f"""WITH {TRACES}, d AS (SELECT root_service AS service, duration_ms AS v FROM tp), l AS (SELECT service, list_sort(list(v)) AS l, coalesce(stddev_samp(v), 0) AS s, count(*) AS n FROM d GROUP BY service),
  m AS (SELECT *, l[n // 2 + 1] AS med FROM l), o AS (SELECT *, list_sort(list_transform(l, lambda x: abs(x - med))) AS o FROM m)
  SELECT service, round(med, 6) AS med, round(o[n // 2 + 1], 6) AS mad, round(CASE WHEN n <= 1 THEN 0 ELSE greatest(s, 1.4826 * o[n // 2 + 1]) END, 6) AS sigma FROM o""")
def upper_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).select(F.col("root_service").alias("service"), F.col("duration_ms").alias("v"))
    return retention.upper_scales(rows, "service", "v").select("service", *[S.sixth(F.col(c)).alias(c) for c in ("med", "mad", "sigma")])


@query(f"""WITH {TRACES}, {INCIDENTS}, x AS (SELECT sid, service, count(*) OVER (PARTITION BY service) AS n, row_number() OVER (ORDER BY sid) AS i FROM inc)
  SELECT sid, service, CASE WHEN n > 1 THEN 'repeated' ELSE 'single' END AS status, (SELECT st FROM inc WHERE inc.sid = x.sid) AS start_s, (SELECT st + 600 FROM inc WHERE inc.sid = x.sid) AS end_s FROM x""")
def duplicate_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rankings (here of one candidate, the cause) are word for word those of another scenario; and the labels'
    ranges of ten minutes."""
    found = traces.incidents(spans(spark, sf_dir))
    audit = evaluation.duplicate_rankings(found.select("sid", F.col("service").alias("candidate"), F.lit(1).alias("rank")))
    ranges = found.select("sid", "service", F.col("st").alias("start_s"), (F.col("st") + 600).alias("end_s"))
    return ranges.join(audit.select("sid", "status"), "sid")


@query(f"""WITH {TRACES}, d AS (SELECT root_service, duration_ms, span_count FROM tp), t AS (SELECT root_service, count(*) AS traces, sum(duration_ms) / 1000 AS seconds, quantile_cont(duration_ms, 0.5) AS p50, quantile_cont(duration_ms, 0.95) AS p95 FROM d GROUP BY root_service),
  a AS (SELECT 'ALL' AS root_service, sum(traces)::BIGINT AS traces, sum(seconds) AS seconds, sum(p50 * traces) / sum(traces) AS p50, sum(p95 * traces) / sum(traces) AS p95 FROM t)
  SELECT root_service, traces, round(seconds, 3) AS seconds, round(1000 * seconds / traces, 4) AS ms_per_trace, round(p50, 4) AS p50, round(p95, 4) AS p95 FROM (SELECT * FROM t UNION ALL SELECT * FROM a)""")
def timing_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timing rows of groups, and their averages weighted by the number of traces."""
    rows = points(spark, sf_dir).select("root_service", "duration_ms")
    at = ordering.quantiles(rows, ["root_service"], "duration_ms", {"p50": ("linear", 0.5), "p95": ("linear", 0.95)})
    sums = rows.groupBy("root_service").agg(F.count("*").alias("traces"), (F.sum("duration_ms") / 1000).alias("seconds"))
    found = evaluation.with_weighted_average(sums.join(at.drop("n"), "root_service"), "root_service", "traces", ["seconds"], ["p50", "p95"])
    return found.select("root_service", "traces", F.round("seconds", 3).alias("seconds"), F.round(1000 * F.col("seconds") / F.col("traces"), 4).alias("ms_per_trace"), F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"))


@query(f"""WITH {TRACES}, b AS (SELECT unnest(['0.1', '1.0', '2.5']) AS budget, unnest([0.001, 0.01, 0.025]) AS share),
  r AS (SELECT budget, count(*) FILTER (WHERE has_error AND {uniform("trace_id", "'keep'")} < 20 * share)::DOUBLE / count(*) FILTER (WHERE has_error) AS score FROM tp, b GROUP BY budget),
  c AS (SELECT unnest(['0.1', '1.0', '2.5']) AS budget, unnest([0.1571, 0.3423, 0.4352]) AS published) SELECT budget, round(score, 6) AS score, published, round(score - published, 6) AS difference FROM r JOIN c USING (budget)""")
def against_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's score at each budget beside published constants (here those of random sampling)."""
    shares = F.array(*[F.struct(F.lit(b).alias("budget"), F.lit(s).alias("share")) for b, s in (("0.1", 0.001), ("1.0", 0.01), ("2.5", 0.025))])
    rows = points(spark, sf_dir).where("has_error").select("trace_id", F.explode(shares).alias("b")).select("trace_id", "b.*")
    scores = rows.groupBy("budget").agg((F.count_if(S.hash_uniform(F.col("trace_id"), "keep") < 20 * F.col("share")) / F.count("*")).alias("score"))
    found = evaluation.against_constants(scores, "budget", "score", {"0.1": 0.1571, "1.0": 0.3423, "2.5": 0.4352})
    return found.select("budget", S.sixth(F.col("score")).alias("score"), "published", S.sixth(F.col("difference")).alias("difference"))


@query(f"""WITH {TRACES}, l AS (SELECT root_service, count(*) AS total, count(*) FILTER (WHERE {KEEP}) AS kept FROM tp GROUP BY root_service)
  SELECT 'svc/' || root_service AS endpoint, kept, total, row_number() OVER (ORDER BY round(100.0 * kept / total, 2) DESC, 'svc/' || root_service) AS rank FROM l""")
def endpoints_of_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoint lines written into report texts and read back out of them, the first line of an endpoint counting."""
    sums = points(spark, sf_dir).groupBy("root_service").agg(F.count("*").alias("total"), F.count_if(_kept()).alias("kept"))
    line = F.format_string("- svc/%s: kept %d of %d", "root_service", "kept", "total")
    reports = sums.select(F.concat(F.lit("# report\n"), line, F.lit("\nother text\n- svc/"), "root_service", F.lit(": kept 0 of 1\n")).alias("text"))
    found = evaluation.endpoint_lines(reports, "text")
    ranked = found.withColumn("score", F.round(100.0 * F.col("kept") / F.col("total"), 2))
    from ..operators import rca

    return rca.ranked(ranked, name="endpoint", digits=2).select("endpoint", "kept", "total", "rank")


@query(f"""WITH {TRACES}, o AS (SELECT trace_id, sec, root_service, has_error, start_ns, count(*) OVER w AS n, coalesce(sum(has_error::INT) OVER w, 0)::BIGINT AS e FROM tp WINDOW w AS (ORDER BY start_ns, trace_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  s AS (SELECT trace_id, row_number() OVER (PARTITION BY root_service, sec // 60 ORDER BY start_ns, trace_id) AS same FROM tp)
  SELECT trace_id, n AS prior, CASE WHEN n > 0 THEN round(e / n, 6) ELSE 0 END AS error_mean, same AS same_minute FROM o JOIN s USING (trace_id)""")
def error_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of all error flags before a trace, and how many traces of its service its minute has had, itself included."""
    rows = points(spark, sf_dir).select("trace_id", "sec", F.col("root_service").alias("service"), "start_ns", "has_error")
    found = windows.error_mean(rows)
    same = windows.same_moment(rows, 60)
    return found.join(same, "trace_id").select("trace_id", "prior", S.sixth(F.col("error_mean")).alias("error_mean"), F.col("same").alias("same_minute"))


@query(f"""WITH {TRACES}, p AS (SELECT root_service, count(*) OVER w AS prior, coalesce(sum(has_error::INT) OVER w, 0) AS errors FROM tp WINDOW w AS (PARTITION BY root_service ORDER BY start_ns, trace_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  r AS (SELECT CASE WHEN prior > 0 THEN errors / prior ELSE 0 END AS rate FROM p WHERE prior > 8) SELECT round(quantile_cont(rate, 0.65), 6) AS p65, round(quantile_cont(rate, 0.55), 6) AS p55, round(quantile_cont(rate, 0.5), 6) AS p50, round(quantile_cont(rate, 0.6), 6) AS p60 FROM r""")
def suspicious_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by budget of the whole history of the services' error rates."""
    rows = points(spark, sf_dir).select("trace_id", F.col("root_service").alias("service"), "start_ns", "has_error")
    rates = windows.suspicious(rows).where("prior > 8").select((F.col("prior_errors") / F.greatest("prior", F.lit(1))).alias("rate"))
    found = ordering.quantiles(rates, [], "rate", {f"p{q}": ("linear", q / 100) for q in (65, 55, 50, 60)})
    return found.select(*[S.sixth(F.col(f"p{q}")).alias(f"p{q}") for q in (65, 55, 50, 60)])


@query(f"""WITH {TRACES}, s AS (SELECT trace_id, 16 * (sec // 3600) AS x, lower(md5(trace_id)) AS id, 0.01 * duration_ms / 1000 + 0.5 * span_count + 10 * has_error::INT AS score, has_error, sec // 3600 AS bin FROM tp),
  b AS (SELECT range AS bin FROM range((SELECT min(bin) FROM s), (SELECT max(bin) + 1 FROM s))),
  w AS (SELECT b.bin, quantile_cont(score, 0.6) FILTER (WHERE s.bin > b.bin - 5) AS short, quantile_cont(score, 0.6) AS long, count(score) AS long_n FROM b LEFT JOIN s ON s.bin BETWEEN b.bin - 29 AND b.bin GROUP BY b.bin),
  v AS (SELECT bin, long_n, 0.3 * short + 0.7 * long AS t FROM w), u AS (SELECT bin, long_n, coalesce(last_value(t IGNORE NULLS) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING), 5.0) AS threshold FROM v)
  SELECT trace_id, round(threshold, 5) AS threshold, has_error OR round(score, 5) > round(threshold, 5) OR round(score, 5) = round(threshold, 5) AND ('0x' || id[17:32])::UBIGINT::DOUBLE / 18446744073709551615.0 <= least(greatest(40 / (long_n / 30.0), 0.05), 1) AS kept FROM s JOIN u USING (bin)""")
def dual_window_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which traces a threshold from a short and a long window keeps. Bins without traces go on with the last threshold;
    failed traces stay, scores at the threshold are decided by the id's hash and the rate wanted."""
    score = 0.01 * F.col("duration_ms") / 1000 + 0.5 * F.col("span_count") + 10 * F.col("has_error").cast("int")
    rows = points(spark, sf_dir).select("trace_id", F.floor(F.col("sec") / 3600).alias("bin"), score.alias("score"), "has_error", F.md5(F.col("trace_id").cast("binary")).alias("id"))
    found = windows.dual_thresholds(rows, short=5, long=30, q=0.6, mix=0.3)
    wanted = S.clamp(40 / (F.col("long_n") / 30.0), 0.05, 1.0)
    at, mine = F.round("threshold", 5), F.round("score", 5)
    kept = F.col("has_error") | (mine > at) | ((mine == at) & F.coalesce(compare.tie_share(F.col("id")) <= wanted, F.lit(False)))
    return rows.join(found, "bin").select("trace_id", at.alias("threshold"), kept.alias("kept"))


@query(f"""WITH {TRACES} SELECT count(*) AS traces, max(sec) - min(sec) + 1 AS seconds, round(count(*) / (max(sec) - min(sec) + 1), 9) AS per_second FROM tp""")
def average_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = points(spark, sf_dir).agg(F.count("*").alias("traces"), (F.max("sec") - F.min("sec") + 1).alias("seconds"))
    return found.select("traces", "seconds", F.round(F.col("traces") / F.col("seconds"), 9).alias("per_second"))
