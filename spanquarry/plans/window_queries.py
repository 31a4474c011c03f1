"""Queries with windows and sampling scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import storage
from ..operators import folds, ordering, retention, sampling, traces, windows
from .base import INCIDENTS, TRACES, points, query, spans, uniform

LOOKBACK = 3600
STATS = f"""st AS (SELECT a.trace_id, count(b.trace_id) AS n, coalesce(avg(b.has_error::INT), 0) AS m, CASE WHEN count(b.trace_id) > 1 THEN stddev_pop(b.has_error::INT) ELSE 0 END AS s,
  coalesce(avg(b.span_count), 0) AS cm, CASE WHEN count(b.trace_id) > 1 THEN stddev_pop(b.span_count) ELSE 0 END AS cs
  FROM tp a LEFT JOIN tp b ON b.sec >= a.sec - {LOOKBACK - 1} AND (b.start_ns < a.start_ns OR b.start_ns = a.start_ns AND b.trace_id < a.trace_id) GROUP BY a.trace_id)"""


@query(f"WITH {TRACES}, {STATS} SELECT trace_id, n, round(m, 6) AS error_mean, round(s, 6) AS error_std, round(cm, 6) AS span_mean, round(cs, 6) AS span_std FROM st")
def lookback_stats_mixed_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.lookback_stats(points(spark, sf_dir), LOOKBACK, {"error": F.col("has_error").cast("int"), "span": F.col("span_count")})
    return found.select("trace_id", "n", *[S.sixth(F.col(c)).alias(c) for c in ("error_mean", "error_std", "span_mean", "span_std")])


@query(f"""WITH {TRACES}, h AS (SELECT trace_id, root_service, count(*) OVER w AS n, list(duration_ms) OVER w AS l FROM tp WINDOW w AS (PARTITION BY root_service ORDER BY start_ns, trace_id ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
  m AS (SELECT *, list_aggregate(l, 'median') AS med FROM h)
  SELECT trace_id, n AS history_count, round(med, 6) AS med, round(list_aggregate(list_transform(l, lambda x: abs(x - med)), 'median'), 6) AS mad FROM m""")
def service_history_median_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).select("trace_id", F.col("root_service").alias("service"), "start_ns", "duration_ms")
    return windows.service_history(rows, "duration_ms").select("trace_id", "history_count", S.sixth(F.col("med")).alias("med"), S.sixth(F.col("mad")).alias("mad"))


@query(f"""WITH {TRACES}, c AS (SELECT service, sec // 3600 AS bin, count(*) AS n FROM sp GROUP BY 1, 2), t AS (SELECT *, ln(1 + n) AS thr FROM c),
  w AS (SELECT *, list(thr) OVER (PARTITION BY service ORDER BY bin ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS l FROM t),
  e AS (SELECT *, list_reduce(list_concat([0.0], l), lambda a, x: 0.2 * x + 0.8 * a) AS ema FROM w)
  SELECT service, bin, n, round(thr, 6) AS thr, round(ema, 6) AS ema, round(thr - ema, 6) AS burst FROM e""")
def service_ema_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = spans(spark, sf_dir).groupBy("service", F.floor(F.col("sec") / 3600).alias("bin")).agg(F.count("*").alias("n"))
    return windows.ema_burst(series).select("service", "bin", "n", *[S.sixth(F.col(c)).alias(c) for c in ("thr", "ema", "burst")])


@query(f"""WITH {TRACES}, p AS (SELECT trace_id, root_service, count(*) OVER w AS prior, coalesce(sum(has_error::INT) OVER w, 0)::BIGINT AS prior_errors FROM tp
  WINDOW w AS (PARTITION BY root_service ORDER BY start_ns, trace_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT trace_id, prior, prior_errors, prior > 8 AND prior_errors > 0.15 * prior AS suspicious, round(1 / sqrt(prior + 1), 6) AS rarity FROM p""")
def suspicious_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).select("trace_id", F.col("root_service").alias("service"), "start_ns", "has_error")
    return windows.suspicious(rows).select("trace_id", "prior", "prior_errors", "suspicious", S.sixth(1 / F.sqrt(F.col("prior") + 1)).alias("rarity"))


@query(f"""WITH {TRACES} SELECT a.trace_id, round(avg(b.has_error::INT), 6) AS density FROM tp a JOIN tp b ON b.sec BETWEEN a.sec - 1800 AND a.sec + 1800 GROUP BY a.trace_id""")
def local_error_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.local_density(points(spark, sf_dir), 1800).select("trace_id", S.sixth(F.col("density")).alias("density"))


BINS = f"""bins AS (SELECT sec // 3600 AS bin, count(*) AS n, sum(has_error::INT)::BIGINT AS errors, count(*) FILTER (WHERE {uniform("trace_id", "'keep'")} < 0.3) AS sampled,
  quantile_cont(duration_ms, 0.95) AS p95, min(duration_ms) FILTER (WHERE NOT has_error AND {uniform("trace_id", "'keep'")} < 0.3) AS least FROM tp GROUP BY 1)"""


def bins_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).select("trace_id", "has_error", "duration_ms", F.floor(F.col("sec") / 3600).alias("bin"))
    rows = storage.stored(rows, "bins")
    kept = S.hash_uniform(F.col("trace_id"), "keep") < 0.3
    counts = rows.groupBy("bin").agg(F.count("*").alias("n"), F.count_if("has_error").alias("errors"), F.count_if(kept).alias("sampled"), F.min(F.when(kept & ~F.col("has_error"), F.col("duration_ms"))).alias("least"))
    p95 = ordering.quantiles(rows.select("bin", "duration_ms"), ["bin"], "duration_ms", {"p95": ("linear", 0.95)}).select("bin", "p95")
    return counts.join(p95, "bin").select("bin", "n", "errors", "sampled", "p95", "least")


@query(f"WITH {TRACES}, {BINS} SELECT bin, n, errors, sampled, round(p95, 6) AS p95, round(least, 6) AS least FROM bins")
def ab_per_secondbins_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins_of(spark, sf_dir).select("bin", "n", "errors", "sampled", S.sixth(F.col("p95")).alias("p95"), S.sixth(F.col("least")).alias("least"))


@query(f"""WITH {TRACES}, {BINS} SELECT bin, errors > 0.6 * n AS raw, max((errors > 0.6 * n)::INT) OVER (ORDER BY bin RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) = 1 AS "on" FROM bins""")
def incident_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.hysteresis(bins_of(spark, sf_dir), F.col("errors") > 0.6 * F.col("n"), 6).select("bin", "raw", "on")


@query(f"""WITH {TRACES}, {BINS}, h AS (SELECT bin, errors > 0.4 * n AS above, lead(errors > 0.4 * n, 1) OVER (ORDER BY bin) AND lead(errors > 0.4 * n, 2) OVER (ORDER BY bin) AS next FROM bins)
  SELECT bin, above, above AND coalesce(next, false) AS detected FROM h""")
def hold_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.held(bins_of(spark, sf_dir), F.col("errors") > 0.4 * F.col("n"), 3).select("bin", "above", "detected")


@query(f"""WITH {TRACES}, {BINS}, l AS (SELECT bin, n, p95, lag(p95) OVER (ORDER BY bin) AS b FROM bins) SELECT count(*) AS bins, round(stddev_pop(p95) / avg(p95) * 100, 6) AS volatility_pct, round(max(CASE WHEN b > 0 THEN abs(p95 - b) / b END), 6) AS max_step FROM l""")
def threshold_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.steps(bins_of(spark, sf_dir), "p95")
    return rows.agg(F.count("*").alias("bins"), S.sixth(F.stddev_pop("p95") / F.avg("p95") * 100).alias("volatility_pct"), S.sixth(F.max("step")).alias("max_step"))


@query(f"""WITH {TRACES}, s AS (SELECT trace_id, sec // 3600 AS bin, 0.01 * duration_ms / 1000 + 0.5 * span_count + 10 * has_error::INT AS score FROM tp),
  b AS (SELECT DISTINCT bin FROM s), w AS (SELECT b.bin, count(*) FILTER (WHERE s.bin > b.bin - 5) AS short_n, quantile_cont(score, 0.7) FILTER (WHERE s.bin > b.bin - 5) AS short, quantile_cont(score, 0.7) AS long, count(*) AS long_n FROM b JOIN s ON s.bin BETWEEN b.bin - 29 AND b.bin GROUP BY b.bin)
  SELECT bin, short_n, long_n, round(0.3 * short + 0.7 * long, 6) AS threshold FROM w""")
def dual_window_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = 0.01 * F.col("duration_ms") / 1000 + 0.5 * F.col("span_count") + 10 * F.col("has_error").cast("int")
    rows = points(spark, sf_dir).select(F.floor(F.col("sec") / 3600).alias("bin"), score.alias("score"))
    counts = rows.groupBy("bin", "score").agg(F.count("*").alias("c"))  # equal scores are counted before they go into 30 windows
    spread = counts.withColumn("at", F.explode(F.sequence("bin", F.col("bin") + 29)))
    short = F.when(F.col("bin") > F.col("at") - 5, F.col("c"))
    by_score = spread.groupBy("at", "score").agg(F.coalesce(F.sum(short), F.lit(0)).alias("short_c"), F.sum("c").alias("c"))
    found = by_score.groupBy("at").agg(F.sum("short_c").alias("short_n"), F.sum("c").alias("long_n"), F.percentile(F.when(F.col("short_c") > 0, F.col("score")), F.lit(0.7), F.greatest("short_c", F.lit(1))).alias("s"), F.percentile("score", F.lit(0.7), F.col("c")).alias("l"))
    present = counts.select(F.col("bin").alias("at")).distinct()
    return found.join(present, "at", "left_semi").select(F.col("at").alias("bin"), "short_n", "long_n", S.sixth(0.3 * F.col("s") + 0.7 * F.col("l")).alias("threshold"))


SCORED = f"""lat AS (SELECT trace_id, sec, start_ns, has_error, span_count, duration_ms, services, root_service, 0.7 * (duration_ms - lo) / (hi - lo) + 0.3 * (span_count - slo) / (shi - slo)::DOUBLE AS latency
  FROM tp, (SELECT min(duration_ms) AS lo, max(duration_ms) AS hi, min(span_count) AS slo, max(span_count) AS shi FROM tp)),
  anchor AS (SELECT min(st) AS first_s FROM inc), causes AS (SELECT list(DISTINCT service) AS c FROM inc),
  scored AS (SELECT l.*, list_has_any(services, c) AS incident, exp(-abs(l.sec - first_s) / 86400.0) AS near, abs(l.has_error::INT - m) / (s + 1e-6) AS z FROM lat l JOIN st USING (trace_id), anchor, causes),
  prob AS (SELECT *, least(greatest(0.55 * (0.45 * incident::INT + 0.25 * latency + 0.15 * has_error::INT + 0.15 * near) + 0.45 * tanh(1.2 * 0.4 * z), 0.02), 0.98) AS p FROM scored)"""


def marked(s: DataFrame, tp: DataFrame) -> DataFrame:
    """Traces with latency, incident (they touch an incident's cause) and nearness to the first incident."""
    facts = traces.incidents(s).agg(F.min("st").alias("at"), F.collect_set("service").alias("causes"))
    rows = retention.latency(tp).crossJoin(F.broadcast(facts))  # one row
    return rows.withColumn("incident", F.arrays_overlap("services", "causes")).withColumn("near", windows.proximity(F.col("sec"), F.col("at"), 86400)).drop("at", "causes")


def probabilities(spark: SparkSession, sf_dir: str, tp: DataFrame | None = None) -> DataFrame:
    """Traces (those given, if they are at hand) with incident, latency, nearness to the first incident, error shock z and
    sampling probability p."""
    s = spans(spark, sf_dir)
    tp = storage.stored(traces.trace_points(s), "points") if tp is None else tp
    stats = windows.lookback_stats(tp, LOOKBACK, {"error": F.col("has_error").cast("int")})
    error = F.col("has_error").cast("int")
    rows = marked(s, tp).join(stats, "trace_id").withColumn("z", error_shock())
    return rows.withColumn("p", windows.base_probability(F.col("incident").cast("int"), F.col("latency"), error, F.col("near"), 0.4 * F.col("z")))


def error_shock() -> Column:
    return F.abs(F.col("has_error").cast("int") - F.col("error_mean")) / (F.col("error_std") + 1e-6)


@query(f"WITH {TRACES}, {INCIDENTS}, {STATS}, {SCORED} SELECT trace_id, incident, round(latency, 5) AS latency, round(near, 5) AS near, round(p, 5) AS p FROM prob")
def sampling_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probabilities(spark, sf_dir).select("trace_id", "incident", *[F.round(c, 5).alias(c) for c in ("latency", "near", "p")])


@query(f"""WITH {TRACES}, n AS (SELECT greatest(1, least(count(*), round_even(count(*) * 0.025, 0)))::BIGINT AS target, count(*) AS n, sum(has_error::INT) AS e FROM tp), q AS (SELECT target, least(e, round_even(target * e / n, 0)) AS quota FROM n),
  r AS (SELECT trace_id, has_error, row_number() OVER (PARTITION BY has_error ORDER BY duration_ms DESC, span_count DESC, trace_id DESC) AS place FROM tp)
  SELECT trace_id, has_error, place FROM r, q WHERE place <= CASE WHEN has_error THEN quota ELSE target - quota END""")
def strict_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.strict_cap(points(spark, sf_dir), 0.025).select("trace_id", "has_error", F.col("place").cast("long").alias("place"))


#: The folds as recursion, a trace a step. ld: the leaders alive; kf: counts and the kept traces of the lookback.
FOLDS = f"""fr AS MATERIALIZED (SELECT row_number() OVER (ORDER BY start_ns, trace_id) AS i, trace_id, sec, has_error, incident, near, z >= 3 AS alarm, p,
  list_concat(list_transform(services, lambda x: 'svc:' || x), [CASE WHEN duration_ms < 100 THEN 'dur:a' WHEN duration_ms < 500 THEN 'dur:b' WHEN duration_ms < 2000 THEN 'dur:c' ELSE 'dur:d' END,
    CASE WHEN span_count <= 3 THEN 'span:a' WHEN span_count <= 8 THEN 'span:b' WHEN span_count <= 20 THEN 'span:c' ELSE 'span:d' END]) AS toks FROM prob),
ld AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS trace_id, NULL::BIGINT AS cluster, NULL::DOUBLE AS similarity, NULL::BIGINT AS mass, []::STRUCT(id BIGINT, toks VARCHAR[], secs BIGINT[])[] AS living, 0::BIGINT AS founded
  UNION ALL SELECT i, trace_id, CASE WHEN best IS NULL THEN founded ELSE -best.n END, coalesce(best.s, 1.0), CASE WHEN best IS NULL THEN 0 ELSE list_sum(list_transform(alive, lambda x: CASE WHEN x.id = -best.n THEN len(x.secs) ELSE 0 END)) END,
    CASE WHEN best IS NULL THEN list_append(alive, {{'id': founded, 'toks': toks, 'secs': [sec]}}) ELSE list_transform(alive, lambda x: {{'id': x.id, 'toks': x.toks, 'secs': CASE WHEN x.id = -best.n THEN list_append(x.secs, sec) ELSE x.secs END}}) END, founded + (best IS NULL)::BIGINT
  FROM (SELECT *, list_max(list_filter(list_transform(alive, lambda x: {{'s': len(list_intersect(x.toks, toks)) / len(list_distinct(list_concat(x.toks, toks))), 'n': -x.id}}), lambda y: y.s >= 0.5)) AS best
    FROM (SELECT fr.*, founded, list_filter(list_transform(living, lambda x: {{'id': x.id, 'toks': x.toks, 'secs': list_filter(x.secs, lambda t: t > sec - {LOOKBACK})}}), lambda x: len(x.secs) > 0) AS alive FROM ld JOIN fr ON fr.i = ld.i + 1))),
lc AS MATERIALIZED (SELECT fr.*, cluster, similarity, mass, least(greatest(pow(1 + CASE WHEN incident THEN 0.35 ELSE 1.0 END * mass * similarity, -CASE WHEN incident THEN 0.55 ELSE 0.8 END), CASE WHEN incident THEN 0.20 ELSE 0.05 END), 1.0) AS p_d FROM fr JOIN ld USING (i))"""


def keep_sql(tag: str, seed: int, p: str = "p", beta: float = 0.025, floor: float = 0.30) -> str:
    """kf{tag}: i, trace_id, kept of the rows lc."""
    u, v = (uniform("trace_id", f"'{seed}'", f"'{k}'") for k in (1, 2))
    return f"""kr{tag} AS MATERIALIZED (SELECT *, {p} AS ps, {u} AS u, {v} AS v, CASE WHEN incident AND near >= 0.55 THEN {max(0.08, floor - 0.06)} ELSE {floor} END AS floor FROM lc),
kf{tag} AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS trace_id, false AS kept, 0::BIGINT AS n, []::STRUCT(t BIGINT, e BIGINT)[] AS win
  UNION ALL SELECT i, trace_id, keep, n + keep::BIGINT, CASE WHEN keep THEN list_append(win, {{'t': sec, 'e': has_error::BIGINT}}) ELSE win END
  FROM (SELECT *, CASE WHEN n / i > {beta} THEN u < ps AND (alarm OR u < p_d) WHEN NOT (p_d >= 0.72 AND ps < floor) AND u < ps THEN true
      WHEN NOT has_error AND NOT incident AND ps < floor AND p_d <= 0.45 AND 1 - CASE WHEN len(win) > 0 THEN list_sum(list_transform(win, lambda x: x.e)) / len(win) ELSE 0 END < 0.3 THEN v < {beta} ELSE false END AS keep
    FROM (SELECT kr{tag}.*, n, list_filter(win, lambda x: x.t > sec - {LOOKBACK}) AS win FROM kf{tag} JOIN kr{tag} ON kr{tag}.i = kf{tag}.i + 1)))"""


FOLDED = f"WITH RECURSIVE {TRACES}, {INCIDENTS}, {STATS}, {SCORED}, {FOLDS}"


def clustered(rows: DataFrame) -> DataFrame:
    """rows, stored as they are gone over twice, with cluster, similarity, mass, p_d and alarm."""
    rows = storage.stored(rows, "scored")
    found = folds.placed_clusters(rows.withColumn("tokens", sampling.tokens()), LOOKBACK)
    rows = rows.join(found.hint("merge"), "place").withColumn("alarm", F.col("z") >= 3)
    return rows.withColumn("p_d", sampling.diversity(F.col("mass"), F.col("similarity"), F.col("incident")))


@query(f"{FOLDED} SELECT trace_id, cluster, round(similarity, 6) AS similarity, mass FROM lc")
def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(probabilities(spark, sf_dir)).select("trace_id", "cluster", S.sixth(F.col("similarity")).alias("similarity"), "mass")


@query(f"{FOLDED}, {keep_sql('', 7)} SELECT trace_id, kept FROM kf WHERE i > 0")
def keep_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = storage.stored(clustered(probabilities(spark, sf_dir)).withColumn("p_s", F.col("p")), "clustered")
    return folds.keep_fold(rows, 0.025, LOOKBACK, (7,)).select("trace_id", F.get("kept", F.lit(0)).alias("kept"))


@query(f"""WITH {TRACES}, {INCIDENTS}, n AS (SELECT greatest(1, least(count(*), round_even(count(*) * 0.025, 0)))::BIGINT AS target, count(*) AS n, sum(has_error::INT) AS e FROM tp), q AS (SELECT target, least(e, round_even(target * e / n, 0)) AS quota, greatest(1, round_even(n * 0.01, 0)) AS final FROM n),
  r AS (SELECT *, row_number() OVER (PARTITION BY has_error ORDER BY duration_ms DESC, span_count DESC, trace_id DESC) AS r FROM tp), k AS (SELECT trace_id, sec, row_number() OVER (ORDER BY has_error DESC, duration_ms DESC, trace_id) AS place FROM r, q WHERE r <= CASE WHEN has_error THEN quota ELSE target - quota END),
  m AS (SELECT trace_id, sid, row_number() OVER (PARTITION BY sid ORDER BY place) AS own FROM k JOIN inc ON sec BETWEEN st AND ed), u AS (SELECT DISTINCT trace_id FROM m WHERE own <= 1),
  f AS (SELECT trace_id, (u.trace_id IS NOT NULL)::INT AS sure, row_number() OVER (ORDER BY u.trace_id IS NOT NULL DESC, place) AS final_place FROM k LEFT JOIN u USING (trace_id)) SELECT trace_id, sure, final_place FROM f, q WHERE final_place <= final""")
def strict_cap_scenario_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    tp = traces.trace_points(s)
    kept = sampling.strict_cap(tp, 0.025)
    kept = ordering.numbered(kept.select("trace_id", "has_error", "duration_ms"), [], F.desc("has_error"), F.desc("duration_ms"), F.col("trace_id"))
    members = traces.membership(tp, traces.incidents(s)).select("trace_id", F.explode("sids").alias("sid"))
    return sampling.scenario_floor(kept, members, max(1, round(tp.count() * 0.01))).select("trace_id", "sure", "final_place")
