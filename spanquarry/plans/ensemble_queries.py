"""Queries of the sampling ensemble: the traces' state, their evidence, the members' probabilities, votes, and what is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import storage
from ..operators import history, metrics, ordering, retention, sampling, traces, windows
from .base import INCIDENTS, TRACES, points, query, spans, uniform
from .metric_queries import Z, deviations_of
from .trace_queries import METRICS
from .window_queries import LOOKBACK, SCORED, STATS, error_shock, marked, probabilities

BUDGET = 1.0
ONLINE = """tq AS (SELECT trace_id, sec, start_ns, has_error, unnest(services) AS service FROM tp),
pr AS (SELECT trace_id, count(*) OVER w AS prior, coalesce(sum(has_error::INT) OVER w, 0) AS pe FROM tq WINDOW w AS (PARTITION BY service ORDER BY start_ns, trace_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sn AS (SELECT trace_id, bool_or(prior > 8 AND pe > 0.15 * prior) AS hit, avg((prior > 8 AND pe > 0.15 * prior)::INT) AS ratio, avg(1 / sqrt(prior + 1)) AS rarity FROM pr GROUP BY trace_id),
hi AS (SELECT trace_id, has_error, count(*) OVER w AS n, coalesce(sum(has_error::INT) OVER w, 0) AS e FROM tp WINDOW w AS (ORDER BY start_ns, trace_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ol AS (SELECT trace_id, hit, ratio, rarity, CASE WHEN n > 0 THEN e / n ELSE 0 END AS history, 0.65 * hit::INT + 0.35 * abs(has_error::INT - CASE WHEN n > 0 THEN e / n ELSE 0 END) AS contrast,
  CASE WHEN has_error AND hit THEN 0.8 + 0.1 * ratio WHEN NOT has_error AND NOT hit THEN 0.5 WHEN has_error THEN 0.28 ELSE 0.4 END AS rca FROM sn JOIN hi USING (trace_id))"""
EVIDENCE = """ej AS (SELECT tq.trace_id, tq.sec, mz.sec AS m_sec, cpu_z, load_z FROM tq ASOF LEFT JOIN mz ON tq.service = mz.service AND tq.sec >= mz.sec),
ek AS (SELECT trace_id, CASE WHEN sec - m_sec <= 7200 THEN exp(-(sec - m_sec) / 7200.0) END AS fresh, 0.24 * cpu_z + 0.12 * load_z AS strength FROM ej),
el AS (SELECT trace_id, list(strength * fresh ORDER BY strength * fresh DESC) FILTER (WHERE fresh IS NOT NULL) AS v, count(fresh) AS known, count(*) AS asked, coalesce(avg(fresh), 0) AS reliability FROM ek GROUP BY trace_id),
em AS (SELECT trace_id, known / asked AS coverage, reliability, coalesce(0.5 * v[1] + 0.3 * coalesce(v[2], 0) + 0.2 * coalesce(v[3], 0), 0) * known / asked AS evidence FROM el)"""
VOTED = f"""ev AS (SELECT * FROM prob JOIN ol USING (trace_id) JOIN em USING (trace_id)),
  vt AS (SELECT *, ({uniform("trace_id", "'11'", "'0'")} < p)::INT + ({uniform("trace_id", "'22'", "'0'")} < p)::INT + ({uniform("trace_id", "'33'", "'0'")} < p)::INT AS votes FROM ev),
  cons AS (SELECT *, 0.42 * votes / 3 + 0.28 * (0.65 * rca + 0.35 * p) + 0.18 / (1 + exp(1 - evidence)) + 0.12 * (0.6 * rarity + 0.4 * contrast) AS consensus FROM vt)"""
ALL = f"WITH {TRACES}, {INCIDENTS}, {METRICS}, {Z}, {STATS}, {SCORED}, {ONLINE}, {EVIDENCE}, {VOTED}"


@query(f"WITH {TRACES}, {ONLINE} SELECT trace_id, hit, round(ratio, 6) AS ratio, round(rarity, 6) AS rarity, round(history, 6) AS history, round(contrast, 6) AS contrast, round(rca, 6) AS rca FROM ol")
def online_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.online_state(points(spark, sf_dir)).select("trace_id", "hit", *[S.sixth(F.col(c)).alias(c) for c in ("ratio", "rarity", "history", "contrast", "rca")])


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces with their probability, online state, metric evidence, votes and consensus; stored, as several steps use it."""
    s = spans(spark, sf_dir)
    tp = storage.stored(traces.trace_points(s), "points")
    rows = probabilities(spark, sf_dir, tp).select("trace_id", "sec", "start_ns", "has_error", "incident", "latency", "near", "p")
    found = metrics.evidence(tp, deviations_of(s).drop("cpu", "load"), 7200).select("trace_id", "coverage", "reliability", "evidence")
    rows = rows.join(sampling.online_state(tp), "trace_id").join(found, "trace_id")
    return storage.stored(sampling.consensus(rows.withColumn("votes", sampling.votes(rows)), BUDGET), "ensemble")


@query(f"{ALL} SELECT trace_id, votes, round(consensus, 5) AS consensus FROM cons")
def consensus_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble(spark, sf_dir).select("trace_id", "votes", F.round("consensus", 5).alias("consensus"))


MODULATED = """q AS (SELECT quantile_cont(evidence, 0.55) AS tau, greatest(1e-6, stddev_pop(evidence)) AS scale FROM cons),
  sg AS (SELECT cons.*, tau, least(greatest(0.6 * (2 / (1 + exp(-(evidence - tau) / scale)) - 1) * coverage * reliability, -0.75), 0.75) AS delta FROM cons, q)"""


def _modulated(rows: DataFrame) -> DataFrame:
    """rows with delta, the shift of p on the logit scale by the evidence; tau is an exact quantile."""
    tau = ordering.quantiles(rows.select("evidence"), [], "evidence", {"tau": ("linear", sampling.by_budget(sampling.TAU, BUDGET))}).select("tau")
    facts = rows.agg(F.greatest(F.lit(1e-6), F.stddev_pop("evidence")).alias("scale")).crossJoin(F.broadcast(tau))  # one row
    return rows.crossJoin(F.broadcast(facts)).withColumn("delta", sampling.shift(F.col("evidence"), F.col("coverage") * F.col("reliability"), BUDGET, F.col("tau"), F.col("scale"))).drop("tau", "scale")  # one row


@query(f"{ALL}, {MODULATED} SELECT trace_id, round(1 / (1 + exp(-(ln(p / (1 - p)) + delta))), 5) AS p FROM sg")
def signed_modulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _modulated(ensemble(spark, sf_dir))
    return rows.select("trace_id", F.round(S.sigmoid(S.logit(F.col("p")) + F.col("delta")), 5).alias("p"))


GUARDED = f"""{ALL}, t AS (SELECT greatest(1, round_even(count(*) * 0.01, 0))::BIGINT AS target FROM cons),
  o AS (SELECT *, row_number() OVER (ORDER BY votes DESC, round(consensus, 5) DESC, trace_id) AS place, row_number() OVER (PARTITION BY has_error ORDER BY votes DESC, round(consensus, 5) DESC, trace_id) AS own FROM cons),
  g AS (SELECT o.*, target, own <= CASE WHEN has_error THEN round_even(target * 0.18, 0) ELSE round_even(target * 0.38, 0) END AS sure FROM o, t),
  k AS (SELECT *, row_number() OVER (ORDER BY sure DESC, place) AS kept_place FROM g)"""


@query(f"{GUARDED} SELECT trace_id, has_error, sure, votes FROM k WHERE kept_place <= target")
def dual_contrast_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ensemble(spark, sf_dir).select("trace_id", "has_error", "votes", F.round("consensus", 5).alias("consensus"))
    target = max(1, round(rows.count() * BUDGET / 100))
    return sampling.guarded(rows, target, BUDGET, F.desc("votes"), F.desc("consensus"), F.col("trace_id")).select("trace_id", "has_error", "sure", "votes")


@query(f"""{ALL}, {MODULATED}, h AS (SELECT trace_id, votes, 0.4 * votes / 3 + 0.3 * rca + 0.2 * greatest(0, delta) + 0.1 * (contrast > 0.5)::INT AS head FROM sg),
  r AS (SELECT *, row_number() OVER (ORDER BY round(head, 5) DESC, trace_id) AS place FROM h)
  SELECT trace_id, CASE WHEN place = 1 THEN 'head' WHEN votes >= 2 THEN 'consensus' WHEN votes = 1 THEN 'remainder' ELSE 'outside' END AS pool, place FROM r WHERE place <= 50""")
def head_tail_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best traces (the report's length): the head, then pools by votes."""
    rows = _modulated(ensemble(spark, sf_dir))
    head = 0.4 * F.col("votes") / 3 + 0.3 * F.col("rca") + 0.2 * F.greatest(F.lit(0.0), "delta") + 0.1 * (F.col("contrast") > 0.5).cast("int")
    best = rows.select("trace_id", "votes", F.round(head, 5).alias("head")).orderBy(F.desc("head"), "trace_id").limit(50)
    pool = F.when(F.col("place") == 1, "head").when(F.col("votes") >= 2, "consensus").when(F.col("votes") == 1, "remainder").otherwise("outside")
    return ordering.numbered(best, [], F.desc("head"), F.col("trace_id")).select("trace_id", pool.alias("pool"), F.col("place").cast("long").alias("place"))


def _sigma_sql(k: str) -> str:
    return f"CASE WHEN n <= 1 THEN 0 ELSE greatest(list_aggregate({k}, 'stddev_samp'), 1.4826 * list_sort(list_transform({k}, lambda x: abs(x - {k}_med)))[n // 2 + 1]) END"


def _robust_sql(k: str) -> str:
    return f"CASE WHEN n = 0 THEN 1e-6 ELSE greatest(1e-6, list_aggregate({k}, 'stddev_pop'), 1.4826 * list_aggregate(list_transform({k}, lambda x: abs(x - list_aggregate({k}, 'median'))), 'median')) END"


SHOCKED = f"""wl AS (SELECT scored.trace_id, scored.sec, scored.start_ns, scored.has_error::INT::DOUBLE AS e, latency AS l, incident::INT::DOUBLE AS i FROM scored),
wf AS (SELECT a.trace_id, count(b.trace_id) AS n, coalesce(list(b.e) FILTER (WHERE b.trace_id IS NOT NULL), []) AS le, coalesce(list(b.l) FILTER (WHERE b.trace_id IS NOT NULL), []) AS ll, coalesce(list(b.i) FILTER (WHERE b.trace_id IS NOT NULL), []) AS li
  FROM wl a LEFT JOIN wl b ON b.sec >= a.sec - {LOOKBACK - 1} AND (b.start_ns < a.start_ns OR b.start_ns = a.start_ns AND b.trace_id < a.trace_id) GROUP BY a.trace_id),
wm AS (SELECT *, list_sort(le)[n // 2 + 1] AS le_med, list_sort(ll)[n // 2 + 1] AS ll_med, list_sort(li)[n // 2 + 1] AS li_med FROM wf),
ws AS (SELECT trace_id, n, {", ".join(f"coalesce(list_aggregate({k}, 'avg'), 0) AS {k}_mean, {_sigma_sql(k)} AS {k}_sigma, {_robust_sql(k)} AS {k}_robust" for k in ("le", "ll", "li"))} FROM wm),
tz AS (SELECT scored.*, ws.*, 0.40 * abs(has_error::INT - le_mean) / (le_sigma + 1e-6) + 0.35 * abs(latency - ll_mean) / (ll_sigma + 1e-6) + 0.25 * abs(incident::INT - li_mean) / (li_sigma + 1e-6) AS zs,
  0.40 * abs(has_error::INT - le_mean) / (le_robust + 1e-6) + 0.35 * abs(latency - ll_mean) / (ll_robust + 1e-6) + 0.25 * abs(incident::INT - li_mean) / (li_robust + 1e-6) AS zr FROM scored JOIN ws USING (trace_id)),
tp2 AS (SELECT *, least(greatest(0.55 * (0.45 * incident::INT + 0.25 * latency + 0.15 * has_error::INT + 0.15 * near) + 0.45 * tanh(1.08 * zs), 0.02), 0.98) AS ps,
  least(greatest(0.55 * (0.45 * incident::INT + 0.25 * latency + 0.15 * has_error::INT + 0.15 * near) + 0.45 * tanh(1.08 * zr), 0.02), 0.98) AS pr0 FROM tz)"""
_FLOOR = "CASE WHEN incident THEN greatest({p}, CASE WHEN has_error AND near >= 0.55 THEN 0.62 WHEN near >= 0.78 AND latency >= 0.58 THEN 0.56 WHEN near >= 0.88 AND latency >= 0.50 THEN 0.50 ELSE 0 END) ELSE {p} END"


def _flags() -> dict[str, Column]:
    return {"error": F.col("has_error").cast("int"), "lat": F.col("latency"), "inc": F.col("incident").cast("int")}


def _shocked(scale: str) -> Column:
    """A trace's probability before floors, by the shock of errors, latency and incidents in their sigmas (the composite sampler) or
    robust scales (the ensemble's members)."""
    flags = _flags()
    z = sampling.shock({k: (v.cast("double"), F.col(f"{k}_mean"), F.col(f"{k}_{scale}")) for k, v in flags.items()}, {"error": 0.40, "lat": 0.35, "inc": 0.25})
    return windows.base_probability(flags["inc"], flags["lat"], flags["error"], F.col("near"), z, 1.2 * 0.9)


@query(f"WITH {TRACES}, {INCIDENTS}, {STATS}, {SCORED}, {SHOCKED} SELECT trace_id, n, round(ll_mean, 5) AS lat_mean, round(ll_sigma, 5) AS lat_sigma, round({_FLOOR.format(p='ps')}, 5) AS p_s FROM tp2")
def composite_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling probability with the shock of errors, latency and incidents against the lookback, and the incident floors."""
    rows = probabilities(spark, sf_dir).select("trace_id", "sec", "start_ns", "has_error", "latency", "incident", "near")
    rows = rows.join(windows.lookback_sigmas(rows, LOOKBACK, _flags()), "trace_id")
    p = sampling.incident_floor(_shocked("sigma"), F.col("incident"), F.col("has_error"), F.col("near"), F.col("latency"))
    return rows.select("trace_id", "n", F.round("lat_mean", 5).alias("lat_mean"), F.round("lat_sigma", 5).alias("lat_sigma"), F.round(p, 5).alias("p_s"))


MEMBER = f"""{ALL}, {MODULATED}, {SHOCKED},
  mb AS (SELECT sg.trace_id, sg.has_error, sg.rca, sg.incident, sg.near, sg.latency, least(greatest(tp2.pr0 + least(greatest(0.4 * (sg.rca - 0.45), -0.12), 0.20), 0.02), 0.98) AS p1, sg.delta FROM sg JOIN tp2 USING (trace_id)),
  mc AS (SELECT *, least(greatest(1 / (1 + exp(-(ln(p1 / (1 - p1)) + delta))), 0.02), 0.98) AS p2 FROM mb),
  md2 AS (SELECT *, {_FLOOR.format(p='p2')} AS p_s FROM mc)"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces by place with z and rca, and p_s, the probability that the ensemble's members draw against."""
    s = spans(spark, sf_dir)
    tp = storage.stored(traces.trace_points(s).select("trace_id", "start_ns", "sec", "duration_ms", "span_count", "has_error", "services"), "points")
    rows = history.histories(marked(s, tp), deviations_of(s).drop("cpu", "load"), LOOKBACK, 7200, _flags())
    rows = rows.withColumn("z", error_shock()).withColumn("rca", sampling.quadrant(F.col("has_error"), F.col("hit"), F.col("ratio"))).withColumn("p_member", _shocked("robust"))
    rows = rows.select("trace_id", "place", "sec", "services", "duration_ms", "span_count", "has_error", "incident", "latency", "near", "z", "rca", "p_member", "coverage", "reliability", "evidence")
    rows = _modulated(storage.stored(rows, "histories"))
    boosted = S.clamp(F.col("p_member") + S.clamp(0.4 * (F.col("rca") - 0.45), -0.12, 0.20), 0.02, 0.98)
    p = S.clamp(S.sigmoid(S.logit(boosted) + F.col("delta")), 0.02, 0.98)
    return rows.withColumn("p_s", sampling.incident_floor(p, F.col("incident"), F.col("has_error"), F.col("near"), F.col("latency")))


@query(f"{MEMBER} SELECT trace_id, round(p_s, 5) AS p_s FROM md2")
def member_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).select("trace_id", F.round("p_s", 5).alias("p_s"))


@query(f"""{MEMBER}, sc AS (SELECT trace_id, has_error, round(0.7 * p_s + 0.3 * rca, 5) AS score FROM md2), t AS (SELECT greatest(1, round_even(count(*) * 0.01, 0))::BIGINT AS target,
    round_even(greatest(1, round_even(count(*) * 0.01, 0)) * least(greatest(greatest(0.08, 1.4 * avg(has_error::INT)), 0.08), 0.40), 0) AS need FROM sc),
  o AS (SELECT *, row_number() OVER (PARTITION BY has_error ORDER BY score DESC, trace_id) AS own FROM sc), g AS (SELECT o.*, target, has_error AND own <= need AS sure FROM o, t),
  f AS (SELECT *, row_number() OVER (ORDER BY sure DESC, score DESC, trace_id) AS final_place FROM g) SELECT trace_id, sure, score, final_place FROM f WHERE final_place <= target""")
def exact_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A member's traces by score, cut or filled up to exactly the budget with the error floor kept."""
    rows = _members(spark, sf_dir).select("trace_id", "has_error", F.round(0.7 * F.col("p_s") + 0.3 * F.col("rca"), 5).alias("score"))
    rows = storage.stored(rows, "members")
    target = max(1, round(rows.count() * BUDGET / 100))
    return sampling.exact_target(rows, target, F.desc("score"), F.col("trace_id")).select("trace_id", "sure", "score", "final_place")


@query(f"""WITH {TRACES}, s AS (SELECT service, trace_id, duration_ms, has_error, tp.sec FROM tp, unnest(services) u(service)), a AS (SELECT service, count(*) AS n, avg(duration_ms) AS mean, avg(has_error::INT) AS error_rate, quantile_cont(duration_ms, 0.95) - avg(duration_ms) AS burst, count(*) / count(DISTINCT sec // 3600) AS per_hour FROM s GROUP BY service),
  m AS (SELECT median(mean) AS med, greatest(1e-6, stddev_pop(mean)) AS scale FROM a) SELECT service, n, round(mean, 4) AS mean, round(error_rate, 6) AS error_rate, round(burst, 4) AS burst, round(per_hour, 6) AS per_hour, round(1 / (1 + exp(-(mean - med) / scale)), 6) AS level FROM a, m""")
def service_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).select(F.explode("services").alias("service"), "duration_ms", "has_error", "sec")
    found = retention.service_inputs(rows)
    return found.select("service", "n", F.round("mean", 4).alias("mean"), S.sixth(F.col("error_rate")).alias("error_rate"), F.round("burst", 4).alias("burst"), S.sixth(F.col("per_hour")).alias("per_hour"), S.sixth(F.col("level")).alias("level"))


_TOLD = ("p", "evidence", "coverage", "reliability", "rarity", "contrast", "rca", "consensus")


@query(f"""{ALL} SELECT count(*) AS traces, count(*) FILTER (WHERE has_error) AS errors, count(*) FILTER (WHERE incident) AS incidents, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE votes = 0) AS votes0, count(*) FILTER (WHERE votes = 1) AS votes1,
  count(*) FILTER (WHERE votes = 2) AS votes2, count(*) FILTER (WHERE votes = 3) AS votes3, {", ".join(f"round(avg({c}), 5) AS {c}_mean, round(min({c}), 5) AS {c}_min, round(max({c}), 5) AS {c}_max, round(stddev_pop({c}), 5) AS {c}_std" for c in _TOLD)} FROM cons""")
def telemetry_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of counts and moments of everything that the ensemble goes by."""
    rows = ensemble(spark, sf_dir)
    moments = [F.round(f(c), 5).alias(f"{c}_{k}") for c in _TOLD for k, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_pop))]
    return rows.agg(F.count("*").alias("traces"), F.count_if("has_error").alias("errors"), F.count_if("incident").alias("incidents"), F.count_if("hit").alias("hits"), *[F.count_if(F.col("votes") == k).alias(f"votes{k}") for k in range(4)], *moments)
