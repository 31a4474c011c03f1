"""Queries that select traces under limits: votes of folded members, backfill and exchange, the trim with live counters, the
calibrated rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import storage
from ..operators import folds, ordering, sampling, selection, traces
from .base import INCIDENTS, TRACES, points, query, spans, uniform
from .ensemble_queries import BUDGET, MEMBER, _members
from .window_queries import FOLDED, FOLDS, LOOKBACK, clustered, keep_sql

SEEDS = (11, 22, 33)
#: Members' folds: as ``keep_fold``, on the members' probability.
VOTED = f"""{MEMBER.replace("WITH ", "WITH RECURSIVE ", 1)}, {FOLDS}, lm AS (SELECT lc.*, md2.p_s AS pm, md2.rca AS rca FROM lc JOIN md2 USING (trace_id)),
{", ".join(keep_sql(str(s), s, "pm", 0.01, 0.20).replace("FROM lc)", "FROM lm)") for s in SEEDS)},
mv AS (SELECT trace_id, has_error, pm, rca, a.kept::INT + b.kept::INT + c.kept::INT AS votes FROM lm JOIN kf11 a USING (i, trace_id) JOIN kf22 b USING (i, trace_id) JOIN kf33 c USING (i, trace_id))"""


def member_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_id, has_error, p_s, rca, votes: how many of three members' folds, run in one pass, keep a trace."""
    rows = _members(spark, sf_dir).select("trace_id", "place", "sec", "services", "duration_ms", "span_count", "has_error", "incident", "near", "z", "p_s", "rca")
    rows = storage.stored(clustered(rows), "members")
    kept = folds.kept_rows(rows, BUDGET / 100, LOOKBACK, SEEDS)
    votes = F.aggregate("kept", F.lit(0), lambda n, k: n + k.cast("int"))
    found = storage.bounded(kept.select("place", votes.alias("votes")), 64)
    return rows.select("trace_id", "place", "has_error", "p_s", "rca").join(found, "place", "left").na.fill(0, ["votes"]).drop("place")


@query(f"{VOTED} SELECT trace_id, votes FROM mv")
def member_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return member_folds(spark, sf_dir).select("trace_id", "votes")


@query(f"""{VOTED}, t AS (SELECT greatest(1, round_even(count(*) * 0.01, 0))::BIGINT AS target, round_even(greatest(1, round_even(count(*) * 0.01, 0)) * 0.1, 0)::BIGINT AS quota FROM mv),
  s AS (SELECT *, CASE WHEN votes >= 2 THEN 2 ELSE votes END AS pool, round(0.6 * pm + 0.4 * rca, 5) AS score FROM mv),
  o AS (SELECT *, row_number() OVER (ORDER BY pool DESC, score DESC, trace_id) AS place, row_number() OVER (PARTITION BY has_error ORDER BY pool DESC, score DESC, trace_id) AS own FROM s),
  g AS (SELECT o.*, target, quota, own <= CASE WHEN has_error THEN round_even(target * 0.18, 0) ELSE round_even(target * 0.38, 0) END AS sure FROM o, t),
  k AS (SELECT *, row_number() OVER (ORDER BY sure DESC, place) <= target AS chosen FROM g),
  w AS (SELECT trace_id, score, row_number() OVER (ORDER BY score, trace_id) AS k FROM k WHERE chosen), y AS (SELECT trace_id, score, row_number() OVER (ORDER BY place) AS k FROM k WHERE NOT chosen),
  x AS (SELECT w.trace_id AS leaves, y.trace_id AS enters FROM w JOIN y USING (k), t WHERE k <= quota AND y.score > w.score),
  n AS (SELECT k.*, (chosen AND trace_id NOT IN (SELECT leaves FROM x)) OR trace_id IN (SELECT enters FROM x) AS now FROM k),
  o2 AS (SELECT *, row_number() OVER (PARTITION BY has_error ORDER BY now DESC, place) AS own2 FROM n), g2 AS (SELECT *, own2 <= CASE WHEN has_error THEN round_even(target * 0.18, 0) ELSE round_even(target * 0.38, 0) END AS sure2 FROM o2),
  f AS (SELECT *, row_number() OVER (ORDER BY sure2 DESC, now DESC, place) AS final FROM g2) SELECT trace_id, has_error, votes, score, chosen AS before FROM f WHERE final <= target""")
def backfilled_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly the budget: traces in pools by votes, floors of clean and failed ones first, filled up from the next pools; then
    the worst tenth exchanged for better ones outside, and the floors applied again."""
    rows = member_folds(spark, sf_dir)
    rows = storage.stored(rows.select("trace_id", "has_error", "votes", F.least("votes", F.lit(2)).alias("pool"), F.round(0.6 * F.col("p_s") + 0.4 * F.col("rca"), 5).alias("score")), "pools")
    target = max(1, round(rows.count() * BUDGET / 100))
    order = (F.desc("pool"), F.desc("score"), F.col("trace_id"))
    # A class gives at most the target, and the exchange no more than that; what it enters or leaves lies in the first two targets.
    rows = storage.stored(selection.foremost(rows, 2 * target, ["has_error"], "pool", "score"), "foremost")
    first = sampling.guarded(rows, target, BUDGET, *order).select("trace_id", F.lit(True).alias("_in"))
    chosen = storage.stored(rows.join(first, "trace_id", "left").withColumn("chosen", F.coalesce("_in", F.lit(False))).drop("_in"), "chosen")
    now = selection.exchanged(chosen, round(target * 0.1), *order)
    now = storage.stored(now.join(chosen.select("trace_id", F.col("chosen").alias("before")), "trace_id"), "exchanged")
    final = sampling.guarded(now, target, BUDGET, F.desc("chosen"), *order)
    return final.select("trace_id", "has_error", "votes", "score", "before")


TRIM = f"""wi AS (SELECT sid, st - 43200 AS st, ed + 43200 AS ed, row_number() OVER (ORDER BY sid) AS s FROM inc), kp AS (SELECT trace_id FROM tp WHERE {uniform("trace_id", "'trim'")} < 0.1),
mb AS MATERIALIZED (SELECT trace_id, list(s ORDER BY s) AS ss FROM tp JOIN wi ON sec BETWEEN st AND ed GROUP BY 1), un AS (SELECT tp.trace_id, has_error, duration_ms, span_count, s, kp.trace_id IS NOT NULL AS k FROM tp JOIN mb USING (trace_id) LEFT JOIN kp USING (trace_id), unnest(mb.ss) u(s)),
ne AS (SELECT s, count(*) FILTER (WHERE k) AS n FROM un GROUP BY s), ad AS (SELECT trace_id, row_number() OVER (PARTITION BY un.s ORDER BY has_error DESC, duration_ms DESC, span_count DESC, trace_id DESC) AS own, n FROM un JOIN ne USING (s) WHERE NOT k AND n < 12),
al AS (SELECT trace_id FROM kp UNION SELECT trace_id FROM ad WHERE own <= 12 - n), od AS MATERIALIZED (SELECT trace_id, coalesce(ss, []) AS ss, row_number() OVER (ORDER BY has_error, duration_ms, span_count, coalesce(len(ss), 0), trace_id) AS place FROM al JOIN tp USING (trace_id) LEFT JOIN mb USING (trace_id)),
cn AS (SELECT list(coalesce(n, 0) ORDER BY s) AS c FROM wi LEFT JOIN (SELECT s, count(*) AS n FROM od, unnest(ss) u(s) GROUP BY s) USING (s)),
lp AS (SELECT 0::BIGINT AS place, NULL::VARCHAR AS trace_id, false AS goes, c FROM cn UNION ALL SELECT place, trace_id, goes, CASE WHEN goes THEN list_transform(c, lambda v, j: v - list_contains(ss, j)::INT) ELSE c END
  FROM (SELECT od.*, c, len(list_filter(ss, lambda x: c[x] <= 12)) = 0 AS goes FROM lp JOIN od ON od.place = lp.place + 1)),
tn AS (SELECT place, trace_id, goes, row_number() OVER (ORDER BY goes DESC, place) AS turn FROM lp WHERE place > 0), ex AS (SELECT greatest(0, (SELECT count(*) FROM od) - (SELECT greatest(1, least(count(*), round_even(count(*) * 0.06, 0))) FROM tp)) AS e)"""


@query(f"WITH RECURSIVE {TRACES}, {INCIDENTS}, {TRIM} SELECT trace_id, place, NOT goes AS sure FROM tn, ex WHERE turn > e")
def scenario_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the traces, topped up to twelve in each incident's day, then trimmed to six percent of all while the incidents'
    days, which overlap, keep twelve each."""
    s = spans(spark, sf_dir)
    tp = storage.stored(traces.trace_points(s).select("trace_id", "sec", "has_error", "duration_ms", "span_count"), "points")
    windows = traces.incidents(s).select("sid", (F.col("st") - 43_200).alias("st"), (F.col("ed") + 43_200).alias("ed"))
    members = storage.stored(traces.membership(tp, windows).select("trace_id", F.explode("sids").alias("sid")).join(tp, "trace_id"), "days")
    kept = tp.where(S.hash_uniform(F.col("trace_id"), "trim") < 0.1)
    every = selection.topped_up(kept, members, 12, F.desc("has_error"), F.desc("duration_ms"), F.desc("span_count"), F.desc("trace_id"))
    n = members.groupBy("trace_id").agg(F.count("*").alias("n"))
    rows = every.join(tp, "trace_id").join(n, "trace_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = ordering.numbered(rows, [], F.col("has_error"), F.col("duration_ms"), F.col("span_count"), F.col("n"), F.col("trace_id"))
    return selection.trimmed(rows, members, max(1, round(tp.count() * 0.06)), 12).select("trace_id", "place", "sure")


RATE = f"""cr AS (SELECT trace_id, {uniform("trace_id", "'rate'")} * sum(1 + has_error::INT) OVER (PARTITION BY sec // 600) / (1 + has_error::INT) AS critical FROM tp), n AS (SELECT count(*) AS n FROM tp),
sh AS (SELECT unnest([0.001, 0.01, 0.1, 0.9]) AS share), lim AS (SELECT 1.5 * avg(n) AS most FROM (SELECT count(*) AS n FROM tp GROUP BY sec // 600)),
rt AS (SELECT share, most, (SELECT list_sort(list(critical)) FROM cr)[greatest(1, ceil(share * n))::BIGINT] AS rate FROM sh, n, lim)"""


@query(f"""WITH {TRACES}, {RATE} SELECT share::DOUBLE AS share, round(least(rate, most), 6) AS rate, round((SELECT count(*) FROM cr WHERE critical <= least(rate, most)) / n::DOUBLE, 6) AS reached, rate > most AS unreachable FROM rt, n""")
def calibrated_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate (weight kept in ten minutes) that keeps a share of the traces, failed ones twice as likely, up to one and a half times
    what comes in on average."""
    tp = points(spark, sf_dir).select("trace_id", F.floor(F.col("sec") / 600).alias("slot"), (1 + F.col("has_error").cast("int")).alias("w"))
    tp = storage.stored(tp, "rates")
    whole = tp.groupBy("slot").agg(F.sum("w").alias("total"), F.count("*").alias("n"))
    most = 1.5 * whole.agg(F.avg("n")).first()[0]
    rows = tp.join(whole, "slot").select("trace_id", selection.critical_rate(S.hash_uniform(F.col("trace_id"), "rate"), F.col("w"), F.col("total")).alias("critical"))
    rows = storage.stored(rows, "critical")
    out = None
    for share in (0.001, 0.01, 0.1, 0.9):
        one = selection.calibrated(rows, share, most).select(F.lit(share).alias("share"), S.sixth(F.col("rate")).alias("rate"), S.sixth(F.col("reached")).alias("reached"), "unreachable")
        out = one if out is None else out.unionByName(one)
    return out
