"""Queries that rank root causes scenario by scenario."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluation, traces, walks
from .base import INCIDENTS, TRACES, query, spans

#: The walk as a linear map with a node 1 that gives every step its restart, run for a fixed number of steps.
CAUSES = f"""so AS MATERIALIZED (SELECT *, lag(op) OVER (PARTITION BY trace_id ORDER BY start_us, span_id) AS up FROM (SELECT trace_id, span_id, start_us, service, service || '_' || coalesce(props->>'$.k', 'none') AS op, weight AS d FROM sp)),
sd AS MATERIALIZED (SELECT sid, 'i' AS side, trace_id, start_ns FROM inc JOIN tp ON sec BETWEEN st AND ed UNION ALL SELECT sid, 'n', trace_id, start_ns FROM inc JOIN tp ON sec BETWEEN st - 1800 AND st - 1),
sb AS (SELECT sid, CASE WHEN bool_or(side = 'n') THEN 'n' ELSE 'i' END AS side FROM sd GROUP BY sid),
sl AS (SELECT sid, op, round(avg(d), 4) AS mean, round(stddev_pop(d), 4) AS std FROM sd JOIN sb USING (sid, side) JOIN so USING (trace_id) GROUP BY sid, op),
av AS (SELECT sid, trace_id, start_ns, sum(d) > sum(coalesce(mean, 1.0) + coalesce(std, 0.1)) + {walks.SLACK} AS bad FROM sd JOIN so USING (trace_id) LEFT JOIN sl USING (sid, op) WHERE side = 'i' GROUP BY ALL),
nn AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY sid) AS n, count(*) FILTER (WHERE bad) OVER (PARTITION BY sid) AS nb, row_number() OVER (PARTITION BY sid ORDER BY start_ns, trace_id) AS r FROM av),
mem AS MATERIALIZED (SELECT sid, 'a' AS part, trace_id FROM nn WHERE bad OR nb = 0 AND r <= greatest(1, n // 3) UNION ALL SELECT sid, 'n', trace_id FROM nn WHERE NOT bad UNION ALL SELECT sid, 'n', trace_id FROM nn WHERE nb = n AND r > greatest(1, n // 3)
  UNION ALL SELECT sid, 'n', trace_id FROM sd WHERE side = 'n' AND sid IN (SELECT sid FROM nn WHERE nb = n AND n <= greatest(1, n // 3))),
wh AS (SELECT sid FROM mem GROUP BY sid HAVING count(DISTINCT part) = 2),
pr AS MATERIALIZED (SELECT DISTINCT sid, part, trace_id, op FROM mem JOIN wh USING (sid) JOIN so USING (trace_id)),
hl AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY sid, part, trace_id) AS k, count(*) OVER (PARTITION BY sid, part, op) AS m FROM pr),
ts AS (SELECT sid, part, sum(1.0 / k) AS total FROM (SELECT DISTINCT sid, part, trace_id, k FROM hl) GROUP BY ALL),
ce AS (SELECT sid, part, up AS f, op, count(*) AS n FROM mem JOIN wh USING (sid) JOIN so USING (trace_id) WHERE up IS NOT NULL GROUP BY ALL),
mv AS MATERIALIZED (SELECT sid, part, f, t, sum(w) AS w FROM (SELECT a.sid, a.part, a.op AS f, b.op AS t, 0.85 * 0.85 / (b.k * a.m) AS w FROM hl a JOIN hl b ON a.sid = b.sid AND a.part = b.part AND a.trace_id = b.trace_id
    UNION ALL SELECT sid, part, f, op, 0.85 * 0.01 * n / sum(n) OVER (PARTITION BY sid, part, f) FROM ce UNION ALL SELECT sid, part, '1', op, 0.85 * 0.15 / (k * k * total) FROM hl JOIN ts USING (sid, part) UNION ALL SELECT DISTINCT sid, part, '1', '1', 1.0 FROM hl) GROUP BY ALL),
wk AS (SELECT 0 AS step, sid, part, t AS node, w AS s FROM mv WHERE f = '1' UNION ALL SELECT step + 1, wk.sid, wk.part, mv.t, sum(w * s) FROM wk JOIN mv ON wk.sid = mv.sid AND wk.part = mv.part AND wk.node = mv.f WHERE step < {walks.MOST} GROUP BY ALL),
sc AS (SELECT sid, part, node AS op, s / sum(s) OVER (PARTITION BY sid, part) AS score FROM wk WHERE step = {walks.MOST} AND node <> '1'),
sm AS (SELECT sc.*, m FROM sc JOIN (SELECT DISTINCT sid, part, op, m FROM hl) USING (sid, part, op)), bn AS (SELECT sid, count(*) AS bad_n FROM mem WHERE part = 'a' GROUP BY sid),
sy AS (SELECT sid, op, bad_n, a.score AS a, a.m AS am, g.score AS g, g.m AS gm FROM (SELECT * FROM sm WHERE part = 'a') a FULL JOIN (SELECT * FROM sm WHERE part = 'n') g USING (sid, op) JOIN bn USING (sid)),
sx AS (SELECT sid, op, CASE WHEN a IS NULL THEN 1e-7 ELSE a * am END AS ef, CASE WHEN a IS NULL THEN 1e-7 ELSE a * (bad_n - am) END AS nf, CASE WHEN a IS NULL THEN (1 + g) * gm WHEN g IS NULL THEN 1e-7 ELSE g * gm END AS ep FROM sy),
sq AS (SELECT sid, split_part(op, '_', 1) AS candidate, sum(CASE WHEN ep + nf > 0 THEN ef * ef / (ep + nf) ELSE 0 END) AS score, 'walk' AS mode FROM sx GROUP BY ALL
  UNION ALL SELECT sid, service, sum(d), 'latency' FROM sd JOIN so USING (trace_id) WHERE side = 'i' AND sid NOT IN (SELECT sid FROM wh) GROUP BY ALL),
rc AS (SELECT sid, candidate, score, mode, row_number() OVER (PARTITION BY sid ORDER BY round(score, 5) DESC, candidate) AS rank FROM sq)"""
ALL = f"WITH RECURSIVE {TRACES}, {INCIDENTS}, {CAUSES}"


def causes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Incidents, and their ranked causes. An event's operation is its service and key, its parent the event before it in
    its trace, its weight its duration."""
    s = spans(spark, sf_dir)
    op = F.concat_ws("_", "service", F.coalesce(F.get_json_object("props", "$.k"), F.lit("none")))
    before = F.lag("span_id").over(Window.partitionBy("trace_id").orderBy("start_us", "span_id"))
    steps = s.select("trace_id", "span_id", before.alias("parent_id"), op.alias("op"), F.col("weight").alias("duration"))
    windows = traces.incidents(s)
    return windows, walks.root_causes(traces.trace_points(s), steps, windows)


@query(f"{ALL} SELECT sid, candidate, round(score, 5) AS score, mode, rank FROM rc")
def scenario_root_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each incident's services ranked by walks over its own traces, or by latency where they cannot be parted."""
    return causes(spark, sf_dir)[1].select("sid", "candidate", F.round("score", 5).alias("score"), "mode", "rank")


@query(f"""{ALL}, e AS (SELECT inc.sid, rank FROM inc LEFT JOIN rc ON inc.sid = rc.sid AND inc.service = rc.candidate)
  SELECT count(*) AS scenarios, round(avg((coalesce(rank, 99) <= 1)::INT), 6) AS a1, round(avg((coalesce(rank, 99) <= 3)::INT), 6) AS a3, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM e""")
def scenario_root_causes_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the true service comes first, among the first three, and its mean reciprocal rank."""
    windows, found = causes(spark, sf_dir)
    return evaluation.scores(evaluation.placed(windows.withColumnRenamed("service", "truth"), found))
