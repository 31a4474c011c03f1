"""Queries that rank causes and score the rankings. Orders are traces here, their lines spans, suppliers services."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import storage
from ..operators import evaluation, rca, traces
from .base import INCIDENTS, TRACES, points, query, spans, uniform

SLACK = 20.0
OPS = """o AS (SELECT l_orderkey AS trace_id, l_linenumber AS span_id, l_linenumber - 1 AS parent_id, 's' || l_suppkey || '_' || l_returnflag AS op, l_quantity AS duration FROM lineitem),
slo AS (SELECT op, round(avg(duration), 4) AS mean, round(stddev_pop(duration), 4) AS std FROM o GROUP BY op),
tr AS (SELECT trace_id, sum(duration) AS duration, sum(mean + std) AS expected, sum(duration) > sum(mean + std) + 20 AS anomalous FROM o JOIN slo USING (op) GROUP BY trace_id),
ed AS (SELECT p.op AS parent, c.op AS child, count(*) AS n FROM o c JOIN o p ON c.trace_id = p.trace_id AND c.parent_id = p.span_id GROUP BY 1, 2),
pf AS (SELECT op, count(*) / sum(count(*)) OVER () AS pref FROM o WHERE trace_id IN (SELECT trace_id FROM tr WHERE anomalous) GROUP BY op),
sh AS (SELECT parent, child, n / sum(n) OVER (PARTITION BY parent) AS w FROM ed)"""


def _step(k: int) -> str:
    return f""", c{k} AS (SELECT child AS op, sum(w * score) AS came FROM sh JOIN r{k - 1} ON parent = r{k - 1}.op GROUP BY child),
r{k} AS (SELECT coalesce(pf.op, c{k}.op) AS op, 0.15 * coalesce(pref, 0) + 0.85 * coalesce(came, 0) AS score FROM pf FULL JOIN c{k} ON pf.op = c{k}.op)"""


RANKED = OPS + ", r0 AS (SELECT op, pref AS score FROM pf)" + _step(1) + _step(2) + _step(3)
SPECTRUM = RANKED + """, sn AS (SELECT DISTINCT trace_id, op FROM o), ct AS (SELECT op, count(*) FILTER (WHERE anomalous) AS bad, count(*) FILTER (WHERE NOT anomalous) AS good FROM sn JOIN tr USING (trace_id) GROUP BY op),
x AS (SELECT op, CASE WHEN bad * score = 0 THEN 1e-7 ELSE bad * score END AS ef, CASE WHEN good * score = 0 THEN 1e-7 ELSE good * score END AS ep, CASE WHEN (a - bad) * score = 0 THEN 1e-7 ELSE (a - bad) * score END AS nf
  FROM ct JOIN r3 USING (op), (SELECT count(*) FILTER (WHERE anomalous) AS a FROM tr))"""


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    op = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit("_"), F.col("l_returnflag"))
    return line.select(F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").alias("span_id"), (F.col("l_linenumber") - 1).alias("parent_id"), op.alias("op"), F.col("l_quantity").alias("duration"))


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = ops(spark, sf_dir)
    t = rca.anomalous(s, rca.slo(s), SLACK)
    return s, t, rca.pagerank(rca.call_edges(s), rca.preference(s, t))


@query(f"WITH {OPS} SELECT op, mean, std FROM slo")
def op_slo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rca.slo(ops(spark, sf_dir))


@query(f"WITH {OPS} SELECT trace_id, round(duration, 4) AS duration, round(expected, 4) AS expected, anomalous FROM tr")
def anomaly_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ops(spark, sf_dir)
    return rca.anomalous(s, rca.slo(s), SLACK).select("trace_id", F.round("duration", 4).alias("duration"), F.round("expected", 4).alias("expected"), "anomalous")


@query(f"WITH {OPS} SELECT parent, child, n FROM ed")
def call_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rca.call_edges(ops(spark, sf_dir))


@query(f"WITH {RANKED} SELECT op, round(score, 8) AS score FROM r3")
def pagerank_fixed_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir)[2].select("op", F.round("score", 8).alias("score"))


@query(f"WITH {SPECTRUM} SELECT split_part(op, '_', 1) AS service, round(sum(ef * ef / (ep + nf)), 6) AS score FROM x GROUP BY 1")
def spectrum_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t, score = _parts(spark, sf_dir)
    return rca.by_service(rca.spectrum(s, t, score), "suspicion").select("service", S.sixth(F.col("score")).alias("score"))


@query(f"WITH {OPS}, l AS (SELECT split_part(op, '_', 1) AS service, sum(duration) AS score FROM o GROUP BY 1) SELECT service, round(score, 4) AS score, row_number() OVER (ORDER BY round(score, 4) DESC, service) AS rank FROM l")
def latency_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rca.ranked(rca.by_service(ops(spark, sf_dir), "duration"), digits=4)
    return found.select("service", F.round("score", 4).alias("score"), "rank")


HEURISTIC = """ca AS (SELECT sid, sp.service AS candidate, sum(weight) + 2 * max(weight) + 5 * count(*) AS score FROM inc JOIN sp ON sec BETWEEN st AND ed WHERE NOT failed GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY round(score, 6) DESC, candidate) AS rank FROM ca),
ev AS (SELECT inc.sid, rk.rank, CASE WHEN rk.rank <= 1 THEN 1.0 ELSE 0 END AS a1, CASE WHEN rk.rank <= 3 THEN 1.0 ELSE 0 END AS a3, coalesce(1.0 / rk.rank, 0) AS rr FROM inc LEFT JOIN rk ON inc.sid = rk.sid AND inc.service = rk.candidate)"""


def rankings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Incidents with their truth, and the services ranked by the heuristic score of their spans in the window."""
    s = spans(spark, sf_dir)
    windows = traces.incidents(s)
    slots = windows.select("sid", "st", "ed", F.explode(traces.by_slots(F.col("st"), F.col("ed"), 3600)).alias("slot"))
    inside = s.where(~F.col("failed")).withColumn("slot", F.floor(F.col("sec") / 3600)).join(slots, "slot").where("sec between st and ed")
    scored = rca.heuristic(inside.withColumnRenamed("service", "candidate"), ["sid", "candidate"], "weight")
    return windows.withColumnRenamed("service", "truth"), rca.ranked(scored, "sid", name="candidate")


@query(f"WITH {TRACES}, {INCIDENTS}, {HEURISTIC} SELECT sid, candidate, round(score, 6) AS score, rank FROM rk")
def heuristic_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankings(spark, sf_dir)[1].select("sid", "candidate", S.sixth(F.col("score")).alias("score"), "rank")


@query(f"WITH {TRACES}, {INCIDENTS}, {HEURISTIC} SELECT count(*) AS scenarios, round(avg(a1), 6) AS a1, round(avg(a3), 6) AS a3, round(avg(rr), 6) AS mrr FROM ev")
def rank_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.scores(evaluation.placed(*rankings(spark, sf_dir)))


@query(f"""WITH {TRACES}, {INCIDENTS}, {HEURISTIC}, nb AS (SELECT row_number() OVER (ORDER BY sid) AS i, a1, a3, rr, count(*) OVER () AS n FROM ev), g AS (SELECT DISTINCT n FROM nb),
  dr AS (SELECT r AS round, floor({uniform("'1'", "r::VARCHAR", "d::VARCHAR")} * n)::BIGINT + 1 AS i FROM g, range(2000) t(r), range(1000) u(d) WHERE d < n),
  m AS (SELECT round, avg(a1) AS a1, avg(a3) AS a3, avg(rr) AS rr FROM dr JOIN nb USING (i) GROUP BY round), l AS (SELECT measure, list_sort(list(v)) AS m FROM (SELECT round, a1, a3, rr FROM m) UNPIVOT (v FOR measure IN (a1, a3, rr)) GROUP BY measure)
  SELECT measure, round(m[floor(0.025 * 1999)::INT + 1], 6) AS low, round(m[floor(0.975 * 1999)::INT + 1], 6) AS high FROM l""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.bootstrap(evaluation.placed(*rankings(spark, sf_dir)), ["a1", "a3", "rr"])


def _walk_sql(tag: str, where: str) -> str:
    """The walk over the traces that meet a condition, unrolled; the last step's name is w{tag}{STEPS}."""
    d = rca.DAMPING
    out = f""", p{tag} AS MATERIALIZED (SELECT DISTINCT trace_id, op FROM o JOIN tr USING (trace_id) WHERE {where}), kt{tag} AS MATERIALIZED (SELECT trace_id, count(*) AS k FROM p{tag} GROUP BY 1), ko{tag} AS MATERIALIZED (SELECT op, count(*) AS m FROM p{tag} GROUP BY 1),
h{tag} AS MATERIALIZED (SELECT a.trace_id, a.op, k, m FROM p{tag} a JOIN kt{tag} USING (trace_id) JOIN ko{tag} USING (op)),
m{tag} AS MATERIALIZED (SELECT f.op AS f, t.op AS op, sum({d} * {d} / (t.k * f.m)) AS w FROM h{tag} f JOIN h{tag} t ON f.trace_id = t.trace_id GROUP BY 1, 2),
ce{tag} AS (SELECT p.op AS f, c.op AS op, count(*) AS n FROM o c JOIN o p ON c.trace_id = p.trace_id AND c.parent_id = p.span_id WHERE c.trace_id IN (SELECT trace_id FROM kt{tag}) GROUP BY 1, 2),
c{tag} AS MATERIALIZED (SELECT f, op, {d} * {rca.CALLS} * n / sum(n) OVER (PARTITION BY f) AS w FROM ce{tag}),
r{tag} AS MATERIALIZED (SELECT op, sum({d} * (1 - {d}) / (k * k * (SELECT sum(1 / k) FROM kt{tag}))) AS r FROM h{tag} GROUP BY op), w{tag}00 AS (SELECT op, 0.0 AS s FROM r{tag}), w{tag}0 AS (SELECT op, r AS s FROM r{tag})"""
    for k in range(1, rca.STEPS + 1):
        before = f"w{tag}00" if k == 1 else f"w{tag}{k - 2}"
        out += f""", w{tag}{k} AS MATERIALIZED (SELECT op, sum(s) AS s FROM (SELECT m.op, w * s AS s FROM m{tag} m JOIN {before} x ON m.f = x.op UNION ALL SELECT m.op, w * s FROM c{tag} m JOIN w{tag}{k - 1} x ON m.f = x.op UNION ALL SELECT op, r FROM r{tag}) GROUP BY op)"""
    return out + f", s{tag} AS MATERIALIZED (SELECT op, s / sum(s) OVER () AS score FROM w{tag}{rca.STEPS})"


WALKS = OPS + _walk_sql("a", "anomalous") + _walk_sql("g", "NOT anomalous")


def _walks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    s = storage.stored(ops(spark, sf_dir), "ops")
    t = storage.stored(rca.anomalous(s, rca.slo(s), SLACK), "traces")
    both = storage.stored(rca.trace_walk(s, t, ("anomalous",)), "walk")
    return s, t, both.where("anomalous").drop("anomalous"), both.where("not anomalous").drop("anomalous")


@query(f"WITH {WALKS} SELECT op, round(sa.score, 8) AS anomalous_score, round(sg.score, 8) AS normal_score FROM sa FULL JOIN sg USING (op)")
def trace_operation_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, bad, good = _walks(spark, sf_dir)
    return bad.withColumnRenamed("score", "a").join(good.withColumnRenamed("score", "g"), "op", "full").select("op", F.round("a", 8).alias("anomalous_score"), F.round("g", 8).alias("normal_score"))


@query(f"""WITH {WALKS}, sn AS (SELECT DISTINCT trace_id, op FROM o), ct AS (SELECT op, count(*) FILTER (WHERE anomalous) AS bad, count(*) FILTER (WHERE NOT anomalous) AS good FROM sn JOIN tr USING (trace_id) GROUP BY op),
  y AS (SELECT op, bad, CASE WHEN bad = 0 THEN 0 ELSE bad * coalesce(sa.score, 0) END AS ef, CASE WHEN bad = 0 THEN al::DOUBLE ELSE (al - bad) * coalesce(sa.score, 0) END AS nf, CASE WHEN bad = 0 THEN (1 + coalesce(sg.score, 0)) * good ELSE good * coalesce(sg.score, 0) END AS ep
    FROM ct LEFT JOIN sa USING (op) LEFT JOIN sg USING (op), (SELECT count(*) FILTER (WHERE anomalous) AS al FROM tr)), z AS (SELECT op, CASE WHEN ef = 0 THEN 1e-7 ELSE ef END AS ef, CASE WHEN ep = 0 THEN 1e-7 ELSE ep END AS ep, CASE WHEN nf = 0 THEN 1e-7 ELSE nf END AS nf FROM y)
  SELECT split_part(op, '_', 1) AS service, round(sum(ef * ef / (ep + nf)), 6) AS score FROM z GROUP BY 1""")
def walk_spectrum_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rca.by_service(rca.two_sided_spectrum(*_walks(spark, sf_dir)), "suspicion").select("service", S.sixth(F.col("score")).alias("score"))


@query(f"""WITH {TRACES}, {INCIDENTS}, w AS (SELECT sid, count(*) FILTER (WHERE sec BETWEEN st AND ed) AS incident, count(*) FILTER (WHERE sec BETWEEN st - 1800 AND st - 1) AS normal, count(*) FILTER (WHERE sec BETWEEN st AND ed AND has_error) AS failed FROM inc LEFT JOIN tp ON sec BETWEEN st - 1800 AND ed GROUP BY sid)
  SELECT sid, incident, normal, failed, CASE WHEN incident > 0 AND normal > 0 THEN 'walk' WHEN incident > 0 THEN 'latency' ELSE 'none' END AS mode FROM w""")
def scenario_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of each incident and of the half hour before it, and how its causes can be ranked: by walks where both sides
    have traces, else by latency."""
    s = spans(spark, sf_dir)
    tp, found = traces.trace_points(s), traces.incidents(s)
    sides = rca.scenario_sides(tp, found).join(tp.select("trace_id", "has_error"), "trace_id")
    n = sides.groupBy("sid").agg(F.count_if(F.col("side") == "incident").alias("incident"), F.count_if(F.col("side") == "normal").alias("normal"), F.count_if((F.col("side") == "incident") & F.col("has_error")).alias("failed"))
    rows = found.select("sid").join(n, "sid", "left").na.fill(0)
    return rows.select("sid", "incident", "normal", "failed", F.when((F.col("incident") > 0) & (F.col("normal") > 0), "walk").when(F.col("incident") > 0, "latency").otherwise("none").alias("mode"))


@query(f"""WITH {TRACES}, {INCIDENTS}, n AS (SELECT sid, count(*) AS normal FROM inc JOIN tp ON sec BETWEEN st - 1800 AND st - 1 GROUP BY sid), f AS (SELECT inc.* FROM inc LEFT JOIN n USING (sid) WHERE coalesce(normal, 0) < 2),
  c AS (SELECT sid, root_service AS candidate, sum(duration_ms) AS score FROM f JOIN tp ON sec BETWEEN st AND ed GROUP BY 1, 2) SELECT sid, candidate, round(score, 4) AS score, row_number() OVER (PARTITION BY sid ORDER BY round(score, 4) DESC, candidate) AS rank FROM c""")
def latency_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services ranked by the time of the incident's traces, for incidents with fewer than two normal traces."""
    s = spans(spark, sf_dir)
    tp, found = traces.trace_points(s), traces.incidents(s)
    sides = rca.scenario_sides(tp, found)
    enough = sides.where("side = 'normal'").groupBy("sid").agg(F.count("*").alias("n")).where("n >= 2")
    rows = sides.where("side = 'incident'").join(enough, "sid", "left_anti").join(tp, "trace_id")
    scored = rows.groupBy("sid", F.col("root_service").alias("candidate")).agg(F.sum("duration_ms").alias("score"))
    return rca.ranked(scored, "sid", name="candidate", digits=4).select("sid", "candidate", F.round("score", 4).alias("score"), "rank")


@query(f"""WITH {TRACES}, b AS (SELECT unnest([0.001, 0.01, 0.025]) AS budget), k AS (SELECT budget, root_service, 100.0 * count(*) FILTER (WHERE has_error AND {uniform("trace_id", "'keep'")} < 10 * budget) / count(*) AS pct FROM tp, b GROUP BY 1, 2),
  a AS (SELECT budget, avg(pct) AS average, count(*) AS datasets FROM k GROUP BY budget) SELECT budget::DOUBLE AS budget, datasets, round(average, 6) AS average, round(average - first_value(average) OVER (ORDER BY budget), 6) AS delta FROM a""")
def macro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).withColumn("budget", F.explode(F.array(*map(F.lit, (0.001, 0.01, 0.025)))))
    kept = F.count_if(F.col("has_error") & (S.hash_uniform(F.col("trace_id"), "keep") < 10 * F.col("budget")))
    return evaluation.macro_average(rows.groupBy("budget", "root_service").agg((100.0 * kept / F.count("*")).alias("pct")), "budget", "pct")
