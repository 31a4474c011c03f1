"""What came before a trace, in one pass, against the operators that find each part alone."""

import random

import pytest
from pyspark.sql import functions as F

from spanquarry.operators import history, metrics, sampling, selection, windows
from spanquarry.plans import ensemble_queries

HOUR = 3600


def made(spark):
    rnd = random.Random(5)
    rows = []
    for k in range(400):
        sec = rnd.choice([rnd.randrange(-2 * HOUR, 9 * HOUR), HOUR, HOUR + 1])
        rows.append((f"t{k:03d}", sec, sec * 10**9 + rnd.choice([0, 0, 7]), rnd.random() < 0.4, rnd.sample("abcdé", rnd.randint(0 if k % 40 == 3 else 1, 4)), rnd.random()))
    points = spark.createDataFrame(rows, "trace_id string, sec long, start_ns long, has_error boolean, services array<string>, latency double")
    found = [(s, h * HOUR + rnd.choice([0, 0, 900]), rnd.choice([None, rnd.random()]), rnd.random()) for s in "abcé" for h in range(-3, 9) if rnd.random() < 0.6]
    return points, spark.createDataFrame([("x", 0, 1.0, 1.0), *found], "service string, sec long, cpu_z double, load_z double")


def test_histories_are_what_the_parts_say_alone(spark):
    points, deviations = made(spark)
    values = {"error": F.col("has_error").cast("int"), "lat": F.col("latency")}
    got = {r.trace_id: r.asDict() for r in history.histories(points, deviations, HOUR, 2 * HOUR, values).collect()}
    assert set(got) == {r.trace_id for r in points.where("size(services) > 0").collect()}
    alone = [windows.lookback_stats(points, HOUR, values), windows.lookback_sigmas(points, HOUR, values).select("trace_id", "error_robust", "lat_robust"), sampling.online_state(points).drop("contrast", "rca"), metrics.evidence(points, deviations, 2 * HOUR).drop("intensity"), points]
    for part in alone:
        for r in part.collect():
            for c, v in r.asDict().items():
                if r.trace_id in got and c not in ("n", "has_error"):
                    assert got[r.trace_id][c] == (pytest.approx(v, abs=1e-9) if isinstance(v, float) else v), (r.trace_id, c)


def test_histories_of_no_traces_no_metrics_and_no_time(spark):
    points, deviations = made(spark)
    values = {"lat": F.col("latency")}
    assert history.histories(points.limit(0), deviations, HOUR, HOUR, values).count() == 0
    assert {(r.coverage, r.reliability, r.evidence) for r in history.histories(points, deviations.limit(0), HOUR, HOUR, values).collect()} == {(0.0, 0.0, 0.0)}
    blank = points.withColumn("sec", F.when(F.col("trace_id") > "t1", F.col("sec"))).withColumn("start_ns", F.when(F.col("trace_id") > "t1", F.col("start_ns")))
    assert {r.trace_id for r in history.histories(blank, deviations, HOUR, HOUR, values).collect()} == {r.trace_id for r in points.where("trace_id > 't1' and size(services) > 0").collect()}


def test_members_join_nothing_by_trace(spark):
    plan = ensemble_queries._members(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(trace_id" not in plan and "Join Inner" not in plan


def test_the_foremost_hold_the_first_of_each_class(spark):
    rnd = random.Random(4)
    data = [(f"t{k:03d}", rnd.random() < 0.2, rnd.randint(0, 2), rnd.randint(0, 9) / 10) for k in range(300)]
    rows = spark.createDataFrame(data, "trace_id string, has_error boolean, pool int, score double")
    for most in (1, 20, 1000):
        got = {r.trace_id for r in selection.foremost(rows, most, ["has_error"], "pool", "score").collect()}
        want = set()
        for own in (True, False):
            ranked = sorted((x[2:] for x in data if x[1] == own), reverse=True)
            want |= {x[0] for x in data if x[1] == own and x[2:] >= ranked[min(most, len(ranked)) - 1]}
        assert got == want
