"""The rescue and the bias against plain loops, with ties, missing pods and empty tables."""

import math
import random

import pytest
from pyspark.sql import functions as F
from spanquarry.operators import metrics, rerank

POINTS = "trace_id string, sec long, duration_ms double, has_error boolean, services array<string>"
PODS = "pod string, sec long, " + ", ".join(f"{m}_z double" for m in rerank.METRICS)


def plain_rescue(points, rows, causes, at, share):
    n = len(points)
    target = max(1, min(n, round(n * share)))
    pool = max(target, min(n, round(target * rerank.pool_factor(share))))
    by = {p[0]: p for p in points}
    firsts = [r[1] for r in rows]
    lo, hi = min(firsts), max(firsts)
    slow = [p[2] for p in points]
    score = {r[0]: r[1] for r in rows}
    first = dict(score)
    best = sorted(rows, key=lambda r: (-r[1], r[0]))[:pool]
    for t, f, fit in best:
        _, sec, ms, _, services = by[t]
        near = [p[3] for p in points if abs(p[1] - sec) <= 60]
        own = 0.40 * sum(near) / len(near) + 0.30 * ((ms - min(slow)) / (max(slow) - min(slow)) if max(slow) > min(slow) else 0.5)
        own += 0.20 * (len(set(services) & set(causes)) / len(services) if services and causes else 0) + 0.10 * math.exp(-abs(sec - at) / 60)
        score[t] = round(0.55 * ((f - lo) / (hi - lo) if hi > lo else 0.5) + 0.25 * fit + 0.20 * own, 6)
    order = lambda t: (-score[t], -first[t], t)
    kept = sorted((r[0] for r in best), key=order)[:target]
    need = round(target * min(max(0.08, 1.2 * sum(p[3] for p in points) / n), 0.40)) - sum(by[t][3] for t in kept)
    if need > 0:
        enter = sorted((t for t in by if by[t][3] and t not in kept), key=order)[:need]
        leave = sorted((t for t in kept if not by[t][3]), key=order)[::-1][: len(enter)]
        kept = [t for t in kept if t not in leave] + enter[: len(leave)]
    return {t: (score[t], t in {r[0] for r in best}, t in kept) for t in by}


@pytest.mark.parametrize(("seed", "share", "failing"), [(1, 0.1, 0.3), (2, 0.01, 0.9), (3, 0.2, 0.0)])
def test_rescue_equals_the_loop(spark, seed, share, failing):
    rnd = random.Random(seed)
    points = [(f"t{k:03}", rnd.randrange(1000), float(rnd.randrange(50)), rnd.random() < failing, rnd.sample("abc", rnd.randrange(0, 4))) for k in range(300)]
    # Failed traces score low, so the floor has to bring some in; scores tie often.
    rows = [(p[0], rnd.randrange(20) / 40 + (0.0 if p[3] else 0.5), rnd.randrange(5) / 4) for p in points]
    got = rerank.rescued(spark.createDataFrame(points, POINTS), spark.createDataFrame(rows, "trace_id string, first double, fit_n double"), spark.createDataFrame([(["a"],)], "causes array<string>"), 500, share).collect()
    want = plain_rescue(points, rows, ["a"], 500, share)
    assert len(got) == len(want) == 300
    for r in got:
        score, pooled, kept = want[r["trace_id"]]
        assert r["score"] == pytest.approx(score, abs=2e-6) and r["pooled"] == pooled and r["kept"] == kept
    assert sum(r["kept"] for r in got) == max(1, round(300 * share))


def test_bias_and_states(spark):
    points = spark.createDataFrame([("t1", 100, 5.0, True, ["a", "b"]), ("t2", 9000, 5.0, False, ["a"]), ("t3", 50, 5.0, False, ["z"])], POINTS)
    pods = spark.createDataFrame([("p", 0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0), ("q", 0, 3.0, 0.0, 9.0, 0.0, 1.0, 0.0), ("p", 7200, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0)], PODS)
    one = rerank.bias(points, pods, 60, 600).first()
    want = [2.0, 1.0, 6.0, 0.5, 3.0, 2.0]
    assert one["bias"] == pytest.approx(want) and one["mass"] == pytest.approx(14.5)
    h = -sum(x / 14.5 * math.log(x / 14.5) for x in want)
    assert one["confidence"] == pytest.approx(0.10 + 0.60 * (1 - h / math.log(6)) + 0.30)
    # no pod near the moment: zeros, and the failures of all traces
    assert rerank.bias(points, pods, 10**6, 600).first()["bias"] == pytest.approx([0, 0, 0, 1 / 3, 0, 0])
    registry = spark.createDataFrame([("a", "p", 0.5), ("a", "q", 0.8), ("b", "p", 1.0)], "service string, pod string, confidence double")
    found = rerank.snapshots(points, pods, registry, 3600)
    assert found.count() == 4  # t1: a with p and q, b with p; t2: a with the later p
    got = {r["trace_id"]: r["state"] for r in rerank.states(points, found).collect()}
    assert got["t1"] == pytest.approx([(0.8 * 3 + 1) / 2, (0 + 2) / 2, (0.8 * 9 + 3) / 2, 1.0, (0.8 * 1 + 5) / 2, (0 + 4) / 2])
    assert got["t2"] == pytest.approx([4.5, 4.5, 4.5, 0.0, 4.5, 4.5]) and got["t3"] == [0.0] * 6
    evidence = {r["trace_id"]: r for r in rerank.pod_evidence(points, found, 3600).collect()}
    z = {"p": sum(w * v for w, v in zip(rerank.INTENSITY.values(), (1, 2, 3, 4, 5, 6), strict=True)), "q": 0.24 * 3 + 0.24 * 9 + 0.12 * 1}
    age = math.exp(-100 / 3600)
    a = sorted((z["p"] * 0.5 * age, z["q"] * 0.8 * age), reverse=True)
    services = sorted((0.5 * a[0] + 0.3 * a[1], 0.5 * z["p"] * age), reverse=True)
    assert evidence["t1"]["intensity"] == pytest.approx(0.5 * services[0] + 0.3 * services[1]) and evidence["t1"]["coverage"] == 1.0
    assert evidence["t3"]["coverage"] == 0.0 and evidence["t3"]["unmatched"] == 1 and evidence["t3"]["evidence"] == 0.0


def test_empty_tables(spark):
    points, pods = spark.createDataFrame([], POINTS), spark.createDataFrame([], PODS)
    one = rerank.bias(points, pods, 0, 600).first()
    assert one["bias"] == [0.0] * 6 and one["confidence"] == 0.0
    registry = spark.createDataFrame([], "service string, pod string, confidence double")
    state = rerank.states(points, rerank.snapshots(points, pods, registry, 600))
    assert state.count() == 0
    scored = points.select("trace_id", F.lit(0.5).alias("p_s"), F.lit(0.5).alias("p_d"))
    rows = rerank.aligned(scored, state, rerank.bias(points, pods, 0, 600))
    assert rerank.rescued(points, rows, spark.createDataFrame([(["a"],)], "causes array<string>"), 0, 0.1).count() == 0


def test_latency_is_exact_to_the_microsecond(spark):
    # As doubles, nanoseconds since 1970 are 256 apart, so a division by 1000 fell short of some starts by a microsecond.
    starts = range(1_704_067_271_172_425, 1_704_067_271_172_425 + 500)
    spans = spark.createDataFrame([(f"t{at}", f"p{at}", at, at // 1_000_000, 1.0, False) for at in starts], "trace_id string, pod string, start_us long, sec long, weight double, failed boolean")
    points = spark.createDataFrame([(f"t{at}", at * 1000) for at in starts], "trace_id string, start_ns long")
    assert {r.latency for r in rerank.pod_metrics(spans, points).collect()} == {0.0}


def test_lists_and_rows_of_snapshots_agree(spark):
    rnd = random.Random(4)
    points = spark.createDataFrame([(f"t{k}", rnd.randrange(20_000), 1.0, k % 2 == 0, rnd.sample("abc", rnd.randrange(0, 4))) for k in range(60)], POINTS)
    held = {(p, sec): [float(rnd.randrange(10)) for _ in rerank.METRICS] for p in "pqr" for sec in rnd.sample(range(20_000), 12)}
    pods = spark.createDataFrame([(p, sec, *z) for (p, sec), z in held.items()], PODS)
    named = [("a", "p", 0.5), ("a", "q", 0.8), ("b", "p", 1.0), ("c", "r", 0.3), ("c", "missing", 0.9)]
    registry = spark.createDataFrame(named, "service string, pod string, confidence double")
    want = set()
    for t in points.collect():
        for service in t.services:
            for s, p, _ in named:
                fit = [at for q, at in held if q == p and t.sec - 3000 <= at <= t.sec]
                if s == service and fit:
                    want.add((t.trace_id, service, p, max(fit), held[p, max(fit)][0]))
    rows = rerank.snapshots(points, pods, registry, 3000)
    assert {(r.trace_id, r.service, r.pod, r.m_sec, r.cpu_z) for r in rows.collect()} == want
    lists = rerank.snapshot_lists(points, pods, registry, 3000, longest=1)
    keyed = lambda frame: {r.trace_id: tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.collect()}
    for found in (rerank.snapshot_lists(points, pods, registry, 3000), lists):
        assert keyed(rerank.pod_evidence(points, found, 3000)) == keyed(rerank.pod_evidence(points, rows, 3000))
        assert {r.trace_id: r.state for r in rerank.states(points, found).collect()} == {r.trace_id: pytest.approx(r.state) for r in rerank.states(points, rows).collect()}


def test_large_and_small_histories_deviate_alike(spark, monkeypatch):
    rnd = random.Random(6)
    table = spark.createDataFrame([(s, k, float(rnd.randrange(30)), rnd.random()) for s, n in (("a", 40), ("b", 7), ("c", 1)) for k in range(n)], "service string, sec long, x double, y double")
    key = lambda frame: {(r.service, r.sec): pytest.approx((r.x_z, r.y_z)) for r in frame.collect()}
    small = metrics.deviations(table, ["x", "y"])
    monkeypatch.setattr(metrics, "CHUNK", 10)
    large = {(r.service, r.sec): (r.x_z, r.y_z) for r in metrics.deviations(table, ["x", "y"]).collect()}
    assert large == key(small) and len(large) == 48


def test_the_registry_and_the_fit_go_over_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(x):
        seen.add(1)
        return x

    pods = spark.createDataFrame([(f"a-{k % 5}", 3600 * k) for k in range(20)], "pod string, sec long").select(told("pod").alias("pod"), "sec")
    services = spark.createDataFrame([("a", 3600 * k) for k in range(20)], "service string, sec long")
    assert metrics.registry_confidence(services, pods).count() == 5 and seen.value == 20
    scored = spark.createDataFrame([(f"t{k}", k / 10, 0.5) for k in range(10)], "trace_id string, p_s double, p_d double").withColumn("p_s", told(F.col("p_s").cast("string")).cast("double"))
    state = spark.createDataFrame([(f"t{k}", [1.0, float(k), 0.0, 0.0, 0.0, 0.0]) for k in range(10)], "trace_id string, state array<double>")
    incident = spark.createDataFrame([([1.0] * 6, 0.5)], "bias array<double>, confidence double")
    assert rerank.aligned(scored, state, incident).where("first is not null").count() == 10 and seen.value == 30
