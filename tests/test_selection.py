"""Selections under limits against the loops that they stand for."""

import random

import pytest
from pyspark.sql import functions as F

from spanquarry.operators import selection, walks


def looped(rows, members, target, floor):
    """Traces in order, each taken out if all its scenarios keep the floor; then the first of what is left."""
    left, count = list(rows), {}
    for t in rows:
        for s in members.get(t, ()):
            count[s] = count.get(s, 0) + 1
    for t in rows:
        if len(left) <= target:
            break
        if all(count[s] > floor for s in members.get(t, ())):
            left.remove(t)
            for s in members.get(t, ()):
                count[s] -= 1
    return left[max(0, len(left) - target) :]


@pytest.mark.parametrize("seed", [1])
def test_trim_is_the_loop(spark, seed, monkeypatch):
    monkeypatch.setattr(selection, "STRETCH", 7)
    rnd = random.Random(seed)
    rows = [f"t{k:02d}" for k in range(60)]
    rnd.shuffle(rows)
    members = {t: sorted(rnd.sample("abcdef", rnd.choice([0, 1, 1, 2, 3]))) for t in rows}
    frame = spark.createDataFrame(list(zip(rows, range(1, 61), strict=True)), "trace_id string, place long")
    inside = spark.createDataFrame([(t, s) for t, ss in members.items() for s in ss], "trace_id string, sid string")
    for target, floor in ((rnd.randint(5, 40), rnd.choice((1, 4, 9))),):
        got = selection.trimmed(frame, inside, target, floor).collect()
        assert {r.trace_id for r in got} == set(looped(rows, members, target, floor))


def test_top_up_adds_what_is_missing(spark):
    kept = spark.createDataFrame([("a",)], "trace_id string")
    members = spark.createDataFrame([("a", "s", 1), ("b", "s", 2), ("c", "s", 3), ("d", "u", 1), ("a", "v", 1)], "trace_id string, sid string, w int")
    assert {r.trace_id for r in selection.topped_up(kept, members, 2, F.desc("w"), F.col("trace_id")).collect()} == {"a", "c", "d"}


def test_exchange_never_lowers_the_score(spark):
    rnd = random.Random(1)
    data = [(f"t{k:02d}", k < 20, rnd.random()) for k in range(60)]
    rows = spark.createDataFrame(data, "trace_id string, chosen boolean, score double")
    for quota in (3, 50):
        got = {r.trace_id: r for r in selection.exchanged(rows, quota, F.desc("score"), F.col("trace_id")).collect()}
        worst, best = sorted(x for _, c, x in data if c)[:quota], sorted((x for _, c, x in data if not c), reverse=True)[:quota]
        gain = sum(b - w for w, b in zip(worst, best, strict=False) if b > w)
        assert sum(r.chosen for r in got.values()) == 20
        assert sum(r.score for r in got.values() if r.chosen) == pytest.approx(sum(x for _, c, x in data if c) + gain)


def test_calibrated_rate_is_where_bisection_ends(spark):
    rnd = random.Random(2)
    critical = [rnd.expovariate(1) for _ in range(500)] + [2.0] * 40
    rows = spark.createDataFrame([(f"t{k}", x) for k, x in enumerate(critical)], "trace_id string, critical double")
    share_at = lambda rate: sum(c <= rate for c in critical) / len(critical)
    for share in (1e-9, 0.37, 1.0):
        low, high = 0.0, 50.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if share_at(middle) < share else (low, middle)
        got = selection.calibrated(rows, share).first()
        assert got.rate == pytest.approx(high, abs=1e-9) and got.reached == pytest.approx(share_at(high)) and not got.unreachable
    far = selection.calibrated(rows, 0.99, most=1.0).first()
    assert far.unreachable and far.rate == 1.0 and far.reached == pytest.approx(share_at(1.0))
    assert selection.calibrated(rows.limit(0), 0.5).count() == 0


def plain_walk(pairs, edges, steps=400, d=walks.DAMPING, c=walks.CALLS):
    """Scores of one part by plain loops over traces and operations."""
    ops, ts = sorted({o for _, o in pairs}), sorted({t for t, _ in pairs})
    k = {t: sum(a == t for a, _ in pairs) for t in ts}
    m = {o: sum(b == o for _, b in pairs) for o in ops}
    out = {o: sum(n for (a, _), n in edges.items() if a == o) for o in ops}
    total = sum(1 / k[t] for t in ts)
    s = dict.fromkeys(ops, 0.0)
    for _ in range(steps):
        t_ = {t: d * sum(s[o] / m[o] for a, o in pairs if a == t) + (1 - d) / (k[t] * total) for t in ts}
        s = {o: d * sum(t_[a] / k[a] for a, b in pairs if b == o) + d * c * sum(s[a] * n / out[a] for (a, b), n in edges.items() if b == o) for o in ops}
    whole = sum(s.values())
    return {o: x / whole for o, x in s.items()}


@pytest.mark.parametrize("fold", [3])
def test_walks_of_parts_stand_still_where_loops_do(spark, fold):
    rnd = random.Random(3)
    spans, members, want = [], [], {}
    for part in range(3):
        pairs, edges = set(), {}
        for t in range(4 + 3 * part):
            name = f"p{part}-t{t}"
            members.append((part, name))
            ops = [rnd.choice("abcdefg") for _ in range(rnd.randint(1, 6))]
            for j, o in enumerate(ops):
                spans.append((name, j, j - 1 if j else None, o))
                pairs.add((name, o))
                if j:
                    edges[ops[j - 1], o] = edges.get((ops[j - 1], o), 0) + 1
        want |= {(part, o): x for o, x in plain_walk(pairs, edges).items()}
    got = walks.fixed_points(spark.createDataFrame(spans, "trace_id string, span_id long, parent_id long, op string"), spark.createDataFrame(members, "part int, trace_id string"), ["part"], fold=fold).collect()
    assert {(r.part, r.op): pytest.approx(r.score, abs=1e-7) for r in got} == want


def test_degenerate_scenarios_have_their_fallbacks(spark):
    minute = 60
    points = [("calm1", 1000), ("calm2", 1500), ("x1", 3600), ("x2", 3700), ("lone", 20_000)]
    spans = [("calm1", 0, None, "a_x", 10.0), ("calm2", 0, None, "b_y", 20.0), ("x1", 0, None, "a_x", 500.0), ("x1", 1, 0, "b_y", 1.0), ("x2", 0, None, "b_y", 900.0), ("lone", 0, None, "a_x", 3.0), ("lone", 1, 0, "c_z", 9.0)]
    tp = spark.createDataFrame([(t, s, s * 10**9) for t, s in points], "trace_id string, sec long, start_ns long")
    steps = spark.createDataFrame(spans, "trace_id string, span_id long, parent_id long, op string, duration double")
    windows = spark.createDataFrame([("s1", 2700, 4000), ("s2", 20_000, 20_000 + minute), ("s3", 50_000, 50_100)], "sid string, st long, ed long")
    got = {}
    for r in walks.root_causes(tp, steps, windows).collect():
        got.setdefault((r.sid, r.mode), []).append((r["rank"], r.candidate))
    assert set(got) == {("s1", "walk"), ("s2", "walk")} and {c for _, c in got["s1", "walk"]} == {"a", "b"}
    none = walks.root_causes(tp.where("trace_id = 'lone'"), steps.withColumn("duration", F.col("duration") + F.when(F.col("span_id") == 0, 10_000).otherwise(0)), windows)
    assert {(r.sid, r.mode) for r in none.collect()} == {("s2", "walk")}
    assert walks.root_causes(tp.limit(0), steps, windows).count() == 0
