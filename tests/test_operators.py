"""Operators on tiny hand-made tables."""

import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from spanquarry.functions import scalars as S
from spanquarry.operators import evaluation, folds, ordering, rca, retention, sampling, traces, windows
from spanquarry.plans import selection_queries

SPANS = "trace_id string, span_id long, service string, start_us long, sec long, weight double, failed boolean, props string"


def spans(spark, rows):
    return spark.createDataFrame([(t, i, s, at, at // 1_000_000, 1.0, bad, None) for i, (t, s, at, bad) in enumerate(rows)], SPANS)


def values(spark, expr, **cols):
    names = list(cols)
    return spark.createDataFrame([tuple(cols[n] for n in names)], ", ".join(f"{n} {'array<double>' if isinstance(cols[n], list) and cols[n] and isinstance(cols[n][0], float) else 'array<string>' if isinstance(cols[n], list) else 'string'}" for n in names)).select(expr).first()[0]


@pytest.mark.parametrize("pod, two, hashes, replica, first", [
    ("frontend-579b9bff58-t2dbm", "frontend", "frontend", "frontend", "frontend"), ("a-b", "a-b", "a-b", "a-b", "a"), ("a-b-c", "a", "a-b-c", "a-b-c", "a"),
    ("ts-travel-service", "ts", "ts", "ts-travel-service", "ts"), ("redis-cart", "redis-cart", "redis-cart", "redis-cart", "redis"), ("Web_App-abcde", "Web_App-abcde", "web-app-abcde", "web-app", "Web_App"),
])
def test_service_names(spark, pod, two, hashes, replica, first):
    row = spark.createDataFrame([(pod,)], "p string").select(*[f(F.col("p")) for f in (S.drop_two_parts, S.drop_two_hashes, S.drop_replica, S.first_part)]).first()
    assert tuple(row) == (two, hashes, replica, first)


def test_scalars(spark):
    assert values(spark, S.top_weighted(F.col("v")), v=[1.0, 4.0, 2.0, 3.0]) == pytest.approx(0.5 * 4 + 0.3 * 3 + 0.2 * 2)
    assert values(spark, S.top_weighted(F.col("v")), v=[4.0]) == 2.0
    assert values(spark, S.jaccard(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == pytest.approx(1 / 3)
    assert values(spark, S.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[-1.0, 0.0]) == 0
    for v, median, upper, rank in (([3.0], 3, 3, 3), ([1.0, 2.0], 1.5, 2, 1), ([5.0, 1.0, 3.0], 3, 3, 3)):
        row = spark.createDataFrame([(v,)], "v array<double>").select(windows.median("v"), S.upper_median(F.col("v")), S.nearest_rank(F.col("v"), 0.95)).first()
        assert tuple(row) == (median, upper, rank)
    sizes = [(n, s, w) for n, s, w in ((50, 0.01, 1), (150, 0.01, 2), (250, 0.01, 2), (5, 10.0, 5))]
    for n, share, want in sizes:
        assert spark.range(1).select(S.target_size(F.lit(n).cast("long"), share)).first()[0] == want


def test_trace_points_paths_and_ties(spark):
    s = spans(spark, [("t", "b", 5, False), ("t", "a", 5, False), ("t", "a", 9_000, True), ("t", "b", 10_000, False), ("u", "a", 7, False)])
    got = {r.trace_id: r for r in traces.trace_points(s).collect()}
    assert got["t"].service_path == ["b", "a", "b"] and got["t"].root_service == "b" and got["t"].has_error and got["t"].duration_ms == pytest.approx(9.995)
    assert not got["u"].has_error and got["u"].duration_ms == 0 and traces.trace_points(s.limit(0)).count() == 0


def test_labels_need_time_and_service(spark):
    tp = traces.trace_points(spans(spark, [("in", "a", 100_000_000, False), ("out", "a", 500_000_000, False), ("other", "b", 100_000_000, False)]))
    win = spark.createDataFrame([("s", 50, 200, "a")], "sid string, st long, ed long, service string")
    assert [r.trace_id for r in traces.label_errors(tp, win).collect()] == ["in"]
    assert {r.trace_id: r.sids for r in traces.membership(tp, win).collect()} == {"in": ["s"], "other": ["s"]}


@pytest.mark.parametrize("at, want", [(1000, 1000), (1000 + 7200, 1000), (1000 + 7201, None), (999, None)])
def test_as_of_tolerance(spark, at, want):
    m = spark.createDataFrame([("a", 1000, 0.5)], "service string, sec long, cpu double")
    p = spark.createDataFrame([("t", at, "a")], "trace_id string, sec long, service string")
    assert traces.as_of(p, m, 7200).first().m_sec == want


def test_lookback_frame_against_a_loop(spark):
    rng = random.Random(2)
    rows = sorted((rng.randrange(0, 400), f"t{i:03d}", rng.random() < 0.4) for i in range(200))
    frame = spark.createDataFrame([(t, s, s * 10**9, e) for s, t, e in rows], "trace_id string, sec long, start_ns long, has_error boolean")
    got = {r.trace_id: r for r in windows.lookback_stats(frame, 60, {"e": F.col("has_error").cast("int")}).collect()}
    for k, (sec, t, _) in enumerate(rows):
        near = [int(e) for s, _, e in rows[:k] if s >= sec - 59]
        mean = sum(near) / len(near) if near else 0
        assert got[t].n == len(near) and got[t].e_mean == pytest.approx(mean)
        assert got[t].e_std == pytest.approx(math.sqrt(max(0, mean - mean**2)) if len(near) > 1 else 0, abs=1e-9)


def test_local_density_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(f"t{i}", rng.randrange(0, 300), rng.random() < 0.5) for i in range(120)]
    frame = spark.createDataFrame(rows, "trace_id string, sec long, has_error boolean")
    for r in windows.local_density(frame, 20).collect():
        sec = next(s for t, s, _ in rows if t == r.trace_id)
        near = [e for _, s, e in rows if abs(s - sec) <= 20]
        assert r.density == pytest.approx(sum(near) / len(near))


def test_hysteresis_and_hold(spark):
    bins = spark.createDataFrame([(b, b in (3, 4, 5)) for b in (1, 2, 3, 4, 5, 6, 9, 20)], "bin long, x boolean")
    assert [r.bin for r in windows.hysteresis(bins, F.col("x"), 5).where("on").orderBy("bin").collect()] == [3, 4, 5, 6, 9]
    assert [r.bin for r in windows.held(bins, F.col("x"), 3).where("detected").collect()] == [3]


def points(spark, n=200):
    rng = random.Random(5)
    return spark.createDataFrame([(f"t{i:03d}", i * 10**9, i, float(rng.randrange(1, 9)), rng.randrange(1, 5), rng.random() < 0.2, ["a", "b"][: 1 + i % 2], rng.random()) for i in range(n)], "trace_id string, start_ns long, sec long, duration_ms double, span_count long, has_error boolean, services array<string>, p double")


def test_strict_cap_keeps_shares_and_order(spark):
    rows = points(spark)
    kept = sampling.strict_cap(rows, 0.1).collect()
    assert len(kept) == 20
    errors = [r for r in rows.collect() if r.has_error]
    best = sorted(errors, key=lambda r: (r.duration_ms, r.span_count, r.trace_id), reverse=True)[: round(20 * len(errors) / 200)]
    assert {r.trace_id for r in kept if r.has_error} == {r.trace_id for r in best}
    assert sampling.strict_cap(rows.limit(1), 0.001).count() == 1


def test_guard_fills_the_target_and_its_floors(spark):
    kept = sampling.guarded(points(spark).select("trace_id", "has_error", "p"), 20, 1.0, F.desc("p"), F.col("trace_id")).collect()
    assert len(kept) == 20 and sum(r.has_error for r in kept) >= round(20 * 0.18) and sum(not r.has_error for r in kept) >= round(20 * 0.38)


def test_leader_clusters_expire_and_break_ties(spark):
    rows = [("a", 0, 0, ["x", "y"]), ("b", 1, 1, ["x", "y"]), ("c", 2, 2, ["q"]), ("d", 3, 100, ["x", "y"]), ("e", 4, 101, ["y", "x"])]
    frame = spark.createDataFrame(rows, "trace_id string, start_ns long, sec long, tokens array<string>")
    got = {r.trace_id: (r.cluster, r.mass) for r in folds.leader_clusters(frame, 60).collect()}
    assert got == {"a": (0, 0), "b": (0, 1), "c": (1, 0), "d": (2, 0), "e": (2, 1)}


def test_keep_fold_is_repeatable_and_near_its_budget(spark):
    rows = points(spark, 400).select("trace_id", "start_ns", F.floor(F.col("start_ns") / 10**9).cast("long").alias("sec"), F.col("p").alias("p_s"), F.lit(0.5).alias("p_d"), "has_error", F.lit(False).alias("incident"), F.lit(0.0).alias("near"), F.lit(False).alias("alarm"))
    one, two = ({r.trace_id for r in folds.keep_fold(rows, 0.1, 3600, (3,)).where("kept[0]").collect()} for _ in range(2))
    assert one == two and 0.05 < len(one) / 400 < 0.4


def test_scenario_floor(spark):
    kept = spark.createDataFrame([(f"t{i}", i) for i in range(1, 9)], "trace_id string, place int")
    members = spark.createDataFrame([("t7", "s1"), ("t8", "s1"), ("t8", "s2")], "trace_id string, sid string")
    assert {r.trace_id for r in sampling.scenario_floor(kept, members, 3).collect()} == {"t7", "t8", "t1"}


def test_causes(spark):
    rows = [(1, 1, 0, "a_x", 10.0), (1, 2, 1, "b_y", 90.0), (2, 1, 0, "a_x", 10.0), (2, 2, 1, "b_y", 5.0), (3, 1, 0, "a_x", 12.0)]
    s = spark.createDataFrame(rows, "trace_id long, span_id long, parent_id long, op string, duration double")
    base = rca.slo(s)
    assert {r.op: (r["mean"], r["std"]) for r in base.collect()}["b_y"] == (47.5, 42.5)
    t = rca.anomalous(s, base, -10.0)
    assert {r.trace_id for r in t.where("anomalous").collect()} >= {1} and [tuple(r) for r in rca.call_edges(s).collect()] == [("a_x", "b_y", 2)]
    score = rca.pagerank(rca.call_edges(s), rca.preference(s, t), 5)
    found = rca.ranked(rca.by_service(rca.spectrum(s, t, score), "suspicion")).collect()
    assert {r.service for r in found} == {"a", "b"} and sorted(r["rank"] for r in found) == [1, 2]


def test_evaluation_has_no_fall_back_to_the_truth(spark):
    scenarios = spark.createDataFrame([("s1", "a"), ("s2", "b"), ("s3", "c")], "sid string, truth string")
    ranked = spark.createDataFrame([("s1", "a", 1), ("s2", "x", 1), ("s2", "b", 2), ("s2", "b", 3)], "sid string, candidate string, rank int")
    rows = evaluation.placed(scenarios, ranked)
    got = evaluation.scores(rows).first()
    assert (got.scenarios, got.a1, got.a3, got.mrr) == (3, pytest.approx(1 / 3, abs=1e-6), pytest.approx(2 / 3, abs=1e-6), 0.5)
    ci = evaluation.bootstrap(rows, ["rr"]).first()
    assert ci.measure == "rr" and 0 <= ci.low <= 0.5 <= ci.high <= 1
    with pytest.raises(TypeError):
        evaluation.bootstrap(rows, "rr")


def test_flat_values_count_as_half(spark):
    rows = points(spark, 3).withColumn("duration_ms", F.lit(1.0)).withColumn("span_count", F.lit(2))
    assert {r.latency for r in retention.latency(rows).collect()} == {0.5}


def test_places_quantiles_and_sums_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(ordering, "CHUNK", 16)
    rnd = random.Random(8)
    data = [(rnd.choice(["a", "b", None]), float(rnd.randint(0, 30)), f"t{i:03d}", rnd.randint(0, 1)) for i in range(400)]
    rows = spark.createDataFrame(data, "g string, v double, id string, e int")
    placed = {r.id: r.place for r in ordering.numbered(rows, ["g"], F.desc("v"), F.col("id")).collect()}
    sums = {r.id: r.e_sum for r in ordering.running_sums(rows, ["g"], ["e"], -F.floor(F.col("v") / 4), F.desc("v"), F.col("id")).collect()}
    asked = {"mid": ("linear", 0.5), "top": ("linear", 0.95), "low": ("rank", 0.95), "up": ("upper", 0.0)}
    found = {r.g: r for r in ordering.quantiles(rows, ["g"], "v", asked).collect()}
    for g in ("a", "b", None):
        mine = sorted((x for x in data if x[0] == g), key=lambda x: (-x[1], x[2]))
        assert [placed[x[2]] for x in mine] == list(range(1, len(mine) + 1))
        assert [sums[x[2]] for x in mine] == [sum(y[3] for y in mine[: k + 1]) for k in range(len(mine))]
        v, n = sorted(x[1] for x in mine), len(mine)
        at = lambda q: v[int(q * (n - 1))] + (v[min(int(q * (n - 1)) + 1, n - 1)] - v[int(q * (n - 1))]) * (q * (n - 1) % 1)
        r = found[g]
        assert (r.n, r.mid, r.top, r.low, r.up) == pytest.approx((n, at(0.5), at(0.95), v[int(0.95 * (n - 1))], v[n // 2]))
    assert ordering.numbered(rows.limit(0), ["g"], F.col("v")).count() == 0


def test_history_over_chunk_borders(spark, monkeypatch):
    monkeypatch.setattr(ordering, "CHUNK", 16)
    rows = spark.createDataFrame([(f"t{i:03d}", "s", i, float(i * i % 37)) for i in range(100)], "trace_id string, service string, start_ns long, value double")
    got = {r.trace_id: r for r in windows.service_history(rows, "value", 5).collect()}
    values_ = [float(i * i % 37) for i in range(100)]
    for i in range(1, 100):
        last = sorted(values_[max(0, i - 5) : i])
        assert got[f"t{i:03d}"].history_count == len(last) and got[f"t{i:03d}"].med == (last[(len(last) - 1) // 2] + last[len(last) // 2]) / 2


def test_parsed_operations_and_slugs(spark):
    rows = spark.createDataFrame([("/a/b",), ("GET /a",), ("a b",), ("  ",), (None,)], "n string")
    from spanquarry.sources.spans import parsed_operation

    assert [r[0] for r in rows.select(parsed_operation(F.col("n"))).collect()] == ["/a/b", "/a", "a b", "unknown", "unknown"]
    assert rows.select(S.slug(F.lit(" V3.5 % A"))).first()[0] == "v3p5-pct-a"


def plain_clusters(rows, lookback, least=0.5):
    """The rule by definition: rows (id, sec, tokens) in order of time."""
    clusters, out = [], {}
    for ident, sec, toks in rows:
        for c in clusters:
            c["members"] = [t for t in c["members"] if t > sec - lookback]
        clusters = [c for c in clusters if c["members"]]
        best = max(clusters, key=lambda c: (len(toks & c["lead"]) / len(toks | c["lead"]), -c["n"]), default=None)
        near = len(toks & best["lead"]) / len(toks | best["lead"]) if best else 0
        if near < least:
            best, near = {"n": 1 + max([o[0] for o in out.values()], default=-1), "lead": toks, "members": []}, 1.0
            clusters.append(best)
        out[ident] = (best["n"], round(near, 9), len(best["members"]))
        best["members"].append(sec)
    return out


def test_leader_clusters_match_a_plain_loop(spark):
    rnd = random.Random(4)
    rows, sec = [], 0
    for i in range(250):
        sec += rnd.choice([0, 1, 5, 40])
        rows.append((f"t{i:03d}", sec, frozenset(rnd.sample("abcdefg", rnd.randint(2, 4)))))
    frame = spark.createDataFrame([(i, 1000 * k, s, sorted(t)) for k, (i, s, t) in enumerate(rows)], "trace_id string, start_ns long, sec long, tokens array<string>")
    for chunk in (1 << 20, 60):  # state goes over from chunk to chunk
        got = {r.trace_id: (r.cluster, round(r.similarity, 9), r.mass) for r in folds.leader_clusters(frame, 60, chunk=chunk).collect()}
        assert got == plain_clusters(rows, 60)
    assert folds.leader_clusters(frame.limit(0), 60).count() == 0


def test_keep_fold_matches_a_plain_loop(spark):
    rnd = random.Random(5)
    data = [(f"t{i:03d}", i, i * 7, rnd.random(), rnd.random(), rnd.random() < 0.3, rnd.random() < 0.2, rnd.random(), rnd.random() < 0.05) for i in range(300)]
    frame = spark.createDataFrame(data, "trace_id string, start_ns long, sec long, p_s double, p_d double, has_error boolean, incident boolean, near double, alarm boolean")
    draws = {r.trace_id: r.d for r in frame.select("trace_id", F.array(*[S.hash_uniform(F.col("trace_id"), seed, k) for seed in (3, 4) for k in (1, 2, 3)]).alias("d")).collect()}
    for soft, beta, base in ((False, 0.05, 0.30), (True, 0.01, 0.20)):
        want = {}
        for n, seed in enumerate((3, 4)):
            kept = []
            for seen, (ident, _, sec, p, d, error, incident, near, alarm) in enumerate(data, 1):
                u, v, w = draws[ident][3 * n : 3 * n + 3]
                low = max(0.08, base - 0.06) if incident and near >= 0.55 else base
                recent = [e for s, e in kept if s > sec - 500]
                if len(kept) / seen > beta:
                    keep = u < p and (alarm or u < d)
                else:
                    keep = u < p and not (d >= 0.72 and p < low)
                    clean = not error and not incident and p < low and d <= 0.45
                    if not keep and clean and 1 - (sum(recent) / len(recent) if recent else 0) < 0.3:
                        keep = v < beta
                    if not keep and clean and soft:
                        keep = w < min(max(beta - len(kept) / seen, 0), 0.2)
                if keep:
                    kept.append((sec, error))
                want.setdefault(ident, []).append(keep)
        for chunk in (1 << 20, 70):
            assert {r.trace_id: r.kept for r in folds.keep_fold(frame, beta, 500, (3, 4), soft=soft, chunk=chunk).collect()} == want




@pytest.mark.parametrize("steps", [0, 3])
def test_walks_of_two_groups_equal_the_loop(spark, steps):
    rnd = random.Random(5)
    rows = [(t, i, i - 1 if i else None, f"o{rnd.randrange(6)}") for t in range(30) for i in range(rnd.randrange(1, 6))] + [(99, i, 0 if i else None, f"o{i}") for i in range(80)]
    side = {t: t % 2 == 0 for t in [*range(30), 99]}
    want = {}
    for bad in (True, False):
        ops = {}
        for t, _, _, o in rows:
            if side[t] == bad:
                ops.setdefault(t, set()).add(o)
        m = {o: sum(o in s for s in ops.values()) for s in ops.values() for o in s}
        at = {(t, i): o for t, i, _, o in rows if t in ops}
        calls = [(at[t, p], o) for t, _, p, o in rows if t in ops and p is not None]
        every = sum(1 / len(s) for s in ops.values())
        r = {o: sum(0.85 * 0.15 / (len(s) ** 2 * every) for s in ops.values() if o in s) for o in m}
        was, now = dict.fromkeys(m, 0.0), dict(r)
        for _ in range(steps):
            new = dict(r)
            for s in ops.values():
                for o in s:
                    new[o] += 0.85**2 / len(s) * sum(was[f] / m[f] for f in s)
            for f, o in calls:
                new[o] += 0.85 * 0.01 / sum(x == f for x, _ in calls) * now[f]
            was, now = now, new
        want |= {(bad, o): v / sum(now.values()) for o, v in now.items()}
    spans_ = spark.createDataFrame(rows, "trace_id long, span_id long, parent_id long, op string")
    got = rca.trace_walk(spans_, spark.createDataFrame(list(side.items()), "trace_id long, bad boolean"), ("bad",), steps=steps).collect()
    assert {(r.bad, r.op): r.score for r in got} == pytest.approx(want)
    one = rca.trace_walk(spans_, spark.createDataFrame([(t,) for t in side if side[t]], "trace_id long"), steps=steps).collect()
    assert {(True, r.op): r.score for r in one} == pytest.approx({k: v for k, v in want.items() if k[0]})


def test_a_chunk_of_a_fold_is_read_alone(spark):
    def step(state, batches):
        yield {"n": [sum(b.num_rows for b in batches)]}
        yield str(int(state or 0) + 1)

    rows = spark.range(1, 26).select(F.col("id").alias("place"))
    found = folds.chained(rows, step, "n long", 10)
    assert sorted(r.n for r in found.collect()) == [5, 10, 10]
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert any(len(list(p.glob("_chunk=*"))) == 3 for p in Path(shared).glob("chunks-*"))


def test_kept_traces_are_picked_as_they_are_decided():
    rnd = random.Random(7)
    for beta, soft, alarms in ((0.05, False, 0.0), (0.05, True, 0.02), (0.3, True, 0.4), (0.9, False, 0.1)):
        one, two = (folds.KeepFold(beta, 40, normal=0.6, soft=soft) for _ in range(2))
        data, sec = [], 0
        for _ in range(600):
            sec += rnd.choice([0, 0, 1, 7])
            data.append((sec, rnd.random(), rnd.random(), rnd.random() < 0.4, rnd.random() < 0.2, rnd.random(), rnd.random() < alarms, rnd.random(), rnd.random(), rnd.random()))
        want = {k for k, row in enumerate(data) if one.decide(*row)}
        open_ = []
        for _, p, d, error, incident, near, alarm, u, v, w in data:
            low = max(0.08, two.floor - 0.06) if incident and near >= 0.55 else two.floor
            clean = not error and not incident and p < low and d <= 0.45
            open_.append((u < p and (alarm or u < d)) + 2 * (u < p and not (d >= 0.72 and p < low)) + 4 * (clean and v < beta) + 8 * (soft and clean and w < beta))
        got, some = set(), [k for k, o in enumerate(open_) if o]
        for part in (some[:50], some[50:51], some[51:51], some[51:]):
            rows = [data[k] for k in part]
            found = two.pick([k + 1 for k in part], [r[0] for r in rows], [r[3] for r in rows], np.array([open_[k] for k in part], int), [r[9] for r in rows])
            got |= {part[k] for k in found}
        assert got == want and 0 < len(want) < 600 and two.kept == one.kept


def test_members_fold_blocks_in_the_order_of_the_frames(spark, monkeypatch):
    """No second order is made for the folds, and their chunks are blocks of arrays."""
    sf, sizes, chained = "/root/testdata/sf0.001", [], folds.chained

    def counted(rows, *more):
        sizes.append(rows.count())
        return chained(rows, *more)

    monkeypatch.setattr(folds, "chained", counted)
    monkeypatch.setattr(folds, "numbered", None)
    votes = selection_queries.member_votes(spark, sf).collect()
    assert len(votes) == 397 and sizes == [1, 1]
