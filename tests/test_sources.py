"""Readers, writers and streams on small files."""

import json

from pyspark.sql import functions as F
from spanquarry.operators import traces
from spanquarry.sources import sinks
from spanquarry.sources import spans as R
from spanquarry.streaming import live

HEAD = "TraceID,SpanID,ParentID,PodName,OperationName,StartTimeUnixNano,EndTimeUnixNano,Duration\n"


def test_span_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + "ABC,1,root,web-579b9bff58-t2dbm,/api/get,1000000,9000000,0\nABC,2,1,,x,2000000,1000000,7\nDEF,3,1,p,,bad,2,3\nGHI,4,,p,,5,2,oops\n")
    got = {r.span_id: r for r in R.span_csv(spark, str(tmp_path)).collect()}
    assert set(got) == {"1", "2", "4"} and got["1"].trace_id == "abc" and got["1"].parent_id is None and got["1"].operation == "get" and got["1"].duration_us == 8000
    assert got["2"].pod == "unknown-service" and got["2"].end_ns == got["2"].start_ns and got["2"].duration_us == 7 and got["4"].operation == "unknown"


def test_labels_and_scenarios(spark, tmp_path):
    (tmp_path / "label.json").write_text(json.dumps({"10": [{"inject_timestamp": "1675079506", "inject_pod": "ts-x-866bd68c97-dzqgd", "inject_type": "net"}, {"inject_timestamp": "?", "inject_pod": "p", "inject_type": "z"}], "9": [{"inject_timestamp": "1675079000", "inject_pod": "a-b-c", "inject_type": "cpu"}]}))
    rows = R.scenarios_of(R.labels(spark, str(tmp_path / "label.json")), "demo").collect()
    assert [(r.scenario_id, r.ground_truth_root_cause) for r in rows] == [("scn-demo-9-001", "a"), ("scn-demo-10-002", "ts-x")] and rows[1].incident_start_ts == "2023-01-30T11:51:46Z"
    (tmp_path / "s.jsonl").write_text("\n".join(json.dumps(x) for x in [rows[0].asDict(), {"scenario_id": " ", "incident_start_ts": "2023-01-30T11:46:46Z"}, {"scenario_id": "q", "incident_start_ts": "2023-01-30T11:46:46Z", "incident_end_ts": "2020-01-01T00:00:00Z"}]) + "\n\n")
    got = {r.sid: (r.st, r.ed) for r in R.scenarios(spark, str(tmp_path / "s.jsonl")).collect()}
    assert got == {"scn-demo-9-001": (1675079000, 1675079900), "q": (1675079206, 1675079206)}


def test_metric_csv(spark, tmp_path):
    head = "TimeStamp,PodName,CpuUsageRate(%),MemoryUsageRate(%),PodClientLatencyP95(s),PodServerLatencyP95(s),PodWorkload(Ops),PodSuccessRate(%)\n"
    (tmp_path / "pod.csv").write_text(head + "100.0,p,150,50,0.1,0.3,,99\n0,p,1,1,1,1,1,1\n5,,1,1,1,1,1,1\n")
    (tmp_path / "dependency.csv").write_text(head + "100.0,q,1,1,1,1,1,1\n")
    rows = R.metric_csv(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [(100, "p", 1.0, 0.5, 0.3, 0.0, 0.99)]


def test_otlp_forms(spark, tmp_path):
    attr = lambda k, **v: {"key": k, "value": v}
    new = {"resourceSpans": [{"resource": {"attributes": [attr("service.name", stringValue="svc")]}, "scopeSpans": [{"spans": [{"traceId": "ABC", "spanId": "1", "startTimeUnixNano": "5", "status": {"code": 2}, "attributes": [attr("http.route", stringValue="/r")]}]}]}]}
    old = {"resourceSpans": [{"instrumentationLibrarySpans": [{"spans": [{"traceId": [1, 255], "spanId": "2", "startTimeUnixNano": "6", "attributes": [attr("http.status_code", intValue="503"), attr("service.name", stringValue="own")]}]}]}]}
    (tmp_path / "x.jsonl").write_text(json.dumps(new) + "\nnot json\n\n" + json.dumps(old) + "\n")
    got = {r.span_id: r for r in R.otlp(spark, str(tmp_path / "x.jsonl")).collect()}
    assert (got["1"].trace_id, got["1"].failed, got["1"].service, got["1"].route) == ("abc", True, "svc", "/r")
    assert (got["2"].trace_id, got["2"].failed, got["2"].service) == ("01ff", True, "own")


def test_ranking_forms_and_honest_status(spark, tmp_path):
    files = {"a.json": {"ranked_candidates": [{"candidate_id": "x", "rank": 2}, {"candidate_id": "y", "rank": 1}]}, "b.ranking.json": ["m", "n"], "c.result.json": {"scores": {"p": 0.1, "q": 0.9}}, "d.json": {"candidates": []}, "e.json": None}
    for name, x in files.items():
        (tmp_path / name).write_text("{broken" if x is None else json.dumps(x))
    got = {}
    for r in R.rankings(spark, str(tmp_path)).collect():
        got.setdefault((r.sid, r.status), []).append((r["rank"], r.candidate))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {("a", "ok"): [(1, "y"), (2, "x")], ("b", "ok"): [(1, "m"), (2, "n")], ("c", "ok"): [(1, "q"), (2, "p")], ("d", "empty"): [(None, None)], ("e", "malformed"): [(None, None)]}


def test_sinks(spark, tmp_path):
    s = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "trace_id string, start_ns long")
    kept = spark.createDataFrame([("a", 1)], "trace_id string, place int")
    assert sinks.kept_spans(s, kept, f"{tmp_path}/k") == (3, 2) and sinks.kept_spans(s, kept, f"{tmp_path}/r", rank=True) == (3, 2)
    sinks.id_list(s, f"{tmp_path}/ids")
    assert [r.value for r in spark.read.text(f"{tmp_path}/ids").orderBy("value").collect()] == ["a", "b"]
    for _ in range(2):
        sinks.table(kept, f"{tmp_path}/t", append=True)
    assert spark.read.csv(f"{tmp_path}/t", header=True).count() == 2
    sinks.ranking_json(spark.createDataFrame([("s", "x", 1, 0.5), ("s", "y", 2, 0.1)], "sid string, candidate string, rank int, score double"), f"{tmp_path}/j", "m")
    assert [c.candidate_id for c in spark.read.json(f"{tmp_path}/j").first().ranked_candidates] == ["x", "y"]
    assert "| a | 1 |" in sinks.markdown(kept, "Kept")


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.limit(300).repartition(3).write.parquet(f"{tmp_path}/in")
    batch = traces.spans_of_events(spark.read.parquet(f"{tmp_path}/in"))
    stream = traces.spans_of_events(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    got = live.run_once(live.bins(stream, late="60 days"), f"{tmp_path}/out", f"{tmp_path}/cp")
    want = batch.groupBy((F.floor(F.col("sec") / 3600) * 3600).alias("start"), "service").agg(F.count("*").alias("n"), F.count_if("failed").alias("errors"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # a last event far ahead moves the watermark, so the sessions before it end
    later = events.limit(1).withColumn("ts", F.expr("ts + interval 400 days"))
    later.write.mode("append").parquet(f"{tmp_path}/in")
    sessions = live.run_once(live.sessions(traces.spans_of_events(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")), late="60 days"), f"{tmp_path}/s", f"{tmp_path}/cs", mode="append")
    assert sessions.agg({"span_count": "sum"}).first()[0] == 300


def test_trace_csv_and_report(spark, tmp_path):
    s = spark.createDataFrame([("t", 1_000_000, 5_000_000, "b", False), ("t", 2_000_000, 9_000_000, "a", True), ("u", 0, 0, "a", False)], "trace_id string, start_ns long, end_ns long, service string, failed boolean")
    sinks.trace_csv(s, f"{tmp_path}/c")
    got = {r.trace_id: (r.duration_ms, r.span_count, r.has_error, r.services) for r in spark.read.csv(f"{tmp_path}/c", header=True).collect()}
    assert got == {"t": ("8.0", "2", "1", "a|b"), "u": ("0.0", "1", "0", "a")}
    sinks.report({"One": s.select("trace_id").distinct().orderBy("trace_id"), "Two": s.limit(0)}, f"{tmp_path}/m", "All")
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/m").collect())
    assert text.startswith("# All") and "## One" in text and "| t |" in text


def test_scenario_files_in_every_form(spark, tmp_path):
    one = '{"scenario_id": "%s", "incident_start_ts": "2024-01-01T00:00:00Z", "incident_end_ts": "2024-01-01T00:10:00Z", "ground_truth_root_cause": "a"}'
    forms = {"lines.jsonl": (one % "l1") + "\n" + (one % "l2") + "\n", "list.json": "[" + (one % "m1") + ",\n" + (one % "m2") + "]", "object.json": '{"scenarios": [' + (one % "o1") + "]}", "single.json": one.replace(", ", ",\n  ") % "s1", "bad.json": "{nothing"}
    for name, text in forms.items():
        (tmp_path / name).write_text(text)
    got = sorted((r.sid, r.ed - r.st) for r in R.scenarios(spark, str(tmp_path)).collect())
    assert got == [(k, 600) for k in ("l1", "l2", "m1", "m2", "o1", "s1")]


def test_checked_readers_return_what_they_reject(spark, tmp_path):
    from spanquarry.sources import checked

    (tmp_path / "a.csv").write_text(HEAD + "ABC,1,root,p,/api/get,1000000,9000000,0\nABC,2\n,3,1,p,,5,2,3\nDEF,4,1,p,,bad,2,3\n")
    got = checked.span_csv(spark, str(tmp_path / "a.csv"))
    assert [r.span_id for r in got.rows.collect()] == ["1"] and (got.accepted, got.rejected) == (1, 3)
    assert sorted((r.reason, r.file) for r in got.rejects.collect()) == [("fields", "a.csv"), ("no start", "a.csv"), ("no trace id", "a.csv")]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "x.json").write_text(json.dumps({"ranked_candidates": ["m", "n"]}))
    (tmp_path / "r" / "y.json").write_text("{broken")
    (tmp_path / "r" / "z.json").write_text(json.dumps({"candidates": []}))
    ranked = checked.ranking_json(spark, str(tmp_path / "r"))
    assert sorted((r.sid, r.candidate) for r in ranked.rows.collect()) == [("x", "m"), ("x", "n")]
    assert sorted((r.record, r.reason) for r in ranked.rejects.collect()) == [("y", "malformed"), ("z", "empty")]
    span = {"traceId": "AB", "spanId": "1", "startTimeUnixNano": "5"}
    lines = [{"resourceSpans": [{"scopeSpans": [{"spans": [span, {**span, "traceId": ""}, {**span, "startTimeUnixNano": "x"}]}]}]}, {"resourceSpans": []}]
    (tmp_path / "o.jsonl").write_text("\n".join([*map(json.dumps, lines), "not json", ""]) + "\n")
    otlp = checked.otlp(spark, str(tmp_path / "o.jsonl"))
    assert [r.trace_id for r in otlp.rows.collect()] == ["ab"] and otlp.accepted == 1
    assert sorted(r.reason for r in otlp.rejects.collect()) == ["blank", "no spans", "no start", "no trace id", "not JSON"] and otlp.rejected == 5
