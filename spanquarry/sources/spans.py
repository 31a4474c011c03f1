"""Readers of span, label, scenario, metric, ranking and OTLP files. Readers keep rows that they can't place out, not in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN_CSV = "TraceID string, SpanID string, ParentID string, PodName string, OperationName string, StartTimeUnixNano string, EndTimeUnixNano string, Duration string"
#: Metric files that hold no pod metrics.
SKIPPED = ("dependency.csv", "front_service.csv", "source_50.csv", "destination_50.csv")
ATTRIBUTE = "struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean,bytesValue:string>>"
OTLP_SPAN = f"array<struct<traceId:string,spanId:string,parentSpanId:string,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:string>,attributes:array<{ATTRIBUTE}>>>"
SCOPES = f"array<struct<spans:{OTLP_SPAN}>>"
OTLP = f"resourceSpans array<struct<resource:struct<attributes:array<{ATTRIBUTE}>>,scopeSpans:{SCOPES},instrumentationLibrarySpans:{SCOPES}>>"


def whole(text: Column) -> Column:
    """Integers written as such, null otherwise."""
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("long"))


def span_csv(spark: SparkSession, path: str, duration_unit: str = "us") -> DataFrame:
    """Spans of CSV files: ids in lower case, rows without a start left out, a missing end or duration filled from the
    other, the operation cut to what follows its last slash. duration_us whatever unit the files use."""
    return span_rows(spark.read.csv(path, header=True, schema=SPAN_CSV), duration_unit)


def span_rows(raw: DataFrame, duration_unit: str = "us") -> DataFrame:
    """Spans of rows as the CSV files have them, all text."""
    start, end, length = whole(F.col("StartTimeUnixNano")), whole(F.col("EndTimeUnixNano")), F.coalesce(whole(F.col("Duration")), F.lit(0))
    rows = raw.select(
        F.lower(F.trim("TraceID")).alias("trace_id"), F.trim("SpanID").alias("span_id"), F.when(F.col("ParentID") != "root", F.col("ParentID")).alias("parent_id"), F.coalesce(F.when(F.trim("PodName") != "", F.trim("PodName")), F.lit("unknown-service")).alias("pod"),
        operation(F.col("OperationName")).alias("operation"), start.alias("start_ns"), F.greatest(F.coalesce(end, start), start).alias("end_ns"), (length / (1000 if duration_unit == "ns" else 1)).cast("long").alias("given"),
    ).where("start_ns > 0 and trace_id != ''")
    return rows.withColumn("duration_us", F.when(F.col("given") > 0, F.col("given")).otherwise(((F.col("end_ns") - F.col("start_ns")) / 1000).cast("long"))).drop("given")


def operation(name: Column) -> Column:
    return F.coalesce(F.when(F.trim(name) != "", F.substring_index(F.trim(name), "/", -1)), F.lit("unknown"))


def parsed_operation(name: Column) -> Column:
    """A path stays, of other names the last word if it is a path, else all of it; ``unknown`` if blank."""
    text = F.trim(name)
    last = F.regexp_extract(text, r"(\S*)$", 1)
    return F.when(F.coalesce(text, F.lit("")) == "", "unknown").when(text.startswith("/"), text).when(last.startswith("/"), last).otherwise(text)


def labels(spark: SparkSession, path: str) -> DataFrame:
    """ts, pod, kind of a label file: an object of arrays of injections."""
    kinds = "map<string,array<struct<inject_timestamp:string,inject_pod:string,inject_type:string>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kinds)).alias("bucket", "all")).select("bucket", F.posexplode("all").alias("idx", "x"))
    return rows.select("bucket", "idx", whole(F.col("x.inject_timestamp")).alias("ts"), F.col("x.inject_pod").alias("pod"), F.col("x.inject_type").alias("kind")).where("ts is not null and pod is not null")


def scenarios_of(found: DataFrame, dataset: str, seconds: int = 900) -> DataFrame:
    """Scenario rows of labels: buckets in the order of their numbers, one id each, windows of so many seconds."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.orderBy(F.col("bucket").try_cast("long"), "bucket", "idx"))  # labels are few
    iso = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    sid = F.format_string(f"scn-{dataset}-%s-%03d", "bucket", n)
    return found.select(sid.alias("scenario_id"), iso(F.col("ts")).alias("incident_start_ts"), iso(F.col("ts") + seconds).alias("incident_end_ts"), F.regexp_replace("pod", "-[^-]*-[^-]*$", "").alias("ground_truth_root_cause"), F.col("kind").alias("inject_type"), F.col("pod").alias("inject_pod"), F.col("ts").cast("string").alias("inject_timestamp"))


SCENARIO = "scenario_id string, incident_start_ts string, incident_end_ts string, ground_truth_root_cause string"


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """sid, st, ed, truth of scenario files: JSON lines, a list, an object with a list under ``scenarios``, or one object.
    Rows without an id or a start are left out, ends before starts moved up."""
    text = spark.read.text(path, wholetext=True)
    trimmed = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    whole_file = F.coalesce(F.from_json(F.get_json_object(trimmed, "$.scenarios"), f"array<struct<{_fields(SCENARIO)}>>"), F.from_json(F.when(trimmed.startswith("["), trimmed), f"array<struct<{_fields(SCENARIO)}>>"))
    by_line = F.transform(F.filter(F.split(trimmed, r"\n(?=\s*\{)"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, f"struct<{_fields(SCENARIO)}>"))
    rows = text.select(F.explode(F.coalesce(whole_file, by_line)).alias("x")).select("x.*")
    second = lambda c: F.unix_seconds(F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00")))
    st = second(F.col("incident_start_ts"))
    rows = rows.select(F.trim("scenario_id").alias("sid"), st.alias("st"), F.greatest(st, F.coalesce(second(F.col("incident_end_ts")), st)).alias("ed"), F.col("ground_truth_root_cause").alias("truth"))
    return rows.where("sid != '' and st > 0")


def _fields(schema: str) -> str:
    return ",".join(":".join(x.split()) for x in schema.split(","))


def metric_csv(spark: SparkSession, path: str) -> DataFrame:
    """sec, pod, cpu, memory, latency, load, success: percentages as shares, blanks as 0, files without pod metrics skipped."""
    names = ["TimeStamp", "PodName", "CpuUsageRate(%)", "MemoryUsageRate(%)", "PodClientLatencyP95(s)", "PodServerLatencyP95(s)", "PodWorkload(Ops)", "PodSuccessRate(%)"]
    raw = spark.read.csv(path, header=True, schema=", ".join(f"`{n}` string" for n in names)).select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)], F.col("_metadata.file_name").alias("file"))
    raw = raw.where(~F.col("file").isin(*SKIPPED))
    number = lambda i: F.coalesce(F.trim(f"c{i}").try_cast("double"), F.lit(0.0))
    share = lambda i: F.least(F.greatest(number(i) / 100, F.lit(0.0)), F.lit(1.0))
    rows = raw.select(number(0).cast("long").alias("sec"), F.trim("c1").alias("pod"), share(2).alias("cpu"), share(3).alias("memory"), F.greatest(number(4), number(5)).alias("latency"), number(6).alias("load"), share(7).alias("success"))
    return rows.where("sec > 0 and pod != ''")


def attribute(attributes: Column, key: str) -> Column:
    """An attribute's value as text, whatever type it has."""
    value = F.get(F.filter(attributes, lambda a: a["key"] == key), F.lit(0))["value"]
    return F.coalesce(value["stringValue"], value["intValue"], value["doubleValue"].cast("string"), value["boolValue"].cast("string"), value["bytesValue"])


def otlp_rows(lines: DataFrame) -> DataFrame:
    """Spans of OTLP JSON lines (column value): current and legacy scopes, ids as text or lists of bytes."""
    parsed = lines.select(F.from_json("value", OTLP).alias("o")).where("o is not null").select(F.explode("o.resourceSpans").alias("r"))
    scopes = F.concat(F.coalesce("r.scopeSpans", F.array().cast(SCOPES)), F.coalesce("r.instrumentationLibrarySpans", F.array().cast(SCOPES)))
    rows = parsed.select("r.resource.attributes", F.explode(scopes).alias("s")).select("attributes", F.explode("s.spans").alias("x"))
    hexed = F.lower(F.array_join(F.transform(F.from_json("x.traceId", "array<int>"), lambda b: F.lpad(F.hex(b), 2, "0")), ""))
    trace = F.when(F.col("x.traceId").startswith("["), hexed).otherwise(F.lower("x.traceId"))
    http = attribute(F.col("x.attributes"), "http.status_code").try_cast("int")
    failed = F.coalesce(F.col("x.status.code").isin("2", "STATUS_CODE_ERROR"), F.lit(False)) | F.coalesce(http >= 500, F.lit(False))
    route = F.coalesce(*[attribute(F.col("x.attributes"), k) for k in ("http.route", "http.target", "rpc.method")])
    service = F.coalesce(attribute(F.col("x.attributes"), "service.name"), attribute(F.col("attributes"), "service.name"))
    return rows.select(trace.alias("trace_id"), F.col("x.spanId").alias("span_id"), whole(F.col("x.startTimeUnixNano")).alias("start_ns"), whole(F.col("x.endTimeUnixNano")).alias("end_ns"), failed.alias("failed"), service.alias("service"), route.alias("route"))


def otlp(spark: SparkSession, path: str) -> DataFrame:
    return otlp_rows(spark.read.text(path))


def rankings(spark: SparkSession, path: str) -> DataFrame:
    """sid, candidate, rank, score, status of ranking files: a list under one of four keys, of names or of objects, or a
    map of scores. Ranks are consecutive; a file that holds none has status ``empty``, one that isn't JSON ``malformed``."""
    from pyspark.sql import Window

    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.ranking|\.result)?\.json$", 1).alias("file"), "value")
    found = F.coalesce(*[F.get_json_object("value", f"$.{k}") for k in ("ranked_candidates", "candidates", "ranking", "results", "topk")], F.when(F.trim("value").startswith("["), F.col("value")))
    maps = F.coalesce(*[F.from_json(F.get_json_object("value", f"$.{k}"), "map<string,double>") for k in ("scores", "score_map", "candidate_scores")])
    objects = F.from_json(found, "array<struct<candidate_id:string,service:string,name:string,rank:int,score:double>>")
    listed = F.transform(objects, lambda x, i: F.struct(F.coalesce(x["candidate_id"], x["service"], x["name"]).alias("candidate"), F.coalesce(x["rank"], i + 1).cast("double").alias("by"), x["score"].alias("score")))
    names = F.transform(F.from_json(found, "array<string>"), lambda x, i: F.struct(x.alias("candidate"), (i + 1).cast("double").alias("by"), F.lit(None).cast("double").alias("score")))
    scored = F.transform(F.map_entries(maps), lambda e: F.struct(e["key"].alias("candidate"), (-e["value"]).alias("by"), e["value"].alias("score")))
    is_objects = found.rlike(r"^\s*\[\s*\{")
    rows = raw.select("file", F.coalesce(F.get_json_object("value", "$.scenario_id"), F.col("file")).alias("sid"), F.when(is_objects, listed).when(found.isNotNull(), names).otherwise(scored).alias("all"), F.get_json_object("value", "$").isNull().alias("bad"))
    rows = rows.withColumn("all", F.filter("all", lambda x: F.coalesce(x["candidate"], F.lit("")) != ""))
    status = F.when(F.col("bad"), "malformed").when(F.coalesce(F.size("all"), F.lit(0)) <= 0, "empty").otherwise("ok")
    rows = rows.select("sid", status.alias("status"), F.explode_outer("all").alias("x")).select("sid", "status", "x.*")
    rank = F.when(F.col("candidate").isNotNull(), F.row_number().over(Window.partitionBy("sid").orderBy("by", "candidate")))
    return rows.select("sid", "candidate", rank.cast("long").alias("rank"), "score", "status")
