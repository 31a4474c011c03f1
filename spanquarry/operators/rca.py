"""Root-cause ranking from kept traces: operation baselines, call graph, personalised PageRank, spectrum, simple scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import limited, stored
from .traces import by_slots


def slo(spans: DataFrame) -> DataFrame:
    """op, mean, std of the durations, four decimals."""
    return spans.groupBy("op").agg(F.round(F.avg("duration"), 4).alias("mean"), F.round(F.stddev_pop("duration"), 4).alias("std"))


def anomalous(spans: DataFrame, baseline: DataFrame, slack: float) -> DataFrame:
    """trace_id, duration, expected, anomalous: a trace is anomalous if it takes longer than its operations' means and
    deviations add up to, plus slack. Operations without a baseline count as 1.0 and 0.1."""
    rows = spans.join(baseline, "op", "left")
    allowed = F.coalesce("mean", F.lit(1.0)) + F.coalesce("std", F.lit(0.1))
    out = rows.groupBy("trace_id").agg(F.sum("duration").alias("duration"), F.sum(allowed).alias("expected"))
    return out.withColumn("anomalous", F.col("duration") > F.col("expected") + slack)


def call_edges(spans: DataFrame) -> DataFrame:
    """parent, child, n: calls between operations, by the spans' parents within their trace."""
    up = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.col("op").alias("parent"))
    return spans.join(up, ["trace_id", "parent_id"]).groupBy("parent", F.col("op").alias("child")).agg(F.count("*").alias("n"))


def preference(spans: DataFrame, traces: DataFrame) -> DataFrame:
    """op, pref: an operation's share of the spans of anomalous traces."""
    bad = spans.join(traces.where("anomalous").select("trace_id"), "trace_id", "left_semi").groupBy("op").agg(F.count("*").alias("n"))
    whole = bad.agg(F.sum("n").alias("all"))
    return bad.crossJoin(F.broadcast(whole)).select("op", (F.col("n") / F.col("all")).alias("pref"))  # one row


def pagerank(edges: DataFrame, pref: DataFrame, iterations: int = 3, damping: float = 0.85) -> DataFrame:
    """op, score: a walk along the calls that restarts at the preferred operations, a fixed number of steps.

    Edges carry their share of their parent's calls. Each step is one join and one grouped sum over the operations;
    long runs are checkpointed every fourth step if the session names a checkpoint folder.
    """
    out = edges.groupBy("parent").agg(F.sum("n").alias("out"))
    share = edges.join(out, "parent").select("parent", "child", (F.col("n") / F.col("out")).alias("w"))
    score = pref.select("op", F.col("pref").alias("score"))
    for step in range(iterations):
        came = share.join(score, share.parent == score.op).groupBy("child").agg(F.sum(F.col("w") * F.col("score")).alias("came"))
        score = pref.join(came.withColumnRenamed("child", "op"), "op", "full").select("op", ((1 - damping) * F.coalesce("pref", F.lit(0.0)) + damping * F.coalesce("came", F.lit(0.0))).alias("score"))
        if step % 4 == 3 and edges.sparkSession.conf.get("spark.checkpoint.dir", None):
            score = score.checkpoint()
    return score


#: Walks over traces and operations: share that goes on, weight of calls beside traces, and steps.
DAMPING, CALLS, STEPS = 0.85, 0.01, 20


def trace_walk(spans: DataFrame, traces: DataFrame, by: tuple[str, ...] = (), damping: float = DAMPING, calls: float = CALLS, steps: int = STEPS) -> DataFrame:
    """by, op, score: walks over the given traces (by, trace_id) and their operations, restarting at traces, those with few
    operations more often. Traces pass their weight on to their operations in equal shares, operations theirs to their traces
    and, by ``calls``, to the operations they call. A group's scores add up to 1; all groups step together.

    Two steps lead from operations over traces to operations. The traces' operations are dealt out by trace and kept in that
    order, so the way over a trace is a sum within it and only sums by operation are shuffled; no trace gives all pairs
    of its operations. Two steps of the walk share a pass over the traces.
    """
    by, of = list(by), [*by, "trace_id"]
    seen = spans.join(traces.select(*of), "trace_id")
    within = Window.partitionBy(*of)
    pairs = seen.select(*of, "op").repartition(*of).distinct().withColumn("k", F.count("*").over(within)).persist()
    ops = stored(pairs.groupBy(*by, "op").agg(F.count("*").alias("m")).withColumn("id", F.monotonically_increasing_id()), "walk")
    n = ops.count()
    few = lambda frame: limited(frame, n, 24)
    held = pairs.join(few(ops), [*by, "op"]).select(*of, "k", "m", "id").sortWithinPartitions(*of).persist()
    up = seen.select(*of, F.col("span_id").alias("parent_id"), F.col("op").alias("from"))
    edges = seen.join(up, [*of, "parent_id"]).groupBy(*by, "from", "op").agg(F.count("*").alias("n"))
    edges = edges.join(few(ops.select(*by, "op", "id")), [*by, "op"]).join(few(ops.select(*by, F.col("op").alias("from"), F.col("id").alias("from_id"))), [*by, "from"])
    edges = stored(edges.select("from_id", "id", "n"), "walk")
    out = edges.groupBy("from_id").agg(F.sum("n").alias("out"))
    edges = stored(edges.join(few(out), "from_id").select("from_id", "id", (damping * calls * F.col("n") / F.col("out")).alias("w")), "walk")
    total = held.groupBy(*by).agg(F.sum(1 / (F.col("k") * F.col("k"))).alias("all"))  # 1 / k of each trace
    restart = held.groupBy(*by, "id").agg(F.sum(damping * (1 - damping) / (F.col("k") * F.col("k"))).alias("r"))
    restart = restart.join(F.broadcast(total), by) if by else restart.crossJoin(F.broadcast(total))  # one row
    restart = stored(restart.select("id", (F.col("r") / F.col("all")).alias("r")), "walk")

    def called(s: DataFrame, value: str) -> DataFrame:
        return edges.join(few(s.select(F.col("id").alias("from_id"), F.col(value).alias("s"))), "from_id").select("id", (F.col("w") * F.col("s")).alias("s"))

    # "was", "now": the last two steps of the walk; a round makes the next two
    score = restart.select("id", F.lit(0.0).alias("was"), F.col("r").alias("now"))
    for done in range(0, steps, 2):
        over = held.join(few(score), "id")
        over = over.select("id", *[(damping * damping / F.col("k") * F.sum(F.col(c) / F.col("m")).over(within)).alias(c) for c in ("was", "now")])
        parts = over.unionByName(called(score, "now").select("id", F.col("s").alias("was"), F.lit(0.0).alias("now"))).unionByName(restart.select("id", F.col("r").alias("was"), F.col("r").alias("now")))
        score = stored(parts.groupBy("id").agg(F.sum("was").alias("was"), F.sum("now").alias("now")), "walk")
        if done + 1 == steps:
            score = score.withColumn("now", F.col("was"))
            break
        parts = score.unionByName(called(score, "was").select("id", F.lit(0.0).alias("was"), F.col("s").alias("now")))
        score = stored(parts.groupBy("id").agg(F.sum("was").alias("was"), F.sum("now").alias("now")), "walk")
    pairs.unpersist()
    held.unpersist()
    scored = ops.select(*by, "op", "id").join(few(score), "id")
    whole = scored.groupBy(*by).agg(F.sum("now").alias("all"))
    scored = scored.join(F.broadcast(whole), by) if by else scored.crossJoin(F.broadcast(whole))  # one row
    return scored.select(*by, "op", (F.col("now") / F.col("all")).alias("score"))


def two_sided_spectrum(spans: DataFrame, traces: DataFrame, bad_score: DataFrame, good_score: DataFrame) -> DataFrame:
    """op, suspicion: as ``spectrum``, anomalous and normal traces weighed by the walk over their own side. An operation of
    normal traces alone has its count raised by its score instead, and nothing against it but that."""
    seen = spans.select("trace_id", "op").distinct().join(traces.select("trace_id", "anomalous"), "trace_id")
    counts = seen.groupBy("op").agg(F.count_if("anomalous").alias("bad"), F.count_if(~F.col("anomalous")).alias("good"))
    total = traces.agg(F.count_if("anomalous").alias("all_bad"))
    rows = counts.join(bad_score.withColumnRenamed("score", "a"), "op", "left").join(good_score.withColumnRenamed("score", "g"), "op", "left").crossJoin(F.broadcast(total))  # one row
    a, g = F.coalesce("a", F.lit(0.0)), F.coalesce("g", F.lit(0.0))
    only = F.col("bad") == 0
    ef = F.when(only, 0.0).otherwise(F.col("bad") * a)
    nf = F.when(only, F.col("all_bad").cast("double")).otherwise((F.col("all_bad") - F.col("bad")) * a)
    ep = F.when(only, (1 + g) * F.col("good")).otherwise(F.col("good") * g)
    low = F.lit(1e-7)
    ef, ep, nf = (F.when(x == 0, low).otherwise(x) for x in (ef, ep, nf))
    return rows.select("op", F.when(ep + nf > 0, ef * ef / (ep + nf)).otherwise(0.0).alias("suspicion"))


def scenario_sides(points: DataFrame, windows: DataFrame, before: int = 1800, width: int = 3600) -> DataFrame:
    """sid, trace_id, side: traces that start in a scenario's window, and the normal ones of the stretch before it."""
    sides = F.array(F.struct(F.lit("incident").alias("side"), F.col("st").alias("a"), F.col("ed").alias("z")), F.struct(F.lit("normal").alias("side"), (F.col("st") - before).alias("a"), (F.col("st") - 1).alias("z")))
    right = windows.select("sid", F.explode(sides).alias("w")).select("sid", "w.*").withColumn("slot", F.explode(by_slots(F.col("a"), F.col("z"), width)))
    left = points.select("trace_id", "sec", F.floor(F.col("sec") / width).alias("slot"))
    return left.join(right, "slot").where("sec between a and z").select("sid", "trace_id", "side")


def spectrum(spans: DataFrame, traces: DataFrame, score: DataFrame) -> DataFrame:
    """op, suspicion ef^2 / (ep + nf): ef and ep weigh the anomalous and normal traces that have the operation by its
    score, nf counts the anomalous ones that lack it."""
    seen = spans.select("trace_id", "op").distinct().join(traces.select("trace_id", "anomalous"), "trace_id")
    counts = seen.groupBy("op").agg(F.count_if("anomalous").alias("bad"), F.count_if(~F.col("anomalous")).alias("good"))
    total = traces.agg(F.count_if("anomalous").alias("all_bad"))
    rows = counts.join(score, "op").crossJoin(F.broadcast(total))  # one row
    ef, ep, nf = F.col("bad") * F.col("score"), F.col("good") * F.col("score"), (F.col("all_bad") - F.col("bad")) * F.col("score")
    low = F.lit(1e-7)
    ef, ep, nf = (F.when(x == 0, low).otherwise(x) for x in (ef, ep, nf))
    return rows.select("op", F.when(ep + nf > 0, ef * ef / (ep + nf)).otherwise(0.0).alias("suspicion"))


def by_service(ops: DataFrame, value: str) -> DataFrame:
    """service, score: the operations' values added up; the service stands before the first underscore."""
    return ops.groupBy(F.substring_index("op", "_", 1).alias("service")).agg(F.sum(value).alias("score"))


def heuristic(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Sum plus twice the largest value plus five for each span."""
    return rows.groupBy(*by).agg((F.sum(value) + 2 * F.max(value) + 5 * F.count("*")).alias("score"))


def ranked(rows: DataFrame, *by: str, name: str = "service", digits: int = 6) -> DataFrame:
    """rows with rank: highest score first, names in order where scores agree to so many decimals."""
    order = Window.partitionBy(*by) if by else Window.partitionBy()
    return rows.withColumn("rank", F.row_number().over(order.orderBy(F.desc(F.round("score", digits)), name)).cast("long"))


def hit(rank: Column, k: int) -> Column:
    return F.when(rank <= k, 1.0).otherwise(0.0)
