"""Traces ranked by how well the state of their pods fits that of an incident, in six dimensions, and a rescue of the best
from a bounded pool.

A trace's state comes from its services' pods: for each service the registry's few pods, each with its latest deviations at
or before the trace (an equi-join on time slots). The incident's state is one row, the mean of all deviations around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp, cosine, top_weighted
from ..functions.storage import bounded, stored
from .metrics import deviations
from .ordering import numbered
from .traces import intervals
from .windows import local_density

METRICS = ("cpu", "mem", "latency", "workload", "node", "error_rate")
#: Weights of the deviations in a pod's intensity, and in the choice of a service's pod.
INTENSITY = {"cpu": 0.24, "mem": 0.20, "latency": 0.24, "workload": 0.12, "node": 0.12, "error_rate": 0.08}
QUALITY = {"latency": 0.30, "cpu": 0.25, "mem": 0.20, "workload": 0.15, "node": 0.10}
#: Shares of probability, diversity and fit in the first score; of first score, fit and prior in the second;
#: of error density, slowness, services of incidents and nearness in the prior.
FIRST, SECOND, PRIOR = (0.60, 0.15, 0.25), (0.55, 0.25, 0.20), (0.40, 0.30, 0.20, 0.10)


def pod_metrics(spans: DataFrame, points: DataFrame, width: int = 3600) -> DataFrame:
    """pod, sec (of the slot) and the six metrics of spans that carry their pod: mean and largest weight, the longest time
    since the start of a span's trace (ms), spans, traces at work, share of failed spans."""
    rows = spans.join(points.select("trace_id", F.expr("start_ns div 1000").alias("t0")), "trace_id")
    slot = (F.floor(F.col("sec") / width) * width).cast("long").alias("sec")
    of_traces = rows.groupBy("pod", slot, "trace_id").agg(F.sum("weight").alias("w"), F.count("weight").alias("k"), F.max("weight").alias("mem"), F.max("start_us").alias("last"), F.first("t0").alias("t0"), F.count("*").alias("n"), F.count_if("failed").alias("e"))
    return of_traces.groupBy("pod", "sec").agg(
        (F.sum("w") / F.sum("k")).alias("cpu"), F.max("mem").alias("mem"), F.max((F.col("last") - F.col("t0")) / 1000.0).alias("latency"), F.sum("n").alias("workload"), F.count("*").alias("node"), (F.sum("e") / F.sum("n")).alias("error_rate"),
    )


def pod_deviations(metrics: DataFrame) -> DataFrame:
    """pod, sec and each metric's deviation from the pod's own median, as ``metrics.deviations`` has it for services."""
    found = deviations(metrics.withColumnRenamed("pod", "service"), list(METRICS))
    return found.select(F.col("service").alias("pod"), "sec", *[f"{m}_z" for m in METRICS])


def snapshots(points: DataFrame, pods: DataFrame, registry: DataFrame, lookback: int) -> DataFrame:
    """trace_id, sec, service, pod, confidence, m_sec and the deviations: for each service of a trace and each of its pods
    in the registry (service, pod, confidence; a few for a service) the latest row at most ``lookback`` seconds old. Pods
    without one are left out."""
    found = snapshot_lists(points, pods, registry, lookback)
    return found.select("trace_id", "sec", "service", F.explode("pods").alias("x")).select("trace_id", "sec", "service", "x.*")


def snapshot_lists(points: DataFrame, pods: DataFrame, registry: DataFrame, lookback: int, longest: int = 512, width: int = 3600) -> DataFrame:
    """The same with a service's pods as one array: trace_id, sec, service, pods. Only pods of the registry are looked at.
    Each service has a list for each time slot, from which a trace picks what fits, so a trace's services are joined once and
    nothing is grouped after it; lists of more than ``longest`` rows are joined row by row instead."""
    registry = bounded(registry, 128)
    valid = intervals(pods.join(registry.select("pod").distinct(), "pod", "left_semi").withColumnRenamed("pod", "service"), lookback, width)
    one = F.struct("pod", "confidence", "m.*").alias("one")
    valid = stored(valid.withColumnRenamed("service", "pod").join(registry, "pod").select("service", "slot", "until", one), "snapshots")
    asked = points.select("trace_id", "sec", F.explode("services").alias("service"), F.floor(F.col("sec") / width).alias("slot"))
    lists = valid.groupBy("service", "slot").agg(F.collect_list(F.struct("until", "one")).alias("all"))
    if (lists.agg(F.max(F.size("all"))).first()[0] or 0) > longest:
        fits = F.col("sec").between(F.col("one.m_sec"), F.col("until"))
        return asked.join(bounded(valid, 160), ["service", "slot"]).where(fits).groupBy("trace_id", "sec", "service").agg(F.collect_list("one").alias("pods"))
    found = F.filter("all", lambda x: F.col("sec").between(x["one"]["m_sec"], x["until"]))
    rows = asked.join(bounded(lists, 4096), ["service", "slot"]).select("trace_id", "sec", "service", F.transform(found, lambda x: x["one"]).alias("pods"))
    return rows.where(F.size("pods") > 0)


def _listed(found: DataFrame) -> DataFrame:
    if "pods" in found.columns:
        return found
    others = [c for c in found.columns if c not in ("trace_id", "sec", "service")]
    return found.groupBy("trace_id", "sec", "service").agg(F.collect_list(F.struct(*others)).alias("pods"))


def pod_evidence(points: DataFrame, found: DataFrame, lookback: int) -> DataFrame:
    """trace_id, intensity, coverage, reliability, evidence, unmatched of all points, from their snapshots (rows or lists): a
    pod's weighted deviations times its reliability (confidence, and age within the lookback); of a service the three strongest
    pods count, of a trace the three strongest services. coverage is the share of services with a pod, unmatched the number
    without; reliability the mean over the services of that over their pods."""
    rel = lambda x: x["confidence"] * F.exp(-(F.col("sec") - x["m_sec"]) / lookback)
    strength = lambda x: F.greatest(F.lit(0.0), sum((w * x[f"{m}_z"] for m, w in INTENSITY.items()), F.lit(0.0)))
    mean = F.aggregate(F.transform("pods", rel), F.lit(0.0), lambda a, x: a + x) / F.size("pods")
    each = _listed(found).select("trace_id", top_weighted(F.transform("pods", lambda x: strength(x) * rel(x))).alias("strength"), mean.alias("rel"))
    rows = each.groupBy("trace_id").agg(top_weighted(F.collect_list("strength")).alias("intensity"), F.avg("rel").alias("reliability"), F.count("*").alias("known"))
    rows = points.select("trace_id", F.size("services").alias("n")).join(rows, "trace_id", "left").na.fill(0)
    coverage = F.when(F.col("n") > 0, F.col("known") / F.col("n")).otherwise(0.0)
    return rows.select("trace_id", "intensity", coverage.alias("coverage"), "reliability", (F.col("intensity") * coverage).alias("evidence"), (F.col("n") - F.col("known")).alias("unmatched"))


def states(points: DataFrame, found: DataFrame) -> DataFrame:
    """trace_id, state: means over a trace's services of cpu, memory, latency, (the trace's own error,) node and workload
    deviations times the confidence, of the pod (snapshots: rows or lists) whose weighted deviations times the confidence are
    the largest (to six decimals; then the first name). Services without a pod don't count; a trace without any has zeros."""
    quality = lambda x: x["confidence"] * sum((w * x[f"{m}_z"] for m, w in QUALITY.items()), F.lit(0.0))
    own = lambda x: [(x["confidence"] * x[f"{m}_z"]).alias(m) for m in QUALITY]
    best = F.array_min(F.transform("pods", lambda x: F.struct((-F.round(quality(x), 6)).alias("least"), x["pod"].alias("pod"), *own(x))))
    means = _listed(found).select("trace_id", best.alias("own")).groupBy("trace_id").agg(*[F.avg(f"own.{m}").alias(m) for m in QUALITY])
    rows = points.select("trace_id", F.col("has_error").cast("double").alias("error")).join(means, "trace_id", "left").na.fill(0.0)
    return rows.select("trace_id", F.array("cpu", "mem", "latency", "error", "node", "workload").alias("state"))


def bias(points: DataFrame, pods: DataFrame, at: int, reach: int) -> DataFrame:
    """One row: bias (mean deviations of all pods within ``reach`` seconds of a moment, and in fourth place the share of
    failed traces there, or of all if there is none), mass (its sum), confidence that it is uneven and strong enough to
    follow; 0 for no mass."""
    near = F.abs(F.col("sec") - at) <= reach
    d = pods.where(near).agg(*[F.coalesce(F.avg(f"{m}_z"), F.lit(0.0)).alias(m) for m in METRICS])
    failed = F.col("has_error").cast("int")
    e = points.agg(F.coalesce(F.avg(F.when(near, failed)), F.avg(failed), F.lit(0.0)).alias("error"))
    rows = d.crossJoin(F.broadcast(e)).select(F.array("cpu", "mem", "latency", "error", "node", "workload").alias("bias"))  # one row
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("mass", total(F.col("bias")))
    share = F.transform(F.filter("bias", lambda x: x > 1e-12), lambda x: x / F.col("mass"))
    uneven = 1 + total(F.transform(share, lambda p: p * F.ln(p))) / F.ln(F.size("bias"))
    strong = clamp(F.log1p("mass") / F.ln(F.lit(6.0)), 0.0, 1.0)
    return rows.withColumn("confidence", F.when(F.col("mass") > 1e-12, clamp(0.10 + 0.60 * uneven + 0.30 * strong, 0.0, 1.0)).otherwise(0.0))


def spread_out(rows: DataFrame, *names: str) -> DataFrame:
    """rows with name_n for each name: scaled to 0..1 over all rows; 0.5 if all are alike."""
    ends = rows.agg(*[f(n).alias(f"_{k}_{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))])
    rows = rows.crossJoin(F.broadcast(ends))  # one row
    for n in names:
        lo, hi = F.col(f"_lo_{n}"), F.col(f"_hi_{n}")
        rows = rows.withColumn(f"{n}_n", F.when(hi <= lo + 1e-12, 0.5).otherwise((F.col(n) - lo) / (hi - lo)))
    return rows.drop(*ends.columns)


def aligned(rows: DataFrame, state: DataFrame, incident: DataFrame) -> DataFrame:
    """rows (trace_id, p_s, p_d) with fit (cosine of a trace's state with the incident's), fit_n, first: the weighted mean
    of probability and diversity, diversity, and fit, each spread out; the fit's weight times the bias's confidence."""
    rows = rows.join(state, "trace_id").crossJoin(F.broadcast(incident.select("bias", "confidence")))  # one row
    rows = rows.withColumn("fit", F.least(cosine(F.col("state"), F.col("bias")), F.lit(1.0))).withColumn("mixed", 0.75 * F.col("p_s") + 0.25 * F.col("p_d"))
    rows = stored(rows.select("trace_id", "p_s", "p_d", "confidence", "fit", "mixed"), "fits")  # the ends are looked for first
    rows = spread_out(rows, "mixed", "p_d", "fit")
    a, b, c = FIRST
    last = c * F.col("confidence")
    first = (a * F.col("mixed_n") + b * F.col("p_d_n") + last * F.col("fit_n")) / (a + b + last)
    return rows.withColumn("first", F.round(first, 6)).drop("confidence", "mixed", "mixed_n", "p_d_n")


def prior(density: Column, slow: Column, overlap: Column, near: Column) -> Column:
    return sum((w * c for w, c in zip(PRIOR, (density, slow, overlap, near), strict=True)), F.lit(0.0))


def pool_factor(share: float) -> float:
    """The pool in targets: the smaller the share that is kept, the larger."""
    return 3.0 if share <= 0.0015 else 2.0 if share <= 0.01 else 1.6


def rescued(points: DataFrame, rows: DataFrame, causes: DataFrame, at: int, share: float) -> DataFrame:
    """trace_id, score, pooled, kept of all rows.

    The best by ``first`` form the pool, which grows with the target only. Within it a second score adds the fit and a
    prior (errors within a minute, slowness, services of incidents, nearness to the moment), and the best are kept, ``share``
    of all. If too few of these failed (their share of all times 1.2, within 8 and 40 percent), the best other failed ones
    take the places of the worst that did not. Ties go by first score, then id.

    points: trace_id, sec, duration_ms, has_error, services; rows: those of ``aligned``; causes: one row, an array of services.
    """
    rows = stored(rows.select("trace_id", "first", "fit_n"), "aligned")
    n = rows.count()
    if not n:
        return rows.select("trace_id", F.col("first").alias("score"), F.lit(False).alias("pooled"), F.lit(False).alias("kept"))
    target = max(1, min(n, round(n * share)))
    pool = max(target, min(n, round(target * pool_factor(share))))
    best = numbered(rows.select("trace_id", "first"), [], F.desc("first"), F.col("trace_id")).where(F.col("place") <= pool).select("trace_id", F.lit(True).alias("_in"))
    facts = spread_out(points.select("trace_id", "sec", "duration_ms", "has_error", "services"), "duration_ms").join(local_density(points, 60), "trace_id").crossJoin(F.broadcast(causes))  # one row
    overlap = F.when((F.size("services") > 0) & (F.size("causes") > 0), F.size(F.array_intersect("services", "causes")) / F.size("services")).otherwise(0.0)
    facts = facts.select("trace_id", "has_error", prior(F.col("density"), F.col("duration_ms_n"), overlap, F.exp(-F.abs(F.col("sec") - at) / 60.0)).alias("prior"))
    rows = spread_out(rows, "first").join(best, "trace_id", "left").join(facts, "trace_id")
    a, b, c = SECOND
    second = F.round(a * F.col("first_n") + b * F.col("fit_n") + c * F.col("prior"), 6)
    pooled = F.coalesce("_in", F.lit(False))
    rows = stored(rows.select("trace_id", "has_error", "first", pooled.alias("pooled"), F.when(pooled, second).otherwise(F.col("first")).alias("score")), "rescue")
    order = (F.desc("score"), F.desc("first"), F.col("trace_id"))
    chosen = numbered(rows.where("pooled").select("trace_id", "score", "first"), [], *order).where(F.col("place") <= target).select("trace_id", F.lit(True).alias("_k"))
    rows = stored(rows.join(chosen, "trace_id", "left").withColumn("kept", F.coalesce("_k", F.lit(False))).drop("_k"), "rescue")
    counts = rows.agg(F.count_if("has_error").alias("all"), F.count_if(F.col("has_error") & F.col("kept")).alias("kept")).first()
    lacking = round(target * min(max(0.08, 1.2 * counts["all"] / n), 0.40)) - counts["kept"]
    if lacking > 0:
        enter = numbered(rows.where("has_error and not kept").select("trace_id", "score", "first"), [], *order, name="k").where(F.col("k") <= lacking)
        leave = numbered(rows.where("kept and not has_error").select("trace_id", "score", "first"), [], F.col("score"), F.col("first"), F.desc("trace_id"), name="k").where(F.col("k") <= lacking)
        pairs = enter.select("k", F.col("trace_id").alias("a")).join(leave.select("k", F.col("trace_id").alias("b")), "k")
        moved = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("trace_id"), F.lit(True).alias("_now")), F.struct(F.col("b").alias("trace_id"), F.lit(False).alias("_now")))).alias("x")).select("x.*")
        rows = rows.join(moved, "trace_id", "left").withColumn("kept", F.coalesce("_now", "kept")).drop("_now")
    return rows.select("trace_id", "score", "pooled", "kept")
