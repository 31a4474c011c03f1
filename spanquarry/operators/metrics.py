"""Service metrics beside traces: normalisation, a registry of names, evidence for each trace, bias of an incident."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, drop_two_parts, jaccard, nearest_rank, sigmoid, top_weighted
from ..functions.storage import bounded, stored
from .ordering import CHUNK
from .retention import medians
from .traces import as_of

#: Weights of the deviations in a service's intensity.
INTENSITY = {"cpu": 0.24, "load": 0.12}


def rolling_scale(metrics: DataFrame, value: str, last: int = 120, q: float = 0.95) -> DataFrame:
    """metrics (service, sec, ...) with value divided by the nearest-rank quantile of the service's last values, itself
    included, and held within 0 and 1."""
    window = Window.partitionBy("service").orderBy("sec").rowsBetween(1 - last, 0)
    top = nearest_rank(F.collect_list(value).over(window), q)
    return metrics.withColumn(f"{value}_share", F.when(top > 0, clamp(F.col(value) / top, 0.0, 1.0)).otherwise(0.0))


def deviations(metrics: DataFrame, values: list[str]) -> DataFrame:
    """metrics with value_z: distance from the service's median in robust scales (the larger of the standard and the
    scaled median deviation), within 0 and 10. The medians look at the whole history: within one window for services of up
    to ``ordering.CHUNK`` rows, from counts and buckets for larger ones."""
    metrics = stored(metrics, "metrics")
    large = stored(metrics.groupBy("service").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select("service"), "large")
    own = Window.partitionBy("service")
    small = metrics.join(bounded(large, 64), "service", "left_anti")
    small = small.select("*", *[F.stddev_pop(v).over(own).alias(f"{v}_std") for v in values], *[F.percentile(v, 0.5).over(own).alias(f"{v}_med") for v in values])
    rows = small.select("*", *[F.percentile(F.abs(F.col(v) - F.col(f"{v}_med")), 0.5).over(own).alias(f"{v}_mad") for v in values])
    if large.take(1):
        rows = rows.unionByName(_with_scales(metrics.join(bounded(large, 64), "service", "left_semi"), values))
    for v in values:
        scale = F.greatest(F.lit(1e-6), f"{v}_std", 1.4826 * F.col(f"{v}_mad"))
        rows = rows.withColumn(f"{v}_z", clamp(F.abs(F.col(v) - F.col(f"{v}_med")) / scale, 0.0, 10.0)).drop(f"{v}_med", f"{v}_std", f"{v}_mad")
    return rows


def _with_scales(metrics: DataFrame, values: list[str]) -> DataFrame:
    """metrics with value_std, value_med and value_mad of the service, without a task that sees a whole service."""
    rows = metrics.join(metrics.groupBy("service").agg(*[F.stddev_pop(v).alias(f"{v}_std") for v in values]), "service")
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("v")) for v in values]))
    found = medians(metrics.select("service", each.alias("x")).select("service", "x.*"), ["service", "name"], "v")
    of = lambda v, c: F.max(F.when(F.col("name") == v, F.col(c)))
    wide = found.groupBy("service").agg(*[of(v, "med").alias(f"{v}_med") for v in values], *[of(v, "mad").alias(f"{v}_mad") for v in values])
    return rows.join(bounded(wide, 32 * len(values)), "service")


def registry(services: DataFrame, pods: DataFrame, best: int = 8) -> DataFrame:
    """service, pod, match, place: for each service the pods whose names are most alike, by shared parts.

    Names meet in a join on their parts, so only pairs with a part in common are looked at.
    """
    parts = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[-_]"), lambda p: p != ""))
    left = services.select("service", parts(F.col("service")).alias("a")).distinct()
    right = pods.select("pod", parts(F.col("pod")).alias("b")).distinct()
    pairs = left.withColumn("part", F.explode("a")).join(right.withColumn("part", F.explode("b")), "part").select("service", "pod", "a", "b").distinct()
    inside = F.when(F.contains(F.lower("pod"), F.lower("service")), 0.75).otherwise(0.0)
    match = F.when(F.lower("service") == F.lower("pod"), 1.0).otherwise(F.greatest(jaccard(F.col("a"), F.col("b")), inside))
    place = F.row_number().over(Window.partitionBy("service").orderBy(F.desc("match"), "pod"))
    return pairs.withColumn("match", match).withColumn("place", place.cast("long")).where(F.col("place") <= best).select("service", "pod", "match", "place")


def registry_confidence(services: DataFrame, pods: DataFrame, width: int = 3600, best: int = 8) -> DataFrame:
    """service, pod, name, overlap, coverage, confidence, place: for each service its best pods by likeness of names,
    shared slots of time (over the fewer of the two), and how much a pod has been seen (over the most seen one).

    services: service, sec; pods: pod, sec. Pairs meet in equi-joins on parts of names and on time slots, so no pair that
    could count is left out and none is looked at that shares neither; pairs with a name likeness and an overlap of at most
    0.05 don't count.
    """
    parts = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[-_]"), lambda p: p != ""))
    slots = lambda rows, c: rows.select(c, F.floor(F.col("sec") / width).alias("slot")).groupBy(c, "slot").agg(F.count("*").alias("n"))
    left, right = stored(slots(services, "service"), "services"), stored(slots(pods, "pod").repartition("pod"), "pods")  # what follows is by pod
    shared = right.select("pod", "slot").join(bounded(left.select("service", "slot"), 64), "slot").groupBy("service", "pod").agg(F.count("*").alias("shared"))
    a, b = left.groupBy("service").agg(F.count("*").alias("a")), right.groupBy("pod").agg(F.count("*").alias("b"), F.sum("n").alias("seen"))
    b = stored(b, "seen")
    most = b.agg(F.max("seen").alias("most"))
    by_name = a.select("service", F.explode(parts(F.col("service"))).alias("part")).join(b.select("pod", F.explode(parts(F.col("pod"))).alias("part")), "part").select("service", "pod").distinct()
    pairs = shared.join(by_name.withColumn("named", F.lit(True)), ["service", "pod"], "full").join(a, "service").join(b, "pod").crossJoin(F.broadcast(most))  # one row
    inside = F.when(F.contains(F.lower("pod"), F.lower("service")) | F.contains(F.lower("service"), F.lower("pod")), 0.75).otherwise(0.0)
    name = F.when(F.lower("service") == F.lower("pod"), 1.0).otherwise(F.greatest(jaccard(parts(F.col("service")), parts(F.col("pod"))), inside))
    rows = pairs.withColumn("name", name).withColumn("overlap", F.coalesce("shared", F.lit(0)) / F.least("a", "b")).withColumn("coverage", F.col("seen") / F.col("most"))
    rows = rows.where((F.col("name") > 0.05) | (F.col("overlap") > 0.05)).withColumn("confidence", 0.45 * F.col("name") + 0.35 * F.col("overlap") + 0.20 * F.col("coverage"))
    place = F.row_number().over(Window.partitionBy("service").orderBy(F.desc(F.round("confidence", 9)), "pod"))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= best).select("service", "pod", "name", "overlap", "coverage", "confidence", "place")


def name_scores(services: DataFrame, pods: DataFrame) -> DataFrame:
    """service, pod, score: 1 for equal names, 0.85 for a service whose name begins the pod's (up to a dash), 0.65 where the
    pod's name without its last parts is the service's without a closing -service. Equi-joins on what would be equal."""
    names, p = services.select("service").distinct(), pods.select("pod").distinct()
    pieces = F.split("pod", "-")
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), lambda k: F.array_join(F.slice(pieces, F.lit(1), k), "-"))
    bare = F.regexp_replace("service", "-service$", "")
    keys = p.select("pod", F.explode(F.concat(F.array(F.struct(F.col("pod").alias("key"), F.lit(1.0).alias("score"))), F.transform(F.filter(heads, lambda h: h != F.col("pod")), lambda h: F.struct(h.alias("key"), F.lit(0.85).alias("score"))))).alias("x")).select("pod", "x.*")
    exact = names.join(keys, names.service == keys.key).select("service", "pod", "score")
    stripped = F.regexp_replace(drop_two_parts(F.col("pod")), "-service$", "")
    loose = names.select("service", bare.alias("key")).join(p.select("pod", stripped.alias("key")), "key").select("service", "pod", F.lit(0.65).alias("score"))
    return exact.unionByName(loose).groupBy("service", "pod").agg(F.max("score").alias("score"))


def evidence(points: DataFrame, metrics: DataFrame, lookback: int) -> DataFrame:
    """trace_id, intensity, coverage, reliability, evidence: for each service of a trace the freshest deviations within
    the lookback, weighed by their age; the three strongest services count, times the share that has metrics at all."""
    asked = points.select("trace_id", "sec", F.explode("services").alias("service"))
    found = as_of(asked, metrics, lookback)
    strength = sum((w * F.col(f"{v}_z") for v, w in INTENSITY.items()), F.lit(0.0))
    fresh = F.exp(-(F.col("sec") - F.col("m_sec")) / lookback)
    rows = found.groupBy("trace_id").agg(F.collect_list(strength * fresh).alias("all"), F.count("m_sec").alias("known"), F.count("*").alias("asked"), F.avg(fresh).alias("reliability"))
    rows = rows.select("trace_id", top_weighted(F.col("all")).alias("intensity"), (F.col("known") / F.col("asked")).alias("coverage"), F.coalesce("reliability", F.lit(0.0)).alias("reliability"))
    return rows.withColumn("evidence", F.col("intensity") * F.col("coverage"))


def history_boost(points: DataFrame, history: DataFrame) -> DataFrame:
    """trace_id, metric, boost: how far the services' latest values lie above their history, and what that adds to p.

    history: trace_id, service, value, med, mad, history_count. Services with more than ten values before count.
    """
    z = clamp((F.col("value") - F.col("med")) / (F.col("mad") + 1.0), 0.0, 10.0)
    known = history.where("history_count > 10").groupBy("trace_id").agg(F.collect_list(z).alias("z"), F.count("*").alias("known"), F.max("history_count").alias("most"), F.sum("history_count").alias("total"))
    rows = points.select("trace_id", F.size("services").alias("n")).join(known, "trace_id", "left")
    metric = F.coalesce(top_weighted(F.col("z")), F.lit(0.0))
    cover = F.coalesce(F.col("known") / F.col("n") * F.exp(-F.col("most") / F.col("total")), F.lit(0.0))
    spread = F.coalesce(F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x) / F.size("z") - F.pow(F.aggregate("z", F.lit(0.0), lambda a, x: a + x) / F.size("z"), 2.0) + 1e-12), F.lit(0.0))
    rows = rows.withColumn("metric", metric)
    return rows.select("trace_id", "metric", F.least(F.lit(0.4), 0.2 * cover * sigmoid(2 * (F.col("metric") - 1.5)) * clamp(spread / 3, 0.2, 1.0) * F.col("metric")).alias("boost"))


def bias(metrics: DataFrame, at: Column, reach: int) -> DataFrame:
    """One row: the share of each deviation around a moment, their mass, and the confidence that it is uneven enough to
    follow (entropy against that of a level spread)."""
    near = metrics.where(F.abs(F.col("sec") - at) <= reach)
    rows = near.agg(F.coalesce(F.sum("cpu_z"), F.lit(0.0)).alias("cpu"), F.coalesce(F.sum("load_z"), F.lit(0.0)).alias("load"))
    mass = F.col("cpu") + F.col("load")
    rows = rows.select("cpu", "load", mass.alias("mass"), *[F.when(mass > 0, F.col(c) / mass).otherwise(0.5).alias(f"{c}_share") for c in ("cpu", "load")])
    h = -sum((F.when(F.col(f"{c}_share") > 0, F.col(f"{c}_share") * F.ln(f"{c}_share")).otherwise(0.0) for c in ("cpu", "load")), F.lit(0.0))
    return rows.withColumn("confidence", clamp(0.10 + 0.60 * (1 - h / F.ln(F.lit(2.0))) + 0.30 * clamp(F.ln(1 + F.col("mass")) / F.ln(F.lit(6.0)), 0.0, 1.0), 0.0, 1.0))
