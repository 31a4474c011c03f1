"""Budgeted trace sampling: scores, ensembles, guards and caps. What is decided trace after trace is in ``folds``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, hash_uniform, sigmoid, target_size
from .ordering import numbered
from .windows import error_mean, suspicious

#: Weights of the ensemble's four parts by budget in percent (up to 0.1, up to 1, beyond).
VOTE_WEIGHTS = ((0.1, (0.46, 0.28, 0.18, 0.08)), (1.0, (0.42, 0.28, 0.18, 0.12)), (None, (0.38, 0.26, 0.18, 0.18)))
#: Least shares of clean and of failed traces by budget.
GUARD_FLOORS = ((0.1, (0.30, 0.15)), (1.0, (0.38, 0.18)), (None, (0.44, 0.16)))
#: Quantile of the evidence that counts as neutral, and gain, by budget.
TAU, GAIN = ((0.1, 0.60), (1.0, 0.55), (None, 0.50)), ((0.1, 0.45), (1.0, 0.60), (None, 0.75))


def by_budget(table: tuple, budget: float):
    return next(v for limit, v in table if limit is None or budget <= limit)


def tokens() -> Column:
    """What a trace is compared by: its services, and the classes of its duration and size."""
    d, n = F.col("duration_ms"), F.col("span_count")
    long = F.when(d < 100, "dur:a").when(d < 500, "dur:b").when(d < 2000, "dur:c").otherwise("dur:d")
    size = F.when(n <= 3, "span:a").when(n <= 8, "span:b").when(n <= 20, "span:c").otherwise("span:d")
    return F.array_sort(F.array_union(F.transform("services", lambda s: F.concat(F.lit("svc:"), s)), F.array(long, size)))


def strict_cap(rows: DataFrame, share: float, by: str = "has_error") -> DataFrame:
    """trace_id, the class and ``place`` in it of the rows that the budget keeps, classes in their own shares (half to
    even, the rest to the other class): of each class the longest, then largest traces."""
    n = rows.agg(F.count("*").alias("n"), F.count_if(by).alias("e"))
    n = n.select(target_size(F.col("n"), share).alias("target"), "n", "e")
    n = n.withColumn("quota", F.least(F.col("e"), F.bround(F.col("target") * F.col("e") / F.col("n")).cast("long"))).select("target", "quota")
    kept = F.when(F.col(by), F.col("quota")).otherwise(F.col("target") - F.col("quota"))
    placed = numbered(rows.select("trace_id", by, "duration_ms", "span_count"), [by], F.desc("duration_ms"), F.desc("span_count"), F.desc("trace_id"))
    return placed.crossJoin(F.broadcast(n)).where(F.col("place") <= kept).drop("target", "quota")  # one row


def votes(rows: DataFrame, members: tuple[int, ...] = (11, 22, 33)) -> Column:
    """How many members of the ensemble pick a trace: each draws against its probability with its own hash."""
    return sum((F.when(hash_uniform(F.col("trace_id"), m, 0) < F.col("p"), 1).otherwise(0) for m in members), F.lit(0))


def consensus(rows: DataFrame, budget: float, members: int = 3) -> DataFrame:
    """rows (votes, rca, p, evidence, rarity, contrast) with their consensus score."""
    a, b, c, d = by_budget(VOTE_WEIGHTS, budget)
    score = a * F.col("votes") / members + b * (0.65 * F.col("rca") + 0.35 * F.col("p")) + c * sigmoid(F.col("evidence") - 1) + d * (0.6 * F.col("rarity") + 0.4 * F.col("contrast"))
    return rows.withColumn("consensus", score)


def shift(evidence: Column, trust: Column, budget: float, tau: Column, scale: Column, bound: float = 0.75) -> Column:
    """How far evidence shifts a probability on the logit scale: by its signed distance from neutral, as far as it is
    trusted (coverage times reliability), within a bound."""
    signed = 2 * sigmoid((evidence - tau) / scale) - 1
    return clamp(by_budget(GAIN, budget) * signed * trust, -bound, bound)


def guarded(rows: DataFrame, target: int, budget: float, *order: Column) -> DataFrame:
    """``target`` rows in an order without ties, at least a floor of clean and of failed ones first: guaranteed rows
    (``sure``), then the best others."""
    normal, failed = by_budget(GUARD_FLOORS, budget)
    placed = numbered(rows, ["has_error"], *order, name="own").where(F.col("own") <= target)  # no class can give more
    floor = F.when(F.col("has_error"), round(target * failed)).otherwise(round(target * normal))
    placed = placed.withColumn("sure", F.col("own") <= floor)
    return numbered(placed, [], F.desc("sure"), *order, name="kept_place").where(F.col("kept_place") <= target)


def shock(parts: dict[str, tuple[Column, Column, Column]], weights: dict[str, float]) -> Column:
    """Weighted distance of values from their means in their sigmas: name -> (value, mean, sigma)."""
    return sum((weights[k] * F.abs(x - m) / (s + 1e-6) for k, (x, m, s) in parts.items()), F.lit(0.0))


def incident_floor(p: Column, incident: Column, error: Column, near: Column, latency: Column) -> Column:
    """p, at least a floor in incidents: failed traces near the moment, then slow ones ever nearer to it."""
    floor = F.when(error & (near >= 0.55), 0.62).when((near >= 0.78) & (latency >= 0.58), 0.56).when((near >= 0.88) & (latency >= 0.50), 0.50).otherwise(0.0)
    return F.when(incident, F.greatest(p, floor)).otherwise(p)


def quadrant(error: Column, hit: Column, ratio: Column) -> Column:
    """Rank value of a trace: failed and touching suspicious services, neither, failed only, touching only."""
    return F.when(error & hit, 0.80 + 0.10 * ratio).when(~error & ~hit, 0.50).when(error, 0.28).otherwise(0.40)


def online_state(points: DataFrame, min_history: int = 8, rate: float = 0.15) -> DataFrame:
    """trace_id, hit, ratio, rarity, history, contrast, rca: what the traces before it say of a trace. hit and ratio: whether
    any, and how many, of its services have failed suspiciously often; rarity: mean of 1/sqrt(1 + traces of a service);
    history: mean of all error flags before."""
    touched = points.select("trace_id", F.explode("services").alias("service"), "start_ns", "has_error")
    seen = suspicious(touched, min_history, rate).groupBy("trace_id").agg(F.max("suspicious").alias("hit"), F.avg(F.col("suspicious").cast("int")).alias("ratio"), F.avg(1 / F.sqrt(F.col("prior") + 1)).alias("rarity"))
    rows = points.select("trace_id", "has_error").join(seen, "trace_id").join(error_mean(points.select("trace_id", "start_ns", "has_error")).withColumnRenamed("error_mean", "history"), "trace_id")
    contrast = 0.65 * F.col("hit").cast("int") + 0.35 * F.abs(F.col("has_error").cast("int") - F.col("history"))
    return rows.select("trace_id", "hit", "ratio", "rarity", "history", contrast.alias("contrast"), quadrant(F.col("has_error"), F.col("hit"), F.col("ratio")).alias("rca"))


def exact_target(rows: DataFrame, target: int, *order: Column) -> DataFrame:
    """Exactly ``target`` rows (or all there are) in an order without ties, at least a floor of failed ones among them: their
    share of all rows times 1.4, within 8 and 40 percent of the target."""
    n = rows.agg(F.count("*").alias("n"), F.count_if("has_error").alias("e"))
    share = F.when(F.col("n") > 0, F.col("e") / F.col("n")).otherwise(0.0)
    need = n.select(F.bround(target * clamp(F.greatest(F.lit(0.08), 1.4 * share), 0.08, 0.40)).cast("long").alias("need"))
    placed = numbered(rows, ["has_error"], *order, name="own").where(F.col("own") <= target)
    placed = placed.crossJoin(F.broadcast(need)).withColumn("sure", F.col("has_error") & (F.col("own") <= F.col("need"))).drop("need")  # one row
    return numbered(placed, [], F.desc("sure"), *order, name="final_place").where(F.col("final_place") <= target)


def scenario_floor(kept: DataFrame, members: DataFrame, target: int, floor: int = 1) -> DataFrame:
    """kept rows (trace_id, place) trimmed to the target while each scenario keeps its first ``floor`` traces, as far
    as the target allows. Works on the kept rows only, which the budget bounds."""
    own = Window.partitionBy("sid").orderBy("place")
    sure = members.join(kept, "trace_id").withColumn("r", F.row_number().over(own)).where(F.col("r") <= floor).select("trace_id").distinct().withColumn("sure", F.lit(1))
    rows = kept.join(sure, "trace_id", "left").withColumn("sure", F.coalesce("sure", F.lit(0)))
    return numbered(rows, [], F.desc("sure"), F.col("place"), name="final_place").where(F.col("final_place") <= target)


def diversity(mass: Column, similarity: Column, incident: Column, gamma: float = 1.0) -> Column:
    """p_d: falls with the mass of a trace's cluster; less so in incidents."""
    g = F.when(incident, max(0.35, 0.55 * gamma)).otherwise(0.8)
    floor = F.when(incident, 0.20).otherwise(0.05)
    return F.least(F.greatest(F.pow(1 + F.when(incident, 0.35).otherwise(1.0) * mass * similarity, -g), floor), F.lit(1.0))
