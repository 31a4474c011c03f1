"""Selections under limits that depend on one another: a trim that leaves each scenario its floor, an exchange that never
lowers a score, and the rate that keeps a given share. Each is a few rounds over tables, not a loop over traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import stored
from .ordering import numbered, quantiles, running_sums

#: Places in a stretch of running counts.
STRETCH = 8192


def topped_up(kept: DataFrame, members: DataFrame, floor: int, *order: Column) -> DataFrame:
    """trace_id of kept traces and, for each scenario with fewer than ``floor`` of them, the first others in an order without
    ties. Scenarios are looked at apart, so a trace added for one does not count for another that overlaps it.

    members: sid, trace_id and what the order goes by.
    """
    there = members.join(kept.select("trace_id", F.lit(1).alias("_k")), "trace_id", "left")
    n = there.groupBy("sid").agg(F.count("_k").alias("_n")).where(F.col("_n") < floor)
    others = there.where("_k is null").join(F.broadcast(n), "sid")  # scenarios
    added = numbered(others.drop("_k"), ["sid"], *order, name="_own").where(F.col("_own") <= floor - F.col("_n"))
    return kept.select("trace_id").unionByName(added.select("trace_id")).distinct()


def trimmed(rows: DataFrame, members: DataFrame, target: int, floor: int, most_rounds: int = 1000) -> DataFrame:
    """trace_id, place, sure of the rows (trace_id, place from 1, the first to go first) that stay when traces are taken out
    in that order, each only if all its scenarios (members: trace_id, sid) then still have ``floor`` traces, until
    ``target`` are left. sure is false for rows that stay only because the target was met before their turn.

    The loop's result comes in rounds. A trace surely goes if even with all undecided ones before it gone each of its
    scenarios has room for one more; it surely stays if one has none without them. The first undecided trace of all is always
    decided, and mostly whole stretches are. Counters are running sums by scenario and stretch of places. If the floors
    hold more than the target, the first of what is left go after all.
    """
    rows = stored(rows.select("trace_id", "place"), "trim")
    inside = stored(members.select("trace_id", "sid").distinct().join(rows, "trace_id"), "members")
    room = inside.groupBy("sid").agg((F.count("*") - floor).alias("room"))
    inside = inside.join(F.broadcast(room), "sid")  # scenarios
    fate = rows.join(inside.select("trace_id").distinct(), "trace_id", "left_anti").select("trace_id", F.lit(True).alias("goes"))
    open_ = stored(inside.withColumn("gone", F.lit(0).cast("long")).withColumn("undecided", F.lit(1).cast("long")), "trim")
    for _ in range(most_rounds):
        counts = running_sums(open_, ["sid"], ["gone", "undecided"], F.floor(F.col("place") / STRETCH), F.col("place"))
        gone, unknown = F.col("gone_sum") - F.col("gone"), F.col("undecided_sum") - F.col("undecided")
        judged = counts.where("undecided = 1").groupBy("trace_id").agg(F.min((gone + unknown < F.col("room")).cast("int")).alias("goes"), F.max((gone >= F.col("room")).cast("int")).alias("stays"))
        found = stored(judged.where("goes = 1 or stays = 1").select("trace_id", (F.col("goes") == 1).alias("goes")), "trim")
        if not found.take(1):
            break
        fate = fate.unionByName(found)
        met = open_.join(found.withColumnRenamed("goes", "_goes"), "trace_id", "left")
        now = met.withColumn("gone", F.when(F.col("_goes"), 1).otherwise(F.col("gone")).cast("long")).withColumn("undecided", F.when(F.col("_goes").isNotNull(), 0).otherwise(F.col("undecided")).cast("long"))
        open_ = stored(now.drop("_goes"), "trim")
    fate = stored(rows.join(fate, "trace_id"), "fate")
    excess = max(0, rows.count() - target)
    turn = numbered(fate, [], F.desc("goes"), F.col("place"), name="turn")  # those that may go, then the others
    return turn.where(F.col("turn") > excess).select("trace_id", "place", (~F.col("goes")).alias("sure"))


def foremost(rows: DataFrame, most: int, by: list[str], *ranks: str) -> DataFrame:
    """Of each class at least its first ``most`` rows in an order that goes by the ranks first, highest first, and of the others
    none but equals of the last. Counts of equal ranks say where to cut, so nothing is sorted but these; a class should have a
    bounded number of them (rounded scores)."""
    counts = rows.groupBy(*by, *ranks).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in ranks]).rowsBetween(Window.unboundedPreceding, -1))
    last = counts.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < most).groupBy(*by).agg(F.min(F.struct(*ranks)).alias("_last"))
    return rows.join(F.broadcast(last), by).where(F.struct(*ranks) >= F.col("_last")).drop("_last")  # classes


def exchanged(rows: DataFrame, quota: int, *order: Column) -> DataFrame:
    """rows (trace_id, chosen, score, in an order without ties) with chosen after an exchange: the k-th worst of the chosen by
    score gives way to the k-th of the others in the order, as long as that one's score is higher, for k up to the quota.
    As many stay chosen, and the sum of their scores never falls."""
    out = numbered(rows.where("chosen").select("trace_id", "score"), [], F.col("score"), F.col("trace_id"), name="k").where(F.col("k") <= quota)
    names = [c for c in rows.columns if c not in ("chosen",)]
    into = numbered(rows.where("not chosen").select(*names), [], *order, name="k").where(F.col("k") <= quota)
    pairs = out.select("k", F.col("trace_id").alias("leaves"), F.col("score").alias("low")).join(into.select("k", F.col("trace_id").alias("enters"), F.col("score").alias("high")), "k").where("high > low")
    moved = pairs.select(F.explode(F.array(F.struct(F.col("leaves").alias("trace_id"), F.lit(False).alias("_now")), F.struct(F.col("enters").alias("trace_id"), F.lit(True).alias("_now")))).alias("x")).select("x.*")
    return rows.join(moved, "trace_id", "left").withColumn("chosen", F.coalesce("_now", "chosen")).drop("_now")


def critical_rate(draw: Column, weight: Column, total: Column) -> Column:
    """The rate from which on a trace is kept: its chance is rate * weight / total, within its second's total weight."""
    return draw * total / weight


def calibrated(rows: DataFrame, share: float, most: float | None = None) -> DataFrame:
    """One row: rate, reached, unreachable. rows: trace_id, critical. The kept share grows with the rate by steps at the
    traces' critical rates, so the rate for a share is one of them: the value at place ceil(share * n), an exact quantile
    in place of a search. If it exceeds ``most`` the rate is that and unreachable is true; reached says what it keeps."""
    n = rows.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "rate double, reached double, unreachable boolean")
    place = max(1, -int(-share * n // 1))
    found = quantiles(rows.select("critical"), [], "critical", {"rate": ("rank", (place - 1) / max(n - 1, 1) + 1e-12)})
    limit = F.lit(most).cast("double") if most is not None else F.lit(float("inf"))
    found = found.select(F.least("rate", limit).alias("rate"), (F.col("rate") > limit).alias("unreachable"))
    met = rows.crossJoin(F.broadcast(found)).agg(F.count_if(F.col("critical") <= F.col("rate")).alias("kept"))  # one row
    return found.crossJoin(F.broadcast(met)).select("rate", (F.col("kept") / n).alias("reached"), "unreachable")  # one row
