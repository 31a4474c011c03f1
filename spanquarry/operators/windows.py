"""Windowed features. Frames over time are cut into slots of one lookback, so that no window spans the whole table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp
from .ordering import numbered, running_sums, with_last
from .ranges import frame_spreads


def _minute() -> Column:
    return F.floor(F.col("start_ns") / 60_000_000_000)


def with_history(rows: DataFrame, sec: str, lookback: int) -> DataFrame:
    """Every row in its own slot (own is true) and, as history, in the next: a frame of up to ``lookback`` seconds back
    then lies within one slot."""
    slot = F.floor(F.col(sec) / lookback)
    return rows.withColumn("_slot", F.explode(F.array(slot, slot + 1))).withColumn("own", F.col("_slot") == slot)


def sums_at(rows: DataFrame, values: list[str], asked: DataFrame) -> DataFrame:
    """sec, and of each value the sum over all rows up to and with that second, for the seconds asked for. Sums by second,
    then by hour: no task sees more than an hour's seconds or all hours."""
    by_sec = rows.groupBy("sec").agg(*[F.sum(v).alias(v) for v in values])
    none = asked.select("sec").distinct().select("sec", *[F.lit(0).cast(rows.schema[v].dataType).alias(v) for v in values])
    whole = by_sec.unionByName(none).groupBy("sec").agg(*[F.sum(v).alias(v) for v in values], F.max(F.lit(1)).alias("_"))
    found = running_sums(whole.drop("_"), [], values, F.floor(F.col("sec") / 3600), F.col("sec"))
    return found.select("sec", *[F.col(f"{v}_sum").alias(v) for v in values]).join(asked.select("sec").distinct(), "sec", "left_semi")


def lookback_stats(points: DataFrame, lookback: int, values: dict[str, Column]) -> DataFrame:
    """For each trace its place (from 1, by start and id), and count, mean and population deviation of 0/1 or real values over
    the traces before it: those of the last lookback - 1 seconds and the earlier ones of its own second (order: start, id). A frame is what came before
    the trace less what came before the lookback: running sums by minute, and sums up to a second."""
    rows = points.select("trace_id", "sec", "start_ns", F.lit(1).cast("double").alias("n"), *[v.cast("double").alias(k) for k, v in values.items()])
    rows = rows.select("*", *[(F.col(k) * F.col(k)).alias(f"{k}_square") for k in values])
    names = ["n", *[c for k in values for c in (k, f"{k}_square")]]
    before = running_sums(rows, [], names, _minute(), F.col("start_ns"), F.col("trace_id"))
    gone = sums_at(rows, names, rows.select((F.col("sec") - lookback).alias("sec")))
    gone = gone.select((F.col("sec") + lookback).alias("sec"), *[F.col(c).alias(f"_{c}") for c in names])
    rows = before.join(gone, "sec").select("trace_id", F.round("n_sum").cast("long").alias("place"), *[(F.col(f"{c}_sum") - F.col(c) - F.col(f"_{c}")).alias(c) for c in names])
    out = ["trace_id", "place", F.round("n").cast("long").alias("n")]
    for k in values:
        mean = F.when(F.col("n") > 0, F.col(k) / F.col("n")).otherwise(0.0)
        rows = rows.withColumn(f"{k}_mean", mean)
        rows = rows.withColumn(f"{k}_std", F.when(F.col("n") > 1, F.sqrt(F.greatest(F.col(f"{k}_square") / F.col("n") - F.col(f"{k}_mean") ** 2, F.lit(0.0)))).otherwise(0.0))
        out += [f"{k}_mean", f"{k}_std"]
    return rows.select(*out)


def lookback_sigmas(points: DataFrame, lookback: int, values: dict[str, Column]) -> DataFrame:
    """For each trace n, and of values over the traces before it (as for ``lookback_stats``) value_mean, value_sigma (the
    larger of the sample's standard deviation and the scaled upper median deviation, 0 for one value or none) and
    value_robust (of the population's and the scaled median deviation, at least 1e-6).

    In order of time a frame is a range of rows. A task has the traces of one lookback and of the one before (three numbers
    each) and answers all its frames together from prefix sums and a wavelet matrix, in n log n; no row carries its frame."""
    rows = with_history(points.select("trace_id", "sec", "start_ns", *[v.cast("double").alias(k) for k, v in values.items()]), "sec", lookback)

    names = list(values)

    def spreads(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["start_ns", "trace_id"], ignore_index=True)
        own = np.flatnonzero(frame.own.to_numpy())
        low, high = np.searchsorted(frame.sec.to_numpy(), frame.sec.to_numpy()[own] - (lookback - 1)), own
        out = {"trace_id": frame.trace_id.to_numpy()[own], "n": high - low}
        for k in names:
            out |= {f"{k}_{name}": v for name, v in frame_spreads(frame[k].to_numpy(float), low, high).items()}
        return pd.DataFrame(out)

    kinds = ", ".join(f"{k}_{x} double" for k in values for x in ("mean", "sigma", "robust"))
    return rows.groupBy("_slot").applyInPandas(spreads, f"trace_id string, n long, {kinds}")


def service_history(rows: DataFrame, value: str, last: int = 60) -> DataFrame:
    """rows (trace_id, service, start_ns, value) with count, median and median deviation of the service's last values. A
    service's rows are dealt out by chunks of their order, each with the last rows of the chunk before."""
    placed = numbered(rows, ["service"], F.col("start_ns"), F.col("trace_id"))
    dealt, chunk = with_last(placed, last)
    before = Window.partitionBy("service", chunk).orderBy("place").rowsBetween(-last, -1)
    out = dealt.withColumn("history_count", F.count(value).over(before)).withColumn("history", F.collect_list(value).over(before)).where("_own")
    out = out.withColumn("med", median("history"))
    return out.withColumn("mad", median(F.transform("history", lambda v: F.abs(v - F.col("med"))))).select(*rows.columns, "history_count", "med", "mad")


def median(values: Column | str) -> Column:
    """Mean of the middle two of an array, null if empty."""
    s = F.sort_array(values)
    n = F.size(values)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def ema_burst(series: DataFrame, new: float = 0.2, last: int = 60) -> DataFrame:
    """series (service, bin, n; one row for each bin of time) with thr = ln(1 + n), its moving average over the last values, and their difference.

    The weight of a value falls by 1 - new each step, so what lies beyond ``last`` steps is below the sixth decimal.
    """
    rows = series.withColumn("thr", F.ln(1 + F.col("n")))
    window = Window.partitionBy("service").orderBy("bin").rowsBetween(1 - last, 0)
    rows = rows.withColumn("ema", F.aggregate(F.collect_list("thr").over(window), F.lit(0.0), lambda acc, x: new * x + (1 - new) * acc))
    return rows.withColumn("burst", F.col("thr") - F.col("ema"))


def suspicious(rows: DataFrame, min_history: int = 8, rate: float = 0.15) -> DataFrame:
    """rows (trace_id, service, start_ns, has_error) with the service's prior count, errors, and whether it is suspicious."""
    rows = rows.withColumn("_e", F.col("has_error").cast("long")).withColumn("_one", F.lit(1).cast("long"))
    out = running_sums(rows, ["service"], ["_one", "_e"], _minute(), F.col("start_ns"), F.col("trace_id"))
    out = out.withColumn("prior", F.col("_one_sum") - 1).withColumn("prior_errors", F.col("_e_sum") - F.col("_e")).drop("_one", "_e", "_one_sum", "_e_sum")
    return out.withColumn("suspicious", (F.col("prior") > min_history) & (F.col("prior_errors") > rate * F.col("prior")))


def error_mean(rows: DataFrame) -> DataFrame:
    """trace_id, prior, error_mean: how many traces came before (by start, then id), and the mean of their error flags."""
    flags = rows.select("trace_id", "start_ns", F.col("has_error").cast("long").alias("e"), F.lit(1).cast("long").alias("one"))
    sums = running_sums(flags, [], ["one", "e"], _minute(), F.col("start_ns"), F.col("trace_id"))
    prior = F.col("one_sum") - 1
    return sums.select("trace_id", prior.alias("prior"), F.when(prior > 0, (F.col("e_sum") - F.col("e")) / prior).otherwise(0.0).alias("error_mean"))


def same_moment(rows: DataFrame, width: int = 1) -> DataFrame:
    """trace_id, same: the place of a trace among those of its service in its stretch of so many seconds."""
    within = Window.partitionBy("service", F.floor(F.col("sec") / width)).orderBy("start_ns", "trace_id")
    return rows.select("trace_id", F.row_number().over(within).cast("long").alias("same"))


def dual_thresholds(rows: DataFrame, short: int, long: int, q: float, mix: float, initial: float = 5.0) -> DataFrame:
    """bin, long_n, threshold of every bin from the first to the last: a mix of the score's quantiles over the last short
    and long stretch of bins; without scores the threshold before goes on. rows: bin, score. Equal scores are counted
    before they go into their windows; after that there is one row for each bin."""
    counts = rows.groupBy("bin", "score").agg(F.count("*").alias("c"))
    spread = counts.withColumn("at", F.explode(F.sequence("bin", F.col("bin") + long - 1)))
    near = F.when(F.col("bin") > F.col("at") - short, F.col("c"))
    by_score = spread.groupBy("at", "score").agg(F.coalesce(F.sum(near), F.lit(0)).alias("near"), F.sum("c").alias("c"))
    found = by_score.groupBy("at").agg(F.sum("c").alias("long_n"), F.percentile(F.when(F.col("near") > 0, F.col("score")), F.lit(q), F.greatest("near", F.lit(1))).alias("s"), F.percentile("score", F.lit(q), F.col("c")).alias("l"))
    every = rows.agg(F.min("bin").alias("a"), F.max("bin").alias("z")).select(F.explode(F.sequence("a", "z")).alias("at"))
    every = every.join(found, "at", "left").withColumn("t", mix * F.col("s") + (1 - mix) * F.col("l"))
    last = F.last("t", ignorenulls=True).over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return every.select(F.col("at").alias("bin"), F.coalesce("long_n", F.lit(0)).alias("long_n"), F.coalesce(last, F.lit(initial)).alias("threshold"))


def local_density(points: DataFrame, reach: int) -> DataFrame:
    """trace_id, density: share of traces with errors within ``reach`` seconds on both sides, from sums up to a second."""
    rows = points.select("sec", F.lit(1).cast("long").alias("n"), F.col("has_error").cast("long").alias("e"))
    own = rows.select("sec").distinct()
    sums = sums_at(rows, ["n", "e"], own.select(F.explode(F.array(F.col("sec") + reach, F.col("sec") - reach - 1)).alias("sec")))
    upto = lambda shift, tag: sums.select((F.col("sec") - shift).alias("sec"), F.col("n").alias(f"n{tag}"), F.col("e").alias(f"e{tag}"))
    found = own.join(upto(reach, 1), "sec").join(upto(-reach - 1, 0), "sec").select("sec", ((F.col("e1") - F.col("e0")) / (F.col("n1") - F.col("n0"))).alias("density"))
    return points.select("trace_id", "sec").join(found, "sec").select("trace_id", "density")


def hysteresis(bins: DataFrame, raw: Column, hold: int) -> DataFrame:
    """bins (bin, ...) with raw and on: on while a raw incident lies in the last ``hold`` bins. One row per bin only."""
    window = Window.orderBy("bin").rangeBetween(1 - hold, 0)
    return bins.withColumn("raw", raw).withColumn("on", F.max(F.col("raw").cast("int")).over(window) == 1)


def held(bins: DataFrame, above: Column, hold: int) -> DataFrame:
    """bins with ``detected``: this and the next hold - 1 existing bins are all above."""
    window = Window.orderBy("bin").rowsBetween(0, hold - 1)
    rows = bins.withColumn("above", above)
    return rows.withColumn("detected", (F.min(F.col("above").cast("int")).over(window) == 1) & (F.count("*").over(window) == hold))


def steps(bins: DataFrame, value: str) -> DataFrame:
    """bins with the relative change from the bin before; null where that is not positive."""
    before = F.lag(value).over(Window.orderBy("bin"))
    return bins.withColumn("step", F.when(before > 0, F.abs(F.col(value) - before) / before))


def proximity(sec: Column, anchor: Column, scale: float) -> Column:
    return F.when(anchor.isNull(), 0.5).otherwise(F.exp(-F.abs(sec - anchor) / scale))


def base_probability(incident: Column, latency: Column, error: Column, near: Column, z: Column, alpha: float = 1.2) -> Column:
    base = 0.45 * incident + 0.25 * latency + 0.15 * error + 0.15 * near
    return clamp(0.55 * base + 0.45 * F.tanh(alpha * z), 0.02, 0.98)
