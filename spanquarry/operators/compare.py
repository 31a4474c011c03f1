"""Two runs side by side: traces folded from their spans, counts, quantiles, routes, thresholds, moments of incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import quantiles
from .windows import median


def trace_fold(spans: DataFrame, run: Column | None = None, attributes: tuple[str, ...] = ()) -> DataFrame:
    """One row per trace of spans (trace_id, span_id, start_us, failed, ...) that meet ``run``: start_us, duration_ms,
    span_count, has_error (any span), and of each attribute the first value that is there, by start and span id."""
    rows = spans if run is None else spans.where(run)
    first = [F.min_by(a, F.when(F.col(a).isNotNull(), F.struct("start_us", "span_id"))).alias(a) for a in attributes]
    return rows.groupBy("trace_id").agg(F.min("start_us").alias("start_us"), ((F.max("start_us") - F.min("start_us")) / 1000).alias("duration_ms"), F.count("*").alias("span_count"), F.max("failed").alias("has_error"), *first)


def run_stats(rows: DataFrame, spans: DataFrame, top: int = 10) -> DataFrame:
    """run, metric, value: what a run holds. rows: traces with run, duration_ms, has_error; spans: run, trace_id, service,
    route, start_us. Only the most frequent routes are listed, the first by name of equals."""
    sums = rows.groupBy("run").agg(F.count("*").alias("traces"), F.count_if("has_error").alias("trace_errors"), F.sum("span_count").alias("trace_spans"))
    at = quantiles(rows.select("run", "duration_ms"), ["run"], "duration_ms", {f"p{round(100 * q)}": ("linear", q) for q in (0.5, 0.95, 0.99)}).drop("n")
    flat = spans.groupBy("run").agg(F.count("*").alias("spans"), F.count_distinct("trace_id").alias("ids"), F.count_if("failed").alias("errors"), F.min("start_us").alias("first_us"), F.max("start_us").alias("last_us"))
    one = sums.join(at, "run").join(flat, "run")
    names = [c for c in one.columns if c != "run"]
    listed = one.select("run", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(c).cast("double") for c in names]))).alias("metric", "value"))
    services = spans.groupBy("run", F.concat(F.lit("service:"), "service").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    routes = spans.groupBy("run", F.concat(F.lit("route:"), "route").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    place = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("value"), "metric"))
    return listed.unionByName(services).unionByName(routes.withColumn("r", place).where(F.col("r") <= top).drop("r"))


def side_by_side(stats: DataFrame, a: str, b: str) -> DataFrame:
    """metric, a, b (0 where a run lacks it), delta, ratio (null if there is nothing to divide by)."""
    pick = lambda run: F.coalesce(F.max(F.when(F.col("run") == run, F.col("value"))), F.lit(0.0))
    rows = stats.where(F.col("run").isin(a, b)).groupBy("metric").agg(pick(a).alias("a"), pick(b).alias("b"))
    return rows.select("metric", "a", "b", (F.col("b") - F.col("a")).alias("delta"), F.when(F.col("a") != 0, F.col("b") / F.col("a")).alias("ratio"))


def retention_report(rows: DataFrame, critical: Column) -> DataFrame:
    """One row of rows (kept, has_error, duration_ms): counts, error rates and their lift by the sample, how far failed
    traces lie from clean ones, and the share of critical ones that is kept."""
    n, k, e, ke = F.count("*"), F.count_if("kept"), F.count_if("has_error"), F.count_if(F.col("kept") & F.col("has_error"))
    clean, failed = F.avg(F.when(~F.col("has_error"), F.col("duration_ms"))), F.avg(F.when(F.col("has_error"), F.col("duration_ms")))
    found = rows.agg(n.alias("traces"), k.alias("kept"), e.alias("errors"), ke.alias("errors_kept"), failed.alias("failed_ms"), clean.alias("clean_ms"), F.count_if(critical).alias("critical"), F.count_if(critical & F.col("kept")).alias("critical_kept"))
    rate = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    lift = F.when(rate("errors", "traces") > 0, rate("errors_kept", "kept") / rate("errors", "traces")).otherwise(0.0)
    return found.select("*", rate("errors", "traces").alias("error_rate"), rate("errors_kept", "kept").alias("kept_error_rate"), lift.alias("error_lift"), (F.col("failed_ms") - F.col("clean_ms")).alias("separation_ms"), rate("critical_kept", "critical").alias("critical_coverage"))


def rounded_medians(bins: DataFrame, value: str, short: int, long: int) -> DataFrame:
    """bins (one row per bin of time) with the medians of the rounded (half to even) value over the last short and long
    stretch of bins."""
    whole = bins.withColumn("_whole", F.bround(value))
    over = lambda n: Window.orderBy("bin").rangeBetween(1 - n, 0)
    held = lambda n: median(F.collect_list("_whole").over(over(n)))
    return whole.withColumn("short", held(short)).withColumn("long", held(long)).drop("_whole")


def first_incident(bins: DataFrame, error_rate: float, latency: float) -> DataFrame:
    """One row: the first bin (bin, n, errors, p95) whose error rate or 95th percentile exceeds its limit; null if none."""
    bad = (F.col("errors") > error_rate * F.col("n")) | (F.col("p95") > latency)
    return bins.agg(F.min(F.when(bad, F.col("bin"))).alias("first_bin"))


def tie_share(trace_id: Column) -> Column:
    """The last 16 hex digits of an id as a share of their largest value; null if they are none."""
    tail = F.right(F.lower(trace_id), F.lit(16))
    return F.when(tail.rlike("^[0-9a-f]+$"), F.conv(tail, 16, 10).cast("decimal(20,0)").cast("double") / 18446744073709551615.0)
