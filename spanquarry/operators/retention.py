"""What a sample keeps, and robust statistics of what there is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sixth
from ..functions.storage import bounded
from .ordering import quantiles


def bucket(value: Column, limits: tuple, below: str, above: str) -> Column:
    """Name of the first limit that the value stays below (or within)."""
    out = F.when(value < limits[0] if below == "<" else value <= limits[0], f"{below}{limits[0]}")
    for n in limits[1:]:
        out = out.when(value < n if below == "<" else value <= n, f"{below}{n}")
    return out.otherwise(f"{above}{limits[-1]}")


def by_endpoint(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """endpoint, total, kept, pct over distinct (trace, endpoint)."""
    marked = rows.distinct().join(kept.select("trace_id", F.lit(1).alias("k")), "trace_id", "left")
    out = marked.groupBy("endpoint").agg(F.count("*").alias("total"), F.count("k").alias("kept"))
    return out.withColumn("pct", sixth(100.0 * F.col("kept") / F.col("total")))


def share_kept(rows: DataFrame, kept: DataFrame, by: str, name: str) -> DataFrame:
    marked = rows.join(kept.select("trace_id", F.lit(1).alias("k")), "trace_id", "left")
    out = marked.groupBy(by).agg(F.count("*").alias(name), F.count("k").alias(f"{name}_kept"))
    return out.withColumn("pct", sixth(100.0 * F.col(f"{name}_kept") / F.col(name)))


def summary(points: DataFrame, kept: DataFrame, by: str) -> DataFrame:
    rows = points.join(kept.select("trace_id", F.lit(True).alias("k")), "trace_id", "left")
    return rows.groupBy(by).agg(
        F.count("*").alias("traces"), F.count("k").alias("kept"), F.sum("span_count").alias("spans"), F.coalesce(F.sum(F.when(F.col("k"), F.col("span_count"))), F.lit(0)).alias("spans_kept"),
        F.count_if("has_error").alias("errors"), F.count_if(F.col("has_error") & F.col("k")).alias("errors_kept"),
    )


def medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, med, mad (the median deviation from it), q1, q3 of a value, by group."""
    quarters = quantiles(rows, by, value, {"med": ("linear", 0.5), "q1": ("linear", 0.25), "q3": ("linear", 0.75)})
    spread = rows.join(bounded(quarters.select(*by, "med"), 64), by).select(*by, F.abs(F.col(value) - F.col("med")).alias("_off"))
    return quarters.join(quantiles(spread, by, "_off", {"mad": ("linear", 0.5)}).select(*by, "mad"), by)


def upper_scales(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, med and mad (both the value at n div 2), and sigma: the larger of the sample's standard deviation and the
    scaled mad, 0 for a single value."""
    med = quantiles(rows, [by], value, {"med": ("upper", 0.0)})
    off = rows.join(bounded(med.select(by, "med"), 64), by).select(by, F.abs(F.col(value) - F.col("med")).alias("_off"))
    out = med.join(quantiles(off, [by], "_off", {"mad": ("upper", 0.0)}).select(by, "mad"), by).join(rows.groupBy(by).agg(F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_samp")), by)
    return out.select(by, "n", "med", "mad", F.when(F.col("n") <= 1, 0.0).otherwise(F.greatest("_samp", 1.4826 * F.col("mad"))).alias("sigma"))


def robust_scales(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Median, its median deviation, quartile, standard and combined scales of a value, by group."""
    x = F.col(value)
    stats = rows.groupBy(by).agg(F.stddev_pop(x).alias("pop"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("samp"))
    out = medians(rows.select(by, value), [by], value).join(stats, by)
    robust = F.greatest(F.lit(1e-6), "pop", 1.4826 * F.col("mad"))
    return out.select(by, sixth(F.col("med")).alias("med"), sixth(F.col("mad")).alias("mad"), sixth((F.col("q3") - F.col("q1")) / 1.349).alias("iqr_scale"), sixth(F.col("pop")).alias("std_pop"), sixth(F.col("samp")).alias("std_samp"), sixth(robust).alias("robust"))


def service_inputs(rows: DataFrame) -> DataFrame:
    """service, n, mean, error_rate, burst (95th percentile over the mean), per_hour, level (of the mean among services) of
    rows service, duration_ms, has_error, sec."""
    sums = rows.groupBy("service", F.floor(F.col("sec") / 3600).alias("hour")).agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total"), F.count_if("has_error").alias("errors"))
    sums = sums.groupBy("service").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), (F.sum("errors") / F.sum("n")).alias("error_rate"), (F.sum("n") / F.count("*")).alias("per_hour"))
    at = quantiles(rows.select("service", "duration_ms"), ["service"], "duration_ms", {"p95": ("linear", 0.95)}).select("service", "p95")
    one = sums.agg(F.median("mean").alias("med"), F.greatest(F.lit(1e-6), F.stddev_pop("mean")).alias("scale"))  # over services
    found = sums.join(at, "service").crossJoin(F.broadcast(one))  # one row
    return found.select("service", "n", "mean", "error_rate", (F.col("p95") - F.col("mean")).alias("burst"), "per_hour", (1 / (1 + F.exp(-(F.col("mean") - F.col("med")) / F.col("scale")))).alias("level"))


def latency(points: DataFrame) -> DataFrame:
    """points with latency: duration and span count scaled to 0..1 over all traces (a flat one counts as 0.5)."""
    b = points.agg(F.min("duration_ms").alias("lo"), F.max("duration_ms").alias("hi"), F.min("span_count").alias("slo"), F.max("span_count").alias("shi"))
    d = F.when(F.col("hi") > F.col("lo"), (F.col("duration_ms") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)
    s = F.when(F.col("shi") > F.col("slo"), (F.col("span_count") - F.col("slo")) / (F.col("shi") - F.col("slo"))).otherwise(0.5)
    return points.crossJoin(F.broadcast(b)).withColumn("latency", 0.7 * d + 0.3 * s).drop("lo", "hi", "slo", "shi")  # one row


def hourly_metrics(spans: DataFrame) -> DataFrame:
    """service, sec (of the hour), cpu (mean weight), load (spans)."""
    hour = (F.floor(F.col("sec") / 3600) * 3600).cast("long")
    return spans.groupBy("service", hour.alias("sec")).agg(F.avg("weight").alias("cpu"), F.count("*").alias("load"))
