"""Scoring of rankings: hits, reciprocal ranks, bootstrap intervals, averages over datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_uniform, nearest_rank
from .rca import hit


def placed(scenarios: DataFrame, rankings: DataFrame) -> DataFrame:
    """sid, rank of the true cause (null if it is not ranked), a1, a3, rr. There is no fall-back to the truth."""
    best = rankings.groupBy("sid", F.col("candidate").alias("truth")).agg(F.min("rank").alias("rank"))
    rows = scenarios.select("sid", "truth").join(best, ["sid", "truth"], "left")
    rr = F.when(F.col("rank").isNull(), 0.0).otherwise(1 / F.col("rank"))
    return rows.select("sid", "rank", hit(F.col("rank"), 1).alias("a1"), hit(F.col("rank"), 3).alias("a3"), rr.alias("rr"))


def scores(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("scenarios"), F.round(F.avg("a1"), 6).alias("a1"), F.round(F.avg("a3"), 6).alias("a3"), F.round(F.avg("rr"), 6).alias("mrr"))


def bootstrap(rows: DataFrame, values: list[str], rounds: int = 2000, seed: int = 1) -> DataFrame:
    """measure, low, high: for each value the 2.5 and 97.5 percent nearest ranks of the means of resamples drawn with hashes.

    Scenarios are few (one row each); draws are a join on the scenario's number, rounds are grouped.
    """
    if isinstance(values, str):
        raise TypeError("values is a list of columns")
    numbered = rows.select(F.row_number().over(Window.orderBy("sid")).alias("i"), *values)
    n = numbered.count()
    spark = rows.sparkSession
    draws = spark.range(rounds * n).select((F.col("id") / n).cast("long").alias("round"), (F.col("id") % n).alias("draw"))
    draws = draws.withColumn("i", (F.floor(hash_uniform(F.lit(str(seed)), F.col("round").cast("string"), F.col("draw").cast("string")) * n) + 1).cast("int"))
    means = draws.join(numbered, "i").groupBy("round").agg(*[F.avg(v).alias(v) for v in values])
    lists = means.agg(*[F.collect_list(v).alias(v) for v in values])  # as many as rounds
    one = lambda v: F.struct(F.lit(v).alias("measure"), F.round(nearest_rank(F.col(v), 0.025), 6).alias("low"), F.round(nearest_rank(F.col(v), 0.975), 6).alias("high"))
    return lists.select(F.explode(F.array(*map(one, values))).alias("x")).select("x.*")


def duplicate_rankings(rankings: DataFrame) -> DataFrame:
    """sid, status: whether another scenario has the same ranking (sid, candidate, rank), candidate by candidate."""
    whole = rankings.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate"))).alias("l")).select("sid", F.sha2(F.to_json("l"), 256).alias("h"))
    n = whole.groupBy("h").agg(F.count("*").alias("n"))
    return whole.join(n, "h").select("sid", F.when(F.col("n") > 1, "repeated").otherwise("single").alias("status"))


def with_weighted_average(rows: DataFrame, by: str, weight: str, added: list[str], averaged: list[str], name: str = "ALL") -> DataFrame:
    """rows and one more for all: sums of the weight and the added columns, averages of the others by weight."""
    mean = [(F.sum(F.col(c) * F.col(weight)) / F.sum(weight)).alias(c) for c in averaged]
    whole = rows.agg(F.sum(weight).alias(weight), *[F.sum(c).alias(c) for c in added], *mean).withColumn(by, F.lit(name))
    return rows.select(by, weight, *added, *averaged).unionByName(whole)


def against_constants(scores: DataFrame, by: str, value: str, published: dict[str, float]) -> DataFrame:
    """by, value, published, difference, for the keys that have a constant (a few, as literals)."""
    table = F.create_map(*[F.lit(x) for pair in published.items() for x in pair])
    rows = scores.withColumn("published", F.try_element_at(table, F.col(by))).where("published is not null")
    return rows.select(by, value, "published", (F.col(value) - F.col("published")).alias("difference"))


def endpoint_lines(reports: DataFrame, text: str) -> DataFrame:
    """endpoint, kept, total of lines like ``- name: kept 3 of 7`` in report texts; the first of an endpoint in a text, and
    of equal endpoints of several texts that of most traces."""
    line = r"(?m)^- (\S+): kept (\d+) of (\d+)$"
    found = reports.select(F.posexplode(F.regexp_extract_all(text, F.lit(line), F.lit(0))).alias("i", "line"), F.xxhash64(text).alias("h"))
    part = lambda k: F.regexp_extract("line", line, k)
    rows = found.select("h", "i", part(1).alias("endpoint"), part(2).cast("long").alias("kept"), part(3).cast("long").alias("total"))
    first = rows.groupBy("h", "endpoint").agg(F.min_by(F.struct("total", "kept"), "i").alias("x"))
    return first.groupBy("endpoint").agg(F.max("x").alias("x")).select("endpoint", "x.kept", "x.total")


def macro_average(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, average over datasets (each counts once), and its difference from the first."""
    out = rows.groupBy(by).agg(F.avg(value).alias("average"), F.count("*").alias("datasets"))
    first = out.agg(F.min_by("average", by).alias("first"))
    return out.crossJoin(F.broadcast(first)).select(by, "datasets", F.round("average", 6).alias("average"), F.round(F.col("average") - F.col("first"), 6).alias("delta"))  # one row
