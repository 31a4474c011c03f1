"""Places, quantiles and frames of rows in an order, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import bounded, stored

#: Rows of a group that one window partition takes.
CHUNK = 8192


def numbered(rows: DataFrame, by: list[str], *order: Column, name: str = "place") -> DataFrame:
    """rows with their place (from 1) in their group, in an order that has no ties.

    A range shuffle by group and order deals the rows out evenly, however large a group is; each partition is sorted and
    its rows numbered as they stand; counts by group and partition then say where each partition begins. The numbered
    rows are stored once in the shared folder, so pass few columns.
    """
    keys = [F.col(c) for c in by]
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    table = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_at", 33))
    counts = table.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(counts.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_of"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "starts")
    same = F.col("_part") == F.col("_of")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return table.join(bounded(starts, 100), same).select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(name))


#: Buckets of a value for each factor of e.
FINE = 4096


def quantiles(rows: DataFrame, by: list[str], value: str, asked: Mapping[str, tuple[str, float]]) -> DataFrame:
    """by, n, and exact quantiles of a value in each group: name -> (kind, q), the kinds being ``linear`` (between the two
    nearest), ``rank`` (the lower nearest rank) and ``upper`` (the value at n div 2).

    Equal values are counted first. Running counts over buckets of the logarithm, of which a group has a bounded number,
    say in which bucket a place lies; only the values of those buckets are then put in order.
    """
    v = F.col(value).cast("double")
    bucket = (F.signum(v) * F.floor(F.log1p(F.abs(v)) * FINE)).cast("long").alias("_b")
    counts = stored(rows.where(F.col(value).isNotNull()).groupBy(*by, v.alias("_v"), bucket).agg(F.count("*").alias("_n")), "counts")
    whole = Window.partitionBy(*by)
    per = counts.groupBy(*by, "_b").agg(F.sum("_n").alias("_m"))
    per = per.withColumn("_upto", F.sum("_m").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("_m").over(whole))
    wanted = []
    for k, (kind, q) in asked.items():
        at = {"linear": q * (F.col("n") - 1), "rank": F.floor(q * (F.col("n") - 1)), "upper": F.floor(F.col("n") / 2)}[kind].cast("double")
        wanted += [F.struct(F.lit(k).alias("k"), (1 - at + F.floor(at)).alias("w"), (F.floor(at) + 1).alias("place")), F.struct(F.lit(k).alias("k"), (at - F.floor(at)).alias("w"), (F.ceil(at) + 1).alias("place"))]
    here = F.filter(F.array(*wanted), lambda x: (x["place"] > F.col("_upto") - F.col("_m")) & (x["place"] <= F.col("_upto")))
    spots = per.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_b").alias("_of"), "n", (F.col("_upto") - F.col("_m")).alias("_before"), F.explode(here).alias("_x"))
    same = F.col("_b") == F.col("_of")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    inside = counts.join(spots, same)
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_b", "_x").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("_upto", upto).where((F.col("_x.place") > F.col("_upto") - F.col("_n")) & (F.col("_x.place") <= F.col("_upto")))
    return found.groupBy(*by, "n").agg(*[F.sum(F.when(F.col("_x.k") == k, F.col("_x.w") * F.col("_v"))).alias(k) for k in asked])


def running_sums(rows: DataFrame, by: list[str], values: list[str], slot: Column, *order: Column) -> DataFrame:
    """rows with value_sum, the running sums (themselves included) of whole-numbered values in their group, in an order
    without ties that goes by slots (of time, say) first: sums by slot, of which a group has a bounded number, then running
    sums within each."""
    table = rows.withColumn("_slot", slot)
    slots = table.groupBy(*by, "_slot").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    before = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_slot").alias("_of"), *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_before_{v}") for v in values])
    within = Window.partitionBy(*by, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_slot") == F.col("_of")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    table = table.select("*", *[F.sum(v).over(within).alias(f"_in_{v}") for v in values])
    return table.join(slots, same).select(*rows.columns, *[(F.col(f"_in_{v}") + F.col(f"_before_{v}")).alias(f"{v}_sum") for v in values])


def with_last(table: DataFrame, last: int, place: str = "place") -> tuple[DataFrame, str]:
    """Numbered rows dealt by chunks of their group, each chunk with the last so many rows of the one before: a frame of up
    to ``last`` rows back lies within (group, _chunk). Rows of the chunk itself have ``_own``."""
    size = max(CHUNK, 4 * last)
    chunk = F.floor((F.col(place) - 1) / size)
    carried = F.pmod(F.col(place) - 1, F.lit(size)) >= size - last
    dealt = table.withColumn("_chunk", F.explode(F.when(carried, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))))
    return dealt.withColumn("_own", F.col("_chunk") == chunk), "_chunk"
