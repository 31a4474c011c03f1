"""Root causes scenario by scenario: the traces of each scenario parted into anomalous and normal ones, a walk over each part,
and the spectrum of both. All scenarios step together; tables are keyed by scenario (and part), so a step is one join and
one grouped sum whatever their number, and a part that stands still leaves."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import bounded, limited, stored
from .rca import CALLS, DAMPING, ranked, scenario_sides

#: Operations up to which a trace is folded into weights between operations; larger ones are stepped over.
FOLD = 64
#: Relative change at which a part's walk ends, steps after which any ends, and steps between two looks at it.
STILL, MOST, TOGETHER = 1e-9, 80, 16
#: Duration in milliseconds by which an anomalous trace exceeds what its operations lead to expect.
SLACK = 50.0
#: The node from which every step gets its restart.
ANEW = "\0"


def baselines(sides: DataFrame, spans: DataFrame) -> DataFrame:
    """sid, op, mean, std of the durations in a scenario's normal traces, or in its incident's where it has none."""
    chosen = sides.groupBy("sid").agg(F.max(F.col("side") == "normal").alias("_calm"))
    base = sides.join(chosen, "sid").where((F.col("side") == "normal") == F.col("_calm")).select("sid", "trace_id")
    return base.join(spans, "trace_id").groupBy("sid", "op").agg(F.round(F.avg("duration"), 4).alias("mean"), F.round(F.stddev_pop("duration"), 4).alias("std"))


def verdicts(sides: DataFrame, spans: DataFrame, slack: float = SLACK) -> DataFrame:
    """sid, trace_id, start_ns, anomalous of the incidents' traces. Operations without a baseline count as 1.0 and 0.1."""
    allowed = F.coalesce("mean", F.lit(1.0)) + F.coalesce("std", F.lit(0.1))
    rows = sides.where("side = 'incident'").join(spans, "trace_id").join(baselines(sides, spans), ["sid", "op"], "left")
    return rows.groupBy("sid", "trace_id", "start_ns").agg((F.sum("duration") > F.sum(allowed) + slack).alias("anomalous"))


def parts(sides: DataFrame, spans: DataFrame, slack: float = SLACK) -> DataFrame:
    """sid, part (bad, good), trace_id. Where no trace of an incident is anomalous, its first third (one at least) counts as
    bad; where all are, those behind the first third count as good too, and where there are none, the normal traces."""
    found = verdicts(sides, spans, slack)
    counts = found.groupBy("sid").agg(F.count("*").alias("n"), F.count_if("anomalous").alias("bad"))
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    rows = found.join(counts, "sid")
    extreme = rows.where("bad = 0 or bad = n")  # only there the order matters
    placed = extreme.withColumn("r", F.row_number().over(Window.partitionBy("sid").orderBy("start_ns", "trace_id")))
    as_part = lambda frame, name: frame.select("sid", F.lit(name).alias("part"), "trace_id")
    calm = sides.where("side = 'normal'").join(counts.where((F.col("bad") == F.col("n")) & (F.col("n") <= third)).select("sid"), "sid", "left_semi")
    bad = as_part(rows.where("anomalous"), "bad").unionByName(as_part(placed.where((F.col("bad") == 0) & (F.col("r") <= third)), "bad"))
    good = as_part(rows.where("not anomalous"), "good").unionByName(as_part(placed.where((F.col("bad") == F.col("n")) & (F.col("r") > third)), "good"))
    return bad.unionByName(good).unionByName(as_part(calm, "good"))


def fixed_points(spans: DataFrame, members: DataFrame, by: list[str], damping: float = DAMPING, calls: float = CALLS, still: float = STILL, most: int = MOST, fold: int = FOLD) -> DataFrame:
    """by, op, m, score: where the walk over each group's traces and operations stands still. Traces (members: by, trace_id)
    pass their weight on to their operations in equal shares, operations theirs to their traces and, by ``calls``, to
    the operations they call; it restarts at traces, those with few operations more often. m: traces with the operation.
    A group's scores add up to 1.

    spans: trace_id, span_id, parent_id, op. Traces of few operations are folded into weights between operations once;
    larger ones are taken operation to trace to operation in every step, so no trace gives all pairs of its operations.
    """
    seen = spans.join(members, "trace_id")
    pairs = stored(seen.select(*by, "trace_id", "op").distinct(), "walk")
    per_trace = pairs.groupBy(*by, "trace_id").agg(F.count("*").alias("k"))
    per_op = pairs.groupBy(*by, "op").agg(F.count("*").alias("m"))
    total = per_trace.groupBy(*by).agg(F.sum(1 / F.col("k")).alias("all"))
    held = stored(pairs.join(per_trace, [*by, "trace_id"]).join(per_op, [*by, "op"]), "walk")
    small = held.where(F.col("k") <= fold)
    weights = small.select(*by, "trace_id", F.col("op").alias("from"), "m").join(small.select(*by, "trace_id", "op", "k"), [*by, "trace_id"]).groupBy(*by, "from", "op").agg(F.sum(damping * damping / (F.col("k") * F.col("m"))).alias("w"))
    up = seen.select(*by, "trace_id", F.col("span_id").alias("parent_id"), F.col("op").alias("from"))
    edges = seen.join(up, [*by, "trace_id", "parent_id"]).groupBy(*by, "from", "op").agg(F.count("*").alias("n"))
    out = edges.groupBy(*by, "from").agg(F.sum("n").alias("out"))
    direct = edges.join(out, [*by, "from"]).select(*by, "from", "op", (damping * calls * F.col("n") / F.col("out")).alias("w"))
    restart = held.join(bounded(total, 64), by).groupBy(*by, "op").agg(F.sum(damping * (1 - damping) / (F.col("k") * F.col("k") * F.col("all"))).alias("w"))
    anew = restart.select(*by, F.lit(ANEW).alias("from"), "op", "w")
    still_one = total.select(*by, F.lit(ANEW).alias("from"), F.lit(ANEW).alias("op"), F.lit(1.0).alias("w"))
    moves = stored(functools.reduce(DataFrame.unionByName, [weights, direct, anew, still_one]).groupBy(*by, "from", "op").agg(F.sum("w").alias("w")), "walk")
    large = held.where(F.col("k") > fold)
    any_large = bool(large.take(1))
    now, done = moves.where(F.col("from") == ANEW).select(*by, "op", F.col("w").alias("s")), []
    n_moves = moves.count()

    def step(now: DataFrame) -> DataFrame:
        came = now.withColumnRenamed("op", "from").join(limited(moves, n_moves), [*by, "from"]).select(*by, "op", (F.col("w") * F.col("s")).alias("s"))
        if any_large:
            to = large.join(now, [*by, "op"]).groupBy(*by, "trace_id").agg(F.sum(damping * F.col("s") / F.col("m")).alias("t"))
            came = came.unionByName(large.join(to, [*by, "trace_id"]).select(*by, "op", (damping * F.col("t") / F.col("k")).alias("s")))
        return came.groupBy(*by, "op").agg(F.sum("s").alias("s"))

    left = True
    for _ in range(0, most, TOGETHER):
        for _ in range(TOGETHER):
            before, now = now, step(now)
        both = now.join(before.withColumnRenamed("s", "_was"), [*by, "op"], "left").withColumn("_off", F.abs(F.col("s") - F.coalesce("_was", F.lit(0.0)))).drop("_was")
        both = stored(both, "walk")
        most_s = F.max(F.when(F.col("op") != ANEW, F.col("s")))
        now, change = both.drop("_off"), both.groupBy(*by).agg((F.max("_off") <= still * most_s).alias("_still"))
        counts = change.agg(F.count("*").alias("n"), F.count_if("_still").alias("still")).first()
        if 4 * counts.still >= counts.n:  # not for a few at a time
            part = lambda frame, which: frame.join(limited(change.where(which).select(*by), counts.n), by, "left_semi")
            done = [*done, part(now, "_still")]
            left = counts.n > counts.still
            if not left:
                break
            now = part(now, "not _still")
    result = functools.reduce(DataFrame.unionByName, [*done, now] if left else done)
    result = result.join(per_op, [*by, "op"])
    whole = result.groupBy(*by).agg(F.sum("s").alias("all"))
    return result.join(bounded(whole, 64), by).select(*by, "op", "m", (F.col("s") / F.col("all")).alias("score"))


def spectra(scores: DataFrame, members: DataFrame) -> DataFrame:
    """sid, op, suspicion ef^2 / (ep + nf) from both parts' scores and counts. An operation of good traces alone has next to
    nothing for it, and its count, raised by its score, against it; one of bad traces alone next to nothing against it
    but the bad traces that lack it."""
    n = members.groupBy("sid").agg(F.count_if(F.col("part") == "bad").alias("bad_n"))
    side = lambda part, a, b: scores.where(F.col("part") == part).select("sid", "op", F.col("score").alias(a), F.col("m").alias(b))
    rows = side("bad", "a", "am").join(side("good", "g", "gm"), ["sid", "op"], "full").join(bounded(n, 64), "sid")
    low = F.lit(1e-7)
    ef = F.when(F.col("a").isNull(), low).otherwise(F.col("a") * F.col("am"))
    nf = F.when(F.col("a").isNull(), low).otherwise(F.col("a") * (F.col("bad_n") - F.col("am")))
    ep = F.when(F.col("a").isNull(), (1 + F.col("g")) * F.col("gm")).when(F.col("g").isNull(), low).otherwise(F.col("g") * F.col("gm"))
    return rows.select("sid", "op", F.when(ep + nf > 0, ef * ef / (ep + nf)).otherwise(0.0).alias("suspicion"))


def service_of(op: Column) -> Column:
    return F.substring_index(op, "_", 1)


def root_causes(points: DataFrame, spans: DataFrame, windows: DataFrame, slack: float = SLACK) -> DataFrame:
    """sid, candidate, score, rank, mode: the services of each scenario's incident, ranked by the spectrum of its walks
    (walk), or by their time in the incident's traces (latency) where a part has no trace. A scenario whose window holds no
    trace has no row.

    points: trace_id, sec, start_ns; spans: trace_id, span_id, parent_id, op (service before its first underscore),
    duration; windows: sid, st, ed.
    """
    sides = scenario_sides(points, windows).join(points.select("trace_id", "start_ns"), "trace_id")
    sides = stored(sides, "sides")
    spans = stored(spans.join(sides.select("trace_id").distinct(), "trace_id", "left_semi"), "spans")
    members = stored(parts(sides, spans, slack), "parts")
    whole = members.groupBy("sid").agg(F.count_distinct("part").alias("_parts")).where("_parts = 2").select("sid")
    walked = members.join(bounded(whole, 64), "sid", "left_semi")
    by_walk = spectra(fixed_points(spans, walked, ["sid", "part"]), walked).groupBy("sid", service_of(F.col("op")).alias("candidate")).agg(F.sum("suspicion").alias("score"))
    rest = sides.where("side = 'incident'").join(whole, "sid", "left_anti").select("sid", "trace_id")
    by_time = rest.join(spans, "trace_id").groupBy("sid", service_of(F.col("op")).alias("candidate")).agg(F.sum("duration").alias("score"))
    rows = by_walk.withColumn("mode", F.lit("walk")).unionByName(by_time.withColumn("mode", F.lit("latency")))
    return ranked(rows, "sid", name="candidate", digits=5)
