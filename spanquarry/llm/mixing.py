"""Mix sources to target weights: min-cost flow over membership patterns, then a seeded choice of documents.

Documents are aggregated by the set of sources they belong to (a pattern). Tokens flow from patterns to source quotas;
each further pass over a pattern costs more than the one before (convex repetition costs), so nothing is repeated
while a fresh document can serve. Only the patterns' sums reach the driver (``max_patterns`` bounds them). A pattern's
flow is whole passes plus a part; the part goes to the documents first in the order of a seeded hash, as long as half of a
document still fits. The place of the cut is found on 4096 hash bins, then on 4096 bins of the one that is cut, then
among the hashes of that bin, equal ones counted. Where equal rows meet the cut, they are numbered (by the task that
reads them, then within it) and as many of them are taken as fit. So no task gets the documents of one pattern.

Defined results: a null or blank text has size 0 and is taken 0 times; a null source is a source of its own, last in
order; of rows alike in id and text (null ids included) the cut takes some and leaves the others, no matter which; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: Weights of the sources in order, repeating; tokens to take over tokens there are; most passes over a document.
WEIGHTS, SHARE, PASSES = (3, 1, 2), 1.5, 2
#: Cost of a token in each pass.
COSTS = (1, 3, 9, 27)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: tuple = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> dict:
    """Target of each source: weights share the total, nobody gets more than passes times its size, the excess is shared anew.

    The sources that the limit holds are those with the least size per weight, so one pass over them in that order
    finds the common level.
    """
    named = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(named)}
    left, heavy = share * sum(sizes.values()), sum(weight.values())
    out = {}
    for s in sorted(named, key=lambda s: (passes * sizes[s] / weight[s], named.index(s))):
        if weight[s] * left < passes * sizes[s] * heavy:
            level = left / heavy
            return out | {s: weight[s] * level for s in named if s not in out}
        out[s] = float(passes * sizes[s])
        left, heavy = left - passes * sizes[s], heavy - weight[s]
    return out


def route(capacity: dict[tuple, int], quota: dict, passes: int = PASSES) -> dict[tuple, dict]:
    """Min-cost flow of whole tokens: pattern -> {source: tokens}. Successive cheapest paths over patterns and quotas."""
    patterns, sources = list(capacity), list(quota)
    first, last = len(patterns) + len(sources), len(patterns) + len(sources) + 1
    arcs: list[list] = []  # to, room, cost; the arc back is at the index with the last bit flipped
    out: list[list[int]] = [[] for _ in range(last + 1)]

    def arc(a: int, b: int, room: int, cost: int) -> int:
        out[a].append(len(arcs))
        arcs.append([b, room, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])
        return len(arcs) - 2

    served = {}
    for i, p in enumerate(patterns):
        for k in range(passes):
            arc(first, i, capacity[p], COSTS[min(k, len(COSTS) - 1)])
        for j, s in enumerate(sources):
            if s in p:
                served[i, s] = arc(i, len(patterns) + j, passes * capacity[p], 0)
    for j, s in enumerate(sources):
        arc(len(patterns) + j, last, int(quota[s] + 0.5), 0)
    while True:
        cost, via, queue, waiting = {first: 0}, {}, deque([first]), {first}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for k in out[a]:
                b, room, c = arcs[k]
                if room and cost[a] + c < cost.get(b, 1 << 60):
                    cost[b], via[b] = cost[a] + c, k
                    if b not in waiting:
                        waiting.add(b)
                        queue.append(b)
        if last not in cost:
            break
        path, at = [], last
        while at != first:
            path.append(via[at])
            at = arcs[via[at] ^ 1][0]
        room = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= room
            arcs[k ^ 1][1] += room
    flows: dict[tuple, dict] = {p: {} for p in patterns}
    for (i, s), k in served.items():
        flows[patterns[i]][s] = arcs[k ^ 1][1]
    return flows


def key(doc_id: Column, text: Column) -> Column:
    """What orders a document once the seed is put before it; alike just for rows alike in id and text."""
    plain = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat_ws(":", plain(doc_id), F.md5(plain(text).cast("binary")))


def mix(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: int = 7, max_patterns: int = 50_000) -> DataFrame:
    """rows (doc_id, sources array, size, order_key if documents are to be told apart by more than their id, and whatever
    else) with the added columns pattern_size, quota, taken.

    quota: the target of a single source, or the sum over the pattern's sources. taken: words of the document that the
    mix takes, repeats counted; at most passes times its size.
    """
    own = ("_order", "_pattern", "_whole", "_split", "_cut", "_take", "_at", "pattern_size", "quota", "taken", "order_key")
    names = [c for c in rows.columns if c not in own]
    by = F.col("order_key") if "order_key" in rows.columns else F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    seeded = F.md5(F.concat_ws(":", F.lit(str(seed)), by, F.col("size").cast("string")).cast("binary"))
    rows = rows.select(*names, seeded.alias("_order")).withColumn("_pattern", F.array_sort(F.array_distinct("sources")))
    sums = rows.groupBy("_pattern").agg(F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(sums) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    capacity = {tuple(r[0] or ()): int(r[1] or 0) for r in sums}
    sizes: dict = {}
    for p, n in capacity.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    quota = targets(sizes, weights, share, passes) if sizes else {}
    flows = route(capacity, quota, passes)
    spark = rows.sparkSession
    plan = []
    for p, n in capacity.items():
        flow = sum(flows[p].values())
        whole = flow // n if n else 0
        plan.append((list(p), n, float(sum(quota[s] for s in p)), whole, flow - whole * n))
    if not plan:
        return rows.drop("_order", "_pattern").select("*", F.lit(0).cast("long").alias("pattern_size"), F.lit(0.0).alias("quota"), F.lit(0).cast("long").alias("taken"))
    parts = spark.createDataFrame(plan, "_pattern array<string>, pattern_size long, quota double, _whole long, _part long")
    plan = F.broadcast(_cuts(rows, parts))
    out = rows.join(plan, "_pattern", "left")
    tie = F.coalesce(F.col("_order") == F.col("_cut"), F.lit(False))
    passed = F.col("_whole") + F.when(F.col("_order") < F.col("_cut"), 1).otherwise(0)
    met = cut(out.where(tie).withColumn("_at", F.monotonically_increasing_id()))  # the rows alike that meet the cut
    here = F.shiftright("_at", 33)
    counts = met.groupBy("_pattern", here.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_pattern").orderBy("_part")) - F.col("_n")
    starts = counts.select(F.col("_pattern").alias("_of"), "_part", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_pattern", here).orderBy("_at"))
    met = met.withColumn("_no", within).join(starts, F.col("_pattern").eqNullSafe(F.col("_of")) & (here == F.col("_part")))
    met = met.withColumn("passed", F.col("_whole") + F.when(F.col("_no") + F.col("_before") <= F.col("_take"), 1).otherwise(0))
    final = lambda frame, times: frame.select(*names, "pattern_size", "quota", (times * F.col("size")).alias("taken"))
    return final(out.where(~tie), passed).unionByName(final(met, F.col("passed")))


def _cuts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Per pattern the hash value (_cut) below which documents belong to the partial pass, and how many of the rows with
    that value do (_take). A row belongs if at least half of its tokens fit into what is left."""
    running = Window.partitionBy("_pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)

    def bins(frame: DataFrame, digits: int) -> DataFrame:
        sums = frame.groupBy("_pattern", F.substring("_order", 1, digits).alias("bin")).agg(F.sum("size").alias("n"))
        return sums.withColumn("after", F.sum("n").over(running)).withColumn("before", F.col("after") - F.col("n"))

    def met(found: DataFrame, base: DataFrame | None) -> DataFrame:
        """The bin in which the part runs out, and what went before it."""
        room = found.join(F.broadcast(parts if base is None else base), "_pattern")
        start = F.lit(0) if base is None else F.col("base")
        return room.where((start + F.col("before") < F.col("_part")) & (start + F.col("after") >= F.col("_part"))).select("_pattern", F.col("bin").alias("split"), (start + F.col("before")).alias("base"), "_part")

    first = cut(met(bins(rows, 3), None))
    in_first = rows.join(F.broadcast(first.select("_pattern", "split")), "_pattern").where(F.substring("_order", 1, 3) == F.col("split"))
    second = cut(met(bins(in_first, 6), first))
    inside = rows.join(F.broadcast(second), "_pattern").where(F.substring("_order", 1, 6) == F.col("split"))
    alike = inside.where("size > 0").groupBy("_pattern", "_part", "base", "_order").agg(F.max("size").alias("size"), F.count("*").alias("n"))
    upto = F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("_pattern").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1))
    alike = alike.withColumn("left", F.col("_part") - F.col("base") - F.coalesce(upto, F.lit(0)))
    fits = F.least(F.col("n"), F.floor(F.col("left") / F.col("size") + 0.5))
    # the first hash of which not all rows fit; where all do, the cut lies behind the last
    last = alike.withColumn("fits", F.greatest(fits, F.lit(0))).groupBy("_pattern").agg(F.min_by(F.struct("_order", "fits"), F.when(F.col("fits") < F.col("n"), F.col("_order"))).alias("x"), F.max("_order").alias("end"))
    last = last.select("_pattern", F.coalesce("x._order", F.concat("end", F.lit("~"))).alias("_cut"), F.coalesce("x.fits", F.lit(0)).alias("_take"))
    found = parts.join(last, "_pattern", "left")
    return found.select("_pattern", "pattern_size", "quota", "_whole", F.coalesce("_cut", F.lit("")).alias("_cut"), F.coalesce("_take", F.lit(0)).alias("_take"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, sources, size of the documents, and the key that orders them."""
    return docs.select("doc_id", "source", F.array("source").alias("sources"), words(F.col("text")).alias("size"), key(F.col("doc_id"), F.col("text")).alias("order_key"))


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The documents' rows as often as the mix takes them."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", F.array("source").alias("sources"), words(F.col("text")).alias("size"), key(F.col("doc_id"), F.col("text")).alias("order_key"))
    rows = mix(rows, seed=seed)
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    return rows.where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times))).select("doc.*")


ORACLE = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS t FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
  row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER before, 0)) AS room,
  (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS heavy FROM w
  WINDOW before AS (ORDER BY 2 * source_size::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(room / heavy) FILTER (WHERE weight * room < 2.0 * source_size * heavy) AS lowest,
  arg_min(room / heavy, 2 * source_size::DOUBLE / weight) FILTER (WHERE weight * room < 2.0 * source_size * heavy) AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN weight * room < 2.0 * source_size * heavy THEN weight * level ELSE 2.0 * source_size END::DOUBLE AS target FROM l, f),
q AS (SELECT *, floor(target + 0.5)::BIGINT AS flow FROM t),
h AS (SELECT doc_id, source, size, md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || t || ':' || size::VARCHAR) AS h FROM d),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h)
SELECT c.doc_id, c.size, q.source_size, q.target,
  (c.size * (CASE WHEN q.source_size = 0 THEN 0 ELSE q.flow // q.source_size END
   + CASE WHEN q.source_size > 0 AND 2 * c.before + c.size <= 2 * (q.flow % q.source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source
"""
