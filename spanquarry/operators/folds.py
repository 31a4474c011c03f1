"""The sampler's decisions that follow one another: leader clusters over an index, and what is kept.

Both go over the traces in order of time and carry a compact state: the living leaders with their members' seconds, and counts
with the kept traces of the lookback. ``chained`` cuts the order into chunks, one task each, and hands the state on, so
nothing starts anew at a border and no task or pandas frame holds more than a chunk's batch. The streaming sampler
(``streaming.sampler``) runs the same classes on Spark's state.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.scalars import hash_uniform
from ..functions.storage import bounded, shared_dir, stored
from .ordering import numbered

#: Places in a chunk, and in a block, which is one row of it.
CHUNK, BLOCK = 1 << 20, 1 << 13


class LeaderIndex:
    """Living clusters. A trace joins the one whose first trace's tokens are most like its own (Jaccard, the oldest of
    equals), or founds one; members leave after the lookback, and an empty cluster ends.

    Leaders are found by their token set if it is the same, else by the tokens that a set as like as ``least`` has to share:
    those in the first places of both sets in a common order. A set's answer stands until leaders come or go.
    """

    def __init__(self, lookback: int, least: float = 0.5):
        self.lookback, self.least, self.founded, self.version = lookback, least, 0, 0  # the version changes with the leaders
        self.leaders: dict[int, list] = {}  # id -> tokens, (second, members), members in all
        self.by_set: dict[frozenset, int] = {}
        self.by_token: dict[str, set[int]] = {}
        self.joined: deque = deque()  # (second, id), as members came
        self.known: dict[frozenset, tuple[int, float]] = {}

    def _prefix(self, tokens: frozenset) -> list[str]:
        """Two sets of Jaccard t share one of the first n - ceil(t n) + 1 tokens of each."""
        n = len(tokens)
        return sorted(tokens)[: n - -int(-self.least * n // 1) + 1]

    def _enter(self, ident: int, tokens: frozenset) -> None:
        self.leaders[ident] = [tokens, deque(), 0]
        self.by_set[tokens] = ident
        for t in self._prefix(tokens):
            self.by_token.setdefault(t, set()).add(ident)
        self._changed()

    def _changed(self) -> None:
        self.known.clear()
        self.version += 1

    def expire(self, sec: int) -> None:
        """Members of before the lookback leave."""
        while self.joined and self.joined[0][0] <= sec - self.lookback:
            _, ident = self.joined.popleft()
            lead = self.leaders[ident]
            tokens, gone = lead[0], lead[1].popleft()[1]
            lead[2] -= gone
            if not lead[2]:
                del self.leaders[ident], self.by_set[tokens]
                for t in self._prefix(tokens):
                    self.by_token[t].discard(ident)
                self._changed()

    def nearest(self, tokens: frozenset) -> tuple[int, float]:
        if tokens in self.by_set:
            return self.by_set[tokens], 1.0
        if tokens not in self.known:
            best, how = -1, 0.0
            for ident in sorted({i for t in self._prefix(tokens) for i in self.by_token.get(t, ())}):
                lead = self.leaders[ident][0]
                near = len(tokens & lead) / len(tokens | lead)
                if near >= self.least and near > how:
                    best, how = ident, near
            self.known[tokens] = (best, how)
        return self.known[tokens]

    def add(self, sec: int, tokens: Iterable[str]) -> tuple[int, float, int]:
        """Cluster, similarity, and members of the lookback before this one."""
        return next(zip(*self.add_all([sec], [0], [frozenset(tokens)]), strict=True))

    def add_all(self, secs: list[int], codes: list[int], sets: list[frozenset]) -> tuple[list[int], list[float], list[int]]:
        """The same of traces in order, whose token sets are named by their place in ``sets``. A set's leader is looked up
        again only after leaders have come or gone."""
        clusters, likeness, masses, at, version, here = [], [], [], None, -1, {}
        for sec, code in zip(secs, codes, strict=True):
            if sec != at:
                self.expire(sec)
                at = sec
            if version != self.version:
                here, version = {}, self.version
            if code not in here:
                ident, how = self.nearest(sets[code])
                if ident < 0:
                    ident, how, self.founded = self.founded, 1.0, self.founded + 1
                    self._enter(ident, sets[code])
                    here, version = {}, self.version
                here[code] = (ident, how, self.leaders[ident])
            ident, how, lead = here[code]
            members = lead[1]
            clusters.append(ident)
            likeness.append(how)
            masses.append(lead[2])
            if members and members[-1][0] == sec:
                members[-1][1] += 1
            else:
                members.append([sec, 1])
                self.joined.append((sec, ident))
            lead[2] += 1
        return clusters, likeness, masses

    def dump(self) -> str:
        return json.dumps([self.founded, [[i, sorted(t), list(s)] for i, (t, s, _) in self.leaders.items()]])

    def load(self, text: str | None) -> LeaderIndex:
        if text:
            self.founded, leaders = json.loads(text)
            for i, tokens, secs in leaders:
                self._enter(i, frozenset(tokens))
                self.leaders[i][1:] = deque(map(list, secs)), sum(n for _, n in secs)
            self.joined = deque(sorted((s, i) for i, (_, secs, _) in self.leaders.items() for s, _ in secs))
        return self


class KeepFold:
    """Whether a trace is kept. While more than the budget's share is kept, a trace has to pass both its draws (alarms only
    the first); below it, a rare quiet trace goes, others pass on the first draw, and clean ones get a second chance while
    too few of the lookback's kept traces are free of errors, and a third one (``soft``) by how far the share falls
    short."""

    def __init__(self, beta: float, lookback: int, normal: float = 0.3, soft: bool = False):
        self.beta, self.lookback, self.normal, self.soft = beta, lookback, normal, soft
        self.floor = 0.12 if beta <= 0.0015 else 0.20 if beta <= 0.01 else 0.30
        self.seen = self.kept = self.failed = 0
        self.window: deque = deque()  # (second, error) of the kept

    def possible(self, p: Column, d: Column, error: Column, incident: Column, near: Column, alarm: Column, u: Column, v: Column, w: Column, when: Callable = lambda c, x, y: F.when(c, x).otherwise(y)) -> Column:
        """What a trace's own numbers leave open, as a sum: 1 if it is kept above the budget's share, 2 if below it, 4 if it
        has a second chance and 8 a third one. 0: it is not kept, whatever came before. With ``when=np.where`` of arrays."""
        floor = when(incident & (near >= 0.55), max(0.08, self.floor - 0.06), self.floor)
        clean = ~error & ~incident & (p < floor) & (d <= 0.45)
        flags = [(u < p) & (alarm | (u < d)), (u < p) & ~((d >= 0.72) & (p < floor)), clean & (v < self.beta)]
        flags += [clean & (w < self.beta)] if self.soft else []
        return sum(when(f, 1 << k, 0) for k, f in enumerate(flags))

    def _below_from(self) -> float:
        """The first place at which no more than the budget's share is kept."""
        if not self.kept or self.beta <= 0:
            return float("inf") if self.kept else 1
        n = max(1, int(self.kept / self.beta))
        while self.kept / n > self.beta:
            n += 1
        while n > 1 and self.kept / (n - 1) <= self.beta:
            n -= 1
        return n

    def _expire(self, sec: int) -> None:
        while self.window and self.window[0][0] < sec - self.lookback + 1:
            self.failed -= self.window.popleft()[1]

    def pick(self, places: list[int], secs: list[int], errors: list[bool], possible: np.ndarray, ws: list[float] | None = None) -> list[int]:
        """Which of the next rows are kept: the decisions of ``decide`` for traces in order, of which those that can't be
        kept may be left out. It goes from one kept trace to the next: above the share only rows with 1 are looked at, up to
        the place where the share is met, from there on the first of the others."""
        above, below = np.flatnonzero(possible & 1).tolist(), np.flatnonzero(possible & ~1).tolist()
        flags, out, at, n = possible.tolist(), [], 0, len(places)
        while at < n:
            met = bisect_left(places, self._below_from(), at)
            k = bisect_left(above, at)
            if k < len(above) and above[k] < met:  # and all up to there: each moves it further off
                taken = above[k : bisect_left(above, met, k)]
            else:
                k = bisect_left(below, met)
                if k == len(below):
                    break
                at = below[k]
                taken = [at]
                if not flags[at] & 2:
                    self._expire(secs[at])
                    calm = 1 - (self.failed / len(self.window) if self.window else 0.0)
                    short = self.beta - self.kept / places[at]
                    if not (flags[at] & 4 and calm < self.normal) and not (flags[at] & 8 and ws[at] < min(max(short, 0.0), 0.20)):
                        taken, at = [], at + 1
            if taken:
                now = [(secs[i], int(errors[i])) for i in taken]
                self.kept += len(now)
                self.failed += sum(e for _, e in now)
                self.window.extend(now)
                self._expire(now[-1][0])
                out += taken
                at = taken[-1] + 1
        return out

    def decide(self, sec: int, p: float, d: float, error: bool, incident: bool, near: float, alarm: bool, u: float, v: float, w: float) -> bool:
        self.seen += 1
        self._expire(sec)
        share = self.kept / self.seen
        floor = max(0.08, self.floor - 0.06) if incident and near >= 0.55 else self.floor
        if share > self.beta:
            keep = u < p and (alarm or u < d)
        else:
            keep = not (d >= 0.72 and p < floor) and u < p
            if not keep and not error and not incident and p < floor and d <= 0.45:
                calm = 1 - (self.failed / len(self.window) if self.window else 0.0)
                keep = calm < self.normal and v < self.beta
                if not keep and self.soft:
                    keep = w < min(max(self.beta - share, 0.0), 0.20)
        if keep:
            self.kept += 1
            self.failed += error
            self.window.append((sec, int(error)))
        return keep

    def dump(self) -> str:
        return json.dumps([self.seen, self.kept, list(self.window)])

    def load(self, text: str | None) -> KeepFold:
        if text:
            self.seen, self.kept, window = json.loads(text)
            self.window = deque(map(tuple, window))
            self.failed = sum(e for _, e in self.window)
        return self


def chained(rows: DataFrame, step: Callable[[str | None, Iterator[pa.RecordBatch]], Iterator[dict | str]], schema: str, chunk: int = CHUNK) -> DataFrame:
    """rows (with place, from 1; places may be missing) through ``step``, a chunk of places after the other. step(state,
    batches) gives columns of ``schema`` and, last, the state as text. Only the states reach the driver. Each chunk has its own folder, so none is read for
    another; what a step needs is computed before they are written, by all tasks."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    dealt = rows.withColumn("_chunk", F.floor((F.col("place") - 1) / chunk).cast("int"))
    dealt.repartition("_chunk").sortWithinPartitions("_chunk", "place").write.partitionBy("_chunk").parquet(path)
    there = spark.read.schema(StructType([*rows.schema.fields, StructField("_chunk", IntegerType())])).parquet(path)
    chunks = [r._chunk for r in there.select("_chunk").distinct().orderBy("_chunk").collect()]
    made = to_arrow_schema(StructType.fromDDL(f"{schema}, _state string"))
    state, out = None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in step(state, batches):
            if isinstance(found, str):
                found = {"_state": [found]}
            size = len(next(iter(found.values())))
            columns = [found.get(f.name, [None] * size) for f in made]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, made, strict=True)], schema=made)

    for k in chunks:
        part = spark.read.schema(rows.schema).parquet(f"{path}/_chunk={k}")
        done = stored(part.coalesce(1).sortWithinPartitions("place").mapInArrow(run, f"{schema}, _state string"), "fold")
        state = done.where("_state is not null").first()._state if k != chunks[-1] else None
        done = done.where("_state is null").drop("_state")
        out = done if out is None else out.unionByName(done)
    return out if out is not None else spark.createDataFrame([], schema)


def in_order(rows: DataFrame) -> DataFrame:
    """rows with their place by start and id, unless they have it."""
    return rows if "place" in rows.columns else numbered(rows, [], F.col("start_ns"), F.col("trace_id"))


def packed(rows: DataFrame, chunk: int, *columns: Column, where: Column | None = None) -> DataFrame:
    """place (the first of a block), rows: the blocks of the numbered rows as arrays of structs, in any order. What a fold goes
    over one after the other is put together by all tasks, and it reads arrays instead of rows."""
    size = min(BLOCK, chunk)
    first = (F.floor((F.col("place") - 1) / size) * size + 1).alias("place")
    one = F.struct("place", *columns)
    return rows.groupBy(first).agg(F.collect_list(one if where is None else F.when(where, one)).alias("rows"))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, np.ndarray | pa.Array]]]:
    """Blocks in order of their places: columns, ordered by place; numbers as numpy arrays, texts as Arrow's."""
    for batch in batches:
        for place, rows in zip(batch["place"].to_pylist(), batch["rows"], strict=True):
            values = rows.values
            names = [f.name for f in values.type]
            found = dict(zip(names, values.flatten(), strict=True))
            order = np.argsort(found["place"].to_numpy())
            yield place, {k: v.take(pa.array(order)) if pa.types.is_string(v.type) else v.to_numpy(zero_copy_only=False)[order] for k, v in found.items()}


def leader_clusters(rows: DataFrame, lookback: int, least: float = 0.5, chunk: int = CHUNK) -> DataFrame:
    """trace_id, cluster, similarity, mass (members of the lookback before it) of rows trace_id, start_ns (or place), sec, tokens."""
    rows = in_order(rows.select("trace_id", *[c for c in ("place",) if c in rows.columns] or ["start_ns"], "sec", "tokens"))
    return rows.select("trace_id", "place").join(placed_clusters(rows, lookback, least, chunk), "place").drop("place")


def placed_clusters(rows: DataFrame, lookback: int, least: float = 0.5, chunk: int = CHUNK) -> DataFrame:
    """place, cluster, similarity, mass of rows place, sec, tokens; see ``LeaderIndex``. The cost of a trace is a look-up of its
    token set, and each block makes a set but once."""
    lists = ("places", "cluster", "similarity", "mass")

    def step(state: str | None, batches: Iterator[pa.RecordBatch]) -> Iterator[dict | str]:
        index = LeaderIndex(lookback, least).load(state)
        for place, rows in blocks(batches):
            texts = rows["tokens"].dictionary_encode()
            sets = [frozenset(json.loads(x)) for x in texts.dictionary.to_pylist()]
            found = index.add_all(rows["sec"].tolist(), texts.indices.to_pylist(), sets)
            yield {"first": [place], "places": [rows["place"]]} | {c: [np.array(v)] for c, v in zip(lists[1:], found, strict=True)}
        yield index.dump()

    rows = rows.select("place", "sec", F.to_json("tokens").alias("tokens"))
    found = chained(packed(rows, chunk, F.col("sec"), F.col("tokens")), step, "first long, places array<long>, cluster array<long>, similarity array<double>, mass array<long>", chunk)
    found = found.select(F.explode(F.arrays_zip(*lists)).alias("x"))
    return found.select(F.col("x.places").alias("place"), *[f"x.{c}" for c in lists[1:]])


DRAWS = ("u", "v", "w")


def kept_rows(rows: DataFrame, beta: float, lookback: int, seeds: tuple[int, ...], normal: float = 0.3, soft: bool = False, chunk: int = CHUNK) -> DataFrame:
    """place, kept (for each seed, in order) of those rows that a seed keeps at all; rows: trace_id, place, sec, p_s, p_d, has_error,
    incident, near, alarm; see ``KeepFold``. All seeds go in one pass, over the rows only that may be kept whatever came
    before; that, and the draws, which are hashes, are found before it by all tasks."""
    rule, some = KeepFold(beta, lookback, normal, soft), range(len(seeds))
    draw = lambda k, name: hash_uniform(F.col("trace_id"), seeds[k], DRAWS.index(name) + 1)
    facts = [F.col(c) for c in ("p_s", "p_d", "has_error", "incident", "near", "alarm")]
    ws = [f"w{k}" for k in some] if soft else []
    rows = rows.select("trace_id", "place", "sec", "p_s", "p_d", "has_error", "incident", "near", "alarm", *[draw(k, "u").alias(f"u{k}") for k in some], *[draw(k, "w").alias(f"w{k}") for k in some if soft])  # once each
    rows = rows.select("place", "sec", "has_error", *[rule.possible(*facts, F.col(f"u{k}"), draw(k, "v"), F.col(f"w{k}") if soft else None).cast("byte").alias(f"open{k}") for k in some], *ws)
    rows = packed(rows, chunk, F.col("sec"), F.col("has_error"), *[F.col(f"open{k}") for k in some], *[F.col(w) for w in ws], where=sum((F.col(f"open{k}").cast("int") for k in some), F.lit(0)) > 0)

    def step(state: str | None, batches: Iterator[pa.RecordBatch]) -> Iterator[dict | str]:
        states = json.loads(state) if state else [None] * len(seeds)
        folds = [KeepFold(beta, lookback, normal, soft).load(s) for s in states]
        for place, rows in blocks(batches):
            facts = [rows[c].tolist() for c in ("place", "sec", "has_error")]
            kept = np.zeros(len(rows["place"]), np.int64)  # a bit for each seed
            for k, f in enumerate(folds):
                kept[f.pick(*facts, rows[f"open{k}"], rows[f"w{k}"] if soft else None)] |= 1 << k
            yield {"first": [place], "places": [rows["place"][kept > 0]], "kept": [kept[kept > 0]]}
        yield json.dumps([f.dump() for f in folds])

    found = chained(rows, step, "first long, places array<long>, kept array<long>", chunk).select(F.explode(F.arrays_zip("places", "kept")).alias("x"))
    return found.select(F.col("x.places").alias("place"), F.array(*[F.col("x.kept").bitwiseAND(1 << k) > 0 for k in some]).alias("kept"))


def keep_fold(rows: DataFrame, beta: float, lookback: int, seeds: tuple[int, ...], normal: float = 0.3, soft: bool = False, chunk: int = CHUNK) -> DataFrame:
    """trace_id, kept (for each seed, in order) of all rows; see ``kept_rows``. Without a place they are ordered by start_ns and id."""
    names = ("sec", "p_s", "p_d", "has_error", "incident", "near", "alarm")
    rows = in_order(rows.select("trace_id", *[c for c in ("place",) if c in rows.columns] or ["start_ns"], *names))
    found = kept_rows(rows, beta, lookback, seeds, normal, soft, chunk)
    kept = F.coalesce("kept", F.array(*[F.lit(False) for _ in seeds])).alias("kept")
    return rows.select("trace_id", "place").join(bounded(found, 64), "place", "left").select("trace_id", kept)
