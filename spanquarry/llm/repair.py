"""Repair of the turn structure of conversations, with an audit of the edits.

A repaired conversation's role initials have the form ``(s?(ua)+)?``. Edits and their costs: Keep 0, Rerole to user or
assistant 3, Delete 4 (required for blank rows and duplicates), Insert an empty user or assistant row 3; a truncated row
that stays adds 3. Of the cheapest audits (the edits' initials in order) the ASCII-least is taken.

1. ``counted``: equal rows are counted before any shuffle; a row whose role and text were seen at an earlier turn is known
   by an aggregate over (conversation, role, digest), not by reading a conversation in one task.
2. ``aligned``: rows are dealt by ranges of (conversation, turn, role, text), so that a large conversation spreads over
   tasks, and cut into chunks of at most CHUNK free rows (rows that need not go). A chunk's free rows are aligned with each
   feasible length of the alternating string (Wagner and Fischer), shortest distance first, within Ukkonen's band of the
   cheapest alignment so far; equal costs are told apart by the backtraced audits. Forced deletions take no part: a D comes
   before an I, so in the least audit they stand right behind the edit of the row before them.
3. A conversation that lies in one task and has few chunks is finished there. Of the others each chunk gives the best
   alignment for each pair of grammar states at its ends (16 costs and their order); one pass back over these summaries
   picks the states, one pass forward over the chunks makes the edits, each holding a single state. Audits of a chunk end
   with the edit of its last row, so none begins another and their order decides that of whole audits.

Defined results: null roles and texts are one space; rows with a null turn come first, ties are taken in order of role and
text; a null conv_id is a conversation of its own; repeated rows are duplicates; a role that is none of s, u, a at its
beginning is reroled or deleted; texts of any length are taken whole; an empty table has no row; further columns are
ignored whatever their names. A conversation's digest is one hash over its texts in order, so the digest of a conversation
that spans tasks is one task's, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import mapped, stored

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Free rows, and rows of any kind, in a chunk; chunks of a conversation that a task holds at most.
CHUNK, CHUNK_ROWS, HELD = 32, 256, 64
NAMES = {"u": "user", "a": "assistant"}
#: Grammar states: nothing yet, after a system, user or assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 40
#: What has to be inserted after the last row in each state.
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
BLANK_ENDS = " \t\n\x0b\x0c\r"

EDIT = "array<struct<edit: string, role: string, text: string, n: long>>"
ROW = "array<struct<role: string, text: string, n: long, fault: string>>"
COUNTS = "blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, cost long"
SEGMENT = f"conv_id long, pid int, seq int, {COUNTS}, edits {EDIT}"
CHUNKS = f"{SEGMENT}, lead string, tail string, rows {ROW}, costs array<long>, audits array<string>"


def fault_code(conv_id: Column, turn: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    return F.crc32(F.concat_ws(":", text(conv_id), text(turn)).cast("binary")) % 20


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the rows after planted damage (dropped, emptied, without sentence ends, repeated,
    wrong role), by a checksum of conversation and turn."""
    code, none = fault_code(F.col("conv_id"), F.col("turn")), F.lit(" ")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), none).alias("role"), F.coalesce(F.col("text").cast("string"), none).alias("text"), code.alias("_code"))
    text = F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_code") == 4, "user").otherwise(F.col("role"))
    return rows.where("_code <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("_code") == 3, 2).otherwise(1).alias("copies"))


def counted(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, copies) with equal ones counted (n), and whether role and text stand at an earlier
    turn of the conversation (seen)."""
    whole = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("n"))
    at = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))
    digest = F.unhex(F.sha2("text", 256))
    again = rows.groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), digest.alias("_d")).agg(F.min(at).alias("_first"), F.max(at).alias("_last")).where("_first < _last").drop("_last")
    met = whole.withColumn("_digest", digest).join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("_digest") == F.col("_d")), "left")
    return met.select("conv_id", "turn", "role", "text", "n", F.coalesce(at > F.col("_first"), F.lit(False)).alias("seen"))


# ---- alignment of a few free rows with the alternating string ----


def gap(rows: int, places: int) -> int:
    return DELETE * (rows - places) if rows > places else INSERT * (places - rows)


def align(free: tuple[tuple[str, int], ...], target: str, limit: int, closing: bool) -> tuple[int, str] | None:
    """Cost and ASCII-least audit of the cheapest alignment of rows (initial, extra cost if kept) with a target string, None
    beyond limit. Without ``closing`` nothing is inserted behind the last row. Cells whose distance from both corners
    alone costs more than the limit are left out."""
    n, m = len(free), len(target)
    rest = [[FAR] * (m + 1) for _ in range(n + 1)]
    for i in range(n, -1, -1):
        row, below = rest[i], rest[i + 1] if i < n else None
        for j in range(m, -1, -1):
            if gap(i, j) + gap(n - i, m - j) > limit:
                continue
            best = 0 if i == n and j == m else FAR
            if j < m and target[j] != "s" and (i < n or closing):
                best = INSERT + row[j + 1]
            if i < n:
                best = min(best, DELETE + below[j])
                if j < m:
                    initial, extra = free[i]
                    if initial == target[j]:
                        best = min(best, extra + below[j + 1])
                    elif target[j] != "s":
                        best = min(best, REROLE + extra + below[j + 1])
            row[j] = best
    cost = rest[0][0]
    if cost > limit:
        return None
    i = j = 0
    out = []
    while i < n or j < m:
        here = rest[i][j]
        if i < n and DELETE + rest[i + 1][j] == here:
            out.append("D")
            i += 1
        elif j < m and target[j] != "s" and (i < n or closing) and INSERT + rest[i][j + 1] == here:
            out.append("I")
            j += 1
        else:
            out.append("K" if free[i][0] == target[j] else "R")
            i, j = i + 1, j + 1
    return cost, "".join(out)


def targets(start: int, end: int, longest: int) -> Iterator[str]:
    """The pieces of the grammar's strings that lead from one state to another."""
    if start == end:
        yield ""
    if end == SYSTEM:
        if start == START:
            yield "s"
        return
    if end == START:
        return
    heads = ("", "s") if start == START else ("",)
    first, last = ("a" if start == USER else "u"), ("u" if end == USER else "a")
    for head in heads:
        for k in range(1, longest + 1):
            if (first == last) == (k % 2 == 1):
                yield head + ((first + ("u" if first == "a" else "a")) * k)[:k]


@lru_cache(maxsize=50_000)
def cheapest(free: tuple[tuple[str, int], ...], start: int, end: int | None) -> tuple[int, str] | None:
    """The best audit from one state to another; end None: from start to a whole string, insertions at the end included."""
    n, closing = len(free), end is None
    found = {t for e in ((START, ASSISTANT) if closing else (end,)) for t in targets(start, e, 2 * n + 4)}
    best = None
    for target in sorted(found, key=lambda t: (gap(n, len(t)), t)):
        bound = gap(n, len(target))
        if best and bound > best[0]:
            break
        limit = best[0] if best else sum(DELETE + extra for _, extra in free) + INSERT * len(target)
        got = align(free, target, limit, closing)
        if got and (best is None or got < best):
            best = got
    return best


# ---- rows, chunks, edits ----


def spread(audit: str, rows: list[dict]) -> Iterator[tuple[str, dict | None]]:
    """The audit's edits with their rows, forced deletions put in right behind the edit of the row before them."""
    k = 0
    for row in rows:
        if row["fault"] in ("blank", "duplicate"):
            yield "D", row
            continue
        while audit[k] == "I":
            yield "I", None
            k += 1
        yield audit[k], row
        k += 1
    for _ in audit[k:]:
        yield "I", None


def edits(audit: str, rows: list[dict], start: int) -> tuple[list[dict], int]:
    """The edits as rows, and the state behind them."""
    out, state = [], start
    for op, row in spread(audit, rows):
        n = row["n"] if row else 1
        if op != "D":
            if op == "K":
                role = row["role"]
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            else:
                state = ASSISTANT if state == USER else USER
                role = NAMES["a" if state == ASSISTANT else "u"]
            out.append({"edit": op, "role": role, "text": row["text"] if row else "", "n": 1})
        else:
            out.append({"edit": "D", "role": row["role"], "text": row["text"], "n": n})
    return out, state


def free_of(rows: list[dict]) -> tuple[tuple[str, int], ...]:
    return tuple((r["role"][:1], TRUNCATED if r["fault"] == "truncated" else 0) for r in rows if r["fault"] not in ("blank", "duplicate"))


def illegal(before: str | None, initial: str) -> int:
    return int(before is not None and before + initial not in ("su", "ua", "au"))


class Chunk:
    """Rows of a conversation in order, equal ones in one with their number; the counts that its report needs."""

    def __init__(self, conv_id, seq: int):
        self.conv_id, self.seq, self.rows, self.free = conv_id, seq, [], 0
        self.n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns", "forced"), 0)
        self.first_turn = self.last_turn = self.lead = self.tail = None

    def add(self, turn, role: str, text: str, n: int, seen: bool) -> None:
        core = text.rstrip(BLANK_ENDS)
        fault = "blank" if not core else "duplicate" if seen else "" if core[-1] in ".!?" else "truncated"
        if turn is not None and turn != self.last_turn:
            self.n["turns"] += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.n["illegal"] += illegal(self.tail, role[:1]) + (n - 1)
        self.lead, self.tail = role[:1] if self.lead is None else self.lead, role[:1]
        own = n if fault in ("blank", "duplicate") else 1
        self.rows.append({"role": role, "text": text, "n": own, "fault": fault})
        if fault:
            self.n[fault] += own
        if n > own:
            self.rows.append({"role": role, "text": text, "n": n - own, "fault": "duplicate"})
            self.n["duplicate"] += n - own
        self.free += own == 1 and fault in ("", "truncated")
        self.n["forced"] += (n if fault in ("blank", "duplicate") else n - 1) * DELETE

    def full(self) -> bool:
        return self.free >= CHUNK or len(self.rows) >= CHUNK_ROWS

    def counts(self) -> list:
        return [self.n[k] for k in ("blank", "duplicate", "truncated", "illegal", "turns")] + [self.first_turn, self.last_turn]


def joined(chunks: list[Chunk], pid: int) -> list:
    """A conversation that is whole: its segment."""
    sums, rows, before, last = [0] * 5, [], None, None
    for c in chunks:
        own = c.counts()
        sums = [a + b for a, b in zip(sums, own[:5], strict=True)]
        sums[3] += illegal(before, c.lead)
        sums[4] -= last is not None and last == c.first_turn
        before, last = c.tail, c.last_turn if c.last_turn is not None else last
        rows += c.rows
    turns = [t for c in chunks for t in (c.first_turn, c.last_turn) if t is not None]
    if len(chunks) == 1:
        cost, audit = cheapest(free_of(rows), START, None)
    else:
        options = [summary(c) for c in chunks]
        picks = walk_back([o[0] for o in options], [o[1] for o in options])
        cost, audit, state = 0, "", START
        for (costs, audits), pick in zip(options, picks, strict=True):
            at = 4 * state + pick[state]
            cost, audit, state = cost + costs[at], audit + audits[at], pick[state]
        cost, audit = cost + INSERT * len(TAIL[state]), audit + TAIL[state]
    cost += sum(c.n["forced"] for c in chunks)
    return [chunks[0].conv_id, pid, chunks[0].seq, *sums, min(turns, default=None), max(turns, default=None), cost, edits(audit, rows, START)[0]] + [None] * 5


def summary(chunk: Chunk) -> tuple[list[int], list[str | None]]:
    """Costs and audits for each pair of states (4 * start + end); FAR and None where none leads there."""
    free = free_of(chunk.rows)
    got = [cheapest(free, s, e) for s in range(4) for e in range(4)]
    return [g[0] if g else FAR for g in got], [g[1] if g else None for g in got]


def picked(costs: list[int], audits: list[str | None], onward: list[int]) -> tuple[list[int], list[int]]:
    """For each state before a chunk the best state behind it, and the cost from there on."""
    picks, total = [], []
    for s in range(4):
        least = min((costs[4 * s + e] + onward[e], audits[4 * s + e] or "", e) for e in range(4) if audits[4 * s + e] is not None)
        picks.append(least[2])
        total.append(least[0])
    return picks, total


END_COST = [INSERT * len(TAIL[s]) for s in range(4)]


def walk_back(costs: list[list[int]], audits: list[list[str | None]]) -> list[list[int]]:
    onward, out = END_COST, []
    for c, a in zip(reversed(costs), reversed(audits), strict=True):
        pick, onward = picked(c, a, onward)
        out.append(pick)
    return out[::-1]


def batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def emitted(rows: Iterable[list], schema: pa.Schema, together: int = 512) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= together:
            yield batch(held, schema)
            held = []
    if held:
        yield batch(held, schema)


def records(batches: Iterator[pa.RecordBatch], together: int = 500) -> Iterator[tuple]:
    for b in batches:
        for a in range(0, b.num_rows, together):
            yield from zip(*[c.to_pylist() for c in b.slice(a, together).columns], strict=True)


def aligned(rows: DataFrame) -> DataFrame:
    """CHUNKS of counted rows: whole conversations with their edits, and chunks of those that reach over a task's border
    or are large, with the alignments that they may take."""

    schema = arrow(CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()

        def opened(chunks: list[Chunk]) -> Iterator[list]:
            for c in chunks:
                costs, audits = summary(c)
                yield [c.conv_id, pid, c.seq, *c.counts(), c.n["forced"], None, c.lead, c.tail, c.rows, costs, audits]

        def out() -> Iterator[list]:
            held: list[Chunk] = []
            seq, whole = 0, False  # whole: the conversation began in this task and is held from its first row on
            for conv_id, turn, role, text, n, seen in records(batches):
                if held and held[-1].conv_id != conv_id:
                    yield from [joined(held, pid)] if whole else opened(held)
                    held, whole = [], True
                if not held or held[-1].full():
                    if len(held) >= HELD:
                        yield from opened(held[:-1])
                        held, whole = held[-1:], False
                    held.append(Chunk(conv_id, seq))
                    seq += 1
                held[-1].add(turn, role, text, n, seen)
            yield from opened(held)

        yield from emitted(out(), schema)

    ranged = rows.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    return mapped(ranged.select("conv_id", "turn", "role", "text", "n", "seen"), run, CHUNKS)


def by_conversation(rows: DataFrame, order: list[Column]) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def states(chunks: DataFrame) -> DataFrame:
    """pid, seq, picks (the state behind the chunk for each state before it), last: one pass from the end of each
    conversation to its beginning."""
    ddl = "pid int, seq int, picks array<int>, last boolean"
    schema = arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[list]:
            current, onward, begun = None, END_COST, False
            for conv_id, pid, seq, costs, audits in records(batches):
                last = not begun or conv_id != current
                pick, onward = picked(costs, audits, END_COST if last else onward)
                current, begun = conv_id, True
                yield [pid, seq, pick, last]

        yield from emitted(out(), schema)

    rows = by_conversation(chunks.select("conv_id", "pid", "seq", "costs", "audits"), [F.desc("pid"), F.desc("seq")])
    return mapped(rows, run, ddl)


def finished(chunks: DataFrame) -> DataFrame:
    """SEGMENTs of chunks: one pass forward over each conversation, holding its state and the chunk before's last marks."""

    schema = arrow(SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[list]:
            current, begun = None, False
            state, tail, turn = START, None, None
            for conv_id, pid, seq, blank, dup, trunc, bad, turns, first, final, forced, lead, end, rows, costs, audits, picks, last in records(batches, 50):
                if not begun or conv_id != current:
                    current, begun, state, tail, turn = conv_id, True, START, None, None
                at = 4 * state + picks[state]
                audit = audits[at] + (TAIL[picks[state]] if last else "")
                cost = forced + costs[at] + (END_COST[picks[state]] if last else 0)
                made, _ = edits(audit, rows, state)
                yield [conv_id, pid, seq, blank, dup, trunc, bad + illegal(tail, lead), turns - (turn is not None and turn == first), first, final, cost, made]
                state, tail, turn = picks[state], end, final if final is not None else turn

        yield from emitted(out(), schema, 50)

    rows = chunks.join(states(chunks), ["pid", "seq"]).select("conv_id", "pid", "seq", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "cost", "lead", "tail", "rows", "costs", "audits", "picks", "last")
    return mapped(by_conversation(rows, [F.col("pid"), F.col("seq")]), run, SEGMENT)


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SEGMENTs of conversations (rows: conv_id, turn, role, text, copies): the edits in order, with costs and faults. First
    those that are a whole conversation each, then the segments of all others, in order of pid and seq."""
    table = stored(aligned(counted(rows)), "repair")
    whole = [c.split()[0] for c in SEGMENT.split(", edits")[0].split(", ")] + ["edits"]
    return table.where("edits is not null").select(*whole), finished(table.where("edits is null").drop("edits"))


def turns(segments: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, pid, seq, place (order within a conversation), role, text, edit."""
    each = segments.select("conv_id", "pid", "seq", F.posexplode("edits").alias("place", "e"))
    return each.where("e.edit <> 'D'").select("conv_id", "pid", "seq", "place", "e.role", "e.text", "e.edit")


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digests(segments: DataFrame) -> DataFrame:
    """REPORT rows of conversations in several segments, read as a stream."""

    schema = arrow(REPORT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[list]:
            now = None
            for conv_id, *n, made in records(batches, 50):
                if now is None or now[0] != conv_id:
                    if now:
                        yield closed(*now)
                    now = (conv_id, [0] * 6, [], hashlib.sha256(), [], [])
                sums, audit, digest, ends, any_yet = now[1:]
                for k, v in enumerate((*n[:5], n[7])):
                    sums[k] += v
                ends += [t for t in n[5:7] if t is not None]
                ends[:] = [min(ends), max(ends)] if ends else []
                for e in made:
                    audit.append(e["edit"] * e["n"])
                    if e["edit"] != "D":
                        digest.update((("\n" if any_yet else "") + e["role"] + ":" + e["text"]).encode())
                        any_yet[:] = [True]
            if now:
                yield closed(*now)

        def closed(conv_id, sums, audit, digest, ends, _any) -> list:
            blank, dup, trunc, bad, distinct, cost = sums
            return [conv_id, ends[1] - ends[0] + 1 - distinct if ends else 0, blank, dup, trunc, bad, cost, "".join(audit), digest.hexdigest()]

        yield from emitted(out(), schema)

    rows = by_conversation(segments, [F.col("pid"), F.col("seq")])
    return mapped(rows.select("conv_id", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "cost", "edits"), run, REPORT)


def report(conversations: DataFrame, whole: DataFrame, parts: DataFrame) -> DataFrame:
    """REPORT of each conversation in ``conversations`` (its rows before damage): gaps in the turns, faults, cost, audit and
    the digest of the repaired text."""
    lines = F.transform(F.filter("edits", lambda e: e["edit"] != "D"), lambda e: F.concat(e["role"], F.lit(":"), e["text"]))
    audit = F.array_join(F.transform("edits", lambda e: F.repeat(e["edit"], e["n"].cast("int"))), "")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    one = whole.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", audit.alias("audit"), F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    found = one.unionByName(digests(parts)).withColumnRenamed("conv_id", "_conv")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


#: The same by another way: an automaton of the grammar's states, folded from the last row to the first with the best
#: (cost, audit) of each state. The checksum is folded bit by bit, as DuckDB has none.
ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 20 AS f FROM c),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS copy FROM h WHERE f <> 0),
p AS (SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS before, rtrim(text, E' \t\n\x0b\x0c\r') AS core FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS k FROM p),
r AS (SELECT *, CASE WHEN core = '' THEN 'blank' WHEN k > 1 THEN 'duplicate' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS ini FROM q),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal,
  list({'ini': ini, 'forced': fault IN ('blank', 'duplicate'), 'x': CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'role': role, 'text': text} ORDER BY i DESC) AS l, list({'role': role, 'text': text} ORDER BY i) AS fw FROM r GROUP BY conv_id),
s AS (SELECT *, list_reduce(list_prepend({'z': [{'c': 0, 'a': ''}, {'c': 6, 'a': 'II'}, {'c': 3, 'a': 'I'}, {'c': 0, 'a': ''}], 'ini': '', 'forced': false, 'x': 0}, list_transform(l, lambda y: {'z': NULL::STRUCT(c INTEGER, a VARCHAR)[], 'ini': y.ini, 'forced': y.forced, 'x': y.x})),
  lambda acc, y: {'z': list_transform([{'c': 0, 'z': CASE WHEN y.forced THEN list_transform(acc.z, lambda e: {'c': e.c + 4, 'a': 'D' || e.a})
     ELSE [list_min([{'c': acc.z[1].c + 4, 'a': 'D' || acc.z[1].a}, {'c': CASE WHEN y.ini = 's' THEN acc.z[2].c + y.x ELSE 1000000000 END, 'a': 'K' || acc.z[2].a}, {'c': acc.z[3].c + y.x + CASE WHEN y.ini = 'u' THEN 0 ELSE 3 END, 'a': CASE WHEN y.ini = 'u' THEN 'K' ELSE 'R' END || acc.z[3].a}]),
      list_min([{'c': acc.z[2].c + 4, 'a': 'D' || acc.z[2].a}, {'c': acc.z[3].c + y.x + CASE WHEN y.ini = 'u' THEN 0 ELSE 3 END, 'a': CASE WHEN y.ini = 'u' THEN 'K' ELSE 'R' END || acc.z[3].a}]),
      list_min([{'c': acc.z[3].c + 4, 'a': 'D' || acc.z[3].a}, {'c': acc.z[4].c + y.x + CASE WHEN y.ini = 'a' THEN 0 ELSE 3 END, 'a': CASE WHEN y.ini = 'a' THEN 'K' ELSE 'R' END || acc.z[4].a}]),
      list_min([{'c': acc.z[4].c + 4, 'a': 'D' || acc.z[4].a}, {'c': acc.z[3].c + y.x + CASE WHEN y.ini = 'u' THEN 0 ELSE 3 END, 'a': CASE WHEN y.ini = 'u' THEN 'K' ELSE 'R' END || acc.z[3].a}])] END}],
    lambda t: [list_min([t.z[1], {'c': t.z[3].c + 3, 'a': 'I' || t.z[3].a}, {'c': t.z[4].c + 6, 'a': 'II' || t.z[4].a}]), list_min([t.z[2], {'c': t.z[3].c + 3, 'a': 'I' || t.z[3].a}, {'c': t.z[4].c + 6, 'a': 'II' || t.z[4].a}]),
      list_min([t.z[3], {'c': t.z[4].c + 3, 'a': 'I' || t.z[4].a}]), list_min([t.z[4], {'c': t.z[3].c + 3, 'a': 'I' || t.z[3].a}])])[1], 'ini': '', 'forced': false, 'x': 0}).z[1] AS best FROM g),
a AS (SELECT conv_id, fw, string_split(best.a, '') AS ops FROM s WHERE best.a <> ''),
b AS (SELECT conv_id, fw, unnest(ops) AS op, generate_subscripts(ops, 1) AS j FROM a),
e AS (SELECT *, sum((op <> 'D')::INT) OVER (PARTITION BY conv_id ORDER BY j) AS o, sum((op = 'K' AND left(fw[i::INT].role, 1) = 's')::INT) OVER (PARTITION BY conv_id) AS sys FROM (SELECT *, sum((op <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY j) AS i FROM b)),
t AS (SELECT conv_id, sha256(string_agg(CASE WHEN op = 'K' THEN fw[i::INT].role WHEN (o - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE fw[i::INT].text END, chr(10) ORDER BY j)) AS sha FROM e WHERE op <> 'D' GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
  coalesce(best.a, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN s ON o.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN t ON o.conv_id IS NOT DISTINCT FROM t.conv_id"""
