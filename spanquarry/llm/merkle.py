"""Document fingerprints: a Merkle tree over sections, paragraphs and their pieces.

A text's pieces are sentences (a sentence end with the white space behind it), cut further where they are long; a paragraph is a
line with its end; a section ends at a blank line, or behind a paragraph whose digest is a multiple of SECTION, so its
borders depend on what stands there and not on what was put in before. Every node's digest is a hash of its children's; the
root's covers the whole text's, so roots are equal just if texts are.

A fingerprint is the tree as text: ``root.size|section:paragraph=piece.size,piece.size;paragraph=...|section:...``, digests in hex,
sizes in code points. Two fingerprints are compared from the root down and only differing branches are opened:
``likeness`` is twice the size of the nodes that both hold (as often as both do), over both sizes; 1 just for equal roots.
``edits`` gives the code points of the first text that stand in no common node.

``with_next`` needs each document's successor in order of doc_id: rows are dealt by ranges of (doc_id, hash of the text), so
the successor is the next row of the task, and only the rows at the tasks' borders are joined.

Defined results: a null text is empty; an empty text's tree has a root and no section; the successor of the last document is
the first, so a single document's is itself; a null doc_id comes first, rows that share an id stand in order of their
texts' hashes; repeated rows each keep their row; texts of any length are taken whole (a text is one task's); further columns
are ignored whatever their names; an empty table has no row.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, sliced, stored

#: Code points in a piece at most, and in one of a text's first HEAD code points (which short texts are all of); one
#: paragraph in so many ends a section by its digest.
PIECE, HEAD_PIECE, HEAD, SECTION = 64, 16, 256, 8


def _pieces(most: int) -> re.Pattern:
    return re.compile(rf"[^.!?\n]{{1,{most}}}(?:[.!?]{{1,{most}}}[^\S\n]{{0,{most}}})?\n?|[.!?]{{1,{most}}}[^\S\n]{{0,{most}}}\n?|\n")


PIECES, HEAD_PIECES = _pieces(PIECE), _pieces(HEAD_PIECE)


def digest(text: str) -> str:
    """Eight hex digits, for sections and paragraphs; pieces have six, as they are many and only compared within two texts."""
    return xxhash.xxh32_hexdigest(text)


def sections(text: str) -> list[list[list[str]]]:
    """Sections of paragraphs of pieces; all pieces joined are the text."""
    out, section, blank, at = [], [], False, 0
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        empty = not line.strip()
        if blank and not empty and section:
            out.append(section)
            section = []
        head = max(0, HEAD - at)
        section.append((HEAD_PIECES.findall(line[:head]) if head else []) + PIECES.findall(line[head:]))
        at += len(line)
        blank = empty
        if not empty and int(digest(line), 16) % SECTION == 0:
            out.append(section)
            section = []
    return [*out, section] if section else out


def fingerprint(text: str) -> str:
    parts = []
    for section in sections(text):
        paragraphs = []
        for pieces in section:
            leaves = ",".join([f"{xxhash.xxh32_hexdigest(p)[:6]}.{len(p)}" for p in pieces])
            paragraphs.append(f"{digest(leaves)}={leaves}")
        own = digest(";".join([p[:8] for p in paragraphs]))
        parts.append(f"{own}:{';'.join(paragraphs)}")
    root = hashlib.blake2b("|".join([p[:8] for p in parts]).encode() + hashlib.sha256(text.encode()).digest(), digest_size=16).hexdigest()
    return "|".join([f"{root}.{len(text)}", *parts])


SIZE = re.compile(r"\.(\d+)")


def _size(node: str) -> int:
    return sum(map(int, SIZE.findall(node)))


def _common(a: list[str], b: list[str]) -> tuple[list[bool], list[bool]]:
    """Which nodes of either list have a partner of the same content in the other, earlier ones first."""
    shared = set(a).intersection(b)
    if not shared:
        return [False] * len(a), [False] * len(b)
    both = Counter([x for x in a if x in shared]) & Counter([x for x in b if x in shared])
    found = []
    for nodes in (a, b):
        left, marks = both.copy(), []
        for x in nodes:
            met = x in shared and left[x] > 0
            if met:
                left[x] -= 1
            marks.append(met)
        found.append(marks)
    return found[0], found[1]


#: What parts a level's children in the text of a fingerprint, from the sections' down.
SEPARATORS = (";", ",")


def _opened(nodes: list[str], marks: list[bool], level: int) -> list[str]:
    """The children of the nodes that have no partner."""
    cut = ":" if level == 0 else "="
    return [c for x, m in zip(nodes, marks, strict=True) if not m for c in x.split(cut, 1)[1].split(SEPARATORS[level])]


def likeness(a: str, b: str) -> float:
    """0 to 1 from two fingerprints alone."""
    (root_a, *mine), (root_b, *theirs) = a.split("|"), b.split("|")
    if root_a == root_b:
        return 1.0
    whole = _size(root_a) + _size(root_b)
    same = 0
    for level in range(3):
        x, y = _common(mine, theirs)
        same += sum(_size(n) if level < 2 else int(n.rsplit(".", 1)[1]) for n, m in zip(mine, x, strict=True) if m)
        if level < 2:
            mine, theirs = _opened(mine, x, level), _opened(theirs, y, level)
    return min(2 * same / whole, 1 - 1 / (1 + whole)) if whole else 0.0


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """Spans (start, end in code points, joined where they touch) of the first text that are in no common node."""
    if a.split("|", 1)[0] == b.split("|", 1)[0]:
        return []
    out: list[tuple[int, int]] = []

    def walk(mine: list[tuple[int, str]], theirs: list[str], level: int) -> None:
        x, y = _common([n for _, n in mine], theirs)
        rest = [(at, n) for (at, n), m in zip(mine, x, strict=True) if not m]
        if level == 2:
            out.extend((at, at + int(n.rsplit(".", 1)[1])) for at, n in rest)
            return
        below = []
        for at, n in rest:
            for c in _opened([n], [False], level):
                below.append((at, c))
                at += _size(c) if level == 0 else int(c.rsplit(".", 1)[1])
        walk(below, _opened(theirs, y, level), level + 1)

    at, top = 0, []
    for n in a.split("|")[1:]:
        top.append((at, n))
        at += _size(n)
    walk(top, b.split("|")[1:], 0)
    joined: list[tuple[int, int]] = []
    for s, e in sorted(out):
        if joined and joined[-1][1] == s:
            joined[-1] = (joined[-1][0], e)
        else:
            joined.append((s, e))
    return joined


# ---- tables ----


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of documents (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [t.as_py() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint(t) for t in texts])], schema=schema)

    return mapped(_plain(docs), run, "doc_id long, n_chars long, fingerprint string")


def located(pairs: DataFrame) -> DataFrame:
    """pairs (a, b: fingerprints, any further columns) with likeness and spans, the code points of a's text that differ."""

    @F.udf("struct<likeness: double, spans: array<struct<start: long, end: long>>>")
    def compared(a: str, b: str):
        return (likeness(a, b), edits(a, b)) if a is not None and b is not None else None

    return pairs.withColumn("_c", compared("a", "b")).select("*", "_c.likeness", "_c.spans").drop("_c")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def edited(text: str, after: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many of another text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id, text: str, own: str, after: str, next_own: str) -> list:
    changed = edited(text, after)
    print_of = own if changed == text else next_own if changed == after else fingerprint(changed)
    return [doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, print_of, likeness(own, print_of), likeness(own, next_own)]


def with_next(docs: DataFrame) -> DataFrame:
    """COLUMNS: each document's fingerprint, that of its text with the second half taken from the next document, and how
    like its own are that one and the next document's."""
    # both fingerprints are one string here, as half of the second is the first's and compresses with it
    ddl = "doc_id long, n_chars long, edited_sha256 string, both string, near_edited double, near_next double, pid int, place string, text string"
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("both", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("pid", pa.int32()), ("place", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        before: tuple | None = None
        for b in sliced(batches, 100):
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                own = fingerprint(text)
                if before:
                    *head, mine, changed, near, near_next = _row(*before, text, own)
                    out.append([*head, f"{mine}\n{changed}", near, near_next, pid, "inside", None])
                else:
                    out.append([doc_id, None, None, own, None, None, pid, "first", text])
                before = (doc_id, text, own)
            if out:
                yield _batch(out, schema)
        if before:
            yield _batch([[before[0], None, None, before[2], None, None, pid, "last", before[1]]], schema)

    ranged = _plain(docs).withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    table = stored(mapped(ranged.select("doc_id", "text"), run, ddl), "fingerprints")
    table = table.select("*", F.substring_index("both", "\n", 1).alias("fingerprint"), F.substring_index("both", "\n", -1).alias("edited_fingerprint"))
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return table.where("place = 'inside'").select(*names).unionByName(_borders(table))


def _borders(table: DataFrame) -> DataFrame:
    """The rows of each task's last document, with the first of the next task that has any (after the last, the first's)."""
    pids = table.where("place = 'first'").select("pid")
    around = pids.select("pid", F.coalesce(F.lead("pid").over(Window.orderBy("pid")), F.min("pid").over(Window.orderBy("pid"))).alias("after"))  # a number for each task
    firsts = table.where("place = 'first'").select(F.col("pid").alias("after"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_own"))
    pairs = table.where("place = 'last'").select("pid", "doc_id", "text", "fingerprint").join(around, "pid").join(firsts, "after")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 10):
            yield _batch([_row(*r) for r in zip(*[c.to_pylist() for c in b.columns], strict=True)], schema)

    return mapped(pairs.select("doc_id", "text", "fingerprint", "next_text", "next_own"), run, COLUMNS)


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
