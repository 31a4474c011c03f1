"""SimHash near-duplicate groups, with distances counted on vertical bit planes.

1. ``fingerprints``: 64-bit SimHash of the word shingles of each whole text.
2. ``links``: pairs of distinct fingerprints that differ in few bits. Blocks of the fingerprint serve as bucket keys
   (by the pigeonhole principle no pair is lost); inside a bucket, distances of many pairs are counted at once on bit
   planes with carry-save counters, and words of lanes are abandoned once all of them exceed the radius.
3. ``components``: connected components by alternating large-star and small-star steps.

``similar_groups`` and ``keep_one`` join documents by the Jaccard similarity of their shingle sets instead: long
fingerprints (of the distinct shingles) compared the same way give candidates, and each candidate pair is then checked
on the sets themselves, so nothing is linked below the similarity.

Defined results: a null or blank text has fingerprint 0 and links like any other; a null doc_id keeps its row, and
does not count as the smallest id unless the group has no other (then component_id is null); repeated rows each keep a
row; an empty table gives an empty result; further input columns are ignored by ``near_duplicates``. ``keep_one`` knows
a document by doc_id and text, so different texts that share an id (or have none) are different documents, of repeated
rows one stays, all wordless texts are one group, and further columns stay as they are whatever their names. Texts of
any length are taken whole; ties go to the smallest id, then the smallest text hash.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, mapped, sliced, stored

#: Blocks and matching blocks: radius + m blocks of which m must agree. Finer plans have longer keys and more tables.
MATCHING = (1, 2, 3, 4)
#: Fingerprints per bucket that a plan may have on average, and rows of a bucket that one comparison takes.
BUCKET, CHUNK = 256, 2048
#: Groups of up to this size are compared by shifting the planes, larger ones query by query.
SMALL = 128
#: Rows whose groups are compared together.
TOGETHER = 16_384
#: Similar groups: words per shingle, similarity, 64-bit words of the long fingerprint. There are as many key tables as
#: a pair at the similarity itself needs to meet in one with a probability of MEET if bits were independent; the radius
#: is SLACK standard deviations over what is expected (tests measure what is found).
SHINGLE, SIMILARITY, LONG_WORDS, MEET, SLACK = 5, 0.8, 4, 0.99, 2.5
#: Bits of a key at least (it grows so that a bucket has 512 nodes at most on average), and bits of a table's number.
KEY_BITS, TABLE_BITS = 14, 10
#: Candidates of a bucket for each of its nodes up to which they leave their task as pairs; of a bucket with more, the
#: shingle sets come to the task. Bytes of them that one comparison takes.
LINEAR, CHUNK_BYTES = 16, 32 << 20

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 (uint64) of the ASCII-lower-cased words' shingles in order, repeats included; fewer words are one shingle."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    n = max(1, len(parts) - shingle + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    spans = zip(starts, ends[min(shingle, len(parts)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, n)


def simhash(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """``words`` times 64 bits of SimHash (uint64). The first come from the hashes as they are, the others from the hashes
    mixed anew."""
    counts = np.zeros(64 * words, np.int64)
    for a in range(0, len(hashes), 16384):
        part = hashes[a : a + 16384]
        every = np.stack([part, *(_mixed(part, k) for k in range(1, words))], axis=1)
        counts += np.unpackbits(every.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([simhash(shingle_hashes(t, shingle, seed))[0] for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(rows, run, "doc_id long, fp long")


# ---- candidate buckets ----


def _tables(radius: int, m: int) -> list[list[tuple[int, int]]]:
    """For each table its blocks as (first bit, width)."""
    k = radius + m
    edges = [round(i * 64 / k) for i in range(k + 1)]
    return [[(edges[i], edges[i + 1] - edges[i]) for i in chosen] for chosen in itertools.combinations(range(k), m)]


def _key(fp: Column, table: int, blocks: list[tuple[int, int]]) -> Column:
    key = F.lit(table).cast("long")
    for first, width in blocks:
        key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, first).bitwiseAND((1 << width) - 1))
    return key


def _bucketed(rows: DataFrame, radius: int, m: int) -> DataFrame:
    """A row for each table: bucket, fp. Rows that come with a bucket stay apart by it."""
    keys = F.explode(F.array(*[_key(F.col("fp"), t, blocks) for t, blocks in enumerate(_tables(radius, m))]))
    out = rows.select(*rows.columns, keys.alias("key"))
    return out.select((F.xxhash64("bucket", "key") if "bucket" in rows.columns else F.col("key")).alias("bucket"), "fp")


def links(fps: DataFrame, radius: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Edges a, b over distinct fps such that fps within the radius of each other are connected; a is the larger.

    A bucket beyond the chunk size is keyed anew by the next finer plan. What is still too large under the finest plan
    gets a pivot: members within its radius are linked to it and meet one sub-chunk only, the others meet every
    sub-chunk, so no link is lost.
    """
    stars = None
    n = fps.count()
    m = next((m for m in MATCHING if n <= BUCKET * 2 ** min(w for w in (sum(w for _, w in t) for t in _tables(radius, m)))), MATCHING[-1])
    rows, parts = fps.select("fp"), []
    while True:
        keyed = cut(_bucketed(rows, radius, m))
        sizes = keyed.groupBy("bucket").agg(F.count("*").alias("size"))
        hot = cut(sizes.where(F.col("size") > chunk))
        if hot.isEmpty():
            parts.append(keyed.select("bucket", F.lit(0).alias("i"), "fp"))
            break
        parts.append(keyed.join(hot, "bucket", "left_anti").select("bucket", F.lit(0).alias("i"), "fp"))
        if m == MATCHING[-1]:
            pivots = keyed.join(hot, "bucket").groupBy("bucket").agg(F.min("fp").alias("pivot"))
            split = keyed.join(hot, "bucket").join(pivots, "bucket").withColumn("n", F.ceil(F.col("size") / chunk).cast("int"))
            split = cut(split.withColumn("near", F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))) <= radius))
            stars = split.where("near and fp != pivot").select(F.greatest("fp", "pivot").alias("a"), F.least("fp", "pivot").alias("b"))
            own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
            every = F.when(F.col("near"), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("n") - 1))
            open_ = split.where("not near").select("bucket").distinct()  # a bucket of linked rows alone holds nothing new
            parts.append(split.join(open_, "bucket", "left_semi").select("bucket", F.explode(every).alias("i"), "fp"))
            break
        rows, m = keyed.join(hot.select("bucket"), "bucket"), m + 1
    found = _linked(functools.reduce(DataFrame.unionByName, parts).withColumnRenamed("fp", "id"), radius)
    return found if stars is None else found.unionByName(stars).distinct()


# ---- bit-sliced comparison ----


def planes(fps: np.ndarray) -> np.ndarray:
    """[bits, words] uint64: word w of plane b holds bit b of the fingerprints 64 w to 64 w + 63."""
    padded = np.zeros((-(-len(fps) // 64) * 64, fps.reshape(len(fps), -1).shape[1]), np.uint64)
    padded[: len(fps)] = fps.reshape(len(fps), -1)
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(differing, alive: np.ndarray, radius: int, depth: int = 64) -> np.ndarray:
    """Lanes whose count of set bits over all planes is at most radius.

    differing(b, at) gives plane b at the flat word positions at; alive has the lanes to judge. Counters are bit
    planes too: a carry-save step takes in two planes at once, counts beyond 2**bits - 1 stick in ``over``.
    """
    shape, alive = alive.shape, alive.reshape(-1)
    at = np.flatnonzero(alive)
    width = max(1, int(radius + 1).bit_length())
    counters = [np.zeros(len(at), np.uint64) for _ in range(width)]
    over = ~alive[at]
    for b in range(0, depth, 2):
        x, y = differing(b, at), differing(b + 1, at)
        low = counters[0]
        half = x ^ y
        carry = (x & y) | (low & half)
        counters[0] = low ^ half
        for k in range(1, width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over = over | carry
        if b % 8 == 6:
            beyond = _beyond(counters, radius) | over
            over = beyond
            stay = beyond != _FULL
            if stay.mean() < 0.75:  # abandon words of which no lane can come back
                at, over, counters = at[stay], over[stay], [c[stay] for c in counters]
                if not len(at):
                    break
    out = np.zeros(alive.shape, np.uint64)
    out[at] = ~(_beyond(counters, radius) | over)
    return out.reshape(shape)


def _beyond(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter exceeds radius, by comparing from the highest bit down."""
    more, same = np.zeros_like(counters[0]), np.full_like(counters[0], _FULL)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            same = same & counters[k]
        else:
            more, same = more | (same & counters[k]), same & ~counters[k]
    return more


def _shifted(words: np.ndarray, d: int) -> np.ndarray:
    """Lane t of the result is lane t + d of words; zeros come in at the end."""
    whole, rest = divmod(d, 64)
    out = np.zeros_like(words)
    n = words.shape[-1] - whole
    if n > 0:
        out[..., :n] = words[..., whole:] >> np.uint64(rest)
        if rest:
            out[..., : n - 1] |= words[..., whole + 1 :] << np.uint64(64 - rest)
    return out


def _lanes(mask: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little"))


def _packed(flags: np.ndarray) -> np.ndarray:
    padded = np.zeros(-(-len(flags) // 64) * 64, bool)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view(np.uint64)


def _small_pairs(fps: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions within the radius and in one group; groups are runs of at most SMALL rows."""
    own, d = planes(fps), 1
    while d < len(fps) and (same := group[:-d] == group[d:]).any():
        other = _shifted(own, d)
        near = within(lambda b, at, other=other: own[b, at] ^ other[b, at], _packed(np.append(same, np.zeros(d, bool))), radius, len(own))
        t = _lanes(near)
        yield t, t + d
        d += 1


def _large_pairs(fps: np.ndarray, radius: int, queries: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    own, flat = planes(fps), fps.reshape(len(fps), -1)
    words = own.shape[1]
    lanes = np.arange(words * 64)
    for first in range(0, len(fps), queries):
        asked = flat[first : first + queries]
        alive = np.stack([np.packbits((lanes > first + q) & (lanes < len(fps)), bitorder="little").view(np.uint64) for q in range(len(asked))])

        def differing(b: int, at: np.ndarray, asked=asked) -> np.ndarray:
            bit = (asked[at // words, b // 64] >> np.uint64(b % 64)) & np.uint64(1)
            return own[b, at % words] ^ (np.uint64(0) - bit)

        near = within(differing, alive, radius, len(own))
        for q in np.flatnonzero(near.any(axis=1)):
            t = _lanes(near[q])
            yield np.full(len(t), first + q), t


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest position that each of n positions is connected with through the pairs."""
    held, size = [], 0

    def labels() -> np.ndarray:
        label = np.arange(n)
        if not held:
            return label
        s, t = (np.concatenate(x) for x in zip(*held, strict=True))
        while True:
            before, low = label.copy(), np.minimum(label[s], label[t])
            np.minimum.at(label, s, low)
            np.minimum.at(label, t, low)
            np.minimum.at(label, before, label.copy())
            while not np.array_equal(jumped := label[label], label):
                label = jumped
            if np.array_equal(label, before):
                return label

    for pair in pairs:
        if len(pair[0]):
            held.append(pair)
            size += len(pair[0])
        if size > 1 << 20:  # a dense set: its tree says as much
            label = labels()
            held, size = [(np.arange(n), label)], n
    return labels()


def _edges(bucket: np.ndarray, ids: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    """bucket: runs of equal numbers, whole groups. For each connected set in a group a star around its first."""
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    sizes = np.diff(np.append(starts, len(bucket)))
    small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    sets = [(ids[small], fps[small], lambda x: _small_pairs(x, bucket[small], radius))] if small.any() else []
    sets += [(ids[a : a + n], fps[a : a + n], lambda x: _large_pairs(x, radius)) for a, n in zip(starts, sizes, strict=True) if n > SMALL]
    for own, x, pairs in sets:
        label = forest(len(x), pairs(x))
        moved = np.flatnonzero(label != np.arange(len(x)))
        a, b = own[moved], own[label[moved]]
        a, b = a[a != b], b[a != b]
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])


def _whole_groups(batches: Iterator[pa.RecordBatch], by: int = 2) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Numbers of the groups (rows alike in the first columns, sorted by them) and the columns of many rows at a time; a
    group that a batch's end may have cut waits for the next batch."""
    held, seen, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(by)], axis=1)
        change = np.append(True, (keys[1:] != keys[:-1]).any(axis=1))
        change[0] = last is None or (last != keys[0]).any()
        number = seen + np.cumsum(change)
        seen, last = int(number[-1]), keys[-1]
        held.append((number, batch))
        if sum(len(n) for n, _ in held) >= TOGETHER or sum(b.nbytes for _, b in held) >= CHUNK_BYTES:
            number, table = np.concatenate([n for n, _ in held]), pa.Table.from_batches([b for _, b in held])
            whole = int(np.searchsorted(number, seen))
            if whole:
                yield number[:whole], table.slice(0, whole)
            held = [(number[whole:], b) for b in table.slice(whole).combine_chunks().to_batches()]
    if held:
        yield np.concatenate([n for n, _ in held]), pa.Table.from_batches([b for _, b in held])


def _numbers(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([table.column(c).to_numpy().astype(np.int64) for c in names], axis=1)


def _near_pairs(number: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within the radius of each other in the groups: those of all small groups, then those of
    each large one."""
    starts = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    sizes = np.diff(np.append(starts, len(number)))
    small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
    together = lambda pairs: tuple(np.concatenate(x) for x in zip(*pairs, strict=True))
    if len(small) and (pairs := list(_small_pairs(fps[small], number[small], radius))):
        s, t = together(pairs)
        yield small[s], small[t]
    for a, n in zip(starts, sizes, strict=True):
        if n > SMALL and (pairs := list(_large_pairs(fps[a : a + n], radius))):
            s, t = together(pairs)
            yield a + s, a + t


# ---- components ----


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of the edges a, b.

    Large-star and small-star steps in turn: each is a grouped minimum, which combines before the shuffle, and a join
    that Spark can split where a node is hot. The edge set is checkpointed each round.
    """
    now = cut(edges.select("a", "b").where("a != b").distinct())
    size, mark = _mark(now)
    while size:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        star = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        star = cut(star.distinct())
        least = cut(star.groupBy("a").agg(F.min("b").alias("m")))
        low = star.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(low.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        before, (size, mark) = (size, mark), _mark(now)
        if before == (size, mark):
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def _linked(rows: DataFrame, radius: int) -> DataFrame:
    """rows: bucket, i (sub-chunk), id (the fingerprint itself)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in _whole_groups(batches):
            fps = _numbers(table, ["id"])
            yield from _edges(number, fps[:, 0].copy(), fps.view(np.uint64), radius)

    dealt = rows.repartition("bucket", "i").sortWithinPartitions("bucket", "i", "id")
    return dealt.mapInArrow(run, "a long, b long").distinct()


# ---- similar shingle sets ----


def set_fingerprints(docs: DataFrame, shingle: int = SHINGLE, words: int = LONG_WORDS, seed: int = 42) -> DataFrame:
    """doc_id, text_hash, id (hash of the set of shingles), n (its size), fp, fp1, ... of its distinct shingles."""
    names = ["fp", *(f"fp{k}" for k in range(1, words))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, sizes, fps = [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                own = np.unique(shingle_hashes(text, shingle, seed))
                ids.append(xxhash.xxh64_intdigest(own.tobytes(), seed))
                sizes.append(len(own))
                fps.append(simhash(own, words))
            table = np.array(fps, np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), *(pa.array(table[:, k].copy()) for k in range(words))], ["doc_id", "text_hash", "id", "n", *names])

    return mapped(_named(docs), run, "doc_id long, text_hash long, id long, n long, " + ", ".join(f"{n} long" for n in names))


def _named(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text, F.length(text)).alias("text_hash"), text.alias("text"))


def shingle_sets(docs: DataFrame, chosen: DataFrame, shingle: int = SHINGLE, seed: int = 42) -> DataFrame:
    """id, hashes (the set as a sorted array) of the chosen nodes (id, doc_id, text_hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [np.unique(shingle_hashes(t, shingle, seed)).view(np.int64) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)])
            if ends[-1] < 2**31:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))], ["id", "hashes"])

    wanted = chosen.select("id", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    rows = _named(docs).join(bounded(wanted, 24), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    return mapped(rows.select("id", "text"), run, "id long, hashes array<long>").dropDuplicates(["id"])


def _masks(words: int, bits: int, similarity: float) -> tuple[np.ndarray, float]:
    """For each table the bits of its key as masks [tables, words]; and the share of differing bits at the similarity."""
    share = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    tables = max(1, math.ceil(math.log(1 - MEET) / math.log(1 - (1 - share) ** bits))) if share else 1
    picked = np.random.Generator(np.random.Philox(17))
    out = np.zeros((min(tables, 1 << TABLE_BITS), words), np.uint64)
    for t in range(len(out)):
        for at in picked.choice(64 * words, bits, replace=False).tolist():
            out[t, at // 64] |= np.uint64(1) << np.uint64(at % 64)
    return out, share


def _tables_of(nodes: DataFrame, masks: np.ndarray) -> DataFrame:
    """The nodes once for each table: bucket (a hash of table and key, the table's number in its last bits)."""
    names, low = [c for c in nodes.columns if c.startswith("fp")], (1 << TABLE_BITS) - 1
    keys = [F.xxhash64(F.lit(t), *[F.col(n).bitwiseAND(F.lit(int(m.view(np.int64)))) for n, m in zip(names, row, strict=True)]).bitwiseAND(F.lit(~low)).bitwiseOR(F.lit(t)) for t, row in enumerate(masks)]
    return nodes.select(F.explode(F.array(*keys)).alias("bucket"), *nodes.columns)


def _first_table(bucket: np.ndarray, differ: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which pairs don't meet in a table before that of their bucket; differ: their fingerprints' differing bits."""
    table, first = bucket & ((1 << TABLE_BITS) - 1), np.ones(len(bucket), bool)
    for u in range(int(table.max(initial=0))):
        first &= (table <= u) | ((differ & masks[u]) != 0).any(axis=1)
    return first


def _size_fits(n: np.ndarray, s: np.ndarray, t: np.ndarray, similarity: float) -> np.ndarray:
    return np.minimum(n[s], n[t]) >= similarity * np.maximum(n[s], n[t]) - 1e-9


def candidate_pairs(rows: DataFrame, radius: int, masks: np.ndarray, similarity: float) -> DataFrame:
    """a, b: pairs of nodes that share a bucket and may be as similar as asked; bucket instead for a bucket put off.

    rows: bucket, id, n, fp, ... A pair counts if its fingerprints are within the radius and its sizes allow the
    similarity; and in the first table only in which the two meet. A bucket with more than LINEAR pairs for each of its
    nodes is put off.
    """
    names = [c for c in rows.columns if c.startswith("fp")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in _whole_groups(batches, 1):
            bucket, ids, n = _numbers(table, ["bucket", "id", "n"]).T
            fps, number = _numbers(table, names).view(np.uint64), number - number[0]
            sizes = np.bincount(number)
            for s, t in _near_pairs(number, fps, radius):
                fit = _size_fits(n, s, t, similarity)
                s, t = s[fit], t[fit]
                dense = np.bincount(number[s], minlength=len(sizes)) > LINEAR * sizes
                if dense.any():
                    off = np.unique(bucket[dense[number]])
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(off), pa.int64()), pa.nulls(len(off), pa.int64()), pa.array(off)], ["a", "b", "bucket"])
                    s, t = s[~dense[number[s]]], t[~dense[number[s]]]
                first = _first_table(bucket[s], fps[s] ^ fps[t], masks)
                a, b = ids[s[first]], ids[t[first]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.nulls(len(a), pa.int64())], ["a", "b", "bucket"])

    dealt = rows.select("bucket", "id", "n", *names).repartition("bucket").sortWithinPartitions("bucket", "id")
    return dealt.mapInArrow(run, "a long, b long, bucket long").distinct()


def dense_links(rows: DataFrame, radius: int, masks: np.ndarray, similarity: float) -> DataFrame:
    """a, b: links that connect what pairs of a Jaccard similarity of at least so much connect, found where the sets are.

    rows: bucket, i (sub-chunk), id, n, comp, wide, home (0 or 1), hashes, fp, ... As for ``candidate_pairs``; and the two
    comps differ, one of the two is wide (meets every sub-chunk) and one at home in the sub-chunk.
    """
    names = [c for c in rows.columns if c.startswith("fp")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in _whole_groups(batches):
            bucket, ids, n, comp, wide, home = _numbers(table, ["bucket", "id", "n", "comp", "wide", "home"]).T
            fps, lists = _numbers(table, names).view(np.uint64), table.column("hashes").combine_chunks()
            for s, t in _near_pairs(number, fps, radius):
                fit = _size_fits(n, s, t, similarity) & (comp[s] != comp[t]) & ((wide[s] | wide[t]) > 0) & ((home[s] | home[t]) > 0)
                s, t = s[fit], t[fit]
                first = _first_table(bucket[s], fps[s] ^ fps[t], masks)
                a, b = _joined(lists, s[first], t[first], similarity)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(ids[a], ids[b])), pa.array(np.minimum(ids[a], ids[b]))], ["a", "b"])

    columns = ["bucket", "i", "id", "n", "comp", "wide", "home", "hashes", *names]
    dealt = rows.select(*columns).repartition("bucket", "i").sortWithinPartitions("bucket", "i", "id")
    return mapped(dealt, run, "a long, b long").distinct()


def _joined(lists: pa.ListArray, s: np.ndarray, t: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs s, t those that are similar enough and not connected by others before."""
    used, place = np.unique(np.concatenate([s, t]), return_inverse=True)
    s, t = place[: len(s)], place[len(s) :]
    order = np.lexsort((t, s))
    s, t = s[order], t[order]
    own = lists.take(pa.array(used))
    ends = own.offsets.to_numpy() - own.offsets[0].as_py()
    hashes = np.unique(own.flatten().to_numpy(), return_inverse=True)[1]
    sizes, label, mark = np.diff(ends), np.arange(len(used)), np.zeros(len(hashes), bool)
    out: list[tuple[int, int]] = []
    for a, z in zip(starts := np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, int), np.append(starts[1:], len(s)), strict=True):
        x, others = s[a], t[a:z]
        others = others[label[others] != label[x]]
        if not len(others):
            continue
        mark[hashes[ends[x] : ends[x + 1]]] = True
        shared = np.array([np.count_nonzero(mark[hashes[ends[y] : ends[y + 1]]]) for y in others])
        mark[hashes[ends[x] : ends[x + 1]]] = False
        for y in others[shared >= similarity * (sizes[x] + sizes[others] - shared) - 1e-9]:
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
                out.append((x, y))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return used[pairs[:, 0]], used[pairs[:, 1]]


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose sets have a Jaccard similarity of at least so much. A node with many partners is split by
    Spark's handling of skewed joins."""
    x, y = (sets.select(F.col("id").alias(k), F.col("hashes").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    shared = F.size(F.array_intersect("x", "y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y")).alias("sum"))
    return both.where(F.col("shared") >= similarity * (F.col("sum") - F.col("shared")) - 1e-9).select("a", "b")


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, words: int = LONG_WORDS, seed: int = 42, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text_hash, times (rows alike in both), component_id and component_hash (doc_id and text_hash of the group's
    first document): groups are connected by pairs whose shingle sets have a Jaccard similarity of at least so much.

    Documents with equal sets are one node. A Jaccard similarity j is a cosine of 2 j / (1 + j), and that an expected
    share of differing bits; keys of chosen bits give buckets, and nodes of a bucket within the radius are candidates,
    which ``verified`` checks. Where a bucket has very many of them, or more nodes than the chunk size, the sets are
    brought to the bucket instead, so pairs never leave their task. A bucket larger than that comes in sub-chunks: once
    each is linked, members of its largest connected set meet their own sub-chunk, all others every one.
    """
    names = ["id", "n", "fp", *(f"fp{k}" for k in range(1, words))]
    prints = cut(set_fingerprints(docs, shingle, words, seed).groupBy("doc_id", "text_hash").agg(F.count("*").alias("times"), *[F.first(c).alias(c) for c in names]))
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("low")
    nodes = cut(prints.groupBy("id").agg(low, *[F.first(c).alias(c) for c in names[1:]]))
    bits = max(KEY_BITS, math.ceil(math.log2(max(nodes.count(), 1) / 512)))
    masks, share = _masks(words, bits, similarity)
    spread = 64 * words * share
    radius = round(spread + SLACK * math.sqrt(spread * (1 - share)))
    keyed = _tables_of(nodes.select(*names), masks)
    large = cut(keyed.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > chunk).select("bucket"))
    found = cut(candidate_pairs(keyed.join(bounded(large, 8), "bucket", "left_anti"), radius, masks, similarity))
    pairs = found.where("bucket is null").select("a", "b")
    put_off = cut(found.where("bucket is not null").select("bucket").unionByName(large).distinct())
    dense = cut(keyed.join(bounded(put_off, 8), "bucket"))
    some = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(dense.select("id")).distinct()
    chosen = cut(nodes.join(some, "id").select("id", "low.doc_id", "low.text_hash"))
    sets = stored(shingle_sets(docs, chosen, shingle, seed), "shingle-sets")
    links = verified(pairs, sets, similarity)
    if not put_off.isEmpty():
        parts = cut(dense.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / chunk, F.sum("n") * 8 / CHUNK_BYTES)).cast("int").alias("parts")))
        rows = dense.join(bounded(parts, 16), "bucket").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("one", F.lit(1))
        alone = rows.withColumn("comp", F.col("id")).withColumn("i", F.col("own")).withColumn("wide", F.col("one")).withColumn("home", F.col("one"))
        links = cut(links.unionByName(dense_links(alone.join(sets, "id"), radius, masks, similarity)))
        rows = rows.where("parts > 1")
        if not rows.isEmpty():
            roots = cut(components(links))
            rows = cut(rows.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root"))
            main = rows.groupBy("bucket", "comp").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
            rows = rows.join(bounded(cut(main), 16), "bucket").withColumn("wide", (F.col("comp") != F.col("main")).cast("int"))
            rows = rows.withColumn("i", F.explode(F.when(F.col("wide") == 1, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))))
            rows = rows.withColumn("home", (F.col("i") == F.col("own")).cast("int"))
            links = links.unionByName(cut(dense_links(rows.join(sets, "id"), radius, masks, similarity)))
    roots = cut(components(links))
    named = nodes.select("id", "low").join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "low", F.coalesce("root", "id").alias("root"))
    heads = named.groupBy("root").agg(F.min("low").alias("head"))
    ids = named.join(heads, "root").select("id", "head")
    return prints.join(ids, "id").select("doc_id", "text_hash", "times", F.col("head.doc_id").alias("component_id"), F.col("head.text_hash").alias("component_hash"))


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the group), one row per input row."""
    fps = cut(fingerprints(docs, shingle, seed))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = cut(components(links(nodes, radius)))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp").groupBy("root").agg(F.min("low").alias("group_low"))
    grouped = roots.join(named, "root").select(F.col("node").alias("fp"), "group_low")
    ids = nodes.join(grouped, "fp", "left").select("fp", F.coalesce("group_low", "low").alias("component_id"))
    return fps.join(cut(ids), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The documents' rows, one of each group of similar documents: that with the smallest doc_id (then text hash); of
    rows alike in doc_id and text one. Texts stay where they are as long as the table of what goes can be broadcast."""
    found = similar_groups(docs.select("doc_id", "text"), similarity, shingle)
    head = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("component_hash"))
    fate = cut(found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.when(~head, "gone").when(F.col("times") > 1, "repeated").alias("fate")).where("fate is not null"))
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text, F.length(text)).alias("hash"))
    rows = rows.join(bounded(fate, 32), F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left")
    once = rows.where("fate = 'repeated'").dropDuplicates(["id", "hash"])
    return rows.where("fate is null").select("doc.*").unionByName(once.select("doc.*"))
