"""Alignment of two tokenizers' tokens: which tokens of one cover the bytes of which of the other, and how often.

1. ``aligned_units``: every token points to the farthest-right token that overlaps it (the other tokenizer's token that
   holds its last byte, where that one ends later); successors are doubled for all tokens of a batch at once until they stand,
   at the token of the second tokenizer that ends where one of the first does. That terminal labels the group.
2. ``links``: each text is cut at single spaces between other characters, where both tokenizers start a token whatever
   stands before (the first's pattern never crosses such a space; no piece of the second holds a space behind another
   character, which is asked of its vocabulary). The stretches recur, so a task keeps the groups of those it has seen (at most
   KEPT); a document's tokens, groups and links are those of its stretches in order.
3. ``counted``: documents that hold a pair linked are counted over the corpus, after a map-side sum. The counts go back to
   the documents' pairs in two ways that split them: the pairs of most documents, BROADCAST_PAIRS at most, are broadcast,
   which leaves no key with many rows; the others that two documents share are joined by shuffle; what is in neither table
   has the count one. So the corpus's pairs are never shuffled as a whole.

Defined results: null and empty texts and those whose tokens' bytes differ from space+text have no tokens and zeros;
repeated rows count as documents of their own; a null doc_id is kept; texts of any length are taken whole; strings of special
tokens are plain text; further columns are ignored whatever their names; an empty table has no row.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, sliced, stored

BYTE_LEVEL, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Stretches whose groups a task keeps; pairs whose counts are broadcast.
KEPT, BROADCAST_PAIRS = 400_000, 1_000_000
STRETCH = re.compile(r"(?<=\S) (?=\S)")
SHIFT = 32


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the others as the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both vocabularies, and the groups of the stretches seen so far."""

    def __init__(self, byte_level: str, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = tokenizers.Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        letters = byte_of_letter()
        vocabulary = {v: k for k, v in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [bytes(letters[c] for c in vocabulary[i]) if i in vocabulary and all(c in letters for c in vocabulary[i]) else b"" for i in range(max(vocabulary) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.splits = not any(re.search("[^▁]▁", p) for p in names)
        self.long_a, self.long_b = np.array([len(x) for x in self.bytes_a]), np.array([len(x) for x in self.bytes_b])
        self.text_a, self.text_b = [str(i) for i in range(len(self.bytes_a))], [str(i) for i in range(len(names))]
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.strings: list[str] = []
        self.numbers = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, n_links, fits
        self.first, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def stretches(self, text: str) -> list[str]:
        return STRETCH.split(text) if self.splits else [text]

    def learn(self, texts: list[str]) -> None:
        """Tokens, groups and links of stretches not seen before."""
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        ids_b = self.b.encode(texts, num_threads=1)
        ba, bb = self.bytes_a, self.bytes_b
        fits = np.array([b"".join([ba[i] for i in x]) == (w := b" " + t.encode()) and b"".join([bb[i] for i in y]) == w for t, x, y in zip(texts, ids_a, ids_b, strict=True)], bool)
        good_a, good_b = [x for x, f in zip(ids_a, fits, strict=True) if f], [y for y, f in zip(ids_b, fits, strict=True) if f]
        flat_a, flat_b = (np.array([i for x in good for i in x], np.int64) for good in (good_a, good_b))
        label_a, label_b, n = groups(np.cumsum(self.long_a[flat_a]), np.cumsum(self.long_b[flat_b]))
        count_a, count_b = np.bincount(label_a, minlength=n), np.bincount(label_b, minlength=n)
        of_group = np.repeat(np.arange(len(good_a)), [len(x) for x in good_a])[np.cumsum(count_a) - count_a] if n else np.zeros(0, np.int64)
        # every token of the first with every one of the second in its group
        times = count_b[label_a]
        start_b = np.cumsum(count_b) - count_b
        each = np.repeat(np.arange(len(flat_a)), times)
        within = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
        pairs = flat_a[each] << SHIFT | flat_b[start_b[label_a[each]] + within] if len(each) else np.zeros(0, np.int64)
        n_groups = np.bincount(of_group, minlength=len(good_a))
        n_links = np.bincount(of_group, weights=count_a * count_b, minlength=len(good_a)).astype(np.int64)
        numbers = np.zeros((len(texts), 5), np.int64)
        numbers[fits] = np.stack([[len(x) for x in good_a], [len(y) for y in good_b], n_groups, n_links, np.ones(len(good_a), np.int64)], 1) if len(good_a) else numbers[fits]
        sa, sb, written, p, q = self.text_a, self.text_b, [], 0, 0
        la, lb = flat_a.tolist(), flat_b.tolist()
        for ca, cb in zip(count_a.tolist(), count_b.tolist(), strict=True):
            written.append(sa[la[p]] + "|" + sb[lb[q]] if ca == cb == 1 else ",".join([sa[i] for i in la[p : p + ca]]) + "|" + ",".join([sb[i] for i in lb[q : q + cb]]))
            p, q = p + ca, q + cb
        at = 0
        for t, k in zip(texts, numbers[:, 2].tolist(), strict=True):
            self.place[t] = len(self.strings)
            self.strings.append(";".join(written[at : at + k]))
            at += k
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(numbers[:, 3])])
        self.pairs, self.numbers = np.concatenate([self.pairs, pairs]), np.concatenate([self.numbers, numbers])

    def documents(self, texts: list[str | None]) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, n_links), digest of the groups, distinct pairs and how often each is linked."""
        cut = [self.stretches(t) if t else [] for t in texts]
        new = {w for ws in cut for w in ws if w not in self.place}
        if len(self.place) + len(new) > KEPT:
            self.forget()
            new = {w for ws in cut for w in ws}
        if new:
            self.learn(sorted(new))
        none = np.zeros(0, np.int64)
        for ws in cut:
            at = np.array([self.place[w] for w in ws], np.int64)
            numbers = self.numbers[at]
            if not len(at) or not numbers[:, 4].all():
                yield (0, 0, 0, 0), "", none, none
                continue
            sums = numbers.sum(0)
            first, size = self.first[at], numbers[:, 3]
            where = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(sums[3])
            kinds, times = np.unique(self.pairs[where], return_counts=True)
            strings = self.strings
            yield tuple(sums[:4].tolist()), hashlib.sha256(";".join([strings[k] for k in at.tolist()]).encode()).hexdigest(), kinds, times


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Group numbers, in order, of the tokens of two tokenizations of the same bytes, by their ends. A token's successor is
    the farthest-right token that overlaps it: the other side's token that holds its last byte. Where both end together the
    second side's token is the terminal, its own successor."""
    na, nb = len(ends_a), len(ends_b)
    if not na or not nb:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    to_b = np.searchsorted(ends_b, ends_a)
    to_a = np.searchsorted(ends_a, ends_b)
    own = na + np.arange(nb)
    after = np.concatenate([na + to_b, np.where(ends_a[to_a] > ends_b, to_a, own)])
    while True:
        further = after[after]
        if np.array_equal(further, after):
            break
        after = further
    _, label = np.unique(after, return_inverse=True)
    return label[:na], label[na:], int(label.max()) + 1


_tokenizers: dict[int, Tokenizers] = {}


def both(byte_level: str, pieces: bytes) -> Tokenizers:
    """The tokenizers, once per worker."""
    key = hash((byte_level, pieces))
    if key not in _tokenizers:
        _tokenizers[key] = Tokenizers(byte_level, pieces)
    return _tokenizers[key]


LINKS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<int>"


def links(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """LINKS of documents (doc_id, text): numbers of tokens, groups and links, digest of the groups, and the distinct
    linked id pairs (a[k], b[k]) with how often each is linked in the document."""
    with open(byte_level, encoding="utf-8") as f, open(pieces, "rb") as g:
        vocabularies = (json.dumps(json.load(f)), g.read())
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), *[(c, pa.list_(pa.int32())) for c in ("a", "b", "times")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = both(*vocabularies)
        for batch in sliced(batches, 64):
            found = list(two.documents(batch.column(1).to_pylist()))
            ends = pa.array(np.cumsum([0] + [len(k) for _, _, k, _ in found]), pa.int32())
            kinds, times = (np.concatenate([x[c] for x in found]).astype(np.int64) for c in (2, 3))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (kinds >> SHIFT, kinds & ((1 << SHIFT) - 1), times)]
            numbers = [pa.array(c, pa.int64()) for c in zip(*[n for n, *_ in found], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array([d for _, d, *_ in found], pa.string()), *lists], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(rows, run, LINKS)


def pair_counts(table: DataFrame) -> DataFrame:
    """pair (a's id shifted left by SHIFT, with b's id), docs: how many documents hold it linked."""
    return pairs_of(table.select("a", "b")).groupBy("pair").agg(F.count("*").alias("docs"))


def pairs_of(table: DataFrame) -> DataFrame:
    """A row for each pair of a document's lists, with the other columns."""
    lists = [c for c in ("a", "b", "times") if c in table.columns]
    each = table.select(*[c for c in table.columns if c not in lists], F.inline(F.arrays_zip(*lists)))
    return each.select(*[c for c in each.columns if c not in ("a", "b")], (F.shiftleft(F.col("a").cast("long"), SHIFT) + F.col("b")).alias("pair"))


def counted(table: DataFrame, limit: int = BROADCAST_PAIRS) -> DataFrame:
    """LINKS rows (stored) with n_best and count_sum in place of the lists: links whose pair is in as many documents as any
    pair of its first id, and the links' sum of such documents."""
    table = stored(table.withColumn("_row", F.monotonically_increasing_id()), "links")
    counts = stored(pair_counts(table), "pairs")
    highest = counts.groupBy(F.shiftright("pair", SHIFT).cast("int").alias("a")).agg(F.max("docs").alias("highest"))  # one row for each id of a vocabulary
    best = counts.where("docs > 1").join(F.broadcast(highest), F.shiftright("pair", SHIFT) == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("highest")).alias("best"))
    border = least_broadcast(counts, limit)
    rows = pairs_of(table.select("_row", "a", "b", "times"))
    common = best.where(F.col("docs") >= border)
    near = rows.join(F.broadcast(common), "pair", "left")
    sums = [F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("docs") * F.col("times")).alias("count_sum")]
    if border <= 2:
        parts = near
    else:
        rare = rows.join(F.broadcast(common.select("pair")), "pair", "left_anti").join(best.where(F.col("docs") < border), "pair", "left")
        parts = near.where("docs is not null").unionByName(rare)
    single = F.broadcast(highest.where("highest = 1").select(F.col("a").alias("_a"), F.lit(True).alias("_only")))
    parts = parts.join(single, F.when(F.col("docs").isNull(), F.shiftright("pair", SHIFT)) == F.col("_a"), "left")
    parts = parts.withColumn("best", F.coalesce("best", "_only", F.lit(False))).withColumn("docs", F.coalesce("docs", F.lit(1)))
    found = parts.groupBy("_row").agg(*sums)
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return table.drop("a", "b", "times").join(found, "_row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *numbers, "groups_sha256")


def least_broadcast(counts: DataFrame, limit: int) -> int:
    """The least number of documents, 2 at least, from which on there are at most ``limit`` pairs. Only how often each number
    occurs reaches the driver, for numbers up to a few thousand; beyond them there can't be more pairs than that leaves."""
    high = 4096
    n = dict(counts.where("docs > 1").groupBy(F.least("docs", F.lit(high)).alias("docs")).agg(F.count("*").alias("n")).collect())
    total, border = n.get(high, 0), high
    if total > limit:
        return int(counts.orderBy(F.desc("docs")).limit(limit + 1).agg(F.min("docs")).first()[0]) + 1
    while border > 2 and total + n.get(border - 1, 0) <= limit:
        border -= 1
        total += n.get(border, 0)
    return border
