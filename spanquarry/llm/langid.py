"""Language identification with interpolated Kneser-Ney character models, one per language.

``train`` counts the words of all training rows in Spark (each task counts its own words first), turns them into
character n-gram counts of a padded word (``^word$``), and finds the Kneser-Ney counts, shares and interpolated costs of
all grams there by grouping and equi-joins; no gram is left out, so the model grows with the training rows. The grams of
all languages lie in one sorted array of 64-bit hashes; beside it lie, for each language, the discounted log probability
parts. These arrays are files that Spark hands to each executor, whose workers map them into memory together.
``scored`` looks words up in them (a cache keeps the words seen), sums the bits of a whole text and takes the language
with the lowest cross-entropy per character. A text is rejected if its cross-entropy lies beyond what training texts of
that language show (``REJECT`` standard deviations over their mean, the spread widening for short texts); all training
rows are measured for that.

The files are written on the driver piece by piece; its memory holds a piece at a time. Words are letters (Unicode
category L) and the marks that follow them; digits and numeric signs such as halves are none; case is folded.

Defined results: a null text or one without letters is ``und`` with score 0 and is rejected; rows with a null language
teach nothing; ties between languages go to the first by name; without any training rows everything is ``und``.
"""

from __future__ import annotations

import dataclasses
import functools
import itertools
import os
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import crc32_mod, cut, mapped, sliced, stored

ORDER = 4
#: Standard deviations above the training mean at which a text is rejected, and the least spread in bits a character: a
#: model knows its training texts' odd words, so their spread is less than that of other texts.
REJECT, SPREAD = 6.0, 0.35
#: A cross-entropy difference of 1/SHARP bits a character doubles the odds in the score.
SHARP = 8.0
#: Odd multipliers of the gram hash.
MIX = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: Texts scored at once.
SLICE = 200
#: Words: letters, and the marks that follow them; of ASCII texts the plain form is faster.
ASCII_WORDS, WORDS = re.compile(r"[A-Za-z]+"), regex.compile(r"\p{L}[\p{L}\p{M}]*")
HELD_OUT = (4, 2)


def letter_words(text: str) -> list[str]:
    """The lower-case words of a text."""
    return ASCII_WORDS.findall(text.lower()) if text.isascii() else WORDS.findall(text.lower())


def _trains(n: int = HELD_OUT[0], held: int = HELD_OUT[1]) -> Column:
    return F.col("lang").isNotNull() & (crc32_mod(F.col("doc_id"), n) != held)


def training_rows(docs: DataFrame, n: int = HELD_OUT[0], held: int = HELD_OUT[1]) -> DataFrame:
    return docs.where(F.col("text").isNotNull() & _trains(n, held)).select("text", "lang")


def _codes(words: list[str]) -> np.ndarray:
    """Code points of the padded words, one after the other."""
    return np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _rolling(codes: np.ndarray) -> list[np.ndarray]:
    """By order, the hash of the code points that end at each position (before place order - 1 it has no meaning)."""
    sums, out = codes.copy(), []
    for k in range(1, ORDER + 1):
        if k > 1:
            sums[k - 1 :] += codes[: 1 - k] * MIX[k - 1]
        out.append(sums * MIX[4] + np.uint64(k))
    return out


def gram_hash(grams: list[str]) -> np.ndarray:
    """The same hash for grams of one length."""
    if not grams:
        return np.zeros(0, np.uint64)
    k = len(grams[0])
    return _rolling(np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64))[k - 1][k - 1 :: k]


def _places(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the padded words its place in its word, and the word's number."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    return np.arange(sizes.sum()) - starts[owner], owner


def _gram_counts(words: Counter, into: Counter) -> None:
    """Add the grams that end at each character of the padded words: of ORDER characters, or back to the word's start."""
    names, times = list(words), np.fromiter(words.values(), np.int64, len(words))
    for a in range(0, len(names), 20_000):
        part = names[a : a + 20_000]
        codes = _codes(part)
        place, owner = _places(part)
        hashes = _rolling(codes)
        for k in range(2, ORDER + 1):
            at = np.flatnonzero(place == k - 1 if k < ORDER else place >= k - 1)
            if not len(at):
                continue
            _, first, group = np.unique(hashes[k - 1][at], return_index=True, return_inverse=True)
            sums = np.bincount(group, times[a : a + 20_000][owner[at]])
            for i, n in zip(at[first].tolist(), sums.tolist(), strict=True):
                into["".join(map(chr, codes[i + 1 - k : i + 1].tolist()))] += int(n)


def _word_counts(batches: Iterator[pa.RecordBatch], most: int = 60_000) -> Iterator[pa.RecordBatch]:
    """lang, gram, n of the padded words, summed over what a task has read since it last sent."""
    words: dict[str, Counter] = {}
    grams: dict[str, Counter] = {}

    def folded() -> None:
        for lang, counts in words.items():
            _gram_counts(counts, grams.setdefault(lang, Counter()))
        words.clear()

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, counts in grams.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "gram", "n"])
        grams.clear()

    for batch in sliced(batches):
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(letter_words(text))
        if sum(map(len, words.values())) > most:
            folded()
        if sum(map(len, grams.values())) > 4 * most:
            yield from sent()
    folded()
    yield from sent()


@functools.lru_cache(maxsize=2)
def _opened(name: str, langs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, cost, back = (np.asarray(np.memmap(SparkFiles.get(f"{name}.{part}"), kind, "r")) for part, kind in (("keys", np.int64), ("cost", np.float32), ("back", np.float32)))
    return keys, cost.reshape(-1, langs), back.reshape(-1, langs)


@dataclasses.dataclass
class Model:
    """Files of the sorted hashes (as signed numbers) of the grams of all orders; for each and each language ``cost``,
    the bits of its last character after the others (interpolated down to single characters), and ``back``, the bits
    that it costs as a context to fall back from it."""

    langs: list[str]
    name: str
    floor: float  # bits of a character that no training text has
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None

    @property
    def keys(self) -> np.ndarray:
        return _opened(self.name, len(self.langs))[0]

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, asked = self.keys, asked.view(np.int64)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return at, keys[at] == asked

    def bits(self, words: list[str]) -> np.ndarray:
        """[words, langs]: bits of each padded word, its end included."""
        _, cost, back = _opened(self.name, len(self.langs))
        codes = _codes(words)
        place, _ = _places(words)
        hashes = np.stack(_rolling(codes))
        out = np.zeros((len(codes), len(self.langs)), np.float32)
        at = np.flatnonzero(place)
        k = np.minimum(place[at], ORDER - 1)  # order - 1
        while len(at):
            found, hit = self.find(hashes[k, at])
            out[at[hit]] += cost[found[hit]]
            at, k = at[~hit], k[~hit]
            out[at[k == 0]] += self.floor
            at, k = at[k > 0], k[k > 0]
            left, known = self.find(hashes[k - 1, at - 1])
            out[at[known]] += back[left[known]]
            k = k - 1
        return np.add.reduceat(out, np.flatnonzero(place == 0), axis=0)


def train(rows: DataFrame, discount: float = 0.75) -> Model | None:
    """rows: text, lang. The model, or None if there is nothing to learn from.

    Grams that start a word count as they are; any other gram lends its tail one continuation for each distinct left
    neighbour, which is what Kneser-Ney counts for the lower orders.
    """
    counted = mapped(rows.select("text", "lang"), _word_counts, "lang string, gram string, n long")
    full = cut(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    langs = sorted(r.lang for r in full.select("lang").distinct().collect())
    if not langs:
        return None

    def by_language(values: DataFrame, key: str, value: str, missing: float) -> DataFrame:
        """key, value: an array of the value in each language."""
        known = values.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("lang", value))).alias("known"))
        return known.select(key, F.transform(F.array(*map(F.lit, langs)), lambda x: F.coalesce(F.try_element_at("known", x), F.lit(missing))).alias(value))

    level, shares, backs = full.where(F.length("gram") == ORDER), {}, []
    for k in range(ORDER, 0, -1):
        level = cut(level)
        found = level.withColumn("context", F.substring("gram", 1, k - 1))
        sides = found.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        share = F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total")
        shares[k] = by_language(found.join(sides, ["lang", "context"]).withColumn("share", share), "gram", "share", 0.0)
        if k > 1:
            backs.append(by_language(sides.withColumn("back", discount * F.col("kinds") / F.col("total")), "context", "back", 1.0))
            tails = level.groupBy("lang", F.substring("gram", 2, k - 1).alias("gram")).agg(F.count("*").alias("n"))
            level = full.where(F.length("gram") == k - 1).unionByName(tails)
    floor = discount / (20 * max(level.count(), 1))
    back = cut(functools.reduce(DataFrame.unionByName, backs))
    parts = [cut(shares[1].select("gram", F.transform("share", lambda x: x + floor).alias("p")))]
    for k in range(2, ORDER + 1):
        shorter = parts[-1].select(F.col("gram").alias("tail"), F.col("p").alias("shorter"))
        held = shares[k].select("*", F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("tail")).join(back, "context").join(shorter, "tail")
        parts.append(cut(held.select("gram", F.transform("share", lambda x, i: x + F.get("back", i) * F.get("shorter", i)).alias("p"))))
    # contexts that are no gram themselves, such as a word's start, have the floor
    every = functools.reduce(DataFrame.unionByName, parts).join(back.withColumnRenamed("context", "gram"), "gram", "full")
    flat = lambda x: F.array_repeat(F.lit(x), len(langs))
    return _filed(every.select("gram", F.coalesce("p", flat(floor)).alias("p"), F.coalesce("back", flat(1.0)).alias("back")), langs, float(-np.log2(floor)))


def _filed(grams: DataFrame, langs: list[str], floor: float) -> Model:
    """The model of gram, p, back: sorted by hash in Spark, then written to the files piece by piece."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            keys = np.zeros(len(names), np.uint64)
            for k in range(1, ORDER + 1):
                at = [i for i, g in enumerate(names) if len(g) == k]
                keys[at] = gram_hash([names[i] for i in at])
            rows = [pa.array([x.tobytes() for x in -np.log2(c.flatten().to_numpy().reshape(-1, len(langs))).astype(np.float32)], pa.binary()) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *rows], ["key", "cost", "back"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                blobs = [batch.column(0).to_numpy().tobytes(), *(b"".join(c.to_pylist()) for c in batch.columns[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in blobs], ["keys", "cost", "back"])

    rows = cut(grams.mapInArrow(hashed, "key long, cost binary, back binary").orderBy("key"))
    name = f"langid-{uuid.uuid4().hex}"
    base = os.path.join(tempfile.mkdtemp(prefix="spark-langid-"), name)
    with open(f"{base}.keys", "wb") as keys, open(f"{base}.cost", "wb") as cost, open(f"{base}.back", "wb") as back:
        for row in rows.mapInArrow(packed, "keys binary, cost binary, back binary").toLocalIterator():
            keys.write(row["keys"])
            cost.write(row["cost"])
            back.write(row["back"])
    for part in ("keys", "cost", "back"):
        grams.sparkSession.sparkContext.addFile(f"{base}.{part}")
    return Model(langs, name, floor)


class Scorer:
    """Bits of whole texts, many at once; words seen lately are kept, their bits in one table."""

    def __init__(self, model: Model, most: int = 150_000):
        self.model, self.most, self.seen = model, most, {}
        self.table = np.empty((most, len(model.langs)), np.float32)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """[texts, langs]: bits by language; and the characters scored (word ends included)."""
        counts = [Counter(letter_words(t)) if t else Counter() for t in texts]
        names = list(itertools.chain.from_iterable(counts))
        new = list(set(names) - self.seen.keys())
        if len(self.seen) + len(new) > self.most:
            self.seen.clear()
            new = list(set(names))
            if len(new) > len(self.table):  # enormous texts
                self.table = np.empty((len(new), len(self.model.langs)), np.float32)
        for a in range(0, len(new), 20_000):
            part, first = new[a : a + 20_000], len(self.seen)
            self.table[first : first + len(part)] = self.model.bits(part)
            self.seen.update(zip(part, range(first, first + len(part)), strict=True))
        at = np.fromiter(map(self.seen.__getitem__, names), np.int64, len(names))
        times = np.fromiter(itertools.chain.from_iterable(c.values() for c in counts), np.float64, len(names))
        sizes = np.fromiter(map(len, names), np.float64, len(names)) + 1
        bits, chars = np.zeros((len(texts), len(self.model.langs))), np.zeros(len(texts))
        each = np.fromiter(map(len, counts), np.int64, len(counts))
        some = np.flatnonzero(each)
        if len(some):
            starts = (np.cumsum(each) - each)[some]
            bits[some] = np.add.reduceat(self.table[at] * times[:, None], starts, axis=0)
            chars[some] = np.add.reduceat(sizes * times, starts)
        return bits, chars


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, lang_score (0 to 1), _rate (bits a character under the language predicted), _own (under the
    row's own ``lang``, null if the model has none such) and _chars added."""
    names = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_rejected", "_rate", "_own", "_chars")]
    docs = docs.select(*names)
    text, own = names.index("text"), names.index("lang") if "lang" in names else None
    at = {x: j for j, x in enumerate(model.langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model)
        for batch in sliced(batches, SLICE):
            out, langs = [], batch.column(own).to_pylist() if own is not None else [None] * batch.num_rows
            for bits, n, lang in zip(*score(batch.column(text).to_pylist()), langs, strict=True):
                if not n:
                    out.append(("und", 0.0, None, None, 0))
                    continue
                rate = bits / n
                best = int(np.argmin(rate))
                odds = np.exp2(-SHARP * (rate - rate[best]))
                out.append((model.langs[best], float(1 / odds.sum()), float(rate[best]), float(rate[at[lang]]) if lang in at else None, int(n)))
            added = [pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*names, *ADDED])

    schema = StructType(list(docs.schema.fields))
    for name, kind in ADDED.items():
        schema = schema.add(name, kind)
    return mapped(docs, run, schema)


ADDED = {"lang_pred": "string", "lang_score": "double", "_rate": "double", "_own": "double", "_chars": "long"}


def calibrate(model: Model, found: DataFrame) -> Model:
    """Mean and spread of the cross-entropy of all training texts (lang, _own, _chars) under their own language."""
    seen = found.where("_own is not null and _chars >= 40").groupBy("lang").agg(F.avg("_own").alias("mean"), F.stddev_pop("_own").alias("spread"))
    stats = {r.lang: (r["mean"], r["spread"]) for r in seen.collect()}
    of = np.array([stats.get(x, (8.0, 2.0)) for x in model.langs])
    return dataclasses.replace(model, mean=of[:, 0], spread=np.maximum(of[:, 1], SPREAD))


def judged(found: DataFrame, model: Model) -> DataFrame:
    """Scored rows with lang_rejected instead of the inner columns."""
    names = [c for c in found.columns if c not in ADDED]
    limit = F.lit(float("inf"))
    if model.mean is not None:
        at = F.array_position(F.array(*map(F.lit, model.langs)), F.col("lang_pred")).cast("int") - 1
        mean, spread = (F.get(F.array(*[F.lit(float(x)) for x in v]), at) for v in (model.mean, model.spread))
        limit = mean + REJECT * spread * (1 + 6 / F.sqrt("_chars"))
    return found.select(*names, "lang_pred", "lang_score", F.coalesce(F.col("_rate") > limit, F.lit(True)).alias("lang_rejected"))


def _unknown(docs: DataFrame) -> DataFrame:
    names = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_rejected")]
    return docs.select(*names, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("lang_score"), F.lit(True).alias("lang_rejected"))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred, lang_score (0 to 1), lang_rejected added; rows keep their order and columns."""
    return _unknown(docs) if model is None else judged(scored(docs, model), model)


def fitted(docs: DataFrame) -> Model | None:
    rows = training_rows(docs)
    model = train(rows)
    return None if model is None else calibrate(model, scored(rows, model).select("lang", "_own", "_chars"))


def identified(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang and others) without their text, with lang_pred, lang_score and lang_rejected by models
    that are fitted on the same table: as ``identify`` with ``fitted``, but texts are scored once for both."""
    model = train(training_rows(docs))
    if model is None:
        return _unknown(docs).drop("text")
    found = stored(scored(docs, model).drop("text"), "languages")
    return judged(found, calibrate(model, found.where(_trains())))


def held_out(doc_id: Column) -> Column:
    return crc32_mod(doc_id, HELD_OUT[0]) == HELD_OUT[1]
