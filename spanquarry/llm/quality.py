"""Quality rules by distribution divergence, in DataFrame operations throughout.

A document's histogram of character classes and its histogram of common words are compared with those of reference
languages by the Jensen-Shannon distance (the square root of the divergence to base 2, so 0 to 1). The references are
sums over all documents of the corpus that pass the base rules; which language a document lends its sums to, and is
compared with, is the language whose common words it uses most, so no label is read. All other words are one bin of the
word histogram, so a text without common words is far from every language.

Guards: below MIN_CHARS there is no character verdict, below MIN_WORDS no word verdict. A text of which the language's
common words are a share of DECIDED at most may be prose of another language, so its common words say nothing: its
histogram has two bins only, symbols and other words, which all languages have in much the same shares. A text of which most letters are of another script than the references'
gets no verdict but that of the base rules.

The base counts (word characters, symbols, repeated lines, words in repeated windows) come from arrays in the row; no
word leaves its row.

Defined results: a null text has no words and fails the base rules; a language no document lends to is no reference;
without any reference all documents that pass the base rules are kept; ties between languages go to the first by name;
texts are taken whole whatever their length; each row, repeated or not, has its own result; further columns are ignored.
"""

from __future__ import annotations

import functools
import json

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORD, let, stored

#: The commonest words of the reference languages.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus".split(),
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au plus ne se ce il sont avec".split(),
}
#: Character classes, as Java patterns; lower-case letters and blanks are taken out first, the rest is the last class.
LOWER, BLANK = r"[\p{Ll}\p{Lo}]+", BLANKS
CLASSES = {"upper": r"[\p{Lu}\p{Lt}]", "digit": r"\p{Nd}", "stop": r"[.,;:!?'\"()-]"}
#: Common words count as they stand, capitalised, or before one of these; least size of the table of their hashes.
ENDINGS, BINS = ("", ".", ","), 20_000
MIN_CHARS, MIN_WORDS = 200, 50
#: Largest distance from the language's reference that a kept document may have.
MOST_CHARS, MOST_WORDS = 0.32, 0.36
#: Share of a language's common words beyond which a text is taken for its prose.
DECIDED = 0.20
#: Letters of other scripts than that of the references.
FOREIGN = r"[\p{L}&&[^\p{IsLatin}]]"
SYMBOLS = "[#*$%&|<>]"
MIN_KEPT_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def _joined(hashes: Column, size: int, window: int, body) -> Column:
    """body(hashes of all windows), from those of windows of a size by doubling; window is a power of two."""
    if size == window:
        return body(hashes)
    first = F.slice(hashes, F.lit(1), F.size(hashes) - size)
    pairs = F.zip_with(first, F.slice(hashes, F.lit(size + 1), F.size(hashes)), lambda a, b: F.xxhash64(a, b))
    return let(pairs, lambda h: _joined(h, 2 * size, window, body))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of so many words that the text has at least twice."""

    def spread(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            n = F.size(s)
            twice = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.when((F.get(s, j - 1)["h"] == F.get(s, j)["h"]) | (F.get(s, j + 1)["h"] == F.get(s, j)["h"]), F.get(s, j)["i"]))
            starts = F.array_sort(F.filter(twice, lambda i: i.isNotNull()))
            zero = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
            step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(i - acc["last"], F.lit(window))).alias("n"))
            return F.aggregate(starts, zero, step, lambda acc: acc["n"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(placed, covered))

    def hashed(codes: Column) -> Column:
        return _joined(codes, 1, window, spread)

    return F.when(F.size(words) < window, 0).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), hashed))


def _runs(codes: Column) -> Column:
    """Counts of equal values in a sorted array: array of (code, n)."""

    def counted(s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == F.size(s) - 1) | (F.get(s, j) != F.get(s, j + 1)))
        return let(ends, lambda e: F.transform(e, lambda j, k: F.struct(F.get(s, j).alias("code"), (j - F.coalesce(F.get(e, k - 1), F.lit(-1))).cast("long").alias("n"))))

    return F.when(F.size(codes) == 0, F.array().cast("array<struct<code:int,n:bigint>>")).otherwise(let(F.sort_array(codes), counted))


@functools.cache
def _places() -> dict[str, int]:
    """Number of each common word."""
    return {w: i for i, w in enumerate(sorted({w for x in COMMON.values() for w in x}))}


@functools.cache
def _forms() -> dict[str, int]:
    """The forms in which common words count, with the words' numbers."""
    return {form + end: i for w, i in _places().items() for form in (w, w.capitalize()) for end in ENDINGS}


@functools.cache
def _table() -> list[int]:
    """The forms' numbers by hash, in a table of such a size that no two forms share a place (-1: no form's place)."""
    hashes = {xxhash.xxh64_intdigest(form.encode(), 42): i for form, i in _forms().items()}
    size = BINS
    while len({h % size for h in hashes}) < len(hashes):
        size += 1
    out = [-1] * size
    for h, i in hashes.items():
        out[h % size] = i
    return out


def _number(form: Column) -> Column:
    """The number of a common word's form; only for words that are one of the forms."""
    table = _table()
    h = F.xxhash64(form)  # signed: as unsigned, modulo the size
    place = F.pmod(F.pmod(h, F.lit(len(table))) + F.when(h < 0, 2**64 % len(table)).otherwise(0), F.lit(len(table)))
    return F.get(_literal(table, "array<int>"), place.cast("int"))


def _literal(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), kind)


def _votes(language: str) -> Column:
    """How many of the words are common in a language."""
    mine = [_places()[w] for w in COMMON[language]]
    return F.aggregate(F.filter("common", lambda c: c["code"].isin(mine)), F.lit(0).cast("long"), lambda acc, c: acc + c["n"])


def features(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, n_chars, classes (counts: lower, blank, CLASSES, rest), common (array of code, n),
    language, votes, foreign.

    language: number of the language (by name) whose common words the text has most of, null without any; votes: how many
    words that are; foreign: whether most of the text's letters are of another script.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))

    def per_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            let(F.transform(F.filter(w, lambda x: x.isin(list(_forms()))), _number), _runs).alias("common"),
        )

    def per_chars(t: Column) -> Column:  # without lower-case letters
        return let(F.regexp_replace(t, BLANK, ""), lambda u: F.struct(F.length(t).alias("t"), F.length(u).alias("u"), F.regexp_count(u, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), F.array(*[F.regexp_count(u, F.lit(p)).cast("long") for p in CLASSES.values()]).alias("few")))

    rows = rows.select(
        "doc_id", let(_words(F.col("text")), per_words).alias("f"), let(F.regexp_replace("text", LOWER, ""), per_chars).alias("c"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.length("text").cast("long").alias("n_chars"),
        F.when(10 * F.octet_length("text") > 13 * F.length("text"), F.regexp_count("text", F.lit(FOREIGN))).otherwise(0).cast("long").alias("foreign"),
    )
    lower, blank = F.col("n_chars") - F.col("c.t"), (F.col("c.t") - F.col("c.u")).cast("long")
    rest = F.col("c.u") - F.aggregate("c.few", F.lit(0).cast("long"), lambda acc, n: acc + n)
    rows = rows.select("doc_id", "f.*", (F.col("n_chars") - blank).alias("word_chars"), "c.n_symbols", "n_dup_lines", "n_chars", F.concat(F.array(lower, blank), "c.few", F.array(rest)).alias("classes"), (2 * F.col("foreign") > F.col("n_chars") - blank).alias("foreign"))
    rows = rows.withColumn("votes", F.array(*[_votes(x) for x in sorted(COMMON)]))
    language = F.when(F.array_max("votes") > 0, F.array_position("votes", F.array_max("votes")).cast("int") - 1)
    return rows.withColumn("language", language).withColumn("votes", F.array_max("votes"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_KEPT_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def references(rows: DataFrame) -> tuple[list[list[float]], list[list[float]], list[float]]:
    """For each language the shares of the character classes, and of the common words by code (empty without documents),
    and symbols for each word."""
    good = rows.where(~base_failed() & ~F.col("foreign") & F.col("language").isNotNull())
    sums = good.groupBy("language").agg(*[F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES) + 3)]).collect()
    totals = good.groupBy("language").agg(F.sum("n_words").alias("n"), F.sum("n_symbols").alias("symbols")).collect()
    said, marked = {r.language: r.n for r in totals}, {r.language: r.symbols for r in totals}
    words = good.select("language", F.explode("common").alias("c")).groupBy("language", "c.code").agg(F.sum("c.n").alias("n")).collect()
    chars, common = [[] for _ in COMMON], [[] for _ in COMMON]
    for r in sums:
        total = sum(r[1:])
        chars[r.language] = [x / total for x in r[1:]] if total else []
    for k in range(len(COMMON)):
        mine = {r.code: r.n for r in words if r.language == k}
        total = said.get(k, 0)
        common[k] = [*(mine.get(i, 0) / total for i in range(len(_places()))), 1 - sum(mine.values()) / total] if total else []
    return chars, common, [min(1.0, marked[k] / said[k]) if said.get(k) else 0.0 for k in range(len(COMMON))]


def _term(x: Column, other: Column) -> Column:
    return F.when(x > 0, 0.5 * x * F.log2(2 * x / (x + other))).otherwise(0.0)


def _matrix(rows: list[list[float]]) -> Column:
    return _literal([r or [0.0] for r in rows], "array<array<double>>")


def divergences(rows: DataFrame, chars: list[list[float]], common: list[list[float]], symbols: list[float]) -> DataFrame:
    """rows with js_chars and js_words (distances), null where a guard applies or there is no reference."""
    has = F.get(F.lit([bool(c) for c in common]), "language") & ~F.col("foreign")
    named = F.col("votes") > DECIDED * F.col("n_words")
    n_common = F.aggregate("common", F.lit(0).cast("long"), lambda acc, c: acc + c["n"])

    def by_class(q: Column) -> Column:
        pairs = F.zip_with("classes", q, lambda n, y: _term(n / F.col("n_chars"), y) + _term(y, n / F.col("n_chars")))
        return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)

    def by_word(x: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("js"), F.lit(0.0).alias("seen"))

        def add(acc: Column, c: Column) -> Column:
            p, q = c["n"] / F.col("n_words"), F.get(x, c["code"])
            return F.struct((acc["js"] + _term(p, q) + _term(q, p)).alias("js"), (acc["seen"] + q).alias("seen"))

        other = F.struct(F.lit(len(_places())).alias("code"), (F.col("n_words") - n_common).alias("n"))
        return F.aggregate(F.concat(F.array(other), "common"), zero, add, lambda acc: acc["js"] + 0.5 * (1 - acc["seen"]))

    distance = lambda js: F.sqrt(F.greatest(js, F.lit(0.0)))
    js_chars = F.when(has & (F.col("n_chars") >= MIN_CHARS), distance(let(F.get(_matrix(chars), "language"), by_class)))
    p, q = F.least(F.col("n_symbols") / F.col("n_words"), F.lit(1.0)), F.get(_literal(symbols, "array<double>"), "language")
    in_two = _term(p, q) + _term(q, p) + _term(1 - p, 1 - q) + _term(1 - q, 1 - p)
    js_words = F.when(has & (F.col("n_words") >= MIN_WORDS), distance(F.when(named, let(F.get(_matrix(common), "language"), by_word)).otherwise(in_two)))
    return rows.withColumn("js_chars", js_chars).withColumn("js_words", js_words)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, js_chars, js_words.

    A document without any common word is compared with the reference of the most common language of the corpus.
    """
    rows = stored(features(docs), "quality")
    chars, common, symbols = references(rows)
    main = rows.where("language is not null").groupBy("language").count().orderBy(F.desc("count"), "language").first()
    if main:
        rows = rows.withColumn("language", F.coalesce("language", F.lit(main.language)))
    rows = divergences(rows, chars, common, symbols).withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & (F.coalesce("js_chars", F.lit(0.0)) <= MOST_CHARS) & (F.coalesce("js_words", F.lit(0.0)) <= MOST_WORDS)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "js_chars", "js_words")
