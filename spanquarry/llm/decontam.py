r"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations throughout.

1. ``item_windows``: the benchmark's items with their windows (13 consecutive words, or the whole of a shorter item).
2. ``frequencies``: how often the corpus has each of the benchmark's words (a full pass, combined before the shuffle).
   They choose the RAREST terms of each window.
3. ``index``: posting lists (term, document, position) of the chosen terms over all documents, stored once.
4. ``candidates``: posting lists moved back by the term's place in the item are intersected: where the lists of two
   terms (of one, if a window has but one) share an alignment, the item may occur. ``proximity`` asks only that terms
   stand within a distance of a shared alignment.
5. ``occurrences``: exact phrases; the document's words at a candidate's alignment are compared window by window. Only
   documents with candidates are looked at again, and an item's alignments are dealt by STRETCH words of the document, so
   no row holds more than one item's windows and so many alignments.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the ASCII-lower-cased text. A document is known by doc_id and a hash
of its text, so repeated rows and null ids are safe: equal rows have equal results, and each row gets its own.

Defined results: a null or wordless text has 0 words and no hit; a null or wordless item has no window; repeated items
count once; an item without an id hits words but is neither counted nor named; empty tables give rows without hits;
texts of any length are taken whole; further columns are ignored (``clean_documents`` keeps them) whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bounded, cut, stored

SPAN, RAREST = 13, 2
RAW_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a benchmark's word, or of a posting place, in a table that may be broadcast.
WORD_BYTES = 50
#: Words of a document in which alignments of one item are compared together.
STRETCH = 4096
HITS = "array<struct<start:int,size:int,item:bigint,ids:array<string>>>"


def _lowered(term: Column) -> Column:
    """A to Z in lower case; lower() does it where all is ASCII."""
    return F.when(F.octet_length(term) == F.length(term), F.lower(term)).otherwise(F.translate(term, UPPER, LOWER))


def _raw_terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(RAW_TERM), F.lit(0))


def terms(text: Column) -> Column:
    """Array of a text's words, null for null."""
    return F.transform(_raw_terms(text), _lowered)


def item_windows(items: DataFrame, span: int = SPAN) -> DataFrame:
    """item (hash of the words), ids, w (words), size (of its windows), hashes (of its windows, in order)."""
    rows = items.select("item_id", terms(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    rows = rows.groupBy("w").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    rows = rows.select(F.xxhash64("w").alias("item"), "ids", "w", F.least(F.size("w"), F.lit(span)).alias("size"))
    hashes = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda s: F.xxhash64(F.slice(F.col("w"), s, F.col("size"))))
    return rows.withColumn("hashes", hashes)


def _small(df: DataFrame, words: int) -> DataFrame:
    """df, to be broadcast if a benchmark of so many words makes it small enough."""
    return F.broadcast(df) if words * WORD_BYTES <= BROADCAST_BYTES else df


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text, F.length(text)).alias("text_hash"), text.alias("text"))


def frequencies(docs: DataFrame, vocabulary: DataFrame, rows: int) -> DataFrame:
    """term, n: how often each term of the vocabulary occurs in the corpus; terms that never occur are left out."""
    found = docs.select(F.explode(_raw_terms(F.col("text").cast("string"))).alias("term")).select(_lowered(F.col("term")).alias("term"))
    return found.join(_small(vocabulary, rows), "term").groupBy("term").agg(F.count("*").alias("n"))


def chosen(wins: DataFrame, counts: DataFrame, rarest: int = RAREST) -> DataFrame:
    """term, item, place, need: the places in items of terms that are among the rarest of some window.

    need: how many of an item's lists have to meet: 2, or 1 if one of its windows has one term only. Windows with a
    word that no document has can't occur and choose nothing.
    """
    spots = wins.select("item", F.explode(F.sequence(F.lit(0), F.size("hashes") - 1)).alias("s"), "w", "size")
    spots = spots.select("item", "s", F.explode(F.array_distinct(F.slice("w", F.col("s") + 1, F.col("size")))).alias("term")).join(counts, "term", "left")
    ranked = spots.groupBy("item", "s").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("t"))
    ranked = ranked.where(F.col("t")[0]["n"] > 0)
    need = ranked.groupBy("item").agg(F.min(F.least(F.size("t"), F.lit(2))).alias("need"))
    picked = ranked.select("item", F.explode(F.slice("t", 1, rarest)).alias("t")).select("item", "t.term").distinct()
    places = wins.select("item", F.posexplode("w").alias("place", "term")).join(picked, ["item", "term"])
    return places.join(need, "item")


def index(docs: DataFrame, vocabulary: DataFrame, rows: int) -> DataFrame:
    """The positional inverted index of a vocabulary: term, doc_id, text_hash, position (from 0)."""
    found = keyed(docs).select("doc_id", "text_hash", F.posexplode(_raw_terms(F.col("text"))).alias("position", "term"))
    return found.withColumn("term", _lowered(F.col("term"))).join(_small(vocabulary, rows), "term")


def postings(docs: DataFrame, wins: DataFrame, rarest: int = RAREST) -> DataFrame:
    """doc_id, text_hash, item, place, need, start: the chosen terms' posting lists, moved back by the terms' places."""
    n = wins.agg(F.sum(F.size("w"))).first()[0] or 0
    counts = cut(frequencies(docs, wins.select(F.explode("w").alias("term")).distinct(), n))
    lists = cut(chosen(wins, counts, rarest))
    stored_index = stored(index(docs, lists.select("term").distinct(), n), "postings")
    moved = stored_index.join(_small(lists, n), "term")
    return moved.select("doc_id", "text_hash", "item", "place", "need", (F.col("position") - F.col("place")).alias("start"))


def candidates(moved: DataFrame) -> DataFrame:
    """doc_id, text_hash, item, start: alignments that enough of the item's lists share."""
    met = moved.groupBy("doc_id", "text_hash", "item", "start").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.first("need").alias("need"))
    return met.where("need = 1 or low < high").select("doc_id", "text_hash", "item", "start")


def proximity(docs: DataFrame, items: DataFrame, distance: int = 10, least: int = 3, span: int = SPAN) -> DataFrame:
    """doc_id, text_hash, item, start, met: at least so many of an item's rarest terms near one alignment.

    Alignments are dealt into overlapping bins of twice the distance, so terms that differ by up to the distance meet.
    """
    moved = postings(docs, cut(item_windows(items, span)))
    bins = F.explode(F.array(F.floor(F.col("start") / distance), F.floor(F.col("start") / distance) - 1))
    met = moved.withColumn("bin", bins).groupBy("doc_id", "text_hash", "item", "bin").agg(F.count_distinct("place").alias("met"), F.min("start").alias("start"))
    return met.where(F.col("met") >= least).groupBy("doc_id", "text_hash", "item", "start").agg(F.max("met").alias("met"))


def occurrences(docs: DataFrame, items: DataFrame, span: int = SPAN, rarest: int = RAREST) -> DataFrame:
    """For each document doc_id, text_hash, n_words, hits: array of start, size, item, ids, one for each exact phrase."""
    wins = cut(item_windows(items, span))
    n = wins.agg(F.sum(F.size("w"))).first()[0] or 0
    met = candidates(postings(docs, wins, rarest)).groupBy("doc_id", "text_hash", "item", F.floor(F.col("start") / STRETCH).alias("stretch")).agg(F.collect_list("start").alias("starts"))
    met = cut(met.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "item", "starts"))
    same_text = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    places = met.agg(F.sum(F.size("starts") + 8)).first()[0] or 0
    few = F.broadcast(met) if 8 * places <= BROADCAST_BYTES else met
    rows = keyed(docs).join(few, same_text).select("doc_id", "text_hash", "item", "starts", terms(F.col("text")).alias("words"))
    rows = rows.join(_small(wins.select("item", "ids", "size", "hashes"), n), "item")

    def at(start: Column) -> Column:
        spots = F.sequence(F.greatest(-start, F.lit(0)), F.size("hashes") - 1)
        same = lambda s: F.xxhash64(F.slice("words", start + s + 1, F.col("size"))) == F.get("hashes", s)
        fit = F.filter(F.when(-start < F.size("hashes"), spots), same)
        return F.coalesce(F.transform(fit, lambda s: (start + s).cast("int")), F.array().cast("array<int>"))  # none if the text starts behind the item's last window

    hits = rows.select("doc_id", "text_hash", "item", "ids", "size", F.explode(F.flatten(F.transform("starts", at))).alias("start")).distinct()
    found = hits.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "size", "item", "ids")).cast(HITS).alias("hits"))
    found = cut(found.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_hash", "_hash"))
    held = found.agg(F.sum(1 + F.size("hits"))).first()[0] or 0
    n_words = F.coalesce(F.regexp_count("text", F.lit(RAW_TERM)), F.lit(0)).cast("long")
    counted = keyed(docs).select("doc_id", "text_hash", n_words.alias("n_words"))
    counted = counted.join(F.broadcast(found) if 100 * held <= BROADCAST_BYTES else found, same_text, "left")
    return counted.select("doc_id", "text_hash", "n_words", F.coalesce("hits", F.array().cast(HITS)).alias("hits"))


def contaminated(docs: DataFrame, items: DataFrame, span: int = SPAN, share: int = 20) -> DataFrame:
    """For each document doc_id, text_hash, n_words, n_hit, items, n_items, items_sha256, contaminated, hits.

    n_hit: words inside any occurrence. contaminated: hit at all, and at least 1 of ``share`` words is hit.
    """
    rows = occurrences(docs, items, span)
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    ordered = F.array_sort(F.array_distinct(F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["size"].alias("size")))))

    def cover(acc: Column, h: Column) -> Column:
        end = h["start"] + h["size"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(end - F.greatest(acc["end"], h["start"]), F.lit(0))).cast("long").alias("n"))

    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["ids"]))))
    rows = rows.withColumn("n_hit", F.aggregate(ordered, zero, cover, lambda acc: acc["n"])).withColumn("items", ids)
    return rows.select(
        "doc_id", "text_hash", "n_words", "n_hit", "items", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "hits",
    )


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents' rows that are not contaminated."""
    gone = cut(contaminated(docs, items).where("contaminated").select("doc_id", "text_hash").distinct())
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text, F.length(text)).alias("hash"))
    return rows.join(bounded(gone, 24), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left_anti").select("doc.*")


ORACLE = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM iw WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM ig),
dg AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, ns WHERE len(w) >= n)),
m AS (SELECT r, dg.n, s, item_id FROM dg JOIN ig ON dg.g = ig.g AND dg.n = ig.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM m) GROUP BY r),
i AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM m WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(array_to_string(coalesce(ids, []), ',')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""
