r"""Personal data: base patterns, and bootstrapped contextual extraction, in DataFrame operations throughout.

Base spans of each kind are leftmost, non-overlapping regular-expression matches; those that fail their check are
dropped. The quantifiers are possessive, so Java's matcher neither recurses nor backtracks on long texts.

Bootstrapping. Units are runs of tokens with a digit or an at sign, their outer punctuation stripped, with the words
around them, and each single token of a longer run. A unit that meets a base span is a seed of its kind; any other that
could be an identifier (SHAPE) is an unknown instance. Patterns are the contexts, digits in them put as 0: the two words
before, the word before with the word after, and the word before if it ends in a cue such as a colon. The
pattern-instance graph is scored in rounds: a pattern's confidence for a kind is the score-weighted share of the
distinct instances that it extracts, if at least SUPPORT of them are seeds or were accepted in the round before; an
instance's score is the noisy-or of its confident patterns. So what a round accepts supports further patterns in the
next one. Instances of a score of ACCEPT or more are identifiers wherever they stand in such a context; they become
spans of that kind unless they overlap a base span.

The seeds come from the whole corpus; patterns and instances are grouped with partial sums before each shuffle. Nothing
is cut to a length, and positions come from running sums by blocks (``running``), whose cost hardly grows faster than
the number of matches in a text.

Defined results: a null text is empty; rows keep an inner number from the first pass, so null ids and repeated rows are
safe; positions are code points, end exclusive; where an instance is accepted for several kinds the higher score
decides, then the order of kinds; a run goes before its tokens; an empty table gives an empty result; further columns
are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, let, stored

#: Kinds in their order, with patterns for Java's matcher. \G lets a match begin right after the one before it.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))
#: A cheap look whether a kind can occur at all.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
UNIT = TOKEN + r"(?:\x20[^\s0-9@]*+[0-9@]\S*+)*+"
#: What could be an identifier: an at sign, or at least so many digits.
SHAPE = r"@|[0-9](?:[^0-9]*[0-9]){5}"
SUPPORT, CONFIDENT, ACCEPT, ROUNDS = 3, 0.5, 0.8, 3
#: Values that a running sum folds at once.
BLOCK = 64
CUE = r"[:=#]$|[\"'(\[<]$"


def running(values: Column) -> Column:
    """Running sums of an array of numbers: folded by blocks, as a fold that appends copies its result each time."""

    def sums(x: Column) -> Column:
        return F.aggregate(x, F.array().cast("array<int>"), lambda acc, v: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + v)))

    def by_block(blocks: Column) -> Column:
        ends = sums(F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda acc, v: acc + v)))
        within = F.transform(blocks, sums)
        return let(ends, lambda e: F.flatten(F.transform(within, lambda x, k: F.transform(x, lambda v: v + F.coalesce(F.get(e, k - 1), F.lit(0))))))

    dealt = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda k: F.slice(values, k * BLOCK + 1, F.lit(BLOCK)))
    return F.when(F.size(values) == 0, F.array().cast("array<int>")).when(F.size(values) <= BLOCK, sums(values)).otherwise(let(dealt, by_block))


def _ends(found: Column, gaps: Column) -> Column:
    """Where each match ends, from the pieces of text between the matches."""
    return running(F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m)))


def _placed(text: Column, kind: str) -> Column:
    """Spans of all valid matches of a kind."""
    pattern, rank = PATTERNS[kind], KINDS.index(kind)

    def spans(found: Column) -> Column:
        def valid(ends: Column) -> Column:
            every = F.transform(found, lambda m, i: F.struct(_valid(kind, m).alias("ok"), F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.lit(rank).alias("kind"), F.get(ends, i).alias("end")).alias("span")))
            return F.transform(F.filter(every, lambda s: s["ok"]), lambda s: s["span"])

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda gaps: let(_ends(found, gaps), valid)))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    """Whether the digits' Luhn sum is a multiple of ten."""

    def total(d: Column) -> Column:
        values = F.transform(F.split(F.reverse(d), "(?<=.)(?=.)"), lambda c, i: let(c.cast("int") * (1 + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v)))
        return F.aggregate(values, F.lit(0), lambda acc, v: acc + v) % 10 == 0

    return let(_digits(text), total)


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", "")).between(1, 3) & (F.substring(F.regexp_replace(p, "^0+(?=.)", ""), 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(text)).between(14, 19) & _luhn(text)
    if kind == "phone":
        return F.length(_digits(text)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (start, rank of the kind, end), sorted."""
    parts = []
    for kind in KINDS:
        hint = F.contains(text, F.lit(HINTS[kind])) if HINTS[kind] else text.rlike("[0-9](?:[\\x20-]?[0-9]){13}")
        parts.append(F.coalesce(F.when(hint, _placed(text, kind)), F.array().cast(SPANS)))
    return F.array_sort(F.concat(*parts))


SPANS = "array<struct<start:int,kind:int,end:int>>"


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _usable(text: Column) -> Column:
    return (F.length(text) >= 3) & text.rlike(SHAPE)


def _context(text: Column) -> Column:
    """Lower-case, blanks as spaces, digits as 0."""
    return F.translate(F.lower(text), "\n\t\r123456789", "   000000000")


def _core(text: Column) -> tuple[Column, Column]:
    """Length of the opening punctuation, and the text without outer punctuation."""
    head = F.length(F.regexp_extract(text, r"^[\"'(\[<{:;,=]*+", 0))
    return head, F.regexp_replace(F.substring(text, head + 1, F.length(text)), r"[\"')\]>}.,;:!?]++$", "")


def scanned(docs: DataFrame) -> DataFrame:
    """row, doc_id, base (spans), units (run, single, start, text, left2, left, right): one pass over the texts, stored."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("row", "doc_id", "text", base_spans(F.col("text")).alias("base"))

    def unit(run: Column, single: bool, start: Column, text: Column, left2: Column, left: Column, right: Column) -> Column:
        head, core = _core(text)
        return F.struct(run.alias("run"), F.lit(single).alias("single"), (start + head).alias("start"), core.alias("text"), left2.alias("left2"), left.alias("left"), right.alias("right"))

    def runs(found: Column) -> Column:
        def placed(gaps: Column) -> Column:
            def around(ends: Column) -> Column:
                def one(m: Column, i: Column) -> Column:
                    before, after = F.rtrim(_context(F.get(gaps, i))), F.ltrim(_context(F.get(gaps, i + 1)))
                    return F.struct(i.alias("run"), (F.get(ends, i) - F.length(m)).alias("start"), m.alias("text"), F.substring_index(before, " ", -2).alias("left2"), F.substring_index(before, " ", -1).alias("left"), F.substring_index(after, " ", 1).alias("right"))

                return F.transform(found, one)

            return let(_ends(found, gaps), around)

        return let(F.split(F.col("text"), UNIT, -1), placed)

    def whole_and_single(all_runs: Column) -> Column:
        whole = F.transform(all_runs, lambda r: unit(r["run"], False, r["start"], r["text"], r["left2"], r["left"], r["right"]))

        def singles(r: Column) -> Column:
            def each(tokens: Column) -> Column:
                ends = running(F.transform(tokens, lambda t: F.length(t) + 1))  # one blank between two tokens of a run

                def one(t: Column, k: Column) -> Column:
                    word = lambda j, other: F.coalesce(F.when(j >= 0, _context(F.get(tokens, j))), other)
                    before, left = word(k - 2, F.when(k == 1, r["left"])), word(k - 1, r["left"])
                    left2 = F.when(k == 0, r["left2"]).otherwise(F.concat_ws(" ", F.when(before != "", before), left))
                    return F.struct(t.alias("text"), k.alias("k"), left2.alias("left2"), left.alias("left"), word(k + 1, r["right"]).alias("right"))

                return let(ends, lambda e: F.transform(F.transform(tokens, one), lambda x: unit(r["run"], True, r["start"] + F.get(e, x["k"]) - F.length(x["text"]) - 1, x["text"], x["left2"], x["left"], x["right"])))

            return let(F.split(r["text"], " "), each)

        return F.concat(whole, F.flatten(F.transform(F.filter(all_runs, lambda r: F.contains(r["text"], F.lit(" "))), singles)))

    units = F.when(F.col("text").rlike("[0-9@]"), let(F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)), lambda found: F.when(F.size(found) > 0, let(runs(found), whole_and_single))))
    return rows.select("row", "doc_id", "base", F.filter(units, lambda u: _usable(u["text"])).alias("units"))


def occurrences(rows: DataFrame) -> DataFrame:
    """row, run, single, start, end, instance, kind (of the seed, null if unknown), patterns: the units one by one."""
    units = rows.select("row", "base", F.explode("units").alias("u")).select("row", "base", "u.*", (F.col("u.start") + F.length("u.text")).alias("end"))
    met = F.filter("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))
    patterns = F.array(
        F.when(F.contains(F.ltrim(F.col("left2")), F.lit(" ")), F.concat(F.lit("2|"), F.col("left2"))),
        F.when((F.col("left") != "") & (F.col("right") != ""), F.concat(F.lit("b|"), F.col("left"), F.lit("|"), F.col("right"))),
        F.when(F.col("left").rlike(CUE), F.concat(F.lit("1|"), F.col("left"))),
    )
    return units.select("row", "run", "single", "start", "end", F.lower("text").alias("instance"), F.get(met, F.lit(0))["kind"].alias("kind"), F.array_compact(patterns).alias("patterns"))


def bootstrap(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT, accept: float = ACCEPT) -> DataFrame:
    """instance, kind, pattern of accepted unknown instances in confident patterns, by rounds over the graph's edges."""
    edges = found.select("instance", "kind", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.min("kind").alias("seed"))
    sides = edges.groupBy("pattern").agg(F.count("seed").alias("seeds"), F.count("*").alias("all"))
    # only a pattern with enough instances, some of them unknown, can ever find anything
    live = cut(edges.join(sides.where((F.col("all") >= support) & (F.col("seeds") < F.col("all"))).select("pattern"), "pattern"))
    scores = live.where("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    totals = live.groupBy("pattern").agg(F.count("*").alias("all"))
    chosen = None
    for _ in range(rounds):
        held = live.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count_if(F.col("score") >= accept).alias("held")).where(F.col("held") >= support)
        patterns = held.join(totals, "pattern").select("pattern", "kind", (F.col("sum") / (F.col("all") + 1)).alias("confidence")).where(F.col("confidence") >= confident)
        patterns = cut(patterns)
        new = live.where("seed is null").join(bounded(patterns, 200), "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("score"))
        seeds = live.where("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
        scores = cut(seeds.unionByName(new))
        chosen = (patterns, new)
    patterns, new = chosen
    best = new.where(F.col("score") >= accept).groupBy("instance").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    return live.where("seed is null").join(best, "instance").join(bounded(patterns.select("pattern", "kind"), 200), ["pattern", "kind"]).select("instance", "kind", "pattern")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base, spans (arrays of start, kind, end), n_added."""
    rows = stored(scanned(docs), "pii")
    found = occurrences(rows)
    accepted = cut(bootstrap(found))
    marked = found.where("kind is null").select("row", "run", "single", "start", "end", "instance", F.explode("patterns").alias("pattern")).join(accepted, ["instance", "pattern"])
    runs = marked.groupBy("row", "run").agg(F.collect_set(F.when(~F.col("single"), F.struct("start", "kind", "end"))).alias("whole"), F.collect_set(F.when(F.col("single"), F.struct("start", "kind", "end"))).alias("parts"))
    chosen = F.when(F.size("whole") > 0, F.col("whole")).otherwise(F.col("parts"))
    added = runs.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list(chosen))).alias("added"))
    rows = rows.select("row", "doc_id", "base").join(cut(added), "row", "left")
    rows = rows.withColumn("added", F.coalesce("added", F.array().cast(SPANS)))
    rows = rows.withColumn("spans", F.array_sort(F.concat("base", "added")))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return rows.select("doc_id", *counts, "base", "spans", F.size("added").cast("long").alias("n_added"))


def _is(rank: int):
    return lambda s: s["kind"] == rank


def digest(found: DataFrame) -> DataFrame:
    base = F.sha2(spans_text(F.col("base")).cast("binary"), 256)
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], base.alias("base_sha256"), spans_text(F.col("spans")).alias("spans"), "n_added")
