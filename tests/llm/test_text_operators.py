import collections
import hashlib
import re
import sys
import unicodedata
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import WORD, empty, odd, rows, very_long  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from spanquarry.llm import decontam, html, langid, mixing, pii, quality, tokens, toxicity  # noqa: E402
from spanquarry.llm.common import shared_dir  # noqa: E402

SF = "/root/testdata/sf0.001"


# ---- personal data ----

RX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, rx) in enumerate(RX.items()):
        for m in re.finditer(rx, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) < 256 for p in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


PII = ["a@b.c.d_x@y.org", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111x 4111  1111 1111 1111", "+1 (988) 555-2485 4111111111111111", "x" * 20000 + "@", "1 " * 20000, "a@b" + ".c" * 5000, "+1" + " " * 9000, "\U0001f600 é@x.com \U0001f600 a@b.co 10.0.0.1", "a@b.c@d.e f", "1" * 23, "+12345678901 +1234567890123456", "0" * 20 + "1.2.3.4", '(a@b.com) "c@d.org".']


def test_base_spans_match_plain_regexes(spark):
    docs = rows(spark, PII).unionByName(odd(spark).withColumn("doc_id", F.col("doc_id") + 100))
    got = pii.digest(pii.find(docs)).collect()
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(hashlib.sha256(plain_spans(r.text).encode()).hexdigest())
    for r in got:
        assert r.base_sha256 in texts[r.doc_id], r
    assert len(got) == docs.count() and pii.find(empty(spark)).count() == 0


def test_contexts_find_unseen_identifiers_and_keep_base_spans(spark):
    seeds = [f"Hello. My phone number: +1 (988) 555-{1000 + i} is here." for i in range(20)]
    unseen = [f"Hi there. my phone number: 0{400000000 + 37 * i} is here." for i in range(3)]
    clean = [f"order {i}99281{i} was shipped on 1998-10-10" for i in range(20)]
    found = {r.doc_id: r for r in pii.find(rows(spark, seeds + unseen + clean)).collect()}
    assert all(found[i].n_added == (20 <= i < 23) for i in found)
    assert all(found[i].n_phone == 1 and set(found[i].base) <= set(found[i].spans) for i in range(20))
    assert seeds[0][found[0].base[0].start : found[0].base[0].end] == "+1 (988) 555-1000" and unseen[0][found[20].spans[0].start : found[20].spans[0].end] == "0400000000"


def test_accepted_identifiers_support_further_contexts(spark):
    seeds = [f"Hello. My phone number: +1 (988) 555-{1000 + i} is here." for i in range(30)]
    both = [f"Hi there. my phone number: 0{400000000 + 37 * i} is here. Please dial extension: 0{400000000 + 37 * i} after noon." for i in range(8)]
    only = "Please dial extension: 0777123456 after noon."
    found = {r.doc_id: r for r in pii.find(rows(spark, [*seeds, *both, only])).collect()}
    assert found[38].n_added == 1 and only[found[38].spans[0].start : found[38].spans[0].end] == "0777123456"
    assert all(found[i].n_added == 2 for i in range(30, 38))


def test_bootstrapping_goes_two_hops(spark):
    seeds = [f"Please call me on +1 (988) 555-{1000 + i} today." for i in range(20)]
    unseen = [f"Please call me on 0{400000000 + 37 * i} today." for i in range(5)]
    second = [f"The desk line reads 0{400000000 + 37 * i} since then." for i in range(5)]
    new = [f"The desk line reads 0{800000000 + 91 * i} since then." for i in range(2)]
    found = {r.doc_id: r for r in pii.find(rows(spark, seeds + unseen + second + new)).collect()}
    assert [found[i].n_added for i in range(32)] == [0] * 20 + [1] * 12


def test_long_and_neighbouring_identifiers(spark):
    name = lambda i: "x" * 150 + f"{i:04d}" + "y" * 60
    seeds = [f"Mail goes to the box {name(i)}@ex.org every week." for i in range(20)]
    long = f"Mail goes to the box {name(77)}-at-123456-ex every week."
    pair = "Reach the box 5550001112 5550003334 now or later."
    docs = seeds + [long] + [f"Number of the caller: +1 (988) 555-{1000 + i} noted." for i in range(20)] + ["Number of the caller: 5550001112 5550003334 noted."]
    found = {r.doc_id: r for r in pii.find(rows(spark, [*docs, pair])).collect()}
    assert found[20].n_added == 1 and found[20].spans[0].end - found[20].spans[0].start == len(name(77)) + len("-at-123456-ex")
    assert found[41].n_added == 1 and found[42].n_added == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_running_sums(spark, n):
    values = list(range(1, n + 1))
    got = spark.createDataFrame([(values,)], "v array<int>").select(pii.running(F.col("v")).alias("r")).first().r
    assert got == np.cumsum(values).tolist()


def plain_bootstrap(found, rounds=pii.ROUNDS):
    """The graph's scores by definition: pattern -> instances, instance -> accepted kind."""
    seed, members = {}, collections.defaultdict(set)
    for instance, kind, patterns in found:
        for p in patterns:
            members[p].add(instance)
            if kind is not None:
                seed[p, instance] = min(kind, seed.get((p, instance), 9))
    live = {p: m for p, m in members.items() if len(m) >= pii.SUPPORT and any((p, i) not in seed for i in m)}
    seeds = {(i, k): 1.0 for (p, i), k in seed.items() if p in live}
    scores, confidence = dict(seeds), {}
    for _ in range(rounds):
        confidence = {}
        for p, m in live.items():
            for k in range(4):
                have = [scores[i, k] for i in m if (i, k) in scores]
                if sum(x >= pii.ACCEPT for x in have) >= pii.SUPPORT and sum(have) / (len(m) + 1) >= pii.CONFIDENT:
                    confidence[p, k] = sum(have) / (len(m) + 1)
        miss = collections.defaultdict(lambda: 1.0)
        for (p, k), c in confidence.items():
            for i in live[p]:
                if (p, i) not in seed:
                    miss[i, k] *= 1 - min(c, 0.999)
        new = {x: 1 - v for x, v in miss.items()}
        scores = {**new, **seeds}
    best = {}
    for (i, k), v in sorted(new.items(), key=lambda x: (x[1], -x[0][1])):
        if v >= pii.ACCEPT:
            best[i] = k
    return {(i, best[i], p) for (p, k) in confidence for i in live[p] if (p, i) not in seed and best.get(i) == k}


def test_graph_scores_match_their_definition(spark):
    rng = np.random.default_rng(2)
    found = []
    for _ in range(900):
        i = int(rng.integers(120))
        base = i % 12
        patterns = sorted({f"p{base + int(d)}" for d in rng.integers(0, 3, 2)})
        found.append((f"i{i}", base // 6 if i % 5 and base not in (5, 6) else None, patterns))
    frame = spark.createDataFrame(found, "instance string, kind int, patterns array<string>")
    got = {(r.instance, r.kind, r.pattern) for r in pii.bootstrap(frame).collect()}
    assert got == plain_bootstrap(found) and got


# ---- quality ----


def plain_counts(text):
    w = WORD.findall(text or "")
    grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdicts(spark):
    texts = ["a b c d e f g h i a b c d e f g h", "x\nx\n\n \nx y", "# $ | <>", "a b c d e f g h " * 3, "one two " * 40]
    docs = rows(spark, texts).unionByName(odd(spark).withColumn("doc_id", F.col("doc_id") + 100))
    want = collections.Counter((r.doc_id, *plain_counts(r.text)) for r in docs.collect())
    got = quality.judge(docs).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(not (r.base_failed and r.kept) for r in got) and quality.judge(empty(spark)).count() == 0


def test_quality_divergence_tells_junk_from_prose(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: r for r in quality.judge(docs).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = [r.doc_id for r in labels if r.quality == 1 and not found[r.doc_id].base_failed]
    assert all(found[i].kept for i in good)
    junk = "!!! ### $$$ %%% &&& *** " * 20 + " ".join(f"ZX{i}Q" for i in range(60))
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-5, junk)], "doc_id long, text string"))
    assert not quality.judge(more).where("doc_id = -5").first().kept


def test_quality_distances_match_their_definition(spark):
    texts = ["The cat and the dog of the house were in a garden with the bird for it is as that " * 4, "der Hund und die Katze in dem Haus, das ist nicht auf den Tisch. " * 5]
    good = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and length(text) > 2000").limit(3).collect()]
    frame = spark.createDataFrame(list(enumerate(texts + good)), "doc_id long, text string")
    rows_ = quality.features(frame).cache()
    chars, common, symbols = quality.references(rows_)
    forms, places = quality._forms(), len(quality._places())
    js = lambda p, q: np.sqrt(sum(0.5 * x * np.log2(2 * x / (x + y)) for a, b in ((p, q), (q, p)) for x, y in zip(a, b, strict=True) if x > 0))
    for r in quality.divergences(rows_, chars, common, symbols).collect():
        text = (texts + good)[r.doc_id]
        words = WORD.findall(text)
        histogram = np.zeros(places + 1)
        for w in words:
            histogram[forms.get(w, places)] += 1
        blank, lower = len(re.findall(r"[\x20\x09-\x0D]", text)), sum(c.islower() for c in text)
        few = [sum(c.isupper() for c in text), sum(c.isdigit() for c in text), len(re.findall(r"[.,;:!?'\"()-]", text))]
        classes = np.array([lower, blank, *few, len(text) - lower - blank - sum(few)]) / len(text)
        if r.js_words is not None:
            assert r.js_words == pytest.approx(js(histogram / len(words), common[r.language]), abs=1e-9)
        if r.js_chars is not None:
            assert r.js_chars == pytest.approx(js(classes, chars[r.language]), abs=1e-9)


def test_common_words_are_told_apart_exactly(spark):
    forms = quality._forms()
    got = spark.createDataFrame([(w,) for w in forms], "w string").select("w", quality._number(F.col("w")).alias("n")).collect()
    assert {r.w: r.n for r in got} == forms
    found = {r.doc_id: r.language for r in quality.features(spark.createDataFrame([(0, "and " * 60), (1, "Die " * 60), (2, "des " * 60)], "doc_id long, text string")).collect()}
    assert [sorted(quality.COMMON)[found[i]] for i in range(3)] == ["en", "de", "de"]


ITALIAN = "La casa della nonna era piccola ma molto bella, con un giardino pieno di fiori e di alberi da frutto. Ogni estate i bambini andavano a trovare la nonna e giocavano tutto il giorno sotto il sole, mentre lei preparava la cena per tutta la famiglia. La sera si sedevano insieme davanti alla porta e ascoltavano le storie del nonno."
RUSSIAN = "В доме у бабушки было тепло и уютно, и каждое лето дети приезжали к ней в гости. Они играли в саду, ели ягоды и слушали сказки, которые она рассказывала по вечерам. А когда становилось темно, все садились за большой стол и пили чай с вареньем, и никто не хотел уходить спать, потому что так хорошо было вместе всем родным людям."


def test_prose_of_other_languages_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, ITALIAN), (-2, RUSSIAN), (-3, ITALIAN * 3), (-4, " ".join(f"Zx{i}q" for i in range(80)))], "doc_id long, text string")
    found = {r.doc_id: r for r in quality.judge(docs.unionByName(more)).where("doc_id < 0").collect()}
    assert len(WORD.findall(ITALIAN)) >= quality.MIN_WORDS <= len(WORD.findall(RUSSIAN))
    assert found[-1].kept and found[-2].kept and found[-2].js_words is None and not found[-4].kept


# ---- decontamination ----


def test_decontamination_edges(spark):
    item = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([(1, item), (2, "Short one"), (None, "zz yy"), (3, None), (4, ""), (1, item), (5, "aa aa aa")], "item_id long, text string")
    docs = rows(spark, [f"start {item.upper()} end", " ".join(f"w{i}" for i in range(12)), "a SHORT, one!", "zz yy", None, "", "aa aa aa aa", " ".join(f"w{i}" for i in range(7, 20)) + " x" * 300, "é É short one"])
    docs = docs.unionByName(docs.where("doc_id = 0")).unionByName(docs.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    got = sorted(decontam.contaminated(docs, items).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    brief = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got]
    assert brief == [(0, 22, 20, 1, True), (0, 22, 20, 1, True), (1, 12, 0, 0, False), (2, 3, 2, 1, True), (3, 2, 2, 0, True), (4, 0, 0, 0, False), (5, 0, 0, 0, False), (6, 4, 4, 1, True), (7, 313, 13, 1, False), (8, 3, 0, 0, False), (None, 22, 20, 1, True)]
    assert decontam.clean_documents(docs, items).columns == docs.columns and decontam.clean_documents(docs, items).count() == 5
    assert decontam.contaminated(empty(spark), items).count() == 0 and decontam.contaminated(docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_proximity_finds_edited_passages(spark):
    words = [f"t{i}" for i in range(30)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    edited = words[:10] + ["new"] + words[10:17] + ["more"] + words[17:]
    docs = rows(spark, [" ".join(edited[:8] + ["z"] + edited[8:]), "nothing here at all"])
    assert {r.doc_id for r in decontam.proximity(docs, items).collect()} == {0}


# ---- language ----


def test_language_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fitted(docs)
    found = langid.identify(docs, model).where(langid.held_out(F.col("doc_id")))
    right, n, gone = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*"), F.count_if("lang_rejected")).first()
    assert n > 150 and right / n > 0.98 and gone == 0
    got = langid.identify(odd(spark), model)
    assert got.columns[-3:] == ["lang_pred", "lang_score", "lang_rejected"] and got.columns.count("lang_pred") == 1
    for r in got.collect():
        assert (r.lang_pred == "und") == (not any(unicodedata.category(c)[0] == "L" for c in r.text or "")) and 0 <= r.lang_score <= 1
    signs = {r.doc_id: r.lang_pred for r in langid.identify(rows(spark, ["½ ² Ⅷ ٣", "½ a", "中"]), model).collect()}
    assert signs[0] == "und" and signs[1] != "und" and signs[2] != "und"
    noise = langid.identify(rows(spark, ["qzxv kjwq zzqx vvkq xqjz wqzx kkqz jxqv zqxk vqzj qqxz " * 4]), model).first()
    assert noise.lang_rejected
    assert langid.fitted(empty(spark)) is None and langid.identify(odd(spark), None).where("lang_pred = 'und'").count() == odd(spark).count()


def test_words_keep_their_marks():
    assert langid.letter_words("Ein e\u0301te\u0301, हिन्दी ½x") == ["ein", "e\u0301te\u0301", "हिन्दी", "x"]


def plain_bits(counts, word, floor, d=0.75, order=4):
    """Interpolated Kneser-Ney by its definition, from the counts of one language's words."""
    level = {k: collections.Counter() for k in range(1, order + 1)}
    for w, n in counts.items():
        p = f"^{w}$"
        for i in range(1, len(p)):
            g = p[max(0, i + 1 - order) : i + 1]
            level[len(g)][g] += n
    for k in range(order, 1, -1):
        for g in level[k]:
            level[k - 1][g[1:]] += 1

    def prob(g):
        near = [n for x, n in level[len(g)].items() if x[:-1] == g[:-1]]
        shorter = prob(g[1:]) if len(g) > 1 else floor
        if not near:
            return shorter
        return max(level[len(g)][g] - d, 0) / sum(near) + (d * len(near) / sum(near) if len(g) > 1 else 1) * shorter

    p = f"^{word}$"
    return -sum(np.log2(prob(p[max(0, i + 1 - order) : i + 1])) for i in range(1, len(p)))


def test_kneser_ney_matches_its_definition(spark):
    texts = ["abab abba baab ab", "cdcd dccd abc"]
    model = langid.train(rows(spark, texts, ["x", "y"]).select("text", "lang"))
    letters = sum(len(set(t.replace(" ", ""))) + 1 for t in texts)
    for word in ("abab", "ba", "cd", "abcd", "zzz", "c", "bbbbaaac"):
        got = model.bits([word, "ab"])[0]
        for j, t in enumerate(texts):
            assert got[j] == pytest.approx(plain_bits(collections.Counter(t.split()), word, 0.75 / (20 * letters)), rel=1e-3), word


def test_a_small_language_keeps_its_grams_beside_a_large_one(spark):
    rng = np.random.default_rng(8)
    letters = list("abcdefghijklmnopqrstuvwxyz" + "абвгдежзийклмнопрстуфхцчшщ")
    large = [" ".join("".join(w) for w in rng.choice(letters, (3000, 8))) for _ in range(40)]
    small = "kolibu rastemi vodaku pelino zumareti kolinda rasteku vodami pelibu zumaku " * 2
    model = langid.train(rows(spark, large * 2 + [small], ["aa"] * 80 + ["zz"]).select("text", "lang"))
    assert model.langs == ["aa", "zz"] and len(model.keys) > 600_000
    assert langid.identify(rows(spark, [small]), model).first().lang_pred == "zz"


# ---- toxicity ----


def test_factorization_machine_learns_a_pair(spark):
    rng = np.random.default_rng(1)
    data = []
    for i in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"filler{k}" for k in rng.integers(0, 40, 12)] + ["clod"] * a + ["tribe"] * b
        data.append((i, " ".join(words), int(a and b)))
    frame = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    machine = toxicity.fit(frame)
    both, one, two, none, empty_ = machine.scores(["filler1 clod tribe", "filler1 clod", "filler1 tribe", None, ""], toxicity.Terms())
    assert both > 0.5 > max(one, two, none, empty_)


def test_factorization_machine_learns_a_pair_that_tells_nothing_alone(spark):
    rng = np.random.default_rng(3)
    data = []
    for i in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"filler{k}" for k in rng.integers(0, 40, 8)] + ["clod"] * a + ["tribe"] * b
        data.append((i, " ".join(words), int(a == b)))
    machine = toxicity.fit(spark.createDataFrame(data, "doc_id long, text string, toxic int"), epochs=40)
    both, one, two, none = machine.scores(["filler1 clod tribe", "filler1 clod", "filler1 tribe", "filler1"], toxicity.Terms())
    assert min(both, none) > 0.5 > max(one, two)


def test_margins_match_the_sum_over_pairs():
    rng = np.random.default_rng(4)
    place = np.full(toxicity.HASHES, -1, np.int32)
    texts = ["one two three four", "", None, "five one unknownword", "two two two"]
    row, hashes = toxicity.Terms()(texts)
    kept = np.unique(hashes)[::2]
    place[kept] = np.arange(len(kept))
    m = toxicity.Machine(place, 0.3, rng.normal(size=len(kept)), rng.normal(size=(len(kept), 8)))
    got = m.margins(*m.known(row, hashes), len(texts))
    for i in range(len(texts)):
        mine = [place[h] for h in sorted(set(hashes[row == i].tolist())) if place[h] >= 0]
        want = 0.3 + sum(m.weight[a] for a in mine) + sum(float(m.factor[a] @ m.factor[b]) for k, a in enumerate(mine) for b in mine[k + 1 :])
        assert got[i] == pytest.approx(want)


def test_toxicity_edges(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(1, 1), (None, 1), (4, None), (4, 0), (4, 1)], "doc_id long, toxic int")
    machine = toxicity.fit(toxicity.training_rows(docs, labels))
    assert all(0 <= r.toxicity <= 1 for r in toxicity.score(docs, machine).collect())
    none = toxicity.fit(toxicity.training_rows(docs, labels.limit(0)))
    assert toxicity.score(docs, none).where("toxicity >= 0.5").count() == 0 and toxicity.score(empty(spark), none).count() == 0


# ---- pages ----

PAGE = '<!doctype html><html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=1>Home</a></li></ul></nav><div id="x"><h1>Great  title</h1><p>First part &amp; more,<br>with a break. It goes on for long enough to matter.</p><p><b>Second part</b>, by &lt;someone&gt;, is here<p>Third &eacute;t&#233;</div><div class="comments"><h3>Comments</h3><p>I like it, said reader one.</p></div><form>Name <input> Send</form><footer>&copy; us</footer><script>var a = "</p><p>no";</script></body></html>'


def test_main_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    forest = html.train(pages)
    assert html.extract(PAGE, forest) == "Great title\nFirst part & more, with a break. It goes on for long enough to matter.\nSecond part, by <someone>, is here\nThird été"
    for r in html.main_text(pages, forest).collect():
        inner = re.split(r"</?(?:p|h1)>", r.html.partition("<article>")[2].partition("</article>")[0])
        assert r.main_text == "\n".join(x for x in (" ".join(html.entities.unescape(re.sub("<[^>]*(>|$)", " " if "<br" in t else "", t)).split()) for t in inner) if x)


@pytest.mark.parametrize("page", [None, "", "plain", "<", "<p", "a < b", "<!--", "<script>", "</p></div>", "<div " * 2000, "<p>" * 3000, "<div>" * 3000 + "x", '<a title="a>b">x</a>', "&#0;&bogus;&amp"])
def test_odd_pages_do_not_crash(page):
    assert isinstance(html.extract(page, None), str)


def test_empty_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string, main_text string")
    assert html.train(none) is None and html.main_text(none, None).count() == 0


def test_icons_and_foreign_content_do_not_cut_the_text():
    page = '<article><p>One <svg class="i"/> two <math><mi>x</mi></math> three <object><b>four</b></object></p><p>Five <svg><title>no</title></svg> six <select> seven</p><p>Eight</p></article>'
    assert html.extract(page, None) == "One two x three four\nFive six seven\nEight"
    assert html.extract("<article><p>a</p><script>b</article>", None) == "a"


def test_letters_that_grow_in_lower_case_do_not_shift_the_page():
    for letter in ("I", "\u0130"):
        page = f"<article><p>{letter * 30}</p><ScRipt>var a = 1;</sCRIPT><p>Second part</p><SVG><path></svg><p>Third</p></article>"
        assert html.extract(page, None) == f"{letter * 30}\nSecond part\nThird"


def test_marks_with_attributes_train(spark):
    page = lambda mark, end, k: f'<html><body><div class="menu"><a href="#">Home {k}</a></div><{mark}><h1>Title {k}</h1><p>{"Some words that make up a text. " * (4 + k % 5)}</p><p>{"And more of it, with commas, too. " * 5}</p></{end}><div class="footer">Imprint {k} <a href="#">x</a></div></body></html>'
    for mark, end in (('article class="post" id=a', "article"), ("main", "main"), ('DIV itemprop="articleBody"', "div"), ("ARTICLE", "ARTICLE")):
        pages = spark.createDataFrame([(k, "u", page(mark, end, k)) for k in range(30)], "page_id long, url string, html string")
        forest = html.train(pages)
        assert forest is not None, mark
        text = html.extract(page(mark, end, 50), forest)
        assert text.startswith("Title 50\nSome words") and "Imprint" not in text and "Home" not in text


def test_held_out_pages_without_marks(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("html like '%<article>%'")
    forest = html.train(pages.where("page_id % 2 = 0"), sample=60)
    right = n = 0
    for r in pages.where("page_id % 2 = 1").collect():
        want = html.extract(r.html, None)  # the rule, by the mark
        inner = r.html.partition("<article>")[2].partition("</article>")[0]
        want = html.extract(f"<article>{inner}</article>", None)
        for k, plain in enumerate(("<div>", '<div class="c7">')):
            page = r.html.replace("<article>", plain).replace("</article>", '</div><div class="comments"><p>I think so too, said the reader, and more of that.</p></div>' if k else "</div>")
            got = html.extract(page, forest)
            right, n = right + (got == want), n + 1
    assert n > 100 and right / n > 0.95, right / n


def test_decoding_is_the_best_choice_of_subtrees():
    rng = np.random.default_rng(5)
    for _ in range(60):
        root = html.Node("#root", (), None)
        every = [root]
        for _ in range(int(rng.integers(2, 8))):
            up = every[int(rng.integers(len(every)))]
            if up.tag != "#":
                n = html.Node("#" if rng.random() < 0.5 else "div", (), up)
                n.text = f"t{len(every)}" * int(rng.integers(1, 9)) if n.tag == "#" else ""
                every.append(n)
        nodes, _ = html.features(root)
        odds = rng.normal(size=len(nodes))
        worth = [max(n.size, 1) ** 0.5 * odds[n.order] * (1.0 if n.tag == "#" else 0.3) if n.parent else 0.0 for n in nodes]
        best, chosen = -1.0, None
        for mask in range(1 << len(nodes)):
            keep = [mask >> n.order & 1 for n in nodes]
            if keep[0] and all(keep[n.parent.order] for n in nodes if n.parent and keep[n.order]) and all(n.tag == "#" or any(keep[k.order] for k in n.kids) for n in nodes if n.parent and keep[n.order]):
                value = sum(w for w, k in zip(worth, keep, strict=True) if k)
                if value > best + 1e-12:
                    best, chosen = value, [n.text for n in nodes if keep[n.order] and n.text]
        assert html.decode(nodes, odds) == (chosen or [])


def test_forest_odds_match_a_walk_down_each_tree():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    forest = html.boost(x, y, rounds=12)
    odds = forest.odds(x)
    assert ((odds > 0) == (y > 0)).mean() > 0.9
    for row, got in zip(x[:50], odds[:50], strict=True):
        total = forest.start
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + (sum(row[f[at]] > c for c in forest.cuts[f[at]]) > t[at])
            total += leaf[at - len(f)]
        assert got == pytest.approx(total)


# ---- mixing ----


def test_targets_and_flow():
    sizes = {"a": 100, "b": 1000, "c": 10, None: 50}
    got = mixing.targets(sizes)
    assert got["a"] == 200 and got["c"] == 20 and got[None] == 100 and abs(sum(got.values()) - 1.5 * 1160) < 1e-6
    flows = mixing.route({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": 150, "b": 100})
    assert sum(f.get("a", 0) for f in flows.values()) == 150 and sum(f.get("b", 0) for f in flows.values()) == 100
    # no repetition while fresh text is left: 210 fresh tokens serve 250
    assert sum(max(0, sum(flows[p].values()) - n) for p, n in ((("a",), 100), (("a", "b"), 100), (("b",), 10))) == 40


def test_mix_edges(spark):
    docs = odd(spark)
    got = mixing.mix(mixing.sized(docs)).collect()
    assert len(got) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in got)
    assert mixing.mix(mixing.sized(empty(spark))).count() == 0
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, mixing.mixed_documents(docs).collect()))


# ---- tokens ----


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        assert sorted(tokens.permuted(np.arange(n), n)) == list(range(n))
    assert (tokens.permuted(np.arange(1000), 1000, 1) != tokens.permuted(np.arange(1000), 1000, 2)).any()


def test_tokens_round_trip_and_shards(spark, tmp_path):
    docs = odd(spark).unionByName(rows(spark, ["long text " * 300_000]).withColumn("doc_id", F.lit(99).cast("long"))).cache()
    path = f"file://{tmp_path}/shards"
    found = tokens.training_order(docs, seq=64, per_shard=500, path=path).toPandas().sort_values("slot")
    assert sorted(found.slot) == list(range(len(found))) and (found["shard"] == found.slot // 500).all() and (found.offset == found.slot % 500 * tokens.stride(64)).all()
    bpe = tokens.encoder(Path(tokens.VOCABULARY).read_bytes())
    want = collections.Counter()
    for r in docs.collect():
        ids = [*bpe.encode_ordinary(r.text or ""), tokens.END_ID]
        assert bpe.decode(ids[:-1]) == (r.text or "")
        want.update((r.doc_id, k, tuple(ids[a : a + 64])) for k, a in enumerate(range(0, len(ids), 64)))
    got = collections.Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.seq_no, tuple(np.frombuffer(r.tokens, "<u2").tolist())) for r in found.itertuples())
    assert got == want and all(len(r.tokens) == 2 * r.n_tokens for r in found.itertuples())
    files = {p: p.stat().st_mtime_ns for p in Path(tmp_path).rglob("shard=*/part-*")}
    assert len(files) == found["shard"].nunique() and all(p.stat().st_size % tokens.stride(64) == 0 for p in files)
    tokens.training_order(docs, seq=64, per_shard=500, path=path)  # nothing is left to do
    assert files == {p: p.stat().st_mtime_ns for p in Path(tmp_path).rglob("shard=*/part-*")}
    back = [(d, k, ids.tobytes()) for s in sorted(found["shard"].unique()) for d, k, ids in tokens.read_shard(spark, path, int(s), seq=64)]
    assert back == [(tokens.NO_ID if r.doc_id != r.doc_id else int(r.doc_id), r.seq_no, r.tokens) for r in found.itertuples()]
    assert [x[:2] for x in tokens.read_shard(spark, path, 0, 300, 64, 7)] == [x[:2] for x in back[300:500]]
    assert tokens.training_order(empty(spark)).count() == 0


def test_a_lost_shard_is_written_again(spark, tmp_path):
    docs, path = rows(spark, ["some words here " * 200] * 20), f"file://{tmp_path}/shards"
    tokens.training_order(docs, seq=64, per_shard=50, path=path)
    files = {p: p.read_bytes() for p in Path(tmp_path).rglob("part-*")}
    (lost := sorted(files)[1]).unlink()
    tokens.training_order(docs, seq=64, per_shard=50, path=path)
    again = {p.parent.name: p.read_bytes() for p in Path(tmp_path).rglob("part-*")}
    assert again == {p.parent.name: c for p, c in files.items()} and lost.parent.name in again


def test_training_order_writes_its_shards(spark, tmp_path):
    docs = odd(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    before = set(Path(shared_dir(spark).removeprefix("file://")).glob("shards-*"))
    found = tokens.training_order(docs, seq=64, per_shard=500).toPandas().sort_values("slot")
    (new,) = set(Path(shared_dir(spark).removeprefix("file://")).glob("shards-*")) - before
    back = [(d, k, ids.tobytes()) for s in sorted(found["shard"].unique()) for d, k, ids in tokens.read_shard(spark, f"file://{new}", int(s), seq=64)]
    assert back == [(r.doc_id, r.seq_no, r.tokens) for r in found.itertuples()]


# ---- very long texts ----


def test_very_long_texts_are_taken_whole(spark):
    docs = very_long(spark).cache()
    long = docs.where("doc_id = 0").first().text
    words = len(WORD.findall(long))
    found = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert found[0].n_words == words and found[1].word_chars == 1_500_000 and found[0].base_failed
    tail = "at the very end call a@b.org or 10.0.0.1"
    ends = docs.withColumn("text", F.concat("text", F.lit(" " + tail)))
    spans = {r.doc_id: r.spans for r in pii.digest(pii.find(ends)).collect()}
    at = len(long) + 1 + tail.index("a@b")
    assert spans[0] == f"email:{at}:{at + 7},ip:{at + 11}:{at + 19}" and all(spans[i].count(":") == 4 for i in spans)
    item = spark.createDataFrame([(1, tail)], "item_id long, text string")
    hits = {r.doc_id: r for r in decontam.contaminated(ends, item).collect()}
    assert hits[0].n_hit == 13 and hits[0].n_words == words + 13 and hits[1].n_hit == 13
    model = langid.train(rows(spark, [long[:2000]], ["en"]).select("text", "lang"))
    assert {r.lang_pred for r in langid.identify(docs, model).collect()} == {"en"}
    machine = toxicity.Machine(np.full(toxicity.HASHES, -1, np.int32), 0.0, np.zeros(0), np.zeros((0, 8)))
    assert toxicity.score(docs, machine).count() == 3
    taken = {r.doc_id: r["size"] for r in mixing.mix(mixing.sized(docs)).collect()}
    assert taken[0] == words and taken[1] == 1
