"""Conversation repair, document fingerprints and token alignment against brute force, and their awkward cases."""

import functools
import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spanquarry.llm import alignment, merkle, queries, repair

from helpers import empty, odd, very_long

SF = "/root/testdata/sf0.01"
TURNS = "conv_id long, turn long, role string, text string, component_id long, edits string, n string"


# ---- repair ----


def plain_damage(rows):
    sp = lambda x: " " if x is None else str(x)
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1] or 0, r[2], r[3]))


def best_edits(rows):
    """(cost, audit, repaired) of rows (role, text, fault) by an automaton over the grammar's states, each row and each
    insertion a step: another way than the operator's."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    @functools.lru_cache(None)
    def go(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        if inserted < 2:
            for x, name in (("u", "user"), ("a", "assistant")):
                if (state, x) in step and (r := go(i, step[state, x], inserted + 1)):
                    found.append((r[0] + 3, "I" + r[1], (f"{name}:", *r[2])))
        if i < len(rows):
            role, text, fault = rows[i]
            if r := go(i + 1, state, 0):
                found.append((r[0] + 4, "D" + r[1], r[2]))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                if (state, role[:1]) in step and (r := go(i + 1, step[state, role[:1]], 0)):
                    found.append((r[0] + extra, "K" + r[1], (f"{role}:{text}", *r[2])))
                for x, name in (("u", "user"), ("a", "assistant")):
                    if (state, x) in step and (r := go(i + 1, step[state, x], 0)):
                        found.append((r[0] + extra + 3, "R" + r[1], (f"{name}:{text}", *r[2])))
        return min(found, key=lambda f: f[:2]) if found else None

    import sys

    sys.setrecursionlimit(100_000)
    return go(0, 0, 0)


def plain_report(rows):
    by = defaultdict(list)
    ids = {r[0] for r in rows}
    for conv, turn, role, text in plain_damage(rows):
        by[conv].append((turn, role, text))
    out = {}
    for conv in ids:
        seen, marked, n = set(), [], Counter()
        for _, role, text in by[conv]:
            core = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            marked.append((role, text, fault))
        turns = [t for t, *_ in by[conv] if t is not None]
        bad = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        cost, audit, repaired = best_edits(tuple(marked))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], bad, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def conversation(rng, n):
    roles = [None, "", "user", "assistant", "system", "tool", "User"]
    texts = [None, "", " \t", "ok.", "ok", "why?", "a" * 50 + "!", "yes.", "é."]
    return [(rng.choice([None, 0, 1, k, k, k, k]), rng.choice(roles[2:4] * 5 + roles), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}" + rng.choice([".", "", "?"])) for k in range(n)]


def test_chunks_equal_one_alignment_and_the_automaton():
    rng = random.Random(3)
    for _ in range(300):
        free = tuple((rng.choice("uuaasx"), rng.choice((0, 0, 3))) for _ in range(rng.randint(0, 9)))
        marked = tuple((r, "t", "truncated" if x else "") for r, x in free)
        want = best_edits(marked)[:2]
        assert repair.cheapest(free, 0, None) == want
        size = rng.randint(1, 4)
        parts = [free[k : k + size] for k in range(0, len(free), size)]
        options = [[repair.cheapest(p, s, e) for s in range(4) for e in range(4)] for p in parts]
        picks = repair.walk_back([[o[0] if o else repair.FAR for o in os] for os in options], [[o[1] if o else None for o in os] for os in options])
        state, cost, audit = 0, 0, ""
        for os, pick in zip(options, picks, strict=True):
            c, a = os[4 * state + pick[state]]
            cost, audit, state = cost + c, audit + a, pick[state]
        assert (cost + repair.END_COST[state], audit + repair.TAIL[state]) == want


def test_band_leaves_out_nothing_below_its_limit():
    rng = random.Random(4)
    for _ in range(300):
        free = tuple((rng.choice("uas"), rng.choice((0, 3))) for _ in range(rng.randint(0, 8)))
        target = "us"[rng.random() < 0.2] + "ua" * rng.randint(0, 4)
        whole = repair.align(free, target, repair.FAR - 1, True)
        assert whole is None or repair.align(free, target, whole[0], True) == whole and repair.align(free, target, whole[0] - 1, True) is None


def test_repair_against_plain_conversations(spark):
    rng = random.Random(5)
    rows = [(c if c else None, *r) for c in range(120) for r in conversation(rng, rng.randint(1, 12))]
    rows += [(1000, k, "user", "same.") for k in range(300)] + [(1001, 5, "user", "same.")] * 400 + [(1002, None, "user", "a.")] * 3
    rows += [(2000, k, rng.choice(["user", "assistant", "assistant", "system"]), f"{rng.random()}" + rng.choice([".", ""])) for k in range(900)]
    rows += rows[:40]
    frame = spark.createDataFrame([(*r, 1, "e", "n") for r in rows], TURNS)
    got = {r.conv_id: tuple(r)[1:] for r in repair.report(frame, *repair.repaired(repair.damaged(frame.repartition(5)))).collect()}
    want = plain_report(rows)
    assert got.keys() == want.keys()
    assert not [(k, got[k], want[k]) for k in got if got[k] != want[k]][:2]


def test_repaired_turns_are_the_digest(spark):
    rows = spark.createDataFrame([(7, k, "user" if k % 3 else "assistant", f"t{k}.") for k in range(50)], "conv_id long, turn long, role string, text string")
    whole, parts = repair.repaired(repair.damaged(rows))
    found = repair.report(rows, whole, parts).first()
    turns = repair.turns(whole.unionByName(parts)).orderBy("pid", "seq", "place").collect()
    assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns).encode()).hexdigest() == found.repaired_sha256
    assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in turns)) and [t.edit for t in turns] == [e for e in found.audit if e != "D"]


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert repair.report(none, *repair.repaired(repair.damaged(none))).count() == 0


# ---- fingerprints ----


def test_trees_hold_the_whole_text_and_locate_edits():
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "End. ", "\n", "\n\n", "x" * 90, "é! ", "?!.", " "]) for _ in range(rng.randint(0, 60)))
        assert "".join(p for s in merkle.sections(text) for q in s for p in q) == text
        own = merkle.fingerprint(text)
        assert merkle.likeness(own, own) == 1 and merkle.edits(own, own) == []
        at = rng.randint(0, len(text))
        other = merkle.fingerprint(text[:at] + "#new#" + text[at:])
        assert 0 <= merkle.likeness(own, other) == merkle.likeness(other, own) < 1
        changed = merkle.edits(other, own)
        assert any(s <= at < e for s, e in changed)
        assert sum(e - s for s, e in merkle.edits(own, other)) == len(text) - sum(len(x) for x in common_pieces(own, other))


def common_pieces(a, b):
    """As strings of the right length: what is left of a when its located edits are taken out, by its sizes."""
    size = int(a.split("|")[0].rsplit(".", 1)[1])
    return ["x" * (size - sum(e - s for s, e in merkle.edits(a, b)))]


def test_likeness_is_the_common_part_of_pieces():
    """With one section and paragraph each, likeness is Dice's measure over multisets of pieces."""
    rng = random.Random(7)
    words = [f"Word{k} is it. " for k in range(12)]
    for _ in range(100):
        a, b = ("".join(rng.choices(words, k=rng.randint(20, 40))) for _ in range(2))
        tree = lambda t: Counter(p for s in merkle.sections(t) for q in s for p in q)
        both = sum(len(p) * n for p, n in (tree(a) & tree(b)).items())
        if a != b and len(merkle.sections(a)) == 1:
            assert merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b)) == pytest.approx(2 * both / (len(a) + len(b)))


def plain_next(docs):
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    out = []
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        a, b, c = map(merkle.fingerprint, (text, changed, after))
        out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b, merkle.likeness(a, b), merkle.likeness(a, c)))
    return out


def test_every_document_meets_its_successor(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, queries.op12_merkle(spark, SF).collect()))
    assert got == sorted(plain_next([(r.doc_id, r.text or "") for r in docs.collect()]))
    halves = [g[5] for g in got if g[1] > 400]
    assert sum(halves) / len(halves) > 0.45 and all(g[5] > g[6] or g[6] > 0.3 for g in got if g[1] > 400)


def test_fingerprints_of_odd_tables(spark):
    for frame in (odd(spark), very_long(spark), empty(spark)):
        got = merkle.with_next(frame).collect()
        assert len(got) == frame.count() == merkle.fingerprints(frame).count()
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    one = merkle.with_next(odd(spark).limit(1)).first()
    assert one.near_next == 1 and one.near_edited == 1 and one.fingerprint == one.edited_fingerprint
    pair = spark.createDataFrame([(merkle.fingerprint("a. b."), merkle.fingerprint("a. c."), 1), (None, "x", 2)], "a string, b string, likeness_of long")
    assert [r.spans and [tuple(s) for s in r.spans] for r in merkle.located(pair).orderBy("likeness_of").collect()] == [[(3, 5)], None]


# ---- alignment ----


def plain_alignment(texts):
    """Whole texts, one at a time: cut where both ends meet, links by loops."""
    two = alignment.both(json.dumps(json.load(open(alignment.BYTE_LEVEL))), open(alignment.PIECES, "rb").read())
    docs = []
    for text in texts:
        a = two.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.b.encode(text) if text else []
        ba, bb = [two.bytes_a[i] for i in a], [two.bytes_b[i] for i in b]
        want = (" " + (text or "")).encode()
        if not text or b"".join(ba) != want or b"".join(bb) != want:
            docs.append((0, 0, [], []))
            continue
        ends_a, ends_b = (list(itertools.accumulate(map(len, x))) for x in (ba, bb))
        made, p, q = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(cut, p) + 1, ends_b.index(cut, q) + 1
            made.append((a[p:x], b[q:y]))
            p, q = x, y
        docs.append((len(a), len(b), made, [(i, j) for x, y in made for i in x for j in y]))
    count = Counter(p for *_, links in docs for p in set(links))
    top = defaultdict(int)
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    out = []
    for na, nb, made, links in docs:
        digest = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in made).encode()).hexdigest() if made else ""
        out.append((na, nb, len(made), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), digest))
    return out


ODD = [None, "", " ", "a", "  two  spaces ", "tab\tnew\n line \n", "<|endoftext|> <s> </s> <unk>", "x▁y", "日本語のテキスト", "á ﬁ é", "\U0001f600\U0001f600 ok", "nul\x00 x", " nb  \x1c y", "don't we'll", "a" * 3000, "1234567 89", "word word", "word word"]


@pytest.mark.parametrize("limit", [10**6, 0, 40])
def test_alignment_against_loops(spark, limit):
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 5 = 0 or length(text) < 200").select("text").collect()]
    texts = ODD + docs
    frame = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, pair string, docs long").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.counted(alignment.links(frame), limit).collect()}
    want = plain_alignment(texts)
    assert not [(texts[k], got[k], want[k]) for k in range(len(texts)) if got[k] != want[k]][:2]


def test_stretches_are_tokenized_as_whole_texts(spark):
    two = alignment.both(json.dumps(json.load(open(alignment.BYTE_LEVEL))), open(alignment.PIECES, "rb").read())
    for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").select("text").collect():
        cut = two.stretches(r.text)
        assert " ".join(cut) == r.text
        assert [i for w in cut for i in two.b.encode(w)] == two.b.encode(r.text)
        assert [i for w in cut for i in two.a.encode(" " + w, add_special_tokens=False).ids] == two.a.encode(" " + r.text, add_special_tokens=False).ids


def test_alignment_of_odd_tables(spark):
    for frame in (odd(spark), very_long(spark), empty(spark)):
        got = alignment.counted(alignment.links(frame))
        assert got.count() == frame.count() and got.agg(F.sum("n_links")).count() == 1
