import sys
from pathlib import Path

import numpy as np
import pandas as pd
import xxhash

sys.path.insert(0, str(Path(__file__).parent))
from helpers import WORD, empty, odd, rows  # noqa: E402

from spanquarry.llm import simhash  # noqa: E402


def plain(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    n = max(1, len(words) - 3)
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > n)


def reachable(fps, ids, radius=4):
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    known = {g: min((ids[k] for k in range(len(ids)) if group[k] == g and ids[k] is not None), default=None) for g in set(group)}
    return [known[g] for g in group]


def test_fingerprints_and_components_match_brute_force(spark):
    docs = odd(spark)
    got = simhash.near_duplicates(docs).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [plain(t) for _, t in texts]
    want = sorted((str(i), f"{f:016x}", str(c)) for (i, _), f, c in zip(texts, fps, reachable(fps, [i for i, _ in texts]), strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_links_lose_nothing_in_dense_and_hot_buckets(spark):
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**63, 900, dtype=np.uint64)
    for i in range(1, 400):  # a chain of close fingerprints, and a ball
        fps[i] = fps[i - 1] ^ np.uint64(1 << int(rng.integers(64)))
    for i in range(400, 650):
        fps[i] = fps[400] ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64)))
    fps = np.unique(fps)
    want = reachable([int(f) for f in fps], [int(np.int64(f.view(np.int64))) for f in fps])
    frame = spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64)}))
    for chunk in (40, 2048):
        roots = {r.node: r.root for r in simhash.components(simhash.links(frame, 4, chunk)).collect()}
        assert [roots.get(int(f), int(f)) for f in fps.view(np.int64)] == want


def test_bit_sliced_distances():
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 2**63, 200, dtype=np.uint64)
    fps[1:100] = fps[0] ^ (np.uint64(1) << rng.integers(0, 64, 99).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 99).astype(np.uint64))
    for radius in (0, 1, 3, 4, 7):
        want = {(i, j) for i in range(200) for j in range(i + 1, 200) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}
        large = {(int(a), int(b)) for s, t in simhash._large_pairs(fps, radius) for a, b in zip(s, t, strict=True)}
        small = {(int(a), int(b)) for s, t in simhash._small_pairs(fps[:100], np.zeros(100, int), radius) for a, b in zip(s, t, strict=True)}
        assert large == want and small == {(i, j) for i, j in want if j < 100}


def test_keep_one_and_empty(spark):
    kept = simhash.keep_one(odd(spark))
    ids = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
    # 1 and 2 are wordless like 0, 5 and a row without an id repeat 4, row 4 stands there twice
    assert ids == [0, 3, 4, *range(7, 14)] or ids == [0, 3, 4, *range(6, 14)]
    assert kept.columns == odd(spark).columns and kept.where("doc_id is null").count() == 0
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.keep_one(empty(spark)).count() == 0
    assert simhash.near_duplicates(rows(spark, ["one"])).first().component_id == 0


def test_different_texts_that_share_an_id_stay(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (1, "zulu yankee xray whisky victor uniform"), (2, "one two three four five six"), (1, "alpha beta gamma delta epsilon zeta"), (None, "red green blue white black grey"), (None, "up down left right near far")], "doc_id long, text string")
    kept = sorted((str(r.doc_id), r.text[:4]) for r in simhash.keep_one(docs).collect())
    assert kept == [("1", "alph"), ("1", "zulu"), ("2", "one "), ("None", "red "), ("None", "up d")]


def test_similar_groups_join_edits_and_leave_others(spark):
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts, want = [], []
    for g in range(30):
        base = [vocabulary[k] for k in rng.integers(0, 4000, 300)]
        for k in range(4):
            words = list(base)
            for at in rng.integers(0, 300, k + 1):  # two documents differ in up to seven words: at least 0.79
                words[at] = "edit"
            texts.append(" ".join(words))
            want.append(4 * g)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(rows(spark, texts)).collect()}
    together = sum(got[i] == got[w] for i, w in enumerate(want)) / len(want)
    assert together > 0.95 and all(want[i] == want[c] for i, c in got.items())


def shingles(text):
    words = WORD.findall(text)
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_text(rng, words, share, vocabulary):
    """words with single words replaced, until the similarity is about the share asked for."""
    out, base = list(words), shingles(" ".join(words))
    for at in rng.permutation(len(words)):
        mine = shingles(" ".join(out))
        if len(mine & base) / len(mine | base) <= share:
            break
        out[at] = vocabulary[rng.integers(len(vocabulary))]
    return " ".join(out)


def test_recall_and_precision_by_bands_of_similarity(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = []
    for g in range(700):
        base = [vocabulary[k] for k in rng.integers(0, 4000, 400)]
        texts += [" ".join(base), near_text(rng, base, 0.68 + 0.3 * rng.random(), vocabulary)]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(rows(spark, texts)).collect()}
    seen = {}
    for i in range(0, len(texts), 2):
        a, b = shingles(texts[i]), shingles(texts[i + 1])
        j = len(a & b) / len(a | b)
        band = seen.setdefault("below" if j < 0.8 else "0.80" if j < 0.82 else "above", [0, 0])
        band[0] += got[i] == got[i + 1]
        band[1] += 1
    assert seen["below"][0] == 0 and seen["below"][1] > 150
    assert seen["0.80"][0] >= 0.85 * seen["0.80"][1] and seen["above"][0] >= 0.97 * seen["above"][1] and seen["0.80"][1] > 20


def test_repeated_lines_alone_do_not_join_texts(spark):
    rng = np.random.default_rng(10)
    line = "this very line stands here over and over again without end\n"
    own = lambda: " ".join(f"x{k}" for k in rng.integers(0, 10**6, 60))
    texts = [line * 50 + own(), line * 50 + own()]
    texts.append(texts[0] + "\n" + line * 40)
    kept = [r.doc_id for r in simhash.keep_one(rows(spark, texts)).collect()]
    assert sorted(kept) == [0, 1]


def test_dense_groups_keep_every_link_and_no_other(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [vocabulary[k] for k in rng.integers(0, 4000, 250)]
    texts = [near_text(rng, base, 0.84, vocabulary) for _ in range(150)]  # members are about 0.72 like each other
    texts.append(" ".join(base))
    texts += [near_text(rng, base, 0.75, vocabulary) for _ in range(60)]  # near, but to none near enough
    sets = [shingles(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    for chunk in (40, 2048):
        got = {r.doc_id: r.component_id for r in simhash.similar_groups(rows(spark, texts), chunk=chunk).collect()}
        same = sum(got[i] == group[i] for i in range(len(texts)))
        assert same >= 0.96 * len(texts) and all(got[i] == i for i in range(len(texts)) if group.count(group[i]) == 1)


def test_hot_buckets_of_the_finest_plan(spark):
    rng = np.random.default_rng(12)
    base = np.uint64(rng.integers(0, 2**63))
    fps = {int(base)} | {int(base) ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) ^ (1 << int(d)) for a, b, c, d in rng.integers(0, 5, (600, 4))} | {int(base) ^ (31 << 40) ^ (1 << int(a)) for a in rng.integers(0, 5, 60)}
    fps = np.array(sorted(fps), np.uint64)
    want = reachable([int(f) for f in fps], [int(f) for f in fps.view(np.int64)])
    frame = spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64)}))
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame, 4, 8)).collect()}
    assert [roots.get(int(f), int(f)) for f in fps.view(np.int64)] == want
