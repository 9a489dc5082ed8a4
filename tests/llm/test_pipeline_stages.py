import random
from collections import Counter

import numpy as np

import corpus_pipeline
from quantloom.llm import apportion, shingle_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


def changed(ws, places):
    return [w if i not in places else "changed" + str(i) for i, w in enumerate(ws)]


def test_near_duplicates_reach_jaccard(spark):
    base = prose(1, 100)
    far = prose(2, 100)
    # Of 96 shingles, two changes apart lose 10 (Jaccard 86/106 = 0.81), three lose 15 (81/111 = 0.73).
    rows = [(1, base), (2, changed(base, {20, 60})), (3, changed(base, {20, 60, 80})), (4, far), (5, changed(far, {20, 50, 80})), (6, prose(3, 3))]
    rows += [(100 + i, changed(prose(4, 200), {i})) for i in range(40)]
    df = spark.createDataFrame([(i, " ".join(t), "", "", 0) for i, t in rows], DOCS)
    root = {r.doc_id: r.root for r in shingle_join.near_duplicates(df).collect()}
    # 3 differs from 2 in one place more, so the chain links it.
    assert root[1] == root[2] == root[3]
    assert len({root[4], root[5], root[6], root[1], root[100]}) == 5
    assert len({root[100 + i] for i in range(40)}) == 1
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [1, 4, 5, 6, 100]


def test_near_duplicates_keep_null_ids_and_unlinked_texts(spark):
    a, b, c, d = (" ".join(prose(s, 60)) for s in (11, 12, 13, 14))
    rows = [(None, a, "", "", 0), (7, b, "", "", 0), (7, c, "", "", 0), (None, d, "", "", 0), (9, d, "", "", 0), (9, d, "", "", 0)]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted([("None", a), ("7", b), ("7", c), ("9", d)])


def test_mixing_meets_targets(spark):
    sizes = {"a": 300, "b": 300, "c": 60, None: 300}
    rows = [(i * 1000 + j, " ".join(prose(i * 1000 + j, 40 + j % 20)), "", s, 0) for i, (s, n) in enumerate(sizes.items()) for j in range(n)]
    df = spark.createDataFrame(rows, DOCS)
    totals = {r.source: (r.source_size, r.target) for r in apportion.mix(df).select("source", "source_size", "target").distinct().collect()}
    out = corpus_pipeline.mixing(spark, df, "").collect()
    words, copies = Counter(), Counter(r.doc_id for r in out)
    for r in out:
        words[r.source] += len(r.text.split())
    for s, (size, target) in totals.items():
        assert abs(words[s] - target) <= 0.03 * size, (s, words[s], target)
    assert max(copies.values()) in (2, 3)


def brute_roots(texts, size=5):
    """Smallest index of each text's component by Jaccard 0.8 of word-shingle sets."""
    sets = []
    for t in texts:
        ws = t.lower().split()
        sets.append({tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} if len(ws) >= size else {tuple(ws)} if ws else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_equal_brute_force_in_small_blocks(spark, monkeypatch):
    """Hot shingles cut into many blocks and texts with many partners dealt out give the same components."""
    monkeypatch.setattr(shingle_join, "BLOCK", 3)
    monkeypatch.setattr(shingle_join, "PARTNERS", 2)
    r = random.Random(9)
    common = prose(50, 40)
    texts = []
    for g in range(12):
        own = common[: 5 * (g % 8)] + prose(60 + g, 60)
        texts += [" ".join(changed(own, set(r.sample(range(len(own)), r.choice((0, 1, 2, 3)))))) for _ in range(8)]
    texts += ["", "one", "ONE", "two words", " two  words "]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOCS).repartition(5)
    got = {}
    for row in shingle_join.near_duplicates(df).collect():
        got.setdefault(row.root, []).append(row.doc_id)
    want = {}
    for i, x in enumerate(brute_roots(texts)):
        want.setdefault(x, []).append(i)
    assert sorted(map(sorted, got.values())) == sorted(want.values())
    assert 12 < len(want) < 60


def test_fingerprints_link_what_sets_do_not(spark):
    """A long repeated passage with short ends of its own: Jaccard of the sets is far under 0.8, the fingerprints are within two bits."""
    body = prose(31, 13) * 60
    rows = [(i, " ".join(body + prose(40 + i, 12))) for i in range(4)] + [(9, " ".join(prose(50, 200)))]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOCS)
    assert len(set(brute_roots([t for _, t in rows]))) == 5
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [0, 9]


def test_texts_that_share_little_do_not_meet(spark, monkeypatch):
    """Pairs that share a prefix shingle but not enough are dropped by their marks, before any text is moved for them."""
    seen, check = [], shingle_join.confirmed
    monkeypatch.setattr(shingle_join, "confirmed", lambda pairs, *a: seen.append(pairs.count()) or check(pairs, *a))
    texts = []
    for g in range(20):
        own = prose(200 + g, 60)
        texts += [" ".join(own + prose(300 + 2 * g + i, 60)) for i in (0, 1)]
    texts.append(texts[0] + " end")
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOCS)
    root = {r.doc_id: r.root for r in shingle_join.near_duplicates(df).collect()}
    assert root[0] == root[40] and len(set(root.values())) == 40
    assert sum(seen) <= 2


def test_marks_lose_no_pair(monkeypatch):
    """Sets of Jaccard 0.8 may reach it by their marks, whatever the sizes of their bitmaps, also where those are full."""
    r = np.random.default_rng(7)
    for most in (64, 1 << 15):
        monkeypatch.setattr(shingle_join, "MARKS", most)
        for n in (1, 2, 9, 15, 16, 17, 127, 128, 130, 1000):
            for lost_a, lost_b in ((0, 0), (n // 9, n // 9), (n // 4, 0), (0, n // 5), (n // 2, n // 2)):
                every = r.integers(-(2**63), 2**63 - 1, n + lost_a + lost_b)
                a, b = np.unique(every[: n + lost_a]), np.unique(np.r_[every[:n], every[n + lost_a :]])
                reaches = 5 * n >= 4 * (n + lost_a + lost_b)
                may = shingle_join.may_reach(shingle_join.marks(a), len(a), shingle_join.marks(b), len(b))
                assert may or not reaches
                if most > 64 and n == 1000 and lost_a == lost_b == 500:
                    assert not may
