import math
import re
from collections import Counter

import pytest

from quantloom.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
terms = lambda x: TERM.findall((x or "").translate(LOW))


def plain(items, docs, k):
    """(item_id, rank, doc_id, score) by scoring every document for every item; docs and items are (id, text)."""
    held = [(d, c) for d, t in docs if (c := Counter(terms(t)))]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    asked, out = {}, []
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    for i, ts in asked.items():
        found = []
        for d, c in held:
            m = 50 + (50 * sum(c.values()) * n) // length
            s = sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return out


def rows(df):
    return [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()]


by = lambda r: tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("step, shard, block", [(64, 200_000, 1 << 25), (1, 40, 2_000), (2, 40, 1 << 25)])
def test_best_positions_against_every_score(spark, monkeypatch, step, shard, block):
    """Small steps stop early; small shards and blocks are merged."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    monkeypatch.setattr(ranked_search, "STEP", step)
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", shard)
    docs, items = read("documents"), read("benchmark").limit(6)
    k = 5 if step < 64 else 50
    shards = lambda: list(ranked_search._shards(iter(post.toArrow().to_batches(max_chunksize=3))))
    post = ranked_search.postings(docs, ["the"])
    assert step == 64 or len(shards()) > 1
    got = rows(ranked_search.search(items, docs, k, block))
    want = plain([tuple(r) for r in items.select("item_id", "text").collect()], [tuple(r) for r in docs.select("doc_id", "text").collect()], k)
    assert sorted(got, key=by) == sorted(want, key=by) and got


def test_early_stop_reads_less():
    """Lists whose heads agree let a shard stop before their ends, and never at an equal sum."""
    import numpy as np

    size = 5_000
    ids, n = np.arange(size), np.full(size, 10)
    counts = np.where(np.arange(size) < 3, 9, 1)
    shard = ranked_search.Shard(ids, n, np.full(size, 2), np.tile([0, 1], size).astype(np.int32), np.repeat(counts, 2).astype(np.int32), np.array([100, 7]), size, size * 10)
    met, direct = [], shard.direct
    shard.direct = lambda new: (met.append(len(new)), direct(new))[1]
    slots, scores = shard.top(np.array([0, 1]), 3)
    assert slots.tolist() == [0, 1, 2] and sum(met) < 100
    assert shard.top(np.array([0, 1]), 4)[0].tolist() == [0, 1, 2, 3] and not shard.seen.any() and not shard.seen_at.any()


def test_odd_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows, repeated items, clashing names."""
    docs = [(None, "alpha Beta"), (3, "alpha beta"), (3, "alpha beta"), (2**60 + 1, "ALPHA beta"), (4, None), (5, ""), (6, "!!"), (7, "zeta é1 " * 60_000), (8, "gamma")]
    items = [(1, "alpha beta alpha"), (1, "É1 é1"), (2, None), (3, ""), (None, "gamma-zeta"), (2**60 + 3, "beta")]
    d = spark.createDataFrame([(*x, "a", 0) for x in docs], "doc_id long, text string, term string, score int")
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = rows(ranked_search.search(i, d))
    assert sorted(got, key=by) == sorted(plain(items, docs, 50), key=by) and {r[0] for r in got} == {1, None, 2**60 + 3}
    assert ranked_search.search(i, d.limit(0)).count() == 0 == ranked_search.search(i.limit(0), d).count()
