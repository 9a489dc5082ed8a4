"""The seats and blocks of the mix against a plain loop; edge cases and the fit of the graded classifier."""

import random
from collections import defaultdict
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import apportion, ordinal

DOCS = "doc_id long, text string, source string"


def plain_targets(sizes):
    """Shares by weight, capped at three times the size, the excess reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def plain_mix(spark, df, seed=apportion.SEED):
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = df.withColumn("th", th).select(
        "doc_id", "source", "text", "th", F.xxhash64("doc_id", "th", F.lit(seed)).alias("cell"), F.xxhash64("source", F.lit(seed)).alias("start"), F.xxhash64(F.lit(seed), "th", "doc_id").alias("place")
    ).collect()
    size = [len((r.text or "").split()) for r in rows]
    sizes = defaultdict(int)
    for r, n in zip(rows, size):
        sizes[r.source] += n
    target, total = plain_targets(sizes), sum(size)
    shards = total // apportion.SHARD_WORDS + apportion.SHARDS
    block = max(1, total // (shards * apportion.SHARD_BLOCKS))
    own = {s: max(1, min(block, n // apportion.CELL_BLOCKS)) for s, n in sizes.items()}
    spread = {s: max(1, min(shards, n // (own[s] * apportion.CELL_BLOCKS))) for s, n in sizes.items()}
    cells = defaultdict(list)
    for i, r in enumerate(rows):
        cells[(r.source, (r.cell % spread[r.source] + r.start % shards) % shards)].append(i)
    words = {c: sum(size[i] for i in m) for c, m in cells.items()}
    n = {c: -(-words[c] // own[c[0]]) for c in cells}
    vote = {c: target[c[0]] * n[c] / sizes[c[0]] for c in cells if words[c]}
    quota = defaultdict(int)
    for g in {c[1] for c in cells}:
        here = [c for c in vote if c[1] == g]
        for _ in range(floor(sum(vote[c] for c in here) + 0.5)):
            open_ = [c for c in here if quota[c] < 3 * n[c]]
            if not open_:
                break
            quota[min(open_, key=lambda c: (-vote[c] / (2 * quota[c] + 1), c[0] is None, c[0] or ""))] += 1
    shift = {(r.source, r.g): r.h for r in spark.createDataFrame(list(cells), "source string, g long").withColumn("h", F.xxhash64("source", "g", F.lit(seed))).collect()}
    taken = {}
    for c, members in cells.items():
        at, k = 0, max(n[c], 1)
        for i in sorted(members, key=lambda i: (rows[i].place, rows[i].doc_id, rows[i].th)):
            mine = 0
            for w in range(at, at + size[i]):
                b = w // own[c[0]]
                mine += quota[c] // k + ((b * (apportion.PRIME % k) + shift[c] % k) % k < quota[c] % k)
            at += size[i]
            taken[rows[i].doc_id] = mine
    return taken, sizes, target


@pytest.mark.parametrize("counts", [{"a": 60, "b": 400, "c": 25, None: 90}, {"a": 3, "b": 1, "zz": 300, "y": 40, "x": 2}])
def test_seats_and_blocks_equal_a_plain_loop(spark, counts):
    r = random.Random(5)
    rows, i = [], 0
    for s, k in counts.items():
        for _ in range(k):
            rows.append((i, " ".join(f"w{r.randrange(99)}" for _ in range(r.choice((0, 1, 7, 40, 90)))), s))
            i += 1
    rows.append((i, None, "a"))
    df = spark.createDataFrame(rows, DOCS)
    taken, sizes, target = plain_mix(spark, df)
    got = apportion.mix(df.repartition(5)).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.taken == taken[x.doc_id] and x.source_size == sizes[x.source] and x.target == pytest.approx(target[x.source]), x


def test_thresholds_alone_give_the_shares_of_the_grades():
    rows = [(np.zeros(0, np.int64), np.zeros(0), g) for g in [0] * 10 + [1] * 30 + [2] * 60]
    w, t = ordinal.fit(rows)
    assert not w.any()
    assert ordinal.sigmoid(-t[0]) == pytest.approx(0.9, abs=0.02) and ordinal.sigmoid(-t[1]) == pytest.approx(0.6, abs=0.02)


def test_fit_climbs_the_likelihood():
    """A step of the weights along any coordinate doesn't raise the likelihood much: the fit is near the top of a small problem."""
    rows = [(np.array([k]), np.array([1.0]), g) for k, gs in ((3, (0, 0, 1)), (4, (1, 2, 1)), (5, (2, 2, 1))) for g in gs * 5]

    def loss(w, t):
        total = 0.0
        for i, x, g in rows:
            edge = np.concatenate([[1.0], ordinal.sigmoid(w[i] @ x - t), [0.0]])
            total -= np.log(edge[g] - edge[g + 1])
        return total / len(rows) + 5e-5 * (w @ w)

    w, t = ordinal.fit(rows, steps=2000)
    best = loss(w, t)
    for k in (3, 4, 5):
        for d in (-0.3, 0.3):
            step = w.copy()
            step[k] += d
            assert loss(step, t) > best - 1e-3
    assert w[3] < w[4] < w[5]


def test_graded_edges(spark):
    docs = "doc_id long, text string, low string, grade int, t string"
    rows = [(1, "good clean prose", "x", 9, "y"), (1, "good clean prose", "x", 9, "y"), (2, None, None, None, None), (3, "", "", 0, ""), (4, "bad " * 200_000, "", 1, ""), (None, "good", "", 1, "")]
    df = spark.createDataFrame(rows, docs)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (3, 0, 0), (4, 0, 1), (4, 1, 0), (None, 1, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    model = ordinal.train(df, ordinal.graded(labels))
    got = ordinal.score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.p_top <= 1 and 0 <= r.expected_grade <= 2 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.expected_grade, r.p_top))
    assert len(by[1]) == 1 and by[2] == by[3] and max(by[4]) < min(by[3]) < min(by[1])
    assert ordinal.score(df.where("false"), model).collect() == []
    empty = ordinal.train(df, ordinal.graded(labels.where("false")))
    assert not empty[0].any() and len({(r.expected_grade, r.p_top) for r in ordinal.score(df, empty).collect()}) == 1
