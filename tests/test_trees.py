"""Trees of many models against plain loops over one model at a time."""

import random

import pytest
from pyspark.sql import functions as F

from quantloom.operators import training, trees


def plain_tree(rows, features, depth, leaf, allowed):
    """{node: (feature, bin)} and {node: mean}; rows are (bins, target, weight)."""
    splits, means = {}, {}

    def mean(rs):
        return sum(w * round(g * 1e9) for _, g, w in rs) / 1e9 / sum(w for *_, w in rs)

    def grow(node, rs, level):
        means[node] = mean(rs)
        if level == depth:
            return
        best, s0, n0 = None, sum(w * g for _, g, w in rs), sum(w for *_, w in rs)
        for f in features:
            for b in sorted({x[f] for x, *_ in rs}):
                left = [r for r in rs if r[0][f] <= b]
                sl, nl = sum(w * g for _, g, w in left), sum(w for *_, w in left)
                if allowed(node, f) and nl >= leaf and n0 - nl >= leaf:
                    gain = round(sl * sl / nl + (s0 - sl) ** 2 / (n0 - nl) - s0 * s0 / n0, 9)
                    if gain > 1e-9 and (best is None or (gain, -f, -b) > best):
                        best = (gain, -f, -b)
        if best:
            f, b = -best[1], -best[2]
            splits[node] = (f, b)
            grow(2 * node, [r for r in rs if r[0][f] <= b], level + 1)
            grow(2 * node + 1, [r for r in rs if r[0][f] > b], level + 1)

    grow(1, rows, 0)
    return splits, means


def value(tree, x):
    splits, means = tree
    node = 1
    while node in splits:
        f, b = splits[node]
        node = 2 * node + (x[f] > b)
    return means[node]


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    return [(d, 10, f"2023-{i % 12 + 1:02}-01", f"c{i}", float(i % 8 > 3) + 0.3 * float(i % 5 > 2) * k + rng.gauss(0, 0.1), [i % 8, i % 5, rng.randrange(8)]) for k, d in ((1, "2024-01-01"), (-2, "2024-02-01")) for i in range(90)]


def test_all_models_at_once(spark, data):
    df = spark.createDataFrame(data, "decision string, window int, date string, code string, y double, bins array<int>")
    kinds = {"forest": {"c": {"trees": 2, "depth": 2, "columns": 0.6}}, "boosted": {"c": {"trees": 2, "depth": 2, "rate": 0.5, "leaf": 3}, "d": {"trees": 1, "depth": 1, "rate": 1.0}}, "extra": {"c": {"trees": 1, "depth": 2}}}
    experts = trees.expert_grid(spark, {"all": [0, 1, 2], "two": [1, 2]}, [10], kinds)
    models = trees.fit(df.repartition(3), experts)
    got = {(r.decision, r.expert, r.code): r.prediction for r in trees.predict(models, df).collect()}
    again = {(r.decision, r.expert, r.code): r.prediction for r in trees.predict(trees.fit(df.repartition(7, "code"), experts), df).collect()}
    assert got == again and len(got) == 2 * 8 * 90
    for decision in ("2024-01-01", "2024-02-01"):
        rows = [r for r in data if r[0] == decision]
        for name, features in (("all", [0, 1, 2]), ("two", [1, 2])):
            for hyper, n, depth, rate, leaf in (("c", 2, 2, 0.5, 3), ("d", 1, 1, 1.0, 5)):
                base = sum(round(r[4] * 1e9) for r in rows) / len(rows) / 1e9
                pred = {r[3]: base for r in rows}
                for _ in range(n):
                    tree = plain_tree([(r[5], r[4] - pred[r[3]], 1) for r in rows], features, depth, leaf, lambda *_: True)
                    pred = {r[3]: pred[r[3]] + rate * value(tree, r[5]) for r in rows}
                assert all(abs(got[decision, f"boosted_{hyper}_{name}_w10", c] - p) < 1e-6 for c, p in pred.items())
            expert = f"forest_c_{name}_w10"
            total = dict.fromkeys([r[3] for r in rows], 0.0)
            for t in range(2):
                keys = spark.createDataFrame([(expert, t, r[3], r[2]) for r in rows], "expert string, tree int, code string, date string")
                u = {r.code: r.u for r in keys.select("code", trees._uniform("expert", "tree", "code", "date").alias("u")).collect()}
                open_ = spark.range(1, 4).select(F.col("id").cast("int").alias("node"), F.explode(F.array(*map(F.lit, features))).alias("feature"))
                open_ = open_.withColumn("expert", F.lit(expert)).withColumn("tree", F.lit(t))
                share = {(r.node, r.feature): r.u for r in open_.select("node", "feature", trees._uniform("expert", "tree", "node", "feature", F.lit("c")).alias("u")).collect()}
                weighted = [(r[5], r[4], sum(u[r[3]] >= p for p in trees.POISSON)) for r in rows]
                tree = plain_tree([x for x in weighted if x[2]], features, 2, 5, lambda node, f: share[node, f] < 0.6)
                for r in rows:
                    total[r[3]] += value(tree, r[5]) / 2
            assert all(abs(got[decision, expert, c] - p) < 1e-6 for c, p in total.items())


def test_sets_and_bins(spark):
    days = [f"2024-01-{i + 1:02}" for i in range(30)]
    rows = [(d, f"c{c}", float(i * 3 + c) if (i + c) % 4 else None, 5.0, float(c) if i < 28 else None) for i, d in enumerate(days) for c in range(6)]
    p = spark.createDataFrame(rows, "date string, code string, x double, flat double, label double").withColumn("date", F.to_date("date"))
    at = p.where("day(date) in (12, 21)").select("date").distinct()
    sets = training.training_sets(p, at, [5, 15], 2, "label", 4, 20)
    assert {(str(r.decision), r.window, r["count"]) for r in sets.groupBy("decision", "window").count().collect()} == {("2024-01-12", 15, 54), ("2024-01-21", 15, 78)}
    stats = training.window_stats(sets, ["x", "flat"], 0.1)
    z = training.scaled(sets, stats, ["x", "flat"]).agg(F.avg("x"), F.max(F.abs("flat"))).first()
    assert abs(z[0]) < 1e-9 and z[1] == 0.0
    b = training.binned(sets, stats, ["x", "flat"], 4)
    assert {tuple(r.bins)[1] for r in b.collect()} == {0} and {tuple(r.bins)[0] for r in b.collect()} == {0, 1, 2, 3}
    late = spark.createDataFrame([("2024-02-02",), ("2024-02-20",), ("2024-01-03",)], "date string").select(F.to_date("date").alias("date"))
    assert {str(r.decision) for r in training.prediction_rows(p, late).collect()} == {"2024-02-02", "2024-01-03"}
