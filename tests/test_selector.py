import random

import pytest
from pyspark.sql import functions as F

from quantloom.operators import cross_section, portfolio, rotation, selector
from quantloom.operators.windows import pct_change

VOTED = {"strength": 4, "votes": {1: 0.5, 3: 0.5}}


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(4)
    rows, index = [], []
    level = {(i, c): 50.0 + 10 * c for i in range(8) for c in range(4)}
    for d in range(40):
        day = f"2024-{d // 28 + 1:02}-{d % 28 + 1:02}"
        for k in level:
            level[k] *= 1 + r.uniform(-0.05, 0.05 - 0.02 * (d > 25))
            rows.append((day, f"{k[0]}{k[1]}", f"ind{k[0]}", level[k], r.uniform(1, 100), 1 / level[k]))
        index.append((day, sum(level.values())))
    panel = spark.createDataFrame(rows, "date string, code string, industry string, close double, volume double, ep double").withColumn("date", F.to_date("date"))
    return panel.cache(), spark.createDataFrame(index, "date string, close double").withColumn("date", F.to_date("date")).cache()


def books(df):
    return {(str(r.date), r.code): r.weight for r in df.collect() if r.code is not None}


def test_equals_the_chain_of_single_operators(spark, tables):
    panel, index = tables
    v = selector.Rotation("v", 2, 5, 0.4, 0.6, industries=3, per_industry=2, **VOTED, leaders=2, risk=(2, 2), crowding=(1, 2), cheapness=(0.3, 2), weighting="strength", cap=0.2, market=(10, 4))
    got = selector.select(panel, index, [v], panel, ["volume"], (12, 4), (12, 4))

    c = F.col("close")
    codes = panel.select("date", "code", "industry", (0.4 * pct_change(c, 2) + 0.6 * pct_change(c, 5)).alias("mom"), pct_change(c, 2).alias("m2"))
    ind = panel.groupBy("date", "industry").agg(F.avg("close").alias("close"), F.avg("volume").alias("volume"), F.avg("ep").alias("ep"))
    rs = rotation.strength(ind.join(index.withColumnRenamed("close", "index"), "date"), 4, [1, 3])
    held = rotation.vote(rs, {"rs_mom_1": 0.5, "rs_mom_3": 0.5}, 0.5, 3, 2)
    held = rotation.risk_filter(held, codes.groupBy("date", "industry").agg(F.avg("m2").alias("mom")), 2).drop("mom")
    held = rotation.crowding_filter(held, ind.select("date", "industry", rotation.crowding(["volume"], n=12, least=4).alias("crowded")), 1, 2)
    held = rotation.valuation_filter(held, ind.select("date", "industry", rotation.industry_percentile("ep", 12, 4).alias("cheap")), 0.3, 2)
    names = cross_section.top_n(codes.where("mom is not null").join(held.select("date", "industry"), ["date", "industry"]), "mom", 2, ("date", "industry")).drop("rank")
    names = names.withColumn("portfolio", F.lit("v")).join(rs.select("date", "industry", "rs_ratio"), ["date", "industry"])
    want = portfolio.scale_by_market(portfolio.weight_cap(portfolio.strength_weight(names, "rs_ratio"), 0.2), rotation.step_scale(index, 10, 4))
    a, b = books(got), {k: w for k, w in books(want).items() if w > 0}
    assert a.keys() == b.keys() and len(a) > 30
    assert all(a[k] == pytest.approx(b[k]) for k in a)


def test_scale_zero_empties_a_book_and_versions_do_not_mix(spark, tables):
    panel, index = tables
    one = selector.Rotation("one", 2, 5, industries=2, market=(10, 4))
    two = selector.Rotation("two", 3, 6, industries=3, per_industry=1, **VOTED, weighting="inverse_vol", vol_rows=5)
    both = selector.select(panel, index, [one, two], panel)
    for v in (one, two):
        alone, mixed = books(selector.select(panel, index, [v], panel)), books(both.where(F.col("version") == v.name))
        assert alone.keys() == mixed.keys() and all(alone[k] == pytest.approx(mixed[k]) for k in alone)
    rows = both.where("version = 'one'").collect()
    empty = [r for r in rows if r.code is None]
    scale = {r.date: r.scale for r in rotation.step_scale(index, 10, 4).collect()}
    assert empty and all(r.scale == 0 and r.weight is None for r in empty)
    assert {r.date for r in empty} == {d for d in {r.date for r in rows} if scale[d] == 0}
    total = {}
    for r in rows:
        total[r.date] = total.get(r.date, 0) + (r.weight or 0)
    assert all(t == pytest.approx(scale[d]) for d, t in total.items())


def test_scores_missing_and_turned(spark, tables):
    panel, index = tables
    last = panel.agg(F.max("date")).first()[0]
    p = panel.withColumn("score", F.when(F.substring("code", 2, 1) == "3", 1.0)).withColumn("reversal", F.col("close"))
    v = [selector.Rotation("plain", 2, 5, per_industry=1, by_score=True), selector.Rotation("none", 2, 5, per_industry=1), selector.Rotation("turned", 2, 5, per_industry=1, turn=(0, "sign"))]
    day = spark.createDataFrame([(last,)], "date date")
    got = selector.select(p, index, v, day).collect()
    assert {r.code[1] for r in got if r.version == "plain"} == {"3"}
    mom = {r.code: r.m for r in panel.withColumn("m", 0.5 * pct_change(F.col("close"), 2) + 0.5 * pct_change(F.col("close"), 5)).where(F.col("date") == F.lit(last)).collect()}
    for name, of in (("none", max), ("turned", min)):
        assert all(r.code == of((c for c in mom if c[0] == r.code[0]), key=mom.get) for r in got if r.version == name)
    unscored = selector.select(panel, index, v[:2], day).collect()
    assert {r.code for r in unscored if r.version == "plain"} == {r.code for r in unscored if r.version == "none"}


def test_empty_panel(spark, tables):
    panel, index = tables
    assert selector.select(panel.where("false"), index, [selector.Rotation("v")], panel).collect() == []
