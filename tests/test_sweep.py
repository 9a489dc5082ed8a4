import datetime as dt
import random

from pyspark.sql import functions as F

from quantloom.operators import resample, sweep


def test_grid(spark):
    grid = resample.param_grid(spark, {"a": (1, 2, 3), "b": (0.0, 0.1, 11), "c": ["x", "y"]})
    assert grid.count() == grid.select("a", "b", "c").distinct().count() == 3 * 11 * 2
    assert {r.a for r in grid.collect()} == {1, 3, 5} and grid.agg({"b": "max"}).first()[0] == 1.0
    few = [sorted(r.point for r in resample.param_grid(spark, {"a": (1, 2, 3), "b": (0.0, 0.1, 11)}, 10).collect()) for _ in range(2)]
    assert few[0] == few[1] and len(few[0]) == 10


def test_triggered_dates_against_a_loop(spark):
    rng, day = random.Random(3), dt.date(2024, 1, 1)
    rets = [rng.gauss(0, 0.002 if i % 40 < 20 else 0.03) for i in range(150)]
    df = spark.createDataFrame([("s", day + dt.timedelta(i), r) for i, r in enumerate(rets)], "strategy string, date date, ret double")
    want, last = [], None
    for i in range(20, len(rets)):
        past = rets[i - 20 : i]
        mean = sum(past) / 20
        vol = (sum((x - mean) ** 2 for x in past) / 19) ** 0.5 * 242**0.5
        if vol > 0.3 and (last is None or i - last >= 7):
            want.append(day + dt.timedelta(i))
            last = i
    assert sorted(r.date for r in sweep.triggered_dates(df, 0.3, 20, 7).collect()) == want and want


def test_deflated_sharpe_of_luck_and_skill(spark):
    rng, day = random.Random(1), dt.date(2024, 1, 1)
    rows = [("s", day + dt.timedelta(i), rng.gauss(0.0, 0.01)) for i in range(40)]
    df = spark.createDataFrame(rows, "strategy string, date date, ret double")
    one, many = resample.deflated_sharpe(df, 1, 50).first(), resample.deflated_sharpe(df, 20, 50).first()
    assert 0.2 < one.dsr < 0.8 and many.dsr > 0.95


def test_resamples_against_a_loop(spark):
    rng, day, p = random.Random(5), dt.date(2024, 1, 1), 2_147_483_647
    rets = [rng.gauss(0.001, 0.01) for _ in range(37)]
    df = spark.createDataFrame([("s", day + dt.timedelta(i), r) for i, r in enumerate(rets)] + [("short", day, 0.1)], "strategy string, date date, ret double")
    got = {r.sample: r.sharpe for r in resample.bootstrap(df, 130, 7).collect()}
    assert set(got) == set(range(130))
    for sample in (0, 1, 63, 64, 129):
        xs = []
        for i in range(37):
            x = (sample * 48271 + i * 16807 + 7) % p
            x = (x * x % p * 69621 + i + 7) % p
            xs.append(rets[x * x % p % 37])
        mean = sum(xs) / 37
        sd = (sum((v - mean) ** 2 for v in xs) / 36) ** 0.5
        assert abs(got[sample] - mean / sd * 242**0.5) < 1e-9
    places = [x for r in spark.range(2000).select(resample.draw(F.col("id"), F.lit(3), F.lit(10), 1).alias("x")).collect() for x in [r.x]]
    assert all(140 < places.count(v) < 260 for v in range(10))


def test_student_p(spark):
    """Table values of the t distribution."""
    known = [(1.0, 1, 0.5), (12.706, 1, 0.05), (4.303, 2, 0.05), (2.228, 10, 0.05), (2.042, 30, 0.05), (-2.262, 9, 0.05), (3.291, 100_000, 0.001), (0.0, 5, 1.0)]
    df = spark.createDataFrame([(t, n) for t, n, _ in known if n < 10_000], "t double, n int")
    got = [r.p for r in df.select(resample.student_p(F.col("t"), F.col("n")).alias("p")).collect()]
    assert all(abs(a - p) < 2e-4 for a, (_, n, p) in zip(got, [k for k in known if k[1] < 10_000]))


def test_sweep_signals_against_a_loop(spark):
    rng, day, price, prices = random.Random(2), dt.date(2024, 1, 1), 100.0, []
    for _ in range(60):
        price *= 1 + rng.gauss(0, 0.02)
        prices.append(price)
    df = spark.createDataFrame([("s", day + dt.timedelta(i), x) for i, x in enumerate(prices)], "series string, date date, close double")
    for r in resample.sweep(df, {"window": (2, 3, 4), "margin": [0.0, 0.01]}, resample.trend).collect():
        nav = 1.0
        for i in range(1, 60):
            past = prices[max(0, i - r.window) : i]
            if len(past) == r.window and prices[i - 1] > sum(past) / r.window * (1 + r.margin):
                nav *= prices[i] / prices[i - 1]
        assert abs(r.total_return - (nav - 1)) < 1e-9
