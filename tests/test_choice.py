import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantloom.functions import codes
from quantloom.operators import accounts, evaluation, portfolio, trading

DAY = dt.date(2024, 1, 1)


def changed(spark, rows):
    return spark.createDataFrame([("p", DAY, *r) for r in rows], "portfolio string, date date, code string, old double, new double, hold_days int, score double")


@pytest.mark.parametrize(
    "old_score, new_score, days, threshold, least, sold",
    [(0.1, 0.9, 10, 0.0, 0, True), (0.0, 1.0, 5, 0.0, 30, False), (0.1, 0.1001, 10, 0.0, 0, False), (0.1, 0.9, 10, 0.08, 0, False), (None, 0.9, 10, 0.0, 0, True)],
)
def test_cost_benefit(spark, old_score, new_score, days, threshold, least, sold):
    rows = changed(spark, [("000001.SZ", 1.0, 0.0, days, old_score), ("000002.SZ", 0.0, 1.0, None, new_score)])
    got = {r.code: r for r in trading.decide(rows, threshold, least, codes.asset_type(F.col("code"))).collect()}
    assert got["000001.SZ"].action == ("sell" if sold else "keep") and got["000002.SZ"].action == "buy"
    assert got["000001.SZ"].unit_cost == pytest.approx(0.00076)
    assert got["000001.SZ"].weight == (0.0 if sold else 0.5) and sum(r.weight for r in got.values()) == pytest.approx(1.0)


def test_first_book_and_funds(spark):
    first = trading.decide(changed(spark, [("a", 0.0, 0.5, None, None), ("b", 0.0, 0.5, None, None)]), 0.0, 30, F.lit("stock"))
    assert {(r.code, r.action, r.weight) for r in first.collect()} == {("a", "buy", 0.5), ("b", "buy", 0.5)}
    rows = changed(spark, [("510300.XSHG", 0.5, 0.0, 3, 0.0), ("510500.XSHG", 0.5, 0.0, 9, 0.0), ("x", 0.0, 1.0, None, 0.1)])
    got = {r.code: r.action for r in trading.decide(rows, 0.0, 0, codes.asset_type(F.col("code"))).collect()}
    assert got == {"510300.XSHG": "keep", "510500.XSHG": "sell", "x": "buy"}  # 0.01 gained against a fee of 0.015, and none


def _table(spark, series):
    rows = [(f, DAY + dt.timedelta(i), x, 20) for f, xs in series.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "factor string, date date, ic double, n int")


def test_a_factor_left_out_removes_none(spark):
    """b is left out for a; c is close to b and not to a, so it stays. d has too few ICs, e too small ones."""
    n = 40
    u, v = [(-1) ** i * 0.01 for i in range(n)], [(-1) ** (i // 2) * 0.01 for i in range(n)]
    mix = lambda m, p, q: [m + p * x + q * y for x, y in zip(u, v)]
    table = _table(spark, {"a": mix(0.09, 1, 0), "b": mix(0.08, 0.8, 0.6), "c": mix(0.07, 0.3, 1.0), "d": mix(0.5, 1, 1)[:9], "e": mix(0.0001, 1, -1)})
    days = spark.createDataFrame([(DAY + dt.timedelta(n),), (DAY + dt.timedelta(9),), (DAY + dt.timedelta(8),)], "date date")
    got = evaluation.strong_factors(table, days, 0.02, 0.1, 0.75).collect()
    assert [r.factor for r in sorted(got, key=lambda r: r["rank"]) if r.date == DAY + dt.timedelta(n)] == ["a", "c"]
    assert {r.date for r in got} == {DAY + dt.timedelta(n), DAY + dt.timedelta(9)}  # the last day counts, nine days are too few
    assert len([r for r in evaluation.strong_factors(table, days.limit(1), 0.02, 0.1, 0.99, most=2).collect()]) == 2


def test_top_factors(spark):
    t = _table(spark, {"f1": [0.1] * 3, "f2": [-0.3] * 3, "f3": [0.2, 0.2, -0.2]})
    assert [r.factor for r in evaluation.top_factors(t).collect()] == ["f2", "f3", "f1"] or [r.factor for r in evaluation.top_factors(t).collect()] == ["f2", "f1", "f3"]
    assert [r.factor for r in evaluation.top_factors(t, str(DAY + dt.timedelta(1))).collect()] == ["f2", "f3", "f1"]
    many = _table(spark, {f"f{i:02}": [i / 100] for i in range(20)})
    assert [r.factor for r in evaluation.top_factors(many).collect()] == [f"f{i:02}" for i in range(19, 4, -1)]


def test_rolling_ic_sees_no_return_of_the_future(spark):
    days = [DAY + dt.timedelta(i) for i in range(40)]
    prices = [(d, str(c), 1000.0 + (c * i if i < 30 else -c * i)) for i, d in enumerate(days) for c in range(12)]
    p = spark.createDataFrame(prices, "date date, code string, close double")
    scores = p.select("date", "code", F.lit("f").alias("factor"), F.col("code").cast("double").alias("score"))
    at = spark.createDataFrame([(days[28],), (days[3],)], "date date")
    got = {r.date: r.ic for r in evaluation.rolling_factor_ic(scores, p, at, 20, 2).collect()}
    assert got[days[28]] == pytest.approx(1.0) and got[days[3]] is None
    late = evaluation.rolling_factor_ic(scores, p, spark.createDataFrame([(days[39],)], "date date"), 6, 2).first()
    assert late.ic == pytest.approx(-1.0)


def test_constrained_book(spark):
    w = spark.createDataFrame([("p", DAY, c, i, x) for c, i, x in (("a", "s", 0.5), ("b", "s", 0.3), ("c", "t", 0.2))], "portfolio string, date date, code string, industry string, weight double")
    got = {r.code: r.weight for r in portfolio.constrain(w, None, 0.4, 0.5, least=3).collect()}
    a, b = 0.4, 0.3 + 0.1 * 0.3 / 0.5
    assert got == {"a": pytest.approx(a * 0.5 / (a + b)), "b": pytest.approx(b * 0.5 / (a + b)), "c": pytest.approx(0.24)}
    old = spark.createDataFrame([("p", DAY, "z", 1.0)], "portfolio string, date date, code string, weight double")
    moved = {r.code: r.weight for r in portfolio.constrain(w, old, 1.0, limit=0.25).collect()}
    assert moved == {"a": pytest.approx(0.125), "b": pytest.approx(0.075), "c": pytest.approx(0.05), "z": pytest.approx(0.75)}


def test_rebuilt_account(spark):
    """Sell 002, trim 001, buy 003; a name without a price is neither traded nor lost; a first book is sized by its capital."""
    rows = [("m", "001", 3000, 0.2, 10.0, 1000.0, 9e9), ("m", "002", 1000, None, 20.0, 1000.0, 9e9), ("m", "003", None, 0.5, 5.0, 1000.0, 9e9), ("m", "004", 700, 0.1, None, 1000.0, 9e9), ("n", "001", None, 0.1, 10.0, 5.0, 1e7), ("n", "009", None, 0.5, -1.0, 5.0, 1e7)]
    book = spark.createDataFrame(rows, "account string, code string, prev_shares int, weight double, price double, cash double, capital double")
    trades, shares, cash = accounts.rebuild(book)
    got = {(r.account, r.code): (r.side, r.qty, r.amount, r.fee) for r in trades.collect()}
    assert got == {("m", "001"): ("sell", 2000, 20000.0, 20.0), ("m", "002"): ("sell", 1000, 20000.0, 20.0), ("m", "003"): ("buy", 5100, 25500.0, 25.5), ("n", "001"): ("buy", 100_000, 1e6, 1000.0)}
    assert {(r.account, r.code): r.shares for r in shares.collect()} == {("m", "001"): 1000, ("m", "003"): 5100, ("m", "004"): 700, ("n", "001"): 100_000}
    assert {r.account: r.cash for r in cash.collect()} == {"m": pytest.approx(1000 + 40000 - 40 - 25525.5), "n": pytest.approx(5 - 1001000)}


def test_account_nav(spark):
    d = [DAY + dt.timedelta(i) for i in (0, 1, 40, 41, 80)]
    prices = spark.createDataFrame([(x, "a", 10.0 + i) for i, x in enumerate(d)] + [(d[3], "b", 1.0)], "date date, code string, close double")
    trades = [("m", d[1], "a", "buy", 10.0, 110.0, 1.0), ("m", d[3], "a", "sell", 10.0, 130.0, 1.0), ("m", d[3], "b", "buy", 5.0, 5.0, 0.0)]
    nav = accounts.account_nav(spark.createDataFrame(trades, "account string, date date, code string, side string, qty double, amount double, fee double"), prices, 1000.0)
    got = {r.date: (r.cash, r.market_value, r.n_holdings, round(r.nav, 6)) for r in nav.collect()}
    assert got == {d[1]: (889.0, 110.0, 1, 0.999), d[2]: (889.0, 120.0, 1, 1.009), d[3]: (1013.0, 5.0, 1, 1.018), d[4]: (1013.0, 0.0, 1, 1.013)}
