"""Costs, decisions, trade lists and ledger checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.scalars import ratio

#: Commission, transfer fee, stamp duty on sales; redemption fee of funds held under so many days.
COMMISSION, TRANSFER, STAMP = 0.00025, 0.00001, 0.0005
REDEMPTION, SHORT_DAYS = 0.015, 7
DEAD_BAND = 1e-9
BOOK = ("portfolio", "date")


def cost_rate(kind: Column, delta: Column, days: Column) -> Column:
    """Cost of one unit traded: stocks pay on both sides and stamp duty on sales, funds only for early redemption."""
    stock = F.when(delta > 0, COMMISSION + TRANSFER).otherwise(COMMISSION + TRANSFER + STAMP)
    fund = F.when((delta < 0) & (days < SHORT_DAYS), REDEMPTION).otherwise(0.0)
    return F.when(F.abs(delta) <= DEAD_BAND, 0.0).when(kind == "etf", fund).otherwise(stock)


def rebalance_cost(changed: DataFrame, kind: Column, days: Column) -> DataFrame:
    """portfolio, date, cost of the changes from old to new weights."""
    d = F.col("new") - F.col("old")
    return changed.groupBy(*BOOK).agg(F.sum(F.abs(d) * cost_rate(kind, d, days)).alias("cost"))


def flat_cost(changed: DataFrame, rate: float) -> DataFrame:
    return changed.groupBy(*BOOK).agg((rate * F.sum(F.abs(F.col("new") - F.col("old"))) / 2).alias("cost"))


def trades(changed: DataFrame) -> DataFrame:
    """portfolio, date, code, side, size for changes over the dead band."""
    d = F.col("new") - F.col("old")
    return changed.where(F.abs(d) > DEAD_BAND).select(*BOOK, "code", F.when(d > 0, "buy").otherwise("sell").alias("side"), F.abs(d).alias("size"))


def decide(changed: DataFrame, threshold: float, least_days: int, kind: Column, share: float = 0.1) -> DataFrame:
    """changed (with score and hold_days) plus action, benefit, unit_cost and weight, by book.

    A name leaves if the best newcomer's score gains more over its own than the sale of one unit costs, by its kind and the days held, and if it
    was held long enough; else it keeps its old weight. A missing score is 0, missing days are 0. A book without old names takes the new ones.
    Weights are normalised by book.
    """
    book, score, days = Window.partitionBy(*BOOK), F.coalesce("score", F.lit(0.0)), F.coalesce("hold_days", F.lit(0))
    sell, buy = (F.col("old") > 0) & (F.col("new") == 0), (F.col("old") == 0) & (F.col("new") > 0)
    best = F.coalesce(F.max(F.when(buy, score)).over(book), F.lit(0.0))
    rows = changed.withColumn("benefit", F.when(sell, F.greatest(best - score, F.lit(0.0)) * share)).withColumn("unit_cost", F.when(sell, cost_rate(kind, F.lit(-1.0), days)))
    out = (F.col("benefit") - F.col("unit_cost") > threshold) & (days >= least_days)
    action = F.when(sell & out, "sell").when(sell, "keep").when(buy, "buy").otherwise("hold")
    rows = rows.withColumn("action", action).withColumn("weight", F.when(F.col("action") == "keep", F.col("old")).otherwise(F.col("new")))
    return rows.withColumn("weight", ratio(F.col("weight"), F.sum("weight").over(book)))


def decide_simple(changed: DataFrame) -> DataFrame:
    """changed plus action and weight: the new weights as they are."""
    action = F.when((F.col("old") > 0) & (F.col("new") == 0), "sell").when((F.col("old") == 0) & (F.col("new") > 0), "buy").otherwise("hold")
    return changed.withColumn("action", action).withColumn("weight", F.col("new"))


def decide_none(changed: DataFrame) -> DataFrame:
    """changed plus action and weight: the old weights stay."""
    return changed.withColumn("action", F.lit("hold")).withColumn("weight", F.col("old"))


def lot_shares(capital: Column, weight: Column, price: Column, lot: int = 100) -> Column:
    return F.when(price > 0, F.floor(capital * weight / price / lot) * lot).otherwise(0)


def trade_list(book: DataFrame, lot: int = 100, fee: float = 0.001) -> DataFrame:
    """account, code, side, qty, amount, fee from (account, code, prev_shares, weight, price, cash): the book is valued, targets are lots."""
    price, prev = F.col("price"), F.coalesce("prev_shares", F.lit(0))
    value = F.sum(prev * F.coalesce(price, F.lit(0.0))).over(Window.partitionBy("account")) + F.col("cash")
    target = lot_shares(value, F.coalesce("weight", F.lit(0.0)), price, lot)
    rows = book.where("price > 0").withColumn("_d", target - prev).where("_d <> 0")
    rows = rows.withColumn("qty", F.abs("_d")).withColumn("amount", F.col("qty") * price)
    return rows.select("account", "code", F.when(F.col("_d") > 0, "buy").otherwise("sell").alias("side"), "qty", "amount", F.round(F.round(F.col("amount") * fee, 6), 2).alias("fee"))


def ledger_checks(ledger: DataFrame, lot: int = 100, rate: float = 0.001) -> DataFrame:
    """account, rows, and rows that break a rule: lot multiple, fee, amount, shares below 0. ledger has qty, price, amount, fee, shares."""
    bad = lambda c: F.count(F.when(c, 1))
    return ledger.groupBy("account").agg(
        F.count("*").alias("n"), bad(F.col("qty") % lot != 0).alias("bad_lot"), bad(F.abs(F.col("fee") - rate * F.col("amount")) > 0.01).alias("bad_fee"),
        bad(F.abs(F.col("amount") - F.col("qty") * F.col("price")) > 0.01).alias("bad_amount"), bad(F.col("shares") < 0).alias("oversold"),
    )


def trade_summary(ledger: DataFrame) -> DataFrame:
    """account, date, buys, sells, bought, sold, fees."""
    side = lambda s: F.col("side") == s
    total = lambda s: F.coalesce(F.sum(F.when(side(s), F.col("amount"))), F.lit(0.0))
    return ledger.groupBy("account", "date").agg(
        F.count(F.when(side("buy"), 1)).alias("buys"), F.count(F.when(side("sell"), 1)).alias("sells"), total("buy").alias("bought"), total("sell").alias("sold"), F.sum("fee").alias("fees")
    )
