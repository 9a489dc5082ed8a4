"""Accounts: rebuilt books, daily value of holdings with carried cash, costs and turnover, checks of cash and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.scalars import ratio
from quantloom.operators.joins import day_index, with_calendar
from quantloom.operators.performance import YEAR
from quantloom.operators.trading import lot_shares

#: Days of a block in which intervals and prices meet.
BLOCK = 32


def _signed(x: Column) -> Column:
    return F.when(F.col("side") == "sell", -x).otherwise(x)


def paid(fee: Column | str = "fee") -> Column:
    """What a trade takes from cash: amount plus fee of a buy; a sale gives its amount less the fee."""
    return _signed(F.col("amount")) + (F.col(fee) if isinstance(fee, str) else fee)


def rebuild(book: DataFrame, lot: int = 100, fee: float = 0.001) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trades, shares and cash of accounts that move to target weights.

    book has account, code, prev_shares, weight, price and the account's cash (and capital, by which an account without shares is sized). Others are
    sized by cash plus the value of what they hold at these prices. Targets are lots; a name without a price above 0 isn't traded and keeps its shares.
    Trades: account, code, side, qty, price, amount, fee (both to the cent). Shares: account, code, shares over 0. Cash: account, cash.
    """
    by = Window.partitionBy("account")
    price, prev = F.col("price"), F.coalesce("prev_shares", F.lit(0))
    held = F.sum(prev * F.coalesce(price, F.lit(0.0))).over(by)
    value = F.col("cash") + held
    if "capital" in book.columns:
        value = F.when(F.max(prev).over(by) > 0, value).otherwise(F.col("capital"))
    target = F.when(price > 0, lot_shares(value, F.coalesce("weight", F.lit(0.0)), price, lot)).otherwise(prev)
    rows = book.withColumn("_prev", prev).withColumn("shares", target).withColumn("_d", F.col("shares") - F.col("_prev"))
    traded = rows.where("_d <> 0").withColumn("qty", F.abs("_d")).withColumn("amount", F.round(F.round(F.col("qty") * price, 6), 2))
    traded = traded.select("account", "code", F.when(F.col("_d") > 0, "buy").otherwise("sell").alias("side"), "qty", "price", "amount", F.round(F.round(F.col("qty") * price * fee, 6), 2).alias("fee"))
    spent = traded.groupBy("account").agg(F.sum(paid()).alias("_spent"))
    cash = book.select("account", "cash").distinct().join(spent, "account", "left").select("account", (F.col("cash") - F.coalesce("_spent", F.lit(0.0))).alias("cash"))
    return traded, rows.where("shares > 0").select("account", "code", "shares"), cash


def holding_intervals(trades: DataFrame) -> DataFrame:
    """account, code, shares, since, until (exclusive, null while held): what is held from one trade of the name to its next."""
    w = Window.partitionBy("account", "code").orderBy("date")
    daily = trades.groupBy("account", "code", "date").agg(F.sum(_signed(F.col("qty"))).alias("d"))
    rows = daily.withColumn("shares", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("until", F.lead("date").over(w))
    return rows.where("shares <> 0").select("account", "code", "shares", F.col("date").alias("since"), "until")


def account_nav(trades: DataFrame, prices: DataFrame, capital: float) -> DataFrame:
    """account, date, nav, cash, market_value, n_holdings for every date of the prices (date, code, close) from an account's first trade on.

    Intervals of constant shares meet the prices by name and block of days. A name without a price on a day is worth nothing that day and is still
    counted as held. Cash starts at `capital` and is carried from one trade date to the next.
    """
    calendar = prices.select("date").distinct()
    days = day_index(calendar)
    block = F.floor(F.unix_date("date") / BLOCK)
    last = calendar.agg(F.max("date").alias("_last"), F.lit(1).alias("_one"))
    spans = holding_intervals(trades).withColumn("_one", F.lit(1)).join(F.broadcast(last), "_one")  # one row
    spans = spans.withColumn("_end", F.coalesce(F.date_sub("until", 1), "_last")).where("since <= _end")
    number = lambda c: F.floor(F.unix_date(c) / BLOCK)
    pieces = spans.select("account", "code", "shares", "since", "_end", F.explode(F.sequence(number("since"), number("_end"))).alias("_b"))
    priced = pieces.join(prices.select("date", "code", "close").withColumn("_b", block), ["code", "_b"]).where("date between since and _end")
    value = priced.groupBy("account", "date").agg(F.sum(F.col("shares") * F.col("close")).alias("market_value"))

    moves = trades.groupBy("account", "date").agg(F.sum(paid()).alias("_spent"))
    moves = moves.unionByName(spans.select("account", F.col("since").alias("date"), F.lit(1).alias("_open")), allowMissingColumns=True)
    moves = moves.unionByName(spans.where("until is not null").select("account", F.col("until").alias("date"), F.lit(-1).alias("_open")), allowMissingColumns=True)
    marks = with_calendar(trades.select("account"), calendar).withColumn("_day", F.lit(True))
    w = Window.partitionBy("account").orderBy("date").rangeBetween(Window.unboundedPreceding, 0)
    run = moves.unionByName(marks, allowMissingColumns=True)
    run = run.select("account", "date", "_day", F.sum("_spent").over(w).alias("_spent"), F.sum("_open").over(w).alias("n_holdings")).where("_day and _spent is not null")
    out = run.join(value, ["account", "date"], "left").join(days, "date")
    cash, mv = capital - F.col("_spent"), F.coalesce("market_value", F.lit(0.0))
    return out.select("account", "date", ((cash + mv) / capital).alias("nav"), cash.alias("cash"), mv.alias("market_value"), F.coalesce("n_holdings", F.lit(0)).cast("long").alias("n_holdings"))


def cost_summary(trades: DataFrame, nav: DataFrame, capital: float) -> DataFrame:
    """account, traded, cost, cost_of_capital, cost_of_traded, cost_per_date, cash_share, one_way, annual_turnover from trades and `account_nav`."""
    t = trades.groupBy("account").agg(F.sum("amount").alias("traded"), F.sum("fee").alias("cost"), F.count_distinct("date").alias("_dates"))
    asset = F.col("cash") + F.col("market_value")
    n = nav.groupBy("account").agg(F.avg(ratio(F.col("cash"), asset)).alias("cash_share"), F.avg(asset).alias("_asset"), F.count("*").alias("_days"))
    one_way = ratio(F.col("traded") / 2, F.col("_asset"))
    return t.join(n, "account").select(
        "account", "traded", "cost", (F.col("cost") / capital).alias("cost_of_capital"), ratio(F.col("cost"), F.col("traded")).alias("cost_of_traded"),
        (F.col("cost") / F.col("_dates")).alias("cost_per_date"), "cash_share", one_way.alias("one_way"), (one_way * YEAR / F.col("_days")).alias("annual_turnover"),
    )


def cash_checks(nav: DataFrame) -> DataFrame:
    """account, overdrawn (days with cash below 0) and the lowest cash."""
    return nav.groupBy("account").agg(F.count(F.when(F.col("cash") < -0.005, 1)).alias("overdrawn"), F.min("cash").alias("lowest"))


def date_checks(trades: DataFrame, schedule: DataFrame) -> DataFrame:
    """account, missing and extra dates: scheduled (of date) but not traded, and traded off the schedule."""
    done = trades.select("account", "date").distinct().withColumn("_done", F.lit(1))
    due = with_calendar(trades.select("account"), schedule).withColumn("_due", F.lit(1))
    both = done.join(due, ["account", "date"], "full")
    return both.groupBy("account").agg(F.count(F.when(F.col("_done").isNull(), 1)).alias("missing"), F.count(F.when(F.col("_due").isNull(), 1)).alias("extra"))


def rebalance_summary(trades: DataFrame, nav: DataFrame) -> DataFrame:
    """A row per account and trade date: buys, sells, bought, sold, fees, and the day's holdings, value, cash and one-way turnover."""
    side = lambda s, x: F.coalesce(F.sum(F.when(F.col("side") == s, x)), F.lit(0.0))
    t = trades.groupBy("account", "date").agg(
        F.count(F.when(F.col("side") == "buy", 1)).alias("buys"), F.count(F.when(F.col("side") == "sell", 1)).alias("sells"),
        side("buy", F.col("amount")).alias("bought"), side("sell", F.col("amount")).alias("sold"), F.sum("fee").alias("fees"),
    )
    out = t.join(nav.select("account", "date", "n_holdings", "market_value", "cash"), ["account", "date"], "left")
    return out.withColumn("turnover", ratio((F.col("bought") + F.col("sold")) / 2, F.col("market_value") + F.col("cash")))
