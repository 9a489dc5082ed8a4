"""Returns, performance and risk, partitioned by strategy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.scalars import correlation, ratio

YEAR = 242
RISK_FREE = 0.02


def nav(returns: DataFrame) -> DataFrame:
    """strategy, date, ret, nav, drawdown; the first drawdown is 0 by definition."""
    w = Window.partitionBy("strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = returns.withColumn("nav", F.product(1 + F.col("ret")).over(w))
    return out.withColumn("drawdown", F.col("nav") / F.max("nav").over(w) - 1)


def metrics(returns: DataFrame) -> DataFrame:
    """One row per strategy: totals, volatility, Sharpe, Sortino, drawdown, Calmar, VaR, moments, wins and losses."""
    r = F.col("ret")
    base = nav(returns)
    cut = returns.groupBy("strategy").agg(F.percentile("ret", F.lit(0.05)).alias("var_95"))
    rows = base.join(cut, "strategy")
    gain, loss = F.sum(F.when(r > 0, r)), -F.sum(F.when(r < 0, r))
    a = rows.groupBy("strategy").agg(
        F.count("*").alias("n"),
        (F.product(1 + r) - 1).alias("total_return"),
        (F.stddev_samp(r) * YEAR**0.5).alias("volatility"),
        (F.stddev_samp(F.when(r < 0, r)) * YEAR**0.5).alias("_down"),
        F.min("drawdown").alias("max_drawdown"),
        F.first("var_95").alias("var_95"),
        F.avg(F.when(r <= F.col("var_95"), r)).alias("cvar_95"),
        F.when(F.count(r) < 3, 0.0).otherwise(F.skewness(r)).alias("skewness"),
        F.when(F.count(r) < 4, 0.0).otherwise(F.kurtosis(r)).alias("kurtosis"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.avg(F.when(r > 0, r)).alias("avg_win"),
        F.avg(F.when(r < 0, r)).alias("avg_loss"),
        F.when(loss > 0, ratio(F.coalesce(gain, F.lit(0.0)), loss)).otherwise(F.when(gain > 0, float("inf")).otherwise(0.0)).alias("profit_factor"),
    )
    a = a.withColumn("annual_return", F.pow(1 + F.col("total_return"), YEAR / F.col("n")) - 1)
    excess = F.col("annual_return") - RISK_FREE
    return (
        a.withColumn("sharpe", ratio(excess, F.col("volatility")))
        .withColumn("sortino", ratio(excess, F.col("_down")))
        .withColumn("calmar", F.coalesce(ratio(F.col("annual_return"), F.abs("max_drawdown")), F.lit(0.0)))
        .drop("_down")
    )


def full_metrics(returns: DataFrame, by: tuple = ("strategy",), benchmark: DataFrame | None = None) -> DataFrame:
    """One row per key of `by`: the figures of `metrics`, the first and last day, duration, last NAV and, against benchmark (date, bench), excess figures.

    duration counts rows from the first peak to the first deepest trough. Undefined ratios are 0: Sharpe and Calmar of a flat series, Sortino without
    losses, information_ratio (annualised excess over tracking error) without tracking error; daily_ratio is the mean excess over its deviation. Only days
    that the benchmark has count there. All figures come from one partitioning by key.
    """
    r = F.col("ret")
    key = Window.partitionBy(*by)
    run = key.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = returns if benchmark is None else returns.join(benchmark.select("date", "bench"), "date", "left")
    rows = rows.withColumn("_e", F.lit(None).cast("double") if benchmark is None else r - F.col("bench"))
    rows = rows.withColumn("_i", F.row_number().over(key.orderBy("date"))).withColumn("_v", F.percentile("ret", F.lit(0.05)).over(key))
    rows = rows.withColumn("_nav", F.product(1 + r).over(run))
    rows = rows.withColumn("_top", F.max(F.struct(F.col("_nav").alias("nav"), (-F.col("_i")).alias("at"))).over(run))
    rows = rows.withColumn("_dd", F.col("_nav") / F.col("_top.nav") - 1)
    gain, loss, down = F.sum(F.when(r > 0, r)), -F.sum(F.when(r < 0, r)), F.stddev_samp(F.when(r < 0, r)) * YEAR**0.5
    annual = lambda total, n: F.pow(1 + total, YEAR / F.col(n)) - 1
    a = rows.groupBy(*by).agg(
        F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count("*").alias("n"), F.max_by("_nav", "_i").alias("final_nav"),
        (F.stddev_samp(r) * YEAR**0.5).alias("volatility"), down.alias("_down"), F.min(F.struct(F.col("_dd").alias("dd"), F.col("_i").alias("at"), F.col("_top.at").alias("peak"))).alias("_low"),
        F.first("_v").alias("var_95"), F.avg(F.when(r <= F.col("_v"), r)).alias("cvar_95"),
        F.when(F.count(r) < 3, 0.0).otherwise(F.skewness(r)).alias("skewness"), F.when(F.count(r) < 4, 0.0).otherwise(F.kurtosis(r)).alias("kurtosis"),
        F.avg((r > 0).cast("double")).alias("win_rate"), F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(F.when(r < 0, r)), F.lit(0.0)).alias("avg_loss"),
        F.when(loss > 0, ratio(F.coalesce(gain, F.lit(0.0)), loss)).otherwise(F.when(gain > 0, float("inf")).otherwise(0.0)).alias("profit_factor"),
        (F.product(1 + F.col("_e")) - 1).alias("_excess"), F.count("_e").alias("_m"), F.stddev_samp("_e").alias("_te"), F.avg("_e").alias("_em"),
    )
    a = a.withColumn("total_return", F.col("final_nav") - 1).withColumn("annual_return", annual(F.col("total_return"), "n"))
    a = a.withColumn("max_drawdown", F.col("_low.dd")).withColumn("duration", F.col("_low.at") + F.col("_low.peak"))
    none = lambda x: F.coalesce(x, F.lit(0.0))
    over = F.col("annual_return") - RISK_FREE
    a = a.withColumn("sharpe", none(ratio(over, F.col("volatility")))).withColumn("sortino", none(ratio(over, F.col("_down"))))
    a = a.withColumn("calmar", none(ratio(F.col("annual_return"), F.abs("max_drawdown"))))
    if benchmark is not None:
        a = a.withColumn("tracking_error", F.col("_te") * YEAR**0.5)
        a = a.withColumn("information_ratio", none(ratio(F.when(F.col("_m") > 0, annual(F.col("_excess"), "_m")), F.col("tracking_error")))).withColumn("daily_ratio", none(ratio(F.col("_em"), F.col("_te")) * YEAR**0.5))
    return a.drop("_down", "_low", "_excess", "_m", "_te", "_em")


def correlations(returns: DataFrame) -> DataFrame:
    """a, b, corr for each pair of strategies, joined by date (an equi join, as many pairs per date as strategies allow)."""
    x = returns.select("date", F.col("strategy").alias("a"), F.col("ret").alias("x"))
    y = returns.select("date", F.col("strategy").alias("b"), F.col("ret").alias("y"))
    return x.join(y, "date").where("a < b").groupBy("a", "b").agg(correlation("x", "y").alias("corr"), F.count("*").alias("n"))


def monthly(returns: DataFrame) -> DataFrame:
    month = F.date_format("date", "yyyy-MM").alias("month")
    r = F.col("ret")
    return returns.groupBy("strategy", month).agg(
        F.sum(r).alias("total"), F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"), F.max(r).alias("best"), F.min(r).alias("worst")
    )
