"""Returns of portfolios, benchmark-relative figures, attribution, comparison and walk-forward windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.scalars import correlation, ratio
from quantloom.operators.joins import held_from
from quantloom.operators.performance import RISK_FREE, YEAR, full_metrics


def portfolio_returns(weights: DataFrame, returns: DataFrame, lag: int = 0) -> DataFrame:
    """portfolio, date, ret: the held weights times the day's returns; a missing return counts as none."""
    held = held_from(weights.select("portfolio", "date"), returns, "portfolio", lag)
    w = weights.select("portfolio", F.col("date").alias("decision"), "code", "weight")
    rows = held.join(w, ["portfolio", "decision"]).join(returns, ["date", "code"])
    return rows.groupBy("portfolio", "date").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))


def net_returns(returns: DataFrame, costs: DataFrame, key: str = "portfolio") -> DataFrame:
    """returns less the day's cost, and their NAV, 1 on the first day."""
    w = Window.partitionBy(key).orderBy("date")
    out = returns.join(costs, [key, "date"], "left").withColumn("net", F.col("ret") - F.coalesce("cost", F.lit(0.0)))
    nav = F.product(1 + F.col("net")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("nav", nav).withColumn("nav", F.col("nav") / F.first("nav").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def sharpe(returns: DataFrame) -> DataFrame:
    """strategy and its Sharpe ratio by the geometric, the arithmetic and the excess-mean formula."""
    sd = F.stddev_samp(F.col("ret"))
    a = returns.groupBy("strategy").agg(F.product(1 + F.col("ret")).alias("g"), F.avg(F.col("ret")).alias("m"), sd.alias("sd"), F.count("*").alias("n"))
    annual = F.pow("g", YEAR / F.col("n")) - 1
    return a.select(
        "strategy", ratio(annual - RISK_FREE, F.col("sd") * YEAR**0.5).alias("geometric"), (ratio(F.col("m"), F.col("sd")) * YEAR**0.5).alias("arithmetic"),
        (ratio(F.col("m") - RISK_FREE / YEAR, F.col("sd")) * YEAR**0.5).alias("excess"),
    )


def relative(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """strategy, excess, beta, corr, tracking_error, information_ratio against one benchmark series, on their common dates."""
    e = F.col("ret") - F.col("bench")
    rows = returns.join(F.broadcast(benchmark), "date")
    a = rows.groupBy("strategy").agg(
        (F.avg(e) * YEAR).alias("excess"), ratio(F.covar_pop("ret", "bench"), F.var_pop("bench")).alias("beta"), correlation("ret", "bench").alias("corr"),
        (F.stddev_samp(e) * YEAR**0.5).alias("tracking_error"), (F.avg(e) / F.nullif(F.stddev_samp(e), F.lit(0.0)) * YEAR**0.5).alias("information_ratio"),
    )
    return a


def monthly_nav(returns: DataFrame, unit: str = "month") -> DataFrame:
    """strategy, period, ret (compounded), first and last day."""
    return returns.groupBy("strategy", F.date_trunc(unit, "date").cast("date").alias("period")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


def win_rate(returns: DataFrame, unit: str = "month") -> DataFrame:
    """strategy and the share of periods with a gain."""
    return monthly_nav(returns, unit).groupBy("strategy").agg(F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.count("*").alias("n"))


def histogram(returns: DataFrame, bins: int = 50) -> DataFrame:
    """strategy, bin (from 0), n over the range of each strategy's returns."""
    w = Window.partitionBy("strategy")
    at = F.floor((F.col("ret") - F.min(F.col("ret")).over(w)) / F.nullif((F.max(F.col("ret")).over(w) - F.min(F.col("ret")).over(w)) / bins, F.lit(0.0)))
    rows = returns.select("strategy", F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"))
    return rows.groupBy("strategy", "bin").agg(F.count("*").alias("n"))


def drawdown_duration(nav: DataFrame) -> DataFrame:
    """strategy, max_drawdown, duration in rows from the last peak to the first trough; nav has strategy, date, nav, drawdown."""
    w = Window.partitionBy("strategy").orderBy("date")
    rows = nav.withColumn("i", F.row_number().over(w))
    rows = rows.withColumn("peak", F.max(F.when(F.col("drawdown") == 0, F.col("i"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    low = rows.groupBy("strategy").agg(F.min(F.struct("drawdown", "i", "peak")).alias("x"))
    return low.select("strategy", F.col("x.drawdown").alias("max_drawdown"), (F.col("x.i") - F.col("x.peak")).alias("duration"))


def contribution(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """portfolio, code (TOTAL for the whole), sum, mean, max, min, std of weight times return."""
    rows = weights.join(returns, ["date", "code"]).select("portfolio", "date", "code", (F.col("weight") * F.col("ret")).alias("c"))
    total = rows.groupBy("portfolio", "date").agg(F.sum("c").alias("c")).withColumn("code", F.lit("TOTAL"))
    x = F.col("c")
    return rows.unionByName(total).groupBy("portfolio", "code").agg(F.sum(x).alias("total"), F.avg(x).alias("mean"), F.max(x).alias("best"), F.min(x).alias("worst"), F.stddev_pop(x).alias("std"))


def period_contribution(weights: DataFrame, returns: DataFrame, unit: str = "quarter") -> DataFrame:
    """portfolio, period (its first day), code (TOTAL for the whole), total, mean and n of weight times return in each month or quarter."""
    period = F.date_trunc(unit, "date").cast("date").alias("period")
    rows = weights.join(returns, ["date", "code"]).select("portfolio", "date", period, "code", (F.col("weight") * F.col("ret")).alias("c"))
    total = rows.groupBy("portfolio", "date", "period").agg(F.sum("c").alias("c")).withColumn("code", F.lit("TOTAL"))
    return rows.unionByName(total).groupBy("portfolio", "period", "code").agg(F.sum("c").alias("total"), F.avg("c").alias("mean"), F.count("c").alias("n"))


def factor_contribution(exposures: DataFrame, returns: DataFrame) -> DataFrame:
    """factor (TOTAL for the whole), total, mean, best, worst, std (ddof 0), exposure from exposures (date, factor, exposure) and returns (date, factor, ret).

    A factor without a return on a date contributes 0. The whole is the sum of a date's contributions and has no exposure.
    """
    rows = exposures.join(returns, ["date", "factor"], "left").select("date", "factor", "exposure", (F.col("exposure") * F.coalesce("ret", F.lit(0.0))).alias("c"))
    whole = rows.groupBy("date").agg(F.sum("c").alias("c")).withColumn("factor", F.lit("TOTAL"))
    x = F.col("c")
    made = rows.unionByName(whole, allowMissingColumns=True).groupBy("factor")
    return made.agg(F.sum(x).alias("total"), F.avg(x).alias("mean"), F.max(x).alias("best"), F.min(x).alias("worst"), F.stddev_pop(x).alias("std"), F.avg("exposure").alias("exposure"))


#: Figures by which two runs are compared.
RUN_FIGURES = ("total_return", "annual_return", "sharpe", "max_drawdown")


def run_diff(first: DataFrame, second: DataFrame, figures: tuple = RUN_FIGURES) -> DataFrame:
    """strategy, metric, a, b, delta of the strategies' metrics in two runs; a strategy or figure that a run lacks counts as 0."""
    long = lambda m, name: m.select("strategy", *figures).unpivot(["strategy"], list(figures), "metric", name)
    both = long(first, "a").join(long(second, "b"), ["strategy", "metric"], "full")
    both = both.select("strategy", "metric", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    return both.withColumn("delta", F.col("a") - F.col("b"))


def rolling_correlation(returns: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """strategy, date, corr of the n rows before; null until there are n."""
    f = Window.partitionBy("strategy").orderBy("date").rowsBetween(-n, -1)
    mean = lambda c: F.avg(c).over(f)
    x, y = F.col("ret"), F.col("bench")
    cov = mean(x * y) - mean(x) * mean(y)
    return returns.join(F.broadcast(benchmark), "date").select("strategy", "date", F.when(F.count(x).over(f) == n, ratio(cov, F.stddev_pop(x).over(f) * F.stddev_pop(y).over(f))).alias("corr"))


def least_correlated(pairs: DataFrame, n: int) -> DataFrame:
    """The n pairs of smallest absolute correlation."""
    return pairs.orderBy(F.abs("corr"), "a", "b").limit(n)


def weighted(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """date, ret: the strategies of a date combined by weight over the sum of weights."""
    return returns.join(weights, "strategy").groupBy("date").agg(ratio(F.sum(F.col("w") * F.col("ret")), F.sum("w")).alias("ret"))


def pair_allocation(returns: DataFrame, target: float) -> DataFrame:
    """a, b, w_a, w_b, scale: weights by inverse volatility and the factor that brings the pair to the target volatility."""
    x = returns.select("date", F.col("strategy").alias("a"), F.col("ret").alias("x"))
    y = returns.select("date", F.col("strategy").alias("b"), F.col("ret").alias("y"))
    s = x.join(y, "date").where("a < b").groupBy("a", "b").agg(F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy"), F.covar_samp("x", "y").alias("c"))
    s = s.withColumn("w_a", ratio(F.col("sy"), F.col("sx") + F.col("sy"))).withColumn("w_b", 1 - F.col("w_a"))
    var = F.pow(F.col("w_a") * F.col("sx"), 2) + F.pow(F.col("w_b") * F.col("sy"), 2) + 2 * F.col("w_a") * F.col("w_b") * F.col("c")
    return s.select("a", "b", "w_a", "w_b", ratio(F.lit(target), F.sqrt(F.greatest(var, F.lit(0.0))) * YEAR**0.5).alias("scale"))


def split_windows(series: DataFrame, window: int, step: int, least: int) -> DataFrame:
    """series rows with the number of each window that holds them; a row joins the few windows that start before it."""
    w = Window.partitionBy("strategy")
    rows = series.withColumn("_i", F.row_number().over(w.orderBy("date")) - 1).withColumn("_n", F.count("*").over(w))
    first = F.greatest(F.floor((F.col("_i") - window) / step) + 1, F.lit(0))
    rows = rows.withColumn("window", F.explode(F.sequence(first, F.floor(F.col("_i") / step))))
    size = F.least(F.lit(window), F.col("_n") - F.col("window") * step)
    return rows.where((size >= least) & (F.col("_i") < F.col("window") * step + window)).drop("_i", "_n")


def stability(windows: DataFrame) -> DataFrame:
    """strategy, n, mean and deviation of the windows' Sharpe ratio, share of windows with a gain."""
    a = windows.groupBy("strategy", "window").agg((F.product(1 + F.col("ret")) - 1).alias("total"), (ratio(F.avg(F.col("ret")), F.stddev_samp(F.col("ret"))) * YEAR**0.5).alias("sharpe"))
    return a.groupBy("strategy").agg(F.count("*").alias("n"), F.avg("sharpe").alias("mean_sharpe"), F.stddev_samp("sharpe").alias("std_sharpe"), F.avg((F.col("total") > 0).cast("double")).alias("positive"))


def window_report(windows: DataFrame) -> DataFrame:
    """strategy, windows, mean and deviation of Sharpe ratio and annual return, positive, consistency, from `full_metrics` by (strategy, window).

    A window is positive if its Sharpe ratio is; consistency is their share; a single window deviates by 0.
    """
    up = (F.col("sharpe") > 0).cast("int")
    spread = lambda x: F.coalesce(F.stddev_samp(x), F.lit(0.0))
    return windows.groupBy("strategy").agg(
        F.count("*").alias("windows"), F.avg("sharpe").alias("mean_sharpe"), spread("sharpe").alias("std_sharpe"), F.avg("annual_return").alias("mean_annual"),
        spread("annual_return").alias("std_annual"), F.sum(up).alias("positive"), F.avg(up).alias("consistency"),
    )


def ensemble_members(returns: DataFrame, weighting: str = "sharpe", benchmark: DataFrame | None = None) -> DataFrame:
    """strategy, w, sharpe, n: `equal`, or by the positive part of the `sharpe` or (with a benchmark, else as sharpe) `information_ratio` of all its days."""
    m = full_metrics(returns, benchmark=benchmark)
    if weighting == "equal":
        w = m.select("strategy", (1 / F.count("*").over(Window.partitionBy(F.lit(1)))).alias("w"))  # one row a strategy
    else:
        w = ensemble_weights(m, weighting if benchmark is not None else "sharpe")
    return m.select("strategy", "sharpe", "n").join(w, "strategy").select("strategy", "w", "sharpe", "n")


def ensemble_weights(scores: DataFrame, x: str) -> DataFrame:
    """strategy, w: max(score, 0) over their sum, equal where none is positive; one row a strategy."""
    every = Window.partitionBy(F.lit(1))
    up: Column = F.greatest(F.coalesce(F.col(x), F.lit(0.0)), F.lit(0.0))
    return scores.select("strategy", F.coalesce(ratio(up, F.sum(up).over(every)), 1 / F.count("*").over(every)).alias("w"))
