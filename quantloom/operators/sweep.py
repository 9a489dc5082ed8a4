"""Best points of sweeps, and triggered dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import performance
from quantloom.operators.joins import with_calendar


def best_points(swept: DataFrame, key: str = "series", by: str = "sharpe", n: int = 5) -> DataFrame:
    """The n best points of each series by a column of the sweep, with their rank; ties go by the axes."""
    axes = [c for c in swept.columns if c not in (key, "total_return", "sharpe", "max_drawdown", "n")]
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last(by), *axes)
    return swept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def triggered_dates(returns: DataFrame, limit: float, lookback: int = 60, gap: int = 5, least: int = 10) -> DataFrame:
    """strategy, date where the annual volatility of the `lookback` rows before is over the limit, `gap` rows or more after the last such date.

    One value per date and series is collected, which the calendar bounds.
    """
    w = Window.partitionBy("strategy").orderBy("date")
    before = w.rowsBetween(-lookback, -1)
    vol = F.when(F.count("ret").over(before) >= least, F.stddev_samp("ret").over(before) * performance.YEAR**0.5)
    rows = returns.withColumn("i", F.row_number().over(w) - 1).withColumn("vol", vol).where((F.col("i") >= lookback) & (F.col("vol") > limit))
    series = rows.groupBy("strategy").agg(F.array_sort(F.collect_list(F.struct("i", "date"))).alias("at"))
    none = F.slice("at", 1, 0)

    def take(found: Column, x: Column) -> Column:
        last = F.try_element_at(found, F.lit(-1)).getField("i")
        return F.when(last.isNull() | (x.getField("i") - last >= gap), F.concat(found, F.array(x))).otherwise(found)

    return series.select("strategy", F.explode(F.aggregate("at", none, take)).alias("x")).select("strategy", "x.date")


def rebalance_or_triggered(returns: DataFrame, scheduled: DataFrame, limit: float, lookback: int = 60, gap: int = 5) -> DataFrame:
    """strategy, date, scheduled: the calendar's dates (of date) for every strategy, and the dates that volatility triggers."""
    extra = triggered_dates(returns, limit, lookback, gap).withColumn("scheduled", F.lit(False))
    due = with_calendar(returns.select("strategy"), scheduled).withColumn("scheduled", F.lit(True))
    return due.unionByName(extra).groupBy("strategy", "date").agg(F.max("scheduled").alias("scheduled"))
