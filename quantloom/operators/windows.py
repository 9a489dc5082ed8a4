"""Time-series primitives over a code's own rows. All share one window specification, hence one shuffle by code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.scalars import ratio


def own_rows():
    """A code's own rows in order of date."""
    return Window.partitionBy("code").orderBy("date")


def pct_change(x: Column, n: int, w=None) -> Column:
    return ratio(x, F.lag(x, n).over(w or own_rows())) - 1


def fwd_return(x: Column, h: int, w=None) -> Column:
    return ratio(F.lead(x, h).over(w or own_rows()), x) - 1


def rolling(fn, x: Column, n: int, w=None) -> Column:
    """fn over the last n rows, null unless all n values are present."""
    frame = (w or own_rows()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, fn(x).over(frame))


def diff(x: Column, n: int, w=None) -> Column:
    return x - F.lag(x, n).over(w or own_rows())


def cum_sum(x: Column, w=None) -> Column:
    """Running sum that skips nulls and is null where x is."""
    return F.when(x.isNotNull(), F.sum(x).over((w or own_rows()).rowsBetween(Window.unboundedPreceding, 0)))


def forward_sum(panel: DataFrame, x: str, n: int, out: str) -> DataFrame:
    """panel plus the sum of x over the next n days of the panel's calendar; days without a row add nothing."""
    days = panel.select("date").distinct().withColumn("_at", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date")))
    w = Window.partitionBy("code").orderBy("_at").rangeBetween(1, n)
    return panel.join(F.broadcast(days), "date").withColumn(out, F.coalesce(F.sum(x).over(w), F.lit(0.0))).drop("_at")


def historical_percentile(x: str, n: int, least: int = 1) -> Column:
    """Share of the last n values, the current one included, that are at most the current value; null under `least` values."""
    held = F.collect_list(x).over(own_rows().rowsBetween(-(n - 1), 0))
    return F.when(F.col(x).isNotNull() & (F.size(held) >= least), F.size(F.filter(held, lambda v: v <= F.col(x))) / F.size(held))


def above_quantile(x: str, q: float, n: int, least: int) -> Column:
    """1 where x exceeds the q-quantile of its last n values, of which there are `least` or more; else 0."""
    frame = own_rows().rowsBetween(-(n - 1), 0)
    return F.when((F.count(x).over(frame) >= least) & (F.col(x) > F.percentile(x, F.lit(q)).over(frame)), 1).otherwise(0)


def tail_rows(panel: DataFrame, n: int) -> DataFrame:
    """The last n rows of each code."""
    at = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))
    return panel.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")


def densify(panel: DataFrame) -> DataFrame:
    """The panel on the grid of all its dates and codes: each code explodes the calendar, which is one short array."""
    days = panel.agg(F.collect_set("date").alias("date"), F.lit(1).alias("_one"))
    codes = panel.select("code").distinct().withColumn("_one", F.lit(1))
    grid = codes.join(F.broadcast(days), "_one").select("code", F.explode("date").alias("date"))
    return grid.join(panel, ["date", "code"], "left")
