"""Joins along time: as-of, forward fill, look-back, training windows; none compares every pair of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_calendar(keys: DataFrame, calendar: DataFrame, name: str = "date") -> DataFrame:
    """keys with every date of the calendar, which is one short array."""
    days = calendar.agg(F.collect_set("date").alias(name), F.lit(1).alias("_one"))
    return keys.distinct().withColumn("_one", F.lit(1)).join(F.broadcast(days), "_one").select(*keys.columns, F.explode(name).alias(name))


def asof_cross_section(panel: DataFrame, decisions: DataFrame) -> DataFrame:
    """decision, code and the newest row of the code up to then, nulls in it included; codes without a row by then are left out."""
    values = [c for c in panel.columns if c not in ("code", "date")]
    rows = panel.select("code", "date", F.lit(0).alias("_mark"), F.struct("date", *values).alias("_row"))
    marks = with_calendar(panel.select("code"), decisions).select("code", "date", F.lit(1).alias("_mark"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy("code").orderBy("date", "_mark").rowsBetween(Window.unboundedPreceding, 0)
    last = rows.unionByName(marks).withColumn("_row", F.last("_row", ignorenulls=True).over(w))
    return last.where("_mark = 1 and _row is not null").select(F.col("date").alias("decision"), "code", F.col("_row.date").alias("last_date"), *[F.col(f"_row.{c}").alias(c) for c in values])


def held_from(decisions: DataFrame, calendar: DataFrame, key: str = "portfolio", lag: int = 0) -> DataFrame:
    """key, date, decision: the newest decision up to each date; with lag 1, before it."""
    marks = with_calendar(decisions.select(key), calendar).select(key, "date", F.lit(1 - lag).alias("_order"), F.lit(None).cast("date").alias("decision"), F.lit(True).alias("_day"))
    rows = decisions.select(key, "date", F.lit(0.5).alias("_order"), F.col("date").alias("decision"), F.lit(False).alias("_day")).distinct()
    w = Window.partitionBy(key).orderBy("date", "_order").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.unionByName(marks).withColumn("decision", F.last("decision", ignorenulls=True).over(w))
    return filled.where("_day and decision is not null").select(key, "date", "decision")


def lookback_price(wanted: DataFrame, bars: DataFrame, days: int = 10) -> DataFrame:
    """code, date, price of the wanted days: the open of the day, else the newest close of the `days` calendar days before."""
    number = F.unix_date("date")
    rows = bars.select("code", "date", "open", "close", F.lit(False).alias("_w"))
    marks = wanted.select("code", "date", F.lit(None).cast("double").alias("open"), F.lit(None).cast("double").alias("close"), F.lit(True).alias("_w"))
    day = Window.partitionBy("code").orderBy(number)
    out = rows.unionByName(marks).withColumn("now", F.max("open").over(day.rangeBetween(0, 0))).withColumn("before", F.last("close", ignorenulls=True).over(day.rangeBetween(-days, -1)))
    return out.where("_w").select("code", "date", F.coalesce("now", "before").alias("price"))


def common_dates(series: DataFrame, key: str) -> DataFrame:
    """The rows of dates that every key has."""
    n = series.agg(F.count_distinct(key).alias("_n"))
    dates = series.groupBy("date").agg(F.count_distinct(key).alias("_n")).join(F.broadcast(n), "_n", "left_semi")
    return series.join(dates, "date", "left_semi")


def weight_diff(old: DataFrame, new: DataFrame, by: tuple = ("portfolio", "code")) -> DataFrame:
    """by, w_old, w_new, delta over the union of names; a missing weight is 0."""
    a, b = old.select(*by, F.col("weight").alias("w_old")), new.select(*by, F.col("weight").alias("w_new"))
    both = a.join(b, list(by), "full").select(*by, F.coalesce("w_old", F.lit(0.0)).alias("w_old"), F.coalesce("w_new", F.lit(0.0)).alias("w_new"))
    return both.withColumn("delta", F.col("w_new") - F.col("w_old"))


def day_index(calendar: DataFrame) -> DataFrame:
    """date, idx from 0; one row a day, so one task orders them."""
    return calendar.select("date").distinct().withColumn("idx", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date")) - 1)


def training_rows(panel: DataFrame, decisions: DataFrame, window: int, purge: int) -> DataFrame:
    """decision and the rows of the days in [t - window, t - purge) of the panel's calendar; joined by blocks of `window` days."""
    days = day_index(panel)
    rows = panel.join(F.broadcast(days), "date").withColumn("_b", F.floor(F.col("idx") / window))
    t = decisions.join(days, "date").select(F.col("date").alias("decision"), F.col("idx").alias("_t"))
    t = t.withColumn("_b", F.explode(F.sequence(F.floor((F.col("_t") - window) / window), F.floor((F.col("_t") - purge - 1) / window))))
    hit = rows.join(t, "_b").where((F.col("idx") >= F.col("_t") - window) & (F.col("idx") < F.col("_t") - purge))
    return hit.select("decision", *panel.columns)


def nth_trade_day(days: DataFrame, n: int) -> DataFrame:
    """date and the n-th trading day after it (before it, where n is negative), null beyond the calendar."""
    w = Window.partitionBy(F.lit(1)).orderBy("date")
    return days.select("date").distinct().withColumn("day", F.lead("date", n).over(w) if n > 0 else F.lag("date", -n).over(w))
