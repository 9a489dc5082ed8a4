"""Training sets of many overlapping windows at once: rows, statistics of all columns, scaled and binned features, prediction rows."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.joins import training_rows

SET = ("decision", "window")
FLAT = 1e-10


def training_sets(panel: DataFrame, decisions: DataFrame, windows: list[int], purge: int, label: str, least_dates: int = 50, least_rows: int = 200) -> DataFrame:
    """decision, window and the labelled rows of the days in [t - window, t - purge) for each decision and window.

    A set of fewer than `least_dates` dates or `least_rows` rows is left out.
    """
    sets = [training_rows(panel, decisions, w, purge).withColumn("window", F.lit(w)) for w in windows]
    rows = functools.reduce(DataFrame.unionByName, sets).where(F.col(label).isNotNull())
    enough = rows.groupBy(*SET).agg(F.count_distinct("date").alias("d"), F.count("*").alias("n")).where((F.col("d") >= least_dates) & (F.col("n") >= least_rows))
    return rows.join(enough.select(*SET), [*SET])


def window_stats(rows: DataFrame, features: list[str], q: float = 0.01) -> DataFrame:
    """decision, window, feature, lo, hi, mean, std, n of all columns and sets in one grouped pass.

    The columns are unpivoted; ranks within (set, column) give the quantiles q and 1 - q (linear between neighbours), and mean and deviation (ddof 1, 1
    where it is under 1e-10) are those of the clipped values. Sorting may spill; nothing is gathered.
    """
    keys = [*SET, "feature"]
    long = rows.select(*SET, *[F.col(f).cast("double").alias(f) for f in features]).unpivot([*SET], features, "feature", "x").where("x is not null")
    every = Window.partitionBy(*keys)
    long = long.withColumn("i", F.row_number().over(every.orderBy("x"))).withColumn("n", F.count("*").over(every))

    def at(p: float) -> Column:
        place = (F.col("n") - 1) * F.lit(p)
        low = F.max(F.when(F.col("i") == F.floor(place) + 1, F.col("x"))).over(every)
        high = F.max(F.when(F.col("i") == F.ceil(place) + 1, F.col("x"))).over(every)
        return low + (high - low) * (place - F.floor(place))

    long = long.withColumn("lo", at(q)).withColumn("hi", at(1 - q))
    clipped = F.least(F.greatest("x", "lo"), F.col("hi"))
    out = long.groupBy(*keys).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.avg(clipped).alias("mean"), F.stddev_samp(clipped).alias("std"), F.count("*").alias("n"))
    return out.withColumn("std", F.when(F.coalesce("std", F.lit(0.0)) < FLAT, 1.0).otherwise(F.col("std")))


def with_stats(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """rows plus `_s`, their set's statistics by feature: one join whatever the number of columns."""
    entry = F.struct("feature", F.struct("lo", "hi", "mean", "std"))
    return rows.join(stats.groupBy(*SET).agg(F.map_from_entries(F.collect_list(entry)).alias("_s")), [*SET])


def scaled(rows: DataFrame, stats: DataFrame, features: list[str]) -> DataFrame:
    """rows with each feature clipped and scaled by its set's statistics; null, or a feature without statistics, becomes 0."""

    def z(f: str) -> Column:
        s = F.try_element_at("_s", F.lit(f))
        x = F.when(F.col(f).isNotNull(), F.least(F.greatest(F.col(f), s["lo"]), s["hi"]))
        return F.coalesce((x - s["mean"]) / s["std"], F.lit(0.0)).alias(f)

    joined = with_stats(rows, stats)
    return joined.select(*[z(c) if c in features else F.col(c) for c in rows.columns])


def binned(rows: DataFrame, stats: DataFrame, features: list[str], bins: int = 16) -> DataFrame:
    """rows plus `bins`, the place of each feature among equal parts of its set's clipped range; null lies where the mean does."""

    def place(f: str) -> Column:
        s = F.try_element_at("_s", F.lit(f))
        width = s["hi"] - s["lo"]
        share = (F.least(F.greatest(F.coalesce(F.col(f), s["mean"]), s["lo"]), s["hi"]) - s["lo"]) / F.when(width > FLAT, width)
        return F.when(width > FLAT, F.least(F.floor(share * bins), F.lit(bins - 1))).otherwise(0).cast("int")

    joined = with_stats(rows, stats)
    return joined.select(*rows.columns, F.array(*[place(f) for f in features]).alias("bins"))


def prediction_rows(panel: DataFrame, decisions: DataFrame, back: int = 5, least: int = 5) -> DataFrame:
    """decision and the rows of the newest date up to it, `back` calendar days before it at most; a date of fewer than `least` names gives none."""
    sized = panel.groupBy("date").agg(F.count_distinct("code").alias("n")).select("date", "n", F.col("date").alias("newest"))
    marks = decisions.select("date", F.lit(True).alias("_mark")).distinct()
    # One row per date, so one task orders them.
    last = F.last("newest", ignorenulls=True).over(Window.partitionBy(F.lit(1)).orderBy("date", F.col("_mark").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    held = sized.unionByName(marks, allowMissingColumns=True).withColumn("newest", last).where("_mark").select(F.col("date").alias("decision"), F.col("newest").alias("date"))
    held = held.where(F.datediff("decision", "date") <= back).join(sized.where(F.col("n") >= least).select("date"), "date")
    return panel.join(held, "date").select("decision", *panel.columns)


def for_windows(rows: DataFrame, windows: list[int]) -> DataFrame:
    """rows once for each window."""
    return rows.withColumn("window", F.explode(F.array(*map(F.lit, windows))))
