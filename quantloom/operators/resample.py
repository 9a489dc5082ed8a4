"""Resampling and parameter sweeps on one array per series: no draw and no point of a grid is shuffled by date.

A series' values are gathered in one array, in order of date (a calendar bounds it). Blocks of samples or points are dealt over the tasks with a copy of
the array, and each sample or point is a row that folds over it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.scalars import let, ratio
from quantloom.operators.performance import RISK_FREE, YEAR

BLOCK = 64
#: A Mersenne prime and the multipliers of a draw. Two squarings part the draws of neighbouring samples and places.
PRIME, A, B, C = 2_147_483_647, 48_271, 69_621, 16_807


def draw(sample: Column, place: Column, n: Column, seed: int) -> Column:
    """A place from 0 to n - 1; a function of sample, place and seed alone, so reruns, partitions and engines agree."""
    square = lambda value: let(value % PRIME, lambda x: x * x % PRIME)
    first = square(sample.cast("long") % PRIME * A + place.cast("long") * C + seed)
    return (square(first * B + place.cast("long") + seed) % n.cast("long")).cast("int")


def arrays(series: DataFrame, key: str, value: str) -> DataFrame:
    """key and the values in order of date, as `held`."""
    rows = series.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("date", F.col(value).alias("v")))).alias("held"))
    return rows.select(key, F.transform("held", lambda x: x["v"].cast("double")).alias("held"))


def dealt(rows: DataFrame, n: int, name: str, key: str) -> DataFrame:
    """rows with the numbers 0 to n - 1 each, dealt over the tasks by blocks."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a count that is given isn't merged, however small the rows
    blocks = rows.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n - 1) // BLOCK).cast("long")))).repartition(tasks, key, "_b")
    last = F.least((F.col("_b") + 1) * BLOCK, F.lit(n).cast("long")) - 1
    return blocks.withColumn(name, F.explode(F.sequence(F.col("_b") * BLOCK, last))).drop("_b")


def bootstrap(returns: DataFrame, n: int, seed: int = 7, least: int = 10) -> DataFrame:
    """strategy, sample, sharpe of n resamples of each series' own length; series under `least` values have none."""
    rows = dealt(arrays(returns, "strategy", "ret").where(F.size("held") >= least), n, "sample", "strategy")
    size, zero = F.size("held"), F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))

    def add(acc: Column, place: Column) -> Column:
        drawn = F.get("held", draw(F.col("sample"), place, size, seed))
        return let(drawn, lambda x: F.struct((acc["s"] + x).alias("s"), (acc["q"] + x * x).alias("q")))

    sums = rows.select("strategy", "sample", size.alias("k"), F.aggregate(F.sequence(F.lit(0), size - 1), zero, add).alias("a"))
    var = (F.col("a.q") - F.col("a.s") * F.col("a.s") / F.col("k")) / (F.col("k") - 1)
    return sums.select("strategy", "sample", (ratio(F.col("a.s") / F.col("k"), F.sqrt(F.greatest(var, F.lit(0.0)))) * YEAR**0.5).alias("sharpe"))


def sharpe_interval(returns: DataFrame, n: int = 1000, level: float = 0.95, seed: int = 7) -> DataFrame:
    """strategy, low, high: percentile bounds of the resampled Sharpe ratio."""
    q = lambda x: F.percentile("sharpe", F.lit(x))
    return bootstrap(returns, n, seed).groupBy("strategy").agg(q((1 - level) / 2).alias("low"), q((1 + level) / 2).alias("high"))


def deflated_sharpe(returns: DataFrame, trials: int = 100, samples: int = 1000, seed: int = 7) -> DataFrame:
    """strategy, sharpe, dsr: share of `samples` groups of `trials` resamples whose best Sharpe ratio reaches the observed one."""
    seen = returns.groupBy("strategy").agg((ratio(F.avg("ret"), F.stddev_samp("ret")) * YEAR**0.5).alias("sharpe"))
    best = bootstrap(returns, trials * samples, seed).groupBy("strategy", F.floor(F.col("sample") / trials).alias("group")).agg(F.max("sharpe").alias("best"))
    return best.join(seen, "strategy").groupBy("strategy", "sharpe").agg(F.avg((F.col("best") >= F.col("sharpe")).cast("double")).alias("dsr"))


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic with whole degrees of freedom, by the finite series in the angle atan(t / sqrt(df))."""
    angle = F.atan(F.abs(t) / F.sqrt(df))
    cos2, even = F.pow(F.cos(angle), 2), df % 2 == 0
    # Terms of the series: each is the one before times (2j - 1) / 2j, or 2j / (2j + 1), times cos^2.
    terms = F.when(even, (df - 2) / 2).otherwise((df - 3) / 2).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] * cos2 * F.when(even, (2 * j - 1) / (2 * j)).otherwise(2 * j / (2 * j + 1))
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    series = F.aggregate(F.when(terms >= 1, F.sequence(F.lit(1), F.greatest(terms, F.lit(1)))).otherwise(F.array().cast("array<int>")), start, step, lambda acc: acc["sum"])
    inside = F.when(even, F.sin(angle) * series).otherwise(2 / math.pi * (angle + F.when(df > 1, F.sin(angle) * F.cos(angle) * series).otherwise(0.0)))
    return F.greatest(1 - inside, F.lit(0.0))


def t_test(returns: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """strategy, t, p, sharpe, n of the mean return, or of the mean excess over one benchmark series on their common dates; null under 2 values."""
    e = F.col("ret") if benchmark is None else F.col("ret") - F.col("bench")
    rows = (returns if benchmark is None else returns.join(benchmark, "date")).withColumn("e", e)
    a = rows.groupBy("strategy").agg(F.avg("e").alias("m"), F.stddev_samp("e").alias("s"), F.count("e").alias("n"))
    t = ratio(F.col("m"), F.col("s") / F.sqrt("n"))
    return a.select("strategy", t.alias("t"), student_p(t, F.col("n") - 1).alias("p"), (ratio(F.col("m"), F.col("s")) * YEAR**0.5).alias("sharpe"), "n")


def _axis(axis: tuple | list, place: Column) -> Column:
    """A value by its place: a tuple is (start, step, count), a list holds the values."""
    return F.get(F.array(*map(F.lit, axis)), place.cast("int")) if isinstance(axis, list) else F.lit(axis[0]) + place * axis[1]


def points(axes: dict[str, tuple | list]) -> tuple[int, Callable[[Column], dict[str, Column]]]:
    """The size of a grid, and its values by name as columns of a point's number; the last axis runs fastest."""
    sizes = [len(a) if isinstance(a, list) else a[2] for a in axes.values()]

    def at(number: Column) -> dict[str, Column]:
        out = {}
        for i, (name, axis) in enumerate(axes.items()):
            stride = math.prod(sizes[i + 1 :])
            out[name] = _axis(axis, F.floor(number / stride) % sizes[i])
        return out

    return math.prod(sizes), at


def param_grid(spark: SparkSession, axes: dict[str, tuple | list], most: int | None = None, seed: int = 42) -> DataFrame:
    """point (its number) and a column per axis: every combination, or the `most` first by a seeded hash where there are more."""
    size, at = points(axes)
    rows = spark.range(size).withColumnRenamed("id", "point")
    grid = rows.select("point", *[v.alias(n) for n, v in at(F.col("point")).items()])
    return grid if most is None or most >= size else grid.orderBy(F.xxhash64(F.lit(seed), "point"), "point").limit(most)


def sweep(prices: DataFrame, axes: dict[str, tuple | list], signal: Callable[..., Column], key: str = "series") -> DataFrame:
    """key, the axes, total_return, sharpe, max_drawdown and n of holding each series (key, date, close) by a signal, for every point of the grid.

    `signal(mean, close, p)` gives the position of a date: `mean(n)` is the mean of its last n closes (from prefix sums, so any window costs two
    lookups), `close(k)` the close k rows before it, both null where there are too few rows, and p the point's values. The position of a date earns the next date's
    return; a null position is none.
    """
    size, at = points(axes)
    running = F.sum("close").over(Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    rows = prices.where("close is not null").select(key, "date", F.col("close").cast("double").alias("close")).withColumn("sum", running)
    rows = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("date", "close", "sum"))).alias("x")).where(F.size("x") > 1)
    rows = rows.select(key, F.transform("x", lambda x: x["close"]).alias("held"), F.concat(F.array(F.lit(0.0)), F.transform("x", lambda x: x["sum"])).alias("sums"))
    rows = dealt(rows, size, "point", key)
    rows = rows.select("*", *[v.alias(n) for n, v in at(F.col("point")).items()])
    p = {n: F.col(n) for n in axes}
    fold = F.struct(F.lit(1.0).alias("nav"), F.lit(0.0).alias("peak"), F.lit(0.0).alias("low"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))

    def step(acc: Column, i: Column) -> Column:
        """i is the place of the date that earns; the signal stands on the one before."""
        mean = lambda n: F.when(i - n >= 0, (F.get("sums", i) - F.get("sums", F.greatest(i - n, F.lit(0)).cast("int"))) / n)
        close = lambda k: F.when(i - 1 - k >= 0, F.get("held", F.greatest(i - 1 - k, F.lit(0)).cast("int")))
        earned = F.coalesce(signal(mean, close, p), F.lit(0.0)) * F.coalesce(ratio(F.get("held", i), F.get("held", i - 1)) - 1, F.lit(0.0))

        def moved(e: Column, nav: Column) -> Column:
            peak = F.greatest(acc["peak"], nav)
            low = F.least(acc["low"], F.coalesce(ratio(nav, peak), F.lit(1.0)) - 1)
            return F.struct(nav.alias("nav"), peak.alias("peak"), low.alias("low"), (acc["s"] + e).alias("s"), (acc["q"] + e * e).alias("q"))

        return let(earned, lambda e: let(acc["nav"] * (1 + e), lambda nav: moved(e, nav)))

    n = F.size("held") - 1
    out = rows.select(key, *axes, n.alias("n"), F.aggregate(F.sequence(F.lit(1), n), fold, step).alias("a"))
    vol = F.sqrt(F.greatest((F.col("a.q") - F.col("a.s") * F.col("a.s") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0)), F.lit(0.0))) * YEAR**0.5
    annual = F.pow("a.nav", YEAR / F.col("n")) - 1
    return out.select(key, *axes, (F.col("a.nav") - 1).alias("total_return"), ratio(annual - RISK_FREE, F.when(vol > 1e-10, vol)).alias("sharpe"), F.col("a.low").alias("max_drawdown"), "n")


def trend(mean, close, p) -> Column:
    """1 while the close is over its mean of `window` rows by `margin`."""
    return (close(0) > mean(p["window"]) * (1 + p["margin"])).cast("double")


def momentum(mean, close, p) -> Column:
    """1 while the close gained more than `least` on `span` rows before."""
    return (close(0) > close(p["span"]) * (1 + p["least"])).cast("double")
