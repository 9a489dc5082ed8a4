"""Exposure signals of return series (strategy, date, ret), each from the rows before its date; one shuffle by strategy serves them all.

A null return counts as 0. Rows without enough history take each rule's neutral value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.scalars import clip, ratio

YEAR = 242**0.5


@dataclass(frozen=True)
class Limits:
    target: float = 0.25
    lookback: int = 60
    least: float = 0.5
    tail_threshold: float = -0.03
    cvar_factor: float = 1.5
    cvar_strength: float = 0.5
    trend_mode: str = "managed_vol"
    trend_strength: float = 2.0
    tail_strength: float = 0.3


def _rows():
    return Window.partitionBy("strategy").orderBy("date")


def _before(n: int):
    return _rows().rowsBetween(-n, -1)


def annual_vol(n: int) -> Column:
    """Annual deviation of the n returns before the row; 0 under two."""
    return F.coalesce(F.stddev_samp("ret").over(_before(n)) * YEAR, F.lit(0.0))


def var(n: int, alpha: float = 0.05) -> Column:
    """The alpha-quantile of the n returns before; 0 under ten."""
    w = _before(n)
    return F.when(F.count("ret").over(w) >= 10, F.percentile("ret", F.lit(alpha)).over(w)).otherwise(0.0)


def _mean(held: Column) -> Column:
    return F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(held), F.lit(0))


def cvar(n: int, alpha: float = 0.05) -> Column:
    """Mean of the worst alpha of the n returns before, five at least; the plain mean under ten, 0 of none."""
    held = F.sort_array(F.collect_list("ret").over(_before(n)))
    worst = F.slice(held, 1, F.greatest(F.floor(F.size(held) * alpha).cast("int"), F.lit(5)))
    return F.coalesce(F.when(F.size(held) < 10, _mean(held)).otherwise(_mean(worst)), F.lit(0.0))


def figures(returns: DataFrame, p: Limits = Limits()) -> DataFrame:
    """returns plus i (place), level (compounded), n, vol, cvar, var and the other windows that the rules read."""
    w, n = _rows(), p.lookback
    out = returns.withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    out = out.withColumn("i", F.row_number().over(w) - 1).withColumn("level", F.exp(F.sum(F.log1p("ret")).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    std20 = F.when(F.col("i") >= 19, F.stddev_samp("ret").over(w.rowsBetween(-19, 0)))
    peak = lambda last: F.max("level").over(w.rowsBetween(Window.unboundedPreceding, last))
    out = out.select(
        "*", F.least("i", F.lit(n)).alias("n"), annual_vol(n).alias("vol"), annual_vol(120).alias("vol120"), annual_vol(60).alias("vol60"), cvar(n).alias("cvar"), var(n).alias("var"),
        F.collect_list("ret").over(_before(n)).alias("held"), std20.alias("std20"), F.lag("level").over(w).alias("last"),
        *[F.avg("level").over(_before(k)).alias(f"ma{k}") for k in (20, 40, 120)], *[F.sum("ret").over(_before(k)).alias(f"sum{k}") for k in (5, 20)],
        (F.regr_slope("level", "i").over(_before(n)) / F.first("level").over(_before(n)) * 242).alias("slope"),
        F.avg((F.col("ret") > 0).cast("double")).over(_before(n)).alias("up"), (1 - F.col("level") / peak(0)).alias("depth"), (1 - F.lag("level").over(w) / peak(-1)).alias("depth_before"),
    )
    return out.withColumn("short_vol", F.avg("std20").over(_before(41)) * YEAR)


def regime(p: Limits = Limits()) -> tuple[Column, Column]:
    """Name of the market state and its confidence, over `figures`."""
    known, high = (F.col("i") >= p.lookback + 20) & (F.col("n") >= 40), p.target * 1.3
    above = [F.col("last") > F.col(m) for m in ("ma20", "ma40")]
    strong = F.abs("slope") > 0.15
    name = F.when(~known, "weak_trend").when(F.col("vol") > high, "high_vol").when(strong & above[0] & above[1], "strong_trend").when(above[0] | above[1], "weak_trend").otherwise("sideway")
    sure = F.when(~known, 0.5).when(F.col("vol") > high, F.least((F.col("vol") - high) / high + 0.5, F.lit(1.0))).when(strong & above[0] & above[1], F.least(F.abs("slope") / 0.3, F.lit(1.0)))
    return name, sure.when(above[0] | above[1], 0.6).when(F.col("up") < 0.5, F.least(1.3 - F.col("up"), F.lit(0.9))).otherwise(0.5)


def vol_target(p: Limits = Limits()) -> Column:
    """Target deviation by `regime` and deviation."""
    r, v, t = F.col("regime"), F.col("vol"), p.target
    rule = F.when(F.col("n") < 20, 1.0).when(r == "high_vol", 0.85).when(r == "sideway", 0.95).when(r == "strong_trend", F.when(v < t * 0.8, 1.15).otherwise(1.0))
    return t * rule.when(v < t * 0.7, 1.1).when(v > t * 1.5, 0.8).otherwise(1.0)


def cvar_scale(target: Column, p: Limits = Limits()) -> Column:
    """Target over deviation, cut where the worst returns pass their limit, smoothed by the long deviation, within 0.5 to 1.5."""
    plain, limit = ratio(target, F.col("vol")), target / YEAR * p.cvar_factor
    cut = 1 - p.cvar_strength * F.least(F.lit(1.0), F.pow(F.abs("cvar") / limit, F.lit(1.5)))
    scale = F.when(F.col("cvar") < -limit, plain * cut).otherwise(plain)
    long = F.coalesce(ratio(target, F.col("vol120")), scale)
    smooth = F.when(F.col("i") < 120, scale).when(scale < 1, 0.7 * scale + 0.3 * long).otherwise(0.3 * scale + 0.7 * long)
    return F.when((F.col("n") < 20) | (F.col("vol") <= 0), 1.0).when(F.col("n") < 40, clip(plain, 0.5, 1.5)).otherwise(clip(smooth, 0.5, 1.5))


def trend_exposure() -> Column:
    """Exposure by `regime`, less below the mean level of 120 rows."""
    r, gap = F.col("regime"), F.col("last") / F.col("ma120") - 1
    base = F.when(r == "strong_trend", 1.0).when(r == "weak_trend", 0.95).when(r == "sideway", 0.85).otherwise(0.75)
    return clip(base * F.when((F.col("i") >= 120) & (gap < -0.05), 0.85).when((F.col("i") >= 120) & (gap < -0.03), 0.92).otherwise(1.0), 0.4, 1.0)


def drawdown_exposure() -> Column:
    """Exposure by depth below the peak, cut after five bad rows and in small drawdowns without momentum."""
    d, crash = F.col("depth"), (F.col("i") >= 5) & (F.col("sum5") < -0.05)
    step = F.when(d > 0.18, 0.3).when(d > 0.12, 0.45).when(d > 0.08, 0.6).when(d > 0.04, 0.8).otherwise(1.0)
    step = step * F.when(crash, 1 - 0.3 * F.least(F.abs("sum5") / 0.1, F.lit(1.0))).otherwise(1.0)
    small = (F.col("i") >= 20) & (d > 0.02) & (F.col("sum20") <= 0)
    return F.when(F.col("i") < 1, 1.0).when(step < 1, F.greatest(F.lit(0.15), step)).when(small, F.greatest(F.lit(0.7), 1 - 2 * d)).otherwise(1.0)


def managed_vol_scale(p: Limits = Limits()) -> Column:
    """By mode: target over the mean short deviation, or a ladder of short over long deviation."""
    s = F.col("short_vol")
    if p.trend_mode == "managed_vol":
        base = clip(ratio(F.lit(p.target), s), 0.5, 1.2)
    else:
        q = ratio(s, F.col("vol60"))
        base = F.when(q > 1.5, 0.55).when(q > 1.3, 0.7).when(q > 1.15, 0.85).when(q > 1.0, 0.95).when(q < 0.7, 1.1).when(q < 0.85, 1.05).otherwise(1.0)
    return F.when((F.col("i") < 60) | (s <= 0), 1.0).otherwise(1 + (base - 1) * p.trend_strength)


def tail_scale(p: Limits = Limits()) -> Column:
    """Cut by the mean of the returns at or below their 5 % quantile, where it passes the threshold."""
    tail, limit = _mean(F.filter("held", lambda x: x <= F.col("var"))), p.tail_threshold
    cut = F.greatest(F.lit(0.5), 1 - p.tail_strength * F.abs(tail - limit) / abs(limit))
    return F.when((F.col("i") >= p.lookback) & (F.col("n") >= 20) & (tail < limit), cut).otherwise(1.0)


def signals(returns: DataFrame, p: Limits = Limits()) -> DataFrame:
    """strategy, date and all signals; the rest of `figures` stays for `composite`."""
    name, sure = regime(p)
    out = figures(returns, p).withColumn("regime", name).withColumn("confidence", sure).withColumn("vol_target", vol_target(p))
    return out.select(
        "*", cvar_scale(F.lit(p.target), p).alias("cvar_scale"), cvar_scale(F.col("vol_target"), p).alias("vol_scale"), trend_exposure().alias("trend"),
        drawdown_exposure().alias("drawdown"), managed_vol_scale(p).alias("managed"), tail_scale(p).alias("tail"),
    )


def composite(returns: DataFrame, current: float = 1.0, p: Limits = Limits()) -> DataFrame:
    """strategy, date, regime, exposure: all signals together, from the exposure `current` that is held, which recovers slowly."""
    near = F.greatest(F.lit(0.0), 1 - F.coalesce("depth_before", F.lit(0.0)) / 0.1)
    speed = F.when(F.col("i") == 0, 0.0).when((F.col("i") < 20) | (F.col("sum20") > 0), 0.01 + 0.04 * near).otherwise(0.005 + 0.015 * near)
    held = F.when(F.col("drawdown") < current, F.col("drawdown")).otherwise(F.least(current + speed, F.col("drawdown")))
    base = F.greatest(F.lit(0.7), F.col("trend") * held)
    total = F.col("vol_scale") * base * clip(F.col("managed") * F.col("tail"), 0.3, 1.3)
    return signals(returns, p).select("strategy", "date", "regime", clip(total, p.least, 1.5).alias("exposure"))
