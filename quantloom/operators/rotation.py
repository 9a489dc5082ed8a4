"""Industry rotation: blended momentum, relative-strength votes, risk, crowding and valuation rules, factor weights by their IC, market scale.

Inputs are one row per (date, industry), unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.windows import own_rows, pct_change, rolling


def blend_momentum(x: Column, short: int, long: int, w_short: float, w_long: float) -> Column:
    """Weighted momentum of two spans as known one row before; null unless both are known."""
    return F.lag(w_short * pct_change(x, short) + w_long * pct_change(x, long), 1).over(own_rows())


def residual_momentum(momentum: Column, beta: Column, market: Column) -> Column:
    """Momentum less beta times the market's; an unknown beta is 1."""
    return momentum - F.coalesce(beta, F.lit(1.0)) * market


def strength(industries: DataFrame, n: int, spans: list[int]) -> DataFrame:
    """date, industry, rs_ratio, and rs_mom_<span>, from date, industry, close, index."""
    w = Window.partitionBy("industry").orderBy("date")
    rs = industries.withColumn("rs", F.col("close") / F.nullif(F.col("index"), F.lit(0.0)))
    rs = rs.withColumn("rs_ratio", 100 * F.col("rs") / rolling(F.avg, F.col("rs"), n, w))
    return rs.select("date", "industry", "rs_ratio", *[(100 * F.col("rs_ratio") / F.lag("rs_ratio", k).over(w)).alias(f"rs_mom_{k}") for k in spans])


def vote(rs: DataFrame, weights: dict[str, float], need: float, top: int, least: int, extra: Column | None = None) -> DataFrame:
    """date, industry, vote, rank of the `top` leaders: of the 2 top industries by rs_ratio, those whose weighted votes reach `need`.

    Equal weights of 1 count votes. A date with fewer than `least` leaders takes the order of rs_ratio. Ties go by industry.
    `extra`, a column of rs, is added to the votes.
    """
    by = lambda *order: F.row_number().over(Window.partitionBy("date").orderBy(*order, "industry"))
    votes = sum(w * F.coalesce((F.col(c) >= 100).cast("double"), F.lit(0.0)) for c, w in weights.items())
    votes = votes if extra is None else votes + extra
    out = rs.where("rs_ratio is not null").withColumn("plain", by(F.desc("rs_ratio"))).where(F.col("plain") <= 2 * top).withColumn("vote", votes)
    leads = (F.col("vote") >= need).cast("int")
    out = out.withColumn("leads", leads).withColumn("n", F.sum("leads").over(Window.partitionBy("date")))
    lead_rank = F.when(F.col("leads") == 1, by(F.desc("leads"), F.desc("vote"), F.desc("rs_ratio")))
    out = out.withColumn("rank", F.when(F.col("n") >= least, lead_rank).otherwise(F.col("plain")))
    return out.where(F.col("rank") <= top).select("date", "industry", "vote", "rank")


def risk_filter(chosen: DataFrame, momentum: DataFrame, least: int) -> DataFrame:
    """The chosen industries (date, industry, rank) without those of negative mom; the first `least` where fewer would stay. No mom counts as 0."""
    w = Window.partitionBy("date")
    out = chosen.join(momentum, ["date", "industry"], "left").withColumn("mom", F.coalesce("mom", F.lit(0.0)))
    out = out.withColumn("n", F.sum((F.col("mom") >= 0).cast("int")).over(w))
    return out.where(F.when(F.col("n") >= least, F.col("mom") >= 0).otherwise(F.col("rank") <= least)).drop("n")


def valuation_votes(ep: Column, bp: Column, scale: Column, alpha: float, alpha_choppy: float, alpha_b: float) -> Column:
    """What cheapness adds to a vote: percentiles above one half add, below subtract; unknown ones count as one half.

    The weight of ep is alpha_choppy where the market scale is under 1; a weight of 0 or less adds nothing.
    """
    a = F.when(scale < 1, F.lit(max(alpha_choppy, 0.0))).otherwise(F.lit(max(alpha, 0.0)))
    half = F.lit(0.5)
    return a * (F.coalesce(ep, half) - half) + max(alpha_b, 0.0) * (F.coalesce(bp, half) - half)


def _history(n: int):
    return Window.partitionBy("industry").orderBy("date").rowsBetween(-(n - 1), 0)


def industry_percentile(x: str, n: int, least: int = 1) -> Column:
    """Share of the industry's last n values, the current one included, that are at most the current; null under `least` values."""
    held = F.collect_list(x).over(_history(n))  # n values at most
    return F.when(F.col(x).isNotNull() & (F.size(held) >= least), F.size(F.filter(held, lambda v: v <= F.col(x))) / F.size(held))


def crowding(names: list[str], q: float = 0.95, n: int = 250, least: int = 30) -> Column:
    """Number of the columns that exceed the q-quantile of the industry's last n values; one of fewer than `least` values doesn't count."""
    w = _history(n)
    over = [F.when((F.count(c).over(w) >= least) & (F.col(c) > F.percentile(c, F.lit(q)).over(w)), 1).otherwise(0) for c in names]
    return sum(over[1:], over[0])


def _keep(rows: DataFrame, ok: Column, order: Column, least: int) -> DataFrame:
    """The rows that are ok, or the first `least` of a date in the order where fewer are."""
    w = Window.partitionBy("date")
    out = rows.withColumn("_ok", ok).withColumn("_n", F.sum(F.col("_ok").cast("int")).over(w))
    out = out.withColumn("_at", F.row_number().over(w.orderBy(order, "rank", "industry")))
    return out.where(F.when(F.col("_n") >= least, F.col("_ok")).otherwise(F.col("_at") <= least)).drop("_ok", "_n", "_at")


def crowding_filter(chosen: DataFrame, scores: DataFrame, triggers: int = 2, least: int = 3) -> DataFrame:
    """chosen (date, industry, rank) without those of `triggers` or more in scores (date, industry, crowded); the least crowded fill up."""
    out = chosen.join(scores, ["date", "industry"], "left").withColumn("crowded", F.coalesce("crowded", F.lit(0)))
    return _keep(out, F.col("crowded") < triggers, F.col("crowded"), least)


def valuation_filter(chosen: DataFrame, cheapness: DataFrame, limit: float = 0.1, least: int = 3) -> DataFrame:
    """chosen without those whose cheap (of date, industry, cheap) is under the limit; the cheapest fill up. Unknown counts as one half."""
    out = chosen.join(cheapness, ["date", "industry"], "left").withColumn("cheap", F.coalesce("cheap", F.lit(0.5)))
    return _keep(out, F.col("cheap") >= limit, F.desc("cheap"), least)


def crowding_reversal(score: Column, crowded: Column, triggers: int = 2, instead: Column | None = None) -> Column:
    """The score, in crowded industries with its sign turned or, if given, replaced."""
    return F.when(crowded >= triggers, -score if instead is None else instead).otherwise(score)


def ic_weights(ic: DataFrame, weights: dict[str, float], boost: float = 1.0, confirm: bool = False, replace: bool = False) -> DataFrame:
    """date, factor, weight from ic (date, factor, ic, scale): the fixed weight, enlarged up to 1 + boost times by the date's IC.

    The IC counts by its size over the date's largest, with `confirm` only where its sign is the weight's, and not at all where the market
    scale is under 1. With `replace` the weight keeps its sign and takes the size of the IC. A factor without an IC keeps its weight.
    """
    fixed = F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])
    out = ic.withColumn("w", F.coalesce(F.try_element_at(fixed, F.col("factor")), F.lit(1.0)))
    if replace:
        weight = F.coalesce(F.signum("w") * F.abs("ic"), F.col("w"))
    else:
        size = F.when(F.signum("ic") == F.signum("w"), F.abs("ic")).otherwise(F.when(F.col("ic").isNotNull(), 0.0)) if confirm else F.abs("ic")
        out = out.withColumn("size", size)
        most = F.max("size").over(Window.partitionBy("date"))
        counts = (F.col("scale") >= 1) & (most > 1e-10)
        weight = F.col("w") * (1 + boost * F.when(counts, F.coalesce(F.col("size") / most, F.lit(0.0))).otherwise(0.0))
    return out.select("date", "factor", weight.alias("weight"))


def weighted_scores(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """date, code, score: weighted mean of score (of date, code, factor, score) by absolute weights; null where they are all 0.

    A factor is switched off on a date by a weight of null.
    """
    j = scores.where("score is not null").join(F.broadcast(weights.where("weight is not null")), ["date", "factor"])  # one row per date and factor
    total, size = F.sum(F.col("weight") * F.col("score")), F.sum(F.abs("weight"))
    return j.groupBy("date", "code").agg((total / F.nullif(size, F.lit(0.0))).alias("score"))


def step_scale(index: DataFrame, long: int, short: int) -> DataFrame:
    """date, scale: 0 below the mean of `long` rows, one half below that of `short` rows, else 1; 1 up to `long` rows."""
    w = Window.partitionBy(F.lit(1)).orderBy("date")  # one row per date
    at, far, near = F.row_number().over(w), rolling(F.avg, F.col("close"), long, w), rolling(F.avg, F.col("close"), short, w)
    return index.select("date", F.when(at < long + 1, 1.0).when(F.col("close") < far, 0.0).when(F.col("close") < near, 0.5).otherwise(1.0).alias("scale"))


def binary_scale(index: DataFrame, n: int, span: int, threshold: float) -> DataFrame:
    """date, scale: 0 below the mean of n rows or where the momentum of `span` rows is under the threshold, else 1; 1 up to n rows."""
    w = Window.partitionBy(F.lit(1)).orderBy("date")  # one row per date
    at, mean, mom = F.row_number().over(w), rolling(F.avg, F.col("close"), n, w), pct_change(F.col("close"), span, w)
    return index.select("date", F.when(at < n + 1, 1.0).when((F.col("close") < mean) | (mom < threshold), 0.0).otherwise(1.0).alias("scale"))
