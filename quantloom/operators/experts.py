"""Panels of expert predictions (date, expert, code, prediction): ICs, ensembles, overlap and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.scalars import correlation, ratio
from quantloom.operators.cross_section import rank_avg
from quantloom.operators.evaluation import compute_ic

KEY = ("date", "expert")


def excess_label(prices: DataFrame, market: DataFrame, h: int) -> DataFrame:
    """date, code, label: forward return over h rows less the market's."""
    stock = F.lead("close", h).over(Window.partitionBy("code").orderBy("date")) / F.col("close") - 1
    index = market.withColumn("m", F.lead("close", h).over(Window.partitionBy(F.lit(1)).orderBy("date")) / F.col("close") - 1).select("date", "m")
    rows = prices.select("date", "code", stock.alias("s")).join(F.broadcast(index), "date")
    return rows.select("date", "code", (F.col("s") - F.col("m")).alias("label"))


def time_holdout(panel: DataFrame, share: float = 0.2, least: int = 100) -> DataFrame:
    """panel plus holdout: the rows of the last `share` of the dates; none under `least` rows."""
    days = panel.select("date").distinct()
    w = Window.partitionBy(F.lit(1))
    days = days.withColumn("_late", F.row_number().over(w.orderBy("date")) > F.count("*").over(w) * (1 - share))
    n = panel.agg(F.count("*").alias("_n"), F.lit(True).alias("_one"))
    days = days.withColumn("_one", F.lit(True)).join(n, "_one").select("date", (F.col("_late") & (F.col("_n") >= least)).alias("holdout"))
    return panel.join(F.broadcast(days), "date")


def rank_share(x: str, by=KEY) -> Column:
    return rank_avg(x, by) / F.count(F.col(x)).over(Window.partitionBy(*by))


def expert_ic(predictions: DataFrame) -> DataFrame:
    """date, expert, ic, n of predictions against label; an undefined IC is 0."""
    ic = compute_ic(predictions, "prediction", "label", by=KEY)
    return ic.withColumn("ic", F.when(F.col("n") >= 10, F.coalesce("ic", F.lit(0.0))))


def ensemble(predictions: DataFrame, ic: DataFrame | None = None, ranks: bool = False) -> DataFrame:
    """date, code, score: the mean prediction or rank share, weighted by max(IC, 0) where an IC is given; equal if none is positive."""
    x = predictions.withColumn("_x", rank_share("prediction") if ranks else F.col("prediction"))
    if ic is None:
        return x.groupBy("date", "code").agg(F.avg("_x").alias("score"))
    x = x.join(F.broadcast(ic.select(*KEY, F.greatest(F.coalesce("ic", F.lit(0.0)), F.lit(0.0)).alias("_w"))), list(KEY))
    return x.groupBy("date", "code").agg(F.coalesce(ratio(F.sum(F.col("_w") * F.col("_x")), F.sum("_w")), F.avg("_x")).alias("score"))


def expert_summary(ic: DataFrame) -> DataFrame:
    x = F.col("ic")
    return ic.where("ic is not null").groupBy("expert").agg(
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), ratio(F.avg(x), F.stddev_samp(x)).alias("ir"), F.stddev_pop(x).alias("std_pop"),
        F.avg((x > 0).cast("double")).alias("positive"), F.max(x).alias("best"), F.min(x).alias("worst"), F.count("*").alias("n"),
    )


def monthly_ic(ic: DataFrame, period: str) -> DataFrame:
    return ic.where("ic is not null").groupBy("expert", F.col(period).alias("period")).agg(F.avg("ic").alias("ic"))


def _pairs(rows: DataFrame, keys: list[str], value: str | None = None) -> DataFrame:
    x = rows.select(*keys, F.col("expert").alias("a"), *([F.col(value).alias("x")] if value else []))
    y = rows.select(*keys, F.col("expert").alias("b"), *([F.col(value).alias("y")] if value else []))
    return x.join(y, keys).where("a < b")


def expert_correlations(predictions: DataFrame) -> DataFrame:
    """a, b, corr of the within-date ranks over all dates."""
    ranks = predictions.select(*KEY, "code", rank_avg("prediction", KEY).alias("r"))
    return _pairs(ranks, ["date", "code"], "r").groupBy("a", "b").agg(correlation("x", "y").alias("corr"))


def top_picks(predictions: DataFrame, n: int) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc_nulls_last("prediction"), "code"))
    return predictions.withColumn("rank", at).where(F.col("rank") <= n)


def overlap(predictions: DataFrame, n: int) -> DataFrame:
    """a, b, jaccard: mean over dates of the shared part of the two experts' n best names."""
    top = top_picks(predictions, n).select(*KEY, "code")
    size = top.groupBy(*KEY).agg(F.count("*").alias("k"))
    both = _pairs(top, ["date", "code"]).groupBy("date", "a", "b").agg(F.count("*").alias("c"))
    sizes = _pairs(size, ["date"], "k")
    rows = sizes.join(both, ["date", "a", "b"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return rows.groupBy("a", "b").agg(F.avg(F.col("c") / (F.col("x") + F.col("y") - F.col("c"))).alias("jaccard"))


def redundant(correlations: DataFrame, overlaps: DataFrame, corr: float = 0.95, jaccard: float = 0.85) -> DataFrame:
    return correlations.join(overlaps, ["a", "b"]).where((F.col("corr") >= corr) | (F.col("jaccard") >= jaccard))


def votes(predictions: DataFrame, n: int) -> DataFrame:
    """date, code, votes, share of the experts, mean rank among those that pick the name."""
    experts = predictions.groupBy("date").agg(F.count_distinct("expert").alias("_n"))
    v = top_picks(predictions, n).groupBy("date", "code").agg(F.count("*").alias("votes"), F.avg("rank").alias("mean_rank"))
    return v.join(F.broadcast(experts), "date").select("date", "code", "votes", (F.col("votes") / F.col("_n")).alias("share"), "mean_rank")


def group_discrimination(correlations: DataFrame, groups: DataFrame) -> DataFrame:
    """within and between: mean correlation of experts of one group and of different groups; groups is expert, grp."""
    g = lambda k: groups.select(F.col("expert").alias(k), F.col("grp").alias(f"g{k}"))
    rows = correlations.join(F.broadcast(g("a")), "a").join(F.broadcast(g("b")), "b")
    same = F.col("ga") == F.col("gb")
    return rows.agg(F.avg(F.when(same, F.col("corr"))).alias("within"), F.avg(F.when(~same, F.col("corr"))).alias("between"))


def group_stats(summary: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, group, n_experts and the mean, deviation, IR, share over 0 and holdout IC of its experts, by grouping sets: one pass for all dimensions.

    summary has a row per expert: the dimensions, ic, ir, positive, holdout. The deviation (ddof 1) of a single expert is 0; rank is by mean IC within a dimension.
    """
    keys = [F.col(d).cast("string").alias(d) for d in dimensions]
    rows = summary.select(*keys, "ic", "ir", "positive", "holdout")
    out = rows.groupingSets([[d] for d in dimensions], *dimensions).agg(
        F.coalesce(*[F.when(F.grouping(d) == 0, F.lit(d)) for d in dimensions]).alias("dimension"), F.count("*").alias("n_experts"), F.avg("ic").alias("ic_mean"),
        F.coalesce(F.stddev_samp("ic"), F.lit(0.0)).alias("ic_std"), F.avg("ir").alias("ir_mean"), F.avg("positive").alias("positive_mean"), F.avg("holdout").alias("holdout_mean"),
    )
    group = F.coalesce(*[F.when(F.col("dimension") == d, F.col(d)) for d in dimensions])
    at = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc_nulls_last("ic_mean"), "group"))
    return out.withColumn("group", group).drop(*dimensions).withColumn("rank", at)
