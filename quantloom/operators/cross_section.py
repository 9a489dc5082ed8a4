"""Cross-sectional primitives, partitioned by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.scalars import ratio


def by_date():
    return Window.partitionBy("date")


def rank_avg(x: str, by=("date",)) -> Column:
    """Average-tie rank."""
    w = Window.partitionBy(*by).orderBy(x)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    return F.when(F.col(x).isNotNull(), F.rank().over(w) - F.count(F.when(F.col(x).isNull(), 1)).over(Window.partitionBy(*by)) + (ties - 1) / 2)


def rank_pct(x: str) -> Column:
    return rank_avg(x) / F.count(F.col(x)).over(by_date())


def zscore(x: str, min_names: int = 5) -> Column:
    c = F.col(x)
    sd = F.stddev_samp(c).over(by_date())
    return F.when((F.count(c).over(by_date()) >= min_names) & (sd >= 1e-10), (c - F.avg(c).over(by_date())) / sd)


def winsorize(df: DataFrame, x: str, q: float) -> DataFrame:
    """Clip x to its quantiles q and 1 - q by date."""
    lo, hi = F.percentile(x, F.lit(q)).over(by_date()), F.percentile(x, F.lit(1 - q)).over(by_date())
    return df.withColumn(x, F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), lo), hi)))


def quantile_group(x: str, g: int, by=("date",)) -> Column:
    """Groups 1..g of floor(n/g) names each, the last takes the rest; ties go by code."""
    w = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(w)
    at = F.row_number().over(w.orderBy(F.desc(x), "code"))
    return F.when(n >= g, F.least(F.floor((at - 1) / F.floor(n / g)), F.lit(g - 1)) + 1).cast("int")


def top_n(df: DataFrame, score: str, n: int, by=("date",)) -> DataFrame:
    """The n best rows per group, null scores last, ties by code; ranks before the filter so that Spark limits groups early."""
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(score), "code")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def preprocess(df: DataFrame, x: str, q: float, train: DataFrame) -> DataFrame:
    """x clipped to the training rows' quantiles q and 1 - q, then scaled by their mean and deviation; null becomes 0."""
    cut = F.broadcast(train.agg(F.percentile(x, F.lit(q)).alias("_lo"), F.percentile(x, F.lit(1 - q)).alias("_hi"), F.lit(1).alias("_one")))
    clipped = lambda d: d.withColumn("_one", F.lit(1)).join(cut, "_one").withColumn(x, F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), "_lo"), "_hi")))
    stats = clipped(train).agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"), F.lit(1).alias("_one"))
    out = clipped(df).join(F.broadcast(stats), "_one")
    scale = F.when(F.col("_s") < 1e-10, 1.0).otherwise(F.col("_s"))
    return out.withColumn(x, F.coalesce((F.col(x) - F.col("_m")) / scale, F.lit(0.0))).select(*df.columns)


def mad_filter(df: DataFrame, x: str, limit: float = 5.0) -> DataFrame:
    """Rows with |0.6745 (x - median) / MAD| under the limit, by date."""
    rows = df.withColumn("_dev", F.abs(F.col(x) - F.percentile(x, F.lit(0.5)).over(by_date())))
    rows = rows.withColumn("_mad", F.percentile("_dev", F.lit(0.5)).over(by_date()))
    return rows.where(0.6745 * ratio(F.col("_dev"), F.col("_mad")) < limit).select(*df.columns)


def orthogonalize(base: str, target: str, least: int = 10) -> Column:
    """target less corr times base (both z-scores), over its deviation; target itself under `least` names or without a residual."""
    w, both = by_date(), F.col(base).isNotNull() & F.col(target).isNotNull()
    x, y = F.when(both, F.col(base)), F.when(both, F.col(target))
    mean = lambda c: F.avg(c).over(w)
    sx, sy = F.stddev_pop(x).over(w), F.stddev_pop(y).over(w)
    rho = ratio(mean(x * y) - mean(x) * mean(y), sx * sy)
    # The deviation (ddof 1) of y - rho x from the moments, as windows do not nest.
    n = F.count(x).over(w)
    sd = F.sqrt(F.greatest(sy * sy + rho * rho * sx * sx - 2 * rho * rho * sx * sy, F.lit(0.0)) * n / F.nullif(n - 1, F.lit(0)))
    return F.when((n >= least) & both & (sd >= 1e-10), (y - rho * x) / sd).otherwise(F.col(target))


def composite_score(weights: dict[str, float]) -> Column:
    """Weighted sum of the factors at hand over the sum of their absolute weights."""
    total = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    held = sum((F.when(F.col(c).isNotNull(), abs(w)).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return ratio(total, held)
