"""Market-like panels derived from the star-schema tables; reads only the columns it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code(spark: SparkSession, sf_dir: str, rows: DataFrame, by: str) -> DataFrame:
    """rows plus code: the supplier, or the brand of the part."""
    if by == "supplier":
        return rows.withColumn("code", F.col("l_suppkey").cast("string"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("code"))
    return rows.join(part, rows["l_partkey"] == part["p_partkey"])


def bars(spark: SparkSession, sf_dir: str, unit: str = "month", by: str = "supplier") -> DataFrame:
    """date, code, open, high, low, close, volume, money by supplier or brand and period."""
    rows = _code(spark, sf_dir, table(spark, sf_dir, "lineitem"), by).withColumn("px", F.col("l_extendedprice") / F.col("l_quantity"))
    k = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    date = F.date_trunc(unit, "l_shipdate").cast("date").alias("date")
    return rows.groupBy(date, "code").agg(
        F.min_by("px", k).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", k).alias("close"),
        F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("money"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, code (brand, week) with holding ratio, balances, and in- and outflows by size class of the order."""
    rows = _code(spark, sf_dir, table(spark, sf_dir, "lineitem"), "brand")
    q, p, out = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_returnflag") == "R"
    big = q >= 30
    total = lambda c: F.coalesce(F.sum(F.when(c, p)), F.lit(0.0))
    return rows.groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("date"), "code").agg(
        F.sum("l_tax").alias("share_ratio"), F.sum("l_extendedprice").alias("fin_value"), F.sum("l_quantity").alias("sec_value"),
        total(~out & big).alias("big_in"), total(out & big).alias("big_out"), F.sum(p).alias("flow"),
        F.sum(F.when(out, F.col("l_discount"))).alias("rate1"),
    )


def in_file_order(rows: DataFrame, keys: list, sums: dict) -> DataFrame:
    """keys and the named sums of doubles, each added in the order of the rows in their files, so they are the same at any partitioning.

    The rows of a group are held at once. A sum of nulls only is null. rows must come straight from files.
    """
    at = [F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")]
    held = rows.select(*keys, F.struct(*at, *[x.alias(n) for n, x in sums.items()]).alias("_r"))
    names = held.columns[: len(keys)]
    held = held.groupBy(*names).agg(F.sort_array(F.collect_list("_r")).alias("_rows"))  # one code's period
    added = lambda n: F.aggregate("_rows", F.lit(None).cast("double"), lambda a, r: F.when(r[n].isNull(), a).otherwise(F.coalesce(a, F.lit(0.0)) + r[n]))
    counted = lambda n: F.size(F.filter("_rows", lambda r: r[n].isNotNull()))
    return held.select(*names, *[added(n).alias(n) for n in sums], *[counted(n).alias(f"n_{n}") for n in sums])


def valuation(spark: SparkSession, sf_dir: str, unit: str = "month", by: str = "supplier") -> DataFrame:
    """date, code, pe_ratio, pb_ratio, ps_ratio, market_cap, dividend_ratio, turnover_ratio by supplier or brand and period.

    A supplier's sums are those of the file's order: many discounts have a mean of exactly 0.05, where the last digit decides a comparison.
    """
    rows, p = _code(spark, sf_dir, table(spark, sf_dir, "lineitem"), by), F.col("l_extendedprice")
    date = F.date_trunc(unit, "l_shipdate").cast("date").alias("date")
    parts = {"p": p, "pd": p * F.col("l_discount"), "pt": p * F.col("l_tax"), "d": F.col("l_discount"), "t": F.col("l_tax")}
    if by == "supplier":
        v = in_file_order(rows, [date, "code"], parts)
    else:
        v = rows.groupBy(date, "code").agg(*[F.sum(x).alias(n) for n, x in parts.items()], *[F.count(x).alias(f"n_{n}") for n, x in parts.items()])
    ratio, mean = lambda n: F.col("p") / F.nullif(F.col(n), F.lit(0.0)), lambda n: F.col(n) / F.nullif(F.col(f"n_{n}"), F.lit(0))
    return v.select(
        "date", "code", ratio("pd").alias("pe_ratio"), (mean("p") / 1000).alias("pb_ratio"), ratio("pt").alias("ps_ratio"), F.col("p").alias("market_cap"),
        mean("d").alias("dividend_ratio"), mean("t").alias("turnover_ratio"),
    )


def industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").cast("string").alias("code"), F.col("n_name").alias("industry"))


def exact_mean(x: Column) -> Column:
    """Mean whose sum is exact for values of at most ten decimals, so equal values have equal means in any order; others are added as doubles."""
    whole = x.try_cast("decimal(28,10)")
    total = F.coalesce(F.sum(whole).cast("double"), F.lit(0.0)) + F.coalesce(F.sum(F.when(whole.isNull(), x)), F.lit(0.0))
    return total / F.nullif(F.count(x), F.lit(0))


def strategy_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("strategy"), F.to_date("ts").alias("date")).agg(((exact_mean(F.col("value")) - 49.6) / 1000).alias("ret"))


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """portfolio (region), date, code, money."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    of = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").cast("string").alias("code"), F.col("n_regionkey").alias("portfolio"))
    return bars(spark, sf_dir).join(of, "code").select("portfolio", "date", "code", F.col("money").alias("weight"))


def benchmark_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).agg(((exact_mean(F.col("value")) - 49.6) / 1000).alias("bench"))
