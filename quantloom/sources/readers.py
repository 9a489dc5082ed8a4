"""Readers and writers of panel tables: partitioned Parquet, CSV, results; selections by date, code and snapshot; wide tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAR = ("open", "high", "low", "close", "volume", "money")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_partitioned(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table `name` under root, of folders year=<y>; columns merge by name, the partition column goes."""
    return spark.read.option("mergeSchema", True).parquet(f"{root.rstrip('/')}/{name}").drop("year")


def write_by_year(df: DataFrame, root: str, name: str, year: int | None = None) -> None:
    """Write folders year=<y>: all of them, or only the given year's, leaving the others as they are."""
    rows = df.withColumn("year", F.year("date"))
    if year is not None:
        rows = rows.where(F.col("year") == year)
    # One shuffle by year and code keeps few files in each folder and no task with a whole year.
    rows = rows.repartition("year", F.pmod(F.xxhash64("code"), F.lit(8)))
    rows.write.option("partitionOverwriteMode", "dynamic").partitionBy("year").mode("overwrite").parquet(f"{root.rstrip('/')}/{name}")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The CSV file with a header; a missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, schema=schema, header=True, dateFormat="yyyy-MM-dd")


def write_results(df: DataFrame, path: str, form: str = "json") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.json(path)


def read_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """name, date, ret of result files, each an object of a name and equally long arrays dates and returns; empty ones add no row."""
    runs = spark.read.json(paths, schema="name string, dates array<date>, returns array<double>", multiLine=True)
    return runs.select("name", F.explode(F.arrays_zip("dates", "returns")).alias("r")).select("name", F.col("r.dates").alias("date"), F.col("r.returns").alias("ret"))


def select_rows(df: DataFrame, codes=None, start=None, end=None, date: str = "date") -> DataFrame:
    """Rows of inclusive date bounds and of the codes: a list, or a table with a column code. What is not given does not restrict."""
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(date) <= F.lit(end).cast("date"))
    if codes is None:
        return df
    return df.join(codes.select("code").distinct(), "code", "left_semi") if isinstance(codes, DataFrame) else df.where(F.col("code").isin(*codes))


def daily_price(df: DataFrame, codes=None, start=None, end=None, adjust: str | None = None) -> DataFrame:
    """date, code and the bar columns; adjust="post" takes the columns postfq_<name>, where the table has them."""
    name = lambda c: f"postfq_{c}" if adjust == "post" and f"postfq_{c}" in df.columns else c
    return select_rows(df, codes, start, end).select("date", "code", *[F.col(name(c)).alias(c) for c in BAR])


def at_latest(df: DataFrame, as_of=None) -> DataFrame:
    """All rows of the last date up to as_of."""
    rows = select_rows(df, end=as_of)
    last = rows.agg(F.max("date").alias("date"))
    return rows.join(F.broadcast(last), "date", "left_semi")  # one row


def all_codes(df: DataFrame, as_of=None) -> DataFrame:
    return at_latest(df, as_of).select("code").distinct()


def tradable(df: DataFrame, as_of=None, codes=None) -> DataFrame:
    """Codes neither paused nor is_st on the last date; unknown flags don't count as tradable."""
    return select_rows(at_latest(df, as_of), codes).where("paused = false and is_st = false").select("code").distinct()


def industry_map(df: DataFrame, as_of=None) -> DataFrame:
    """code and its last industry up to as_of; of several on one date the greatest."""
    return select_rows(df, end=as_of).groupBy("code").agg(F.max(F.struct("date", "industry")).getField("industry").alias("industry"))


def index_constituents(members: DataFrame, index: str, as_of=None) -> DataFrame:
    """Codes of the index's last snapshot up to as_of."""
    return all_codes(members.where(F.col("index") == index), as_of)


def resolve_pools(members: DataFrame, pools: dict, as_of=None) -> DataFrame:
    """pool, code. A pool is a list of codes, {"stocks": list}, or {"index": name}, where A+B is the union of two indices."""
    spark, parts = members.sparkSession, [members.sparkSession.createDataFrame([], "pool string, code string")]
    for pool, given in pools.items():
        if isinstance(given, dict) and "index" in given:
            parts += [index_constituents(members, i.strip(), as_of).select(F.lit(pool).alias("pool"), "code") for i in given["index"].split("+")]
        else:
            codes = given if isinstance(given, list) else given.get("stocks", [])
            parts.append(spark.createDataFrame([(pool, c) for c in codes], "pool string, code string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def trade_calendar(days: DataFrame, start=None, end=None) -> DataFrame:
    return select_rows(days.where("is_trade_day"), start=start, end=end).select("date").distinct()


def weekday_calendar(bounds: DataFrame) -> DataFrame:
    """date: the days from Monday to Friday between the columns start and end of one row."""
    return bounds.select(F.explode(F.sequence("start", "end")).alias("date")).where(F.weekday("date") < 5)


def wide_table(base: DataFrame, parts: dict[str, DataFrame], latest: DataFrame | None = None) -> DataFrame:
    """base with the columns of each part by (date, code), and of `latest` by code; a name already taken gets the suffix _<part>."""
    def add(left: DataFrame, right: DataFrame, keys: list[str], suffix: str) -> DataFrame:
        return left.join(right.select(*keys, *[F.col(c).alias(f"{c}_{suffix}" if c in left.columns else c) for c in right.columns if c not in keys]), keys, "left")

    for suffix, part in parts.items():
        base = add(base, part, ["date", "code"], suffix)
    return base if latest is None else add(base, latest, ["code"], "ind")


def factor_long(df: DataFrame, names: list[str], codes=None, start=None, end=None) -> DataFrame:
    """date, code, factor, value of pre-computed factors held in columns."""
    return select_rows(df, codes, start, end).unpivot(["date", "code"], names, "factor", "value")
