import random

from pyspark.sql import functions as F

from quantloom.sources import market


def test_sums_follow_the_file(spark, tmp_path):
    """The same rows give the same sums, to the last digit, however the file is split."""
    r = random.Random(5)
    rows = [(i % 3, r.randrange(11) / 100) for i in range(3000)]
    spark.createDataFrame(rows, "k int, x double").coalesce(1).write.parquet(str(tmp_path / "t"), compression="none")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128MB", "1KB"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {v.k: (v.x, v.n_x) for v in market.in_file_order(spark.read.parquet(str(tmp_path / "t")), ["k"], {"x": F.col("x")}).collect()}
            want = {}
            for k, x in rows:
                want[k] = (want.get(k, (0.0, 0))[0] + x, want.get(k, (0.0, 0))[1] + 1)
            assert got == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_days_of_equal_values_tie(spark, tmp_path):
    """Equal values in another order have the same mean, so all of the worst days count in cvar_95."""
    values = [round(0.1 * i + 0.07, 2) for i in range(40)]
    r, rows = random.Random(1), []
    for day in range(1, 29):
        for v in r.sample(values, len(values)):
            rows.append(("a", f"2024-01-{day:02}", v if day <= 10 else v + 60))
    spark.createDataFrame(rows, "event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "events.parquet"))
    got = {x.ret for x in market.strategy_returns(spark, str(tmp_path)).collect()}
    assert len(got) == 2


def test_mean_of_odd_values(spark):
    rows = [(1, 0.1), (1, 0.2), (1, None), (2, None), (3, float("nan")), (3, 1.0), (4, 1e300), (4, 0.5), (5, float("inf"))]
    got = {r.k: r.m for r in spark.createDataFrame(rows, "k int, x double").groupBy("k").agg(market.exact_mean(F.col("x")).alias("m")).collect()}
    assert got[1] == (0.3) / 2 and got[2] is None and got[3] != got[3] and got[4] == 5e299 and got[5] == float("inf")
