from collections import Counter

from pyspark.sql import functions as F

from quantloom.functions.tables import cut
from quantloom.operators import trees


def test_a_level_reads_each_row_once(spark):
    rows = [("d", 9, "t", str(i), 1e-9 * (3 * i - 7), [i % 4, i % 3]) for i in range(40)]
    df = spark.createDataFrame(rows, "decision string, window int, date string, code string, y double, bins array<int>")
    kinds = {"extra": {"a": {"trees": 2, "depth": 2}}}
    split = F.create_map(F.lit(1), F.struct(F.lit(1).alias("feature"), F.lit(0).alias("bin")))
    models = trees.expert_grid(spark, {"all": [0, 1]}, [9], kinds).select(F.lit("d").alias("decision"), F.lit(0.0).alias("base"), "*", F.explode(F.array(F.lit(0), F.lit(1))).alias("tree"))
    models = models.withColumn("splits", split).withColumn("done", F.array().cast("array<struct<splits: map<int, struct<feature: int, bin: int>>, means: map<int, double>>>"))
    out = trees._histogram(df.repartition(3), cut(models))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # a row is not copied for each tree and feature
    want = Counter()
    for *_, i, y, bins in rows:
        for tree in (0, 1):
            for f in (0, 1):
                want[tree, 3 if bins[1] > 0 else 2, f, bins[f], "s"] += round(y * 1e9)
                want[tree, 3 if bins[1] > 0 else 2, f, bins[f], "n"] += 1
    got = {}
    for r in out.collect():
        got |= {(r.tree, r.node, r.feature, r.bin, "s"): r.s, (r.tree, r.node, r.feature, r.bin, "n"): r.n}
    assert got == dict(want)
