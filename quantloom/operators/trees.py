"""Regression trees of many models in one job, grown level by level from histograms.

A model is one expert (kind, parameters, features, window) on one decision date. Rows carry the bins of their features; for each level, sums of
the target by (model, tree, node, feature, bin) are one aggregation of arrays that the tasks fill, the best split of each node is one window over bins,
and the trees themselves are a small table of maps, by which rows find their node again. So the driver loops over levels (and over the rounds
of boosting) only, never over models, dates or trees. Targets are whole numbers of 1e-9, draws are hashes of the row's keys: sums are exact, and a fit is
the same at any partitioning.

Kinds: forest (a Poisson(1) weight per row and tree, a share of the features per node), extra (all rows, one drawn bin per node and feature),
boosted (each tree fits what the ones before leave, times rate).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quantloom.functions.scalars import let
from quantloom.functions.tables import cut

SCALE = 1_000_000_000
MODEL = ("decision", "window", "expert", "tree")
CONFIG = "expert string, kind string, window int, features array<int>, trees int, depth int, rate double, columns double, leaf long"
#: Distribution function of a Poisson variable of mean 1.
POISSON = (0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582)
DRAWS = 1_000_003


def expert_grid(spark: SparkSession, feature_sets: dict[str, list[int]], windows: list[int], kinds: dict[str, dict[str, dict]]) -> DataFrame:
    """A row per expert, named kind_hyper_features_w<window>; kinds holds the parameters (trees, depth, rate, columns, leaf) by kind and hyper set."""
    rows = []
    for kind, hypers in kinds.items():
        for hyper, p in hypers.items():
            for name, features in feature_sets.items():
                rows += [(f"{kind}_{hyper}_{name}_w{w}", kind.split("-")[0], w, features, p["trees"], p["depth"], p.get("rate", 1.0), p.get("columns", 1.0), p.get("leaf", 5)) for w in windows]
    return spark.createDataFrame(rows, CONFIG)


def _uniform(*keys) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(DRAWS)) / DRAWS


def walk(bins: Column, splits: Column, depth: Column) -> Column:
    """The node that a row reaches: 1 is the root, 2n and 2n + 1 are the sides of n."""
    move = lambda n: let(F.try_element_at(splits, n), lambda s: F.when(s.isNull(), n).otherwise(2 * n + F.when(F.get(bins, s["feature"]) <= s["bin"], 0).otherwise(1)))
    return F.aggregate(F.sequence(F.lit(1), depth), F.lit(1), lambda n, _: move(n))


def _leaf(bins: Column, tree: Column, depth: Column) -> Column:
    return F.coalesce(F.try_element_at(tree["means"], walk(bins, tree["splits"], depth)), F.lit(0.0))


def _boosted(bins: Column, done: Column, depth: Column, rate: Column) -> Column:
    return F.aggregate(done, F.lit(0.0), lambda a, t: a + rate * _leaf(bins, t, depth))


def _half_up(x: np.ndarray) -> np.ndarray:
    """Whole numbers, halves away from 0, as Spark rounds."""
    t = np.trunc(x)
    return (t + np.where(np.abs(x - t) >= 0.5, np.sign(x), 0.0)).astype(np.int64)


def _reached(bins: np.ndarray, splits: dict, depth: int) -> np.ndarray:
    """`walk` for many rows: bins has a row each."""
    node = np.ones(len(bins), np.int64)
    for n in sorted(k for k in splits if k < 1 << depth):  # a node comes after the one above it
        at = node == n
        node[at] = 2 * n + (bins[at, splits[n]["feature"]] > splits[n]["bin"])
    return node


def _rest(m: dict, bins: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What the trees before leave of the target."""
    if m["kind"] != "boosted":
        return y
    total = np.zeros(len(y))
    for t in m["done"]:
        node = _reached(bins, t["splits"], m["depth"])
        mean = np.zeros(node.max(initial=0) + 1)
        for n, v in t["means"].items():
            if n < len(mean):
                mean[n] = v
        total = total + m["rate"] * mean[node]
    return y - (m["base"] + total)


def _add(held: tuple | None, m: dict, bins: np.ndarray, rest: np.ndarray, weight: np.ndarray) -> tuple:
    """The sums of a tree by (node, feature, bin) with those of more rows; whole numbers, so in any order."""
    nodes, width = 2 << m["depth"], max(int(bins.max(initial=0)) + 1, held[0].shape[2] if held else 1)
    out = tuple(np.zeros((nodes, len(m["features"]), width), np.int64) for _ in range(2))
    if held:
        for x, h in zip(out, held):
            x[:, :, : h.shape[2]] = h
    node, g = _reached(bins, m["splits"], m["depth"]), weight * _half_up(rest * SCALE)
    for k, f in enumerate(m["features"]):
        place = (node * len(m["features"]) + k) * width + bins[:, f]
        np.add.at(out[0].reshape(-1), place, g)
        np.add.at(out[1].reshape(-1), place, weight)
    return out


def _histogram(rows: DataFrame, models: DataFrame) -> DataFrame:
    """model, node, feature, bin, s, n: sums of the target and of the weights.

    The trees, a small table, go to every task; a task streams its rows into one array of sums per tree, and the arrays' cells are added by Spark.
    So a row is read once a level, not once for each model and feature.
    """
    spark, names = rows.sparkSession, [*MODEL, "kind", "columns", "leaf"]
    found = [r.asDict(recursive=True) for r in models.select(*names, "features", "depth", "rate", "base", "done", "splits").collect()]
    found.sort(key=lambda m: (m["expert"], m["tree"]))
    sets: dict = {}
    for i, m in enumerate(found):
        sets.setdefault((m["decision"], m["window"]), []).append((i, m))
    shared, features = spark.sparkContext.broadcast(sets), [m["features"] for m in found]
    drawn = models.where("kind = 'forest'").groupBy("decision", "window").agg(F.sort_array(F.collect_list(F.struct("expert", "tree"))).alias("drawn"))  # a set's trees
    draw = lambda t: F.pmod(F.xxhash64(t["expert"], t["tree"], "code", "date"), F.lit(DRAWS))
    keyed = rows.join(F.broadcast(drawn), ["decision", "window"], "left")
    keyed = keyed.select("decision", "window", "y", "bins", F.coalesce(F.transform("drawn", draw), F.array().cast("array<bigint>")).alias("draws"))

    def run(batches):
        trees, sums = shared.value, {}
        for b in batches:
            dates, spans = (b.column(c).dictionary_encode() for c in ("decision", "window"))
            y, width = b.column("y").to_numpy(zero_copy_only=False), len(b.column("bins").flatten()) // max(len(b), 1)
            bins = b.column("bins").flatten().to_numpy().reshape(len(b), width)
            for d, decision in enumerate(dates.dictionary.to_pylist()):
                for w, window in enumerate(spans.dictionary.to_pylist()):
                    at = np.nonzero((dates.indices.to_numpy() == d) & (spans.indices.to_numpy() == w))[0]
                    if not len(at) or (decision, window) not in trees:
                        continue
                    x, u = bins[at], b.column("draws").take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1) / DRAWS
                    forest = 0
                    for i, m in trees[decision, window]:
                        weight = np.ones(len(at), np.int64)
                        if m["kind"] == "forest":
                            weight, forest = sum((u[:, forest] >= p).astype(np.int64) for p in POISSON), forest + 1
                        sums[i] = _add(sums.get(i), m, x, _rest(m, x, y[at]), weight)
        for i, (s, n) in sums.items():
            node, k, at = np.nonzero(n)
            feature = np.array(features[i], np.int32)[k]
            yield pa.RecordBatch.from_pydict({"i": np.full(len(node), i, np.int32), "node": node.astype(np.int32), "feature": feature, "bin": at.astype(np.int32), "s": s[node, k, at], "n": n[node, k, at]})

    cells = keyed.mapInArrow(run, "i int, node int, feature int, bin int, s bigint, n bigint")
    cells = cells.groupBy("i", "node", "feature", "bin").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    schema = StructType([StructField("i", IntegerType()), *[models.schema[c] for c in names]])
    of = spark.createDataFrame([(i, *[m[c] for c in names]) for i, m in enumerate(found)], schema)
    return cells.join(F.broadcast(of), "i").select(*names, "node", "feature", "bin", "s", "n")


def _best(hist: DataFrame) -> DataFrame:
    """model, node, mean and the node's best split, null where none gains: ties go to the smaller feature, then the smaller bin."""
    node = Window.partitionBy(*MODEL, "node", "feature")
    upto = node.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumn("sl", F.sum("s").over(upto)).withColumn("nl", F.sum("n").over(upto)).withColumn("st", F.sum("s").over(node)).withColumn("nt", F.sum("n").over(node))
    h = h.withColumn("low", F.min("bin").over(node)).withColumn("high", F.max("bin").over(node))
    sl, sr, st = (x.cast("double") / SCALE for x in (F.col("sl"), F.col("st") - F.col("sl"), F.col("st")))
    nl, nr, nt = F.col("nl"), F.col("nt") - F.col("nl"), F.col("nt")
    gain = F.round(sl * sl / nl + sr * sr / F.nullif(nr, F.lit(0)) - st * st / nt, 9)
    drawn = F.col("low") + F.floor(_uniform("expert", "tree", "node", "feature") * (F.col("high") - F.col("low"))).cast("int")
    # The drawn bin may hold no row; the split then is the one at the last bin with rows up to it.
    after = F.coalesce(F.lead("bin").over(node.orderBy("bin")), F.lit(2**30))
    open_ = F.when(F.col("kind") == "extra", (F.col("bin") <= drawn) & (after > drawn)).otherwise(_uniform("expert", "tree", "node", "feature", F.lit("c")) < F.col("columns"))
    good = open_ & (nl >= F.col("leaf")) & (nr >= F.col("leaf")) & (gain > 1e-9)
    split = F.when(good, F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), (sl / nl).alias("left"), (sr / F.nullif(nr, F.lit(0))).alias("right")))
    return h.select(*MODEL, "node", (st / nt).alias("mean"), split.alias("split")).groupBy(*MODEL, "node").agg(F.first("mean").alias("mean"), F.max("split").alias("split"))


def _grow(models: DataFrame, best: DataFrame) -> DataFrame:
    """models with one more level: splits of their nodes, and the means of the nodes and their sides."""
    at = F.struct("node", "mean", "split")
    found = best.groupBy(*MODEL).agg(F.collect_list(at).alias("found"))  # nodes of one tree
    cut_ = F.filter("found", lambda x: x["split"].isNotNull())
    splits = F.map_from_entries(F.transform(cut_, lambda x: F.struct(x["node"], F.struct((-x["split"]["f"]).alias("feature"), (-x["split"]["b"]).alias("bin")))))
    sides = F.flatten(F.transform(cut_, lambda x: F.array(F.struct((2 * x["node"]).alias("node"), x["split"]["left"].alias("mean")), F.struct((2 * x["node"] + 1).alias("node"), x["split"]["right"].alias("mean")))))
    means = F.map_from_entries(F.concat(F.transform("found", lambda x: F.struct(x["node"].alias("node"), x["mean"].alias("mean"))), sides))
    j = models.join(found, [*MODEL], "left")
    merged = lambda new, old: F.when(F.col("found").isNull(), F.col(old)).otherwise(F.map_concat(F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False))), new))
    return j.withColumn("splits", merged(splits, "splits")).withColumn("means", merged(means, "means")).drop("found")


def fit(rows: DataFrame, experts: DataFrame) -> DataFrame:
    """decision, window, expert, kind, depth, rate, base, trees (their splits and means) from rows (decision, window, date, code, y, bins)."""
    rows = cut(rows.where("y is not null").select("decision", "window", "date", "code", F.col("y").cast("double").alias("y"), "bins"))
    base = cut(rows.groupBy("decision", "window").agg((F.sum(F.round(F.col("y") * SCALE).cast("long")) / F.count("*") / SCALE).alias("base")))
    tree = "struct<splits: map<int, struct<feature: int, bin: int>>, means: map<int, double>>"
    none = lambda kind: F.create_map().cast(kind)
    empty = {"splits": none("map<int, struct<feature: int, bin: int>>"), "means": none("map<int, double>")}
    every = F.sequence(F.lit(0), F.when(F.col("kind") == "boosted", 0).otherwise(F.col("trees") - 1))
    models = base.join(experts, "window").withColumn("tree", F.explode(every)).withColumn("done", F.array().cast(f"array<{tree}>"))
    shape = experts.agg(F.max("depth"), F.max(F.when(F.col("kind") == "boosted", F.col("trees")).otherwise(1))).first()
    finished = []
    for round_ in range(shape[1] or 0):
        models = models.withColumns(empty)
        for level in range(shape[0]):
            # A tree of a smaller depth has its nodes already; so have all the trees that don't boost, after the first round.
            growing = models.where(F.col("depth") > level)
            models = cut(_grow(growing, _best(_histogram(rows, growing))).unionByName(models.where(F.col("depth") <= level)))
        models = models.withColumn("done", F.concat("done", F.array(F.struct("splits", "means").cast(tree))))
        over = (F.col("kind") != "boosted") | (F.col("trees") <= round_ + 1)
        finished.append(models.where(over).drop("splits", "means"))
        models = models.where(~over).withColumn("tree", F.lit(round_ + 1)).drop("splits", "means")
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    return out.groupBy("decision", "window", "expert", "kind", "depth", "rate", "base").agg(F.flatten(F.collect_list("done")).alias("trees"))


def predict(models: DataFrame, rows: DataFrame) -> DataFrame:
    """decision, code, expert, prediction of rows (decision, window, code, bins): the mean of the trees, or their boosted sum over the base."""
    j = rows.select("decision", "window", "code", "bins").join(models, ["decision", "window"])
    mean = F.aggregate("trees", F.lit(0.0), lambda a, t: a + _leaf(F.col("bins"), t, F.col("depth"))) / F.size("trees")
    boosted = F.col("base") + _boosted(F.col("bins"), F.col("trees"), F.col("depth"), F.col("rate"))
    return j.select("decision", "code", "expert", F.when(F.col("kind") == "boosted", boosted).otherwise(mean).alias("prediction"))
