"""Factor evaluation: IC, ICIR, quantile returns, IC decay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.scalars import correlation, ratio
from quantloom.operators.cross_section import quantile_group, rank_avg
from quantloom.operators.joins import with_calendar
from quantloom.operators.windows import fwd_return

MIN_NAMES = 10
#: Partitions a horizon of `ic_decay`.
DATES = 100


def compute_ic(panel: DataFrame, factor: str, fwd: str, method: str = "rank", by=("date",), least: int = MIN_NAMES) -> DataFrame:
    """by, ic, n for every date: correlation of factor and forward return on rows with both; null under `least` names, and an exact 0 is null."""
    rows = panel.withColumn("_ok", F.col(factor).isNotNull() & F.col(fwd).isNotNull())
    value = (lambda c: rank_avg(c, (*by, "_ok"))) if method == "rank" else F.col
    rows = rows.select(*by, *[F.when(F.col("_ok"), value(c)).alias(n) for c, n in ((factor, "_f"), (fwd, "_r"))])
    ic = F.when(F.count("_f") >= least, F.nullif(F.round(correlation("_f", "_r"), 12), F.lit(0.0)))
    return rows.groupBy(*by).agg(ic.alias("ic"), F.count("_f").alias("n"))


def icir(ic: DataFrame, decay: float = 1.0, by=(), window: int | None = None) -> DataFrame:
    """With `window` over the newest so many dates only. Weighted mean, deviation (ddof 0), ICIR, share over 0, mean |IC| and count; the newest date weighs 1."""
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc("date"))
    rows = ic.where("ic is not null").withColumn("_w", F.pow(F.lit(decay), F.row_number().over(w) - 1))
    if window is not None:
        rows = rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= window)
    sums = rows.groupBy(*by).agg(
        (F.sum(F.col("_w") * F.col("ic")) / F.sum("_w")).alias("mean_ic"),
        (F.sum(F.col("_w") * F.col("ic") * F.col("ic")) / F.sum("_w")).alias("_sq"),
        F.avg((F.col("ic") > 0).cast("double")).alias("positive_share"),
        F.avg(F.abs("ic")).alias("mean_abs_ic"),
        F.count("*").alias("n"),
    )
    std = F.sqrt(F.greatest(F.col("_sq") - F.col("mean_ic") * F.col("mean_ic"), F.lit(0.0)))
    out = sums.withColumn("std_ic", std).withColumn("icir", ratio(F.col("mean_ic"), F.col("std_ic"))).drop("_sq")
    values = ["mean_ic", "std_ic", "icir", "positive_share", "mean_abs_ic"]
    return out.select(*by, *[F.when(F.col("n") < MIN_NAMES, 0.0).otherwise(F.col(v)).alias(v) for v in values], "n")


def quantile_returns(panel: DataFrame, factor: str, fwd: str, g: int = 5, by: tuple = ()) -> DataFrame:
    """Mean over dates of the mean forward return by factor group (and by the given keys); a date needs 5 g names."""
    rows = panel.where(F.col(factor).isNotNull() & F.col(fwd).isNotNull())
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*by, "date"))).where(F.col("_n") >= 5 * g)
    daily = rows.withColumn("grp", quantile_group(factor, g, (*by, "date"))).groupBy(*by, "date", "grp").agg(F.avg(fwd).alias("r"))
    return daily.groupBy(*by, "grp").agg(F.avg("r").alias("mean_ret"), F.count("*").alias("n_dates"))


def ic_decay(panel: DataFrame, factor: str, horizons: list[int], price: str = "close", decay: float = 1.0) -> DataFrame:
    """horizon, weighted mean IC, n: all leads in one window, unpivoted, then one IC pass.

    A task ranks about one date of one horizon: the partitions are not merged by their size, as the ranks' sorts need many times that.
    """
    wide = panel.select("date", "code", factor, *[fwd_return(F.col(price), h).alias(str(h)) for h in horizons])
    long = wide.unpivot(["date", "code", factor], [str(h) for h in horizons], "horizon", "fwd")
    long = long.where(F.col(factor).isNotNull() & F.col("fwd").isNotNull()).select("horizon", "date", factor, "fwd").repartition(DATES * len(horizons), "horizon", "date")
    means = icir(compute_ic(long, factor, "fwd", by=("horizon", "date")), decay, ("horizon",))
    return means.select(F.col("horizon").cast("int").alias("horizon"), "mean_ic", "n")


def long_short(groups: DataFrame) -> DataFrame:
    """The first group's mean return less the last one's, from `quantile_returns`."""
    ends = groups.agg(F.min_by("mean_ret", "grp").alias("a"), F.max_by("mean_ret", "grp").alias("b"))
    return ends.select((F.col("a") - F.col("b")).alias("long_short"))


def ic_table(panel: DataFrame, factors: list[str], fwd: str) -> DataFrame:
    """factor, date, ic, n of many factors in one pass."""
    long = panel.select("date", "code", fwd, *factors).unpivot(["date", "code", fwd], factors, "factor", "x")
    return compute_ic(long, "x", fwd, by=("factor", "date"))


def factor_summary(table: DataFrame, decay: float = 1.0) -> DataFrame:
    return icir(table, decay, ("factor",))


def _marked(rows: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """rows plus, for each of the keys, a row per decision date behind the date's own rows (`_mark` 1, values null)."""
    marks = with_calendar(rows.select(*keys), decisions).withColumn("_mark", F.lit(1))
    return rows.withColumn("_mark", F.lit(0)).unionByName(marks, allowMissingColumns=True)


def rolling_factor_ic(scores: DataFrame, prices: DataFrame, decisions: DataFrame, lookback: int, horizon: int, embargo: int | None = None, least_rows: int = 20, least_dates: int = 5) -> DataFrame:
    """date, factor, ic: the mean rank IC as known on each decision date.

    scores are (date, code, factor, score), prices (date, code, close), decisions (date). The return is that of the next `horizon` rows of a code.
    A date's IC counts from `lookback` to `embargo` (default: horizon) calendar days before the decision, so that its return has been seen;
    null under `least_rows` rows or `least_dates` dates with an IC.
    """
    fwd = prices.select("date", "code", fwd_return(F.col("close"), horizon).alias("fwd")).where("fwd is not null")
    daily = compute_ic(scores.join(fwd, ["date", "code"]), "score", "fwd", by=("factor", "date"), least=2)
    w = Window.partitionBy("factor").orderBy(F.unix_date("date")).rangeBetween(-lookback, -(horizon if embargo is None else embargo))
    enough = (F.sum("n").over(w) >= least_rows) & (F.count("ic").over(w) >= least_dates)
    rows = _marked(daily, decisions, ["factor"]).withColumn("known", F.when(enough, F.avg("ic").over(w)))
    return rows.where("_mark = 1").select("date", "factor", F.col("known").alias("ic"))


def strong_factors(table: DataFrame, decisions: DataFrame, min_ic: float = 0.02, min_icir: float = 0.1, max_corr: float = 0.85, most: int = 15, least: int = MIN_NAMES) -> DataFrame:
    """date, rank, factor, mean_ic, icir of the factors chosen at each decision date from the ICs up to it.

    A factor needs `least` ICs and both thresholds (icir has ddof 0, 0 without a deviation). In order of mean IC, highest first (ties by name), a
    factor is left out where its IC series correlates over `max_corr` with one already chosen, so one that is left out removes none. Statistics
    are running sums, so all decision dates take one pass; the fold sees one date's factors.
    """
    known = table.where("ic is not null").select("factor", "date", "ic")
    upto = lambda *keys: Window.partitionBy(*keys).orderBy("date", "_mark").rowsBetween(Window.unboundedPreceding, 0)
    w = upto("factor")
    n, mean, std = F.count("ic").over(w), F.avg("ic").over(w), F.stddev_pop("ic").over(w)
    at = _marked(known, decisions, ["factor"]).select("date", "factor", "_mark", n.alias("n"), mean.alias("mean_ic"), F.when(std > 1e-8, mean / std).otherwise(0.0).alias("icir"))
    strong = at.where((F.col("_mark") == 1) & (F.col("n") >= least) & (F.abs("mean_ic") >= min_ic) & (F.abs("icir") >= min_icir)).select("date", "factor", "mean_ic", "icir")

    x, y = (known.select("date", F.col("factor").alias(a), F.col("ic").alias(v)) for a, v in (("a", "x"), ("b", "y")))
    w = upto("a", "b")
    mean = lambda c: F.avg(c).over(w)
    both = _marked(x.join(y, "date").where("a < b"), decisions, ["a", "b"])
    both = both.select("date", "a", "b", "_mark", ratio(mean(F.col("x") * F.col("y")) - mean("x") * mean("y"), F.stddev_pop("x").over(w) * F.stddev_pop("y").over(w)).alias("corr"))
    pairs = both.where((F.col("_mark") == 1) & (F.abs("corr") > max_corr)).groupBy("date").agg(F.collect_set(F.struct("a", "b")).alias("pairs"))

    order = F.array_sort(F.collect_list(F.struct((-F.col("mean_ic")).alias("at"), "factor", "mean_ic", "icir")))
    books = strong.groupBy("date").agg(order.alias("held")).join(pairs, "date", "left")

    def take(chosen, f):
        pair = lambda c: F.struct(F.least(c["factor"], f["factor"]).alias("a"), F.greatest(c["factor"], f["factor"]).alias("b"))
        clash = F.coalesce(F.exists(chosen, lambda c: F.array_contains("pairs", pair(c))), F.lit(False))
        return F.when(clash | (F.size(chosen) >= most), chosen).otherwise(F.concat(chosen, F.array(f)))

    chosen = F.aggregate("held", F.slice("held", 1, 0), take)
    return books.select("date", F.posexplode(chosen).alias("i", "f")).select("date", (F.col("i") + 1).alias("rank"), "f.factor", "f.mean_ic", "f.icir")


def factor_correlations(table: DataFrame) -> DataFrame:
    """a, b, corr of the factors' IC series, pair by pair on their common dates."""
    x = table.where("ic is not null").select("date", F.col("factor").alias("a"), F.col("ic").alias("x"))
    y = table.where("ic is not null").select("date", F.col("factor").alias("b"), F.col("ic").alias("y"))
    return x.join(y, "date").where("a < b").groupBy("a", "b").agg(correlation("x", "y").alias("corr"))


def icir_weights(table: DataFrame, window: int = 60, decay: float = 0.65, least: int = 5) -> DataFrame:
    """date, factor, weight: max(ICIR, 0) of the `window` rows before, normalised by date; 0 under `least` values.

    The newest value weighs 1, the k-th before it decay to the power k; the deviation is that of the weighted values.
    """
    f = Window.partitionBy("factor").orderBy("date").rowsBetween(-window, -1)
    rows = table.select("date", "factor", F.collect_list("ic").over(f).alias("held"))  # `window` values at most

    def faded(values):
        """Weighted mean, from the oldest value on."""
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
        return F.aggregate(values, zero, lambda a, x: F.struct((a["s"] * decay + x).alias("s"), (a["w"] * decay + 1).alias("w")), lambda a: ratio(a["s"], a["w"]))

    rows = rows.withColumn("mean", faded(F.col("held")))
    rows = rows.withColumn("std", F.sqrt(faded(F.transform("held", lambda x: (x - F.col("mean")) * (x - F.col("mean"))))))
    icir = F.when((F.size("held") >= least) & (F.col("std") > 1e-8), F.greatest(F.col("mean") / F.col("std"), F.lit(0.0))).otherwise(0.0)
    rows = rows.select("date", "factor", icir.alias("x"))
    return rows.select("date", "factor", F.coalesce(ratio(F.col("x"), F.sum("x").over(Window.partitionBy("date"))), F.lit(0.0)).alias("weight"))


def top_factors(table: DataFrame, until: str | None = None, n: int = 15) -> DataFrame:
    """The n factors of largest absolute mean IC of the dates up to `until`; a factor without an IC counts as 0, ties (to 12 digits) go by name."""
    ic = F.col("ic") if until is None else F.when(F.col("date") <= F.lit(until).cast("date"), F.col("ic"))
    means = table.groupBy("factor").agg(F.coalesce(F.avg(ic), F.lit(0.0)).alias("mean_ic"))
    return means.orderBy(F.desc(F.round(F.abs("mean_ic"), 12)), "factor").limit(n)


def factor_tests(panel: DataFrame, factors: list[str], horizon: int = 20, g: int = 5, horizons: tuple = (5, 10, 20, 40, 60), price: str = "close", decay: float = 1.0) -> DataFrame:
    """A row per factor, numbered by ICIR: its summary, the groups' mean returns q1 to qg, first less last group, and the mean IC of each horizon.

    All factors and horizons are unpivoted once, so each part is one pass whatever their number.
    """
    leads = sorted({horizon, *horizons})
    wide = panel.select("date", "code", *factors, *[fwd_return(F.col(price), h).alias(f"_{h}") for h in leads])
    long = wide.unpivot(["date", "code", *[f"_{h}" for h in leads]], factors, "factor", "x")
    one = icir(compute_ic(long, "x", f"_{horizon}", by=("factor", "date")), decay, ("factor",))
    groups = quantile_returns(long, "x", f"_{horizon}", g, ("factor",)).groupBy("factor").agg(*[F.max(F.when(F.col("grp") == i, F.col("mean_ret"))).alias(f"q{i}") for i in range(1, g + 1)])
    far = long.unpivot(["date", "code", "factor", "x"], [f"_{h}" for h in horizons], "horizon", "fwd")
    far = icir(compute_ic(far, "x", "fwd", by=("factor", "horizon", "date")), 1.0, ("factor", "horizon"))
    far = far.groupBy("factor").agg(*[F.max(F.when(F.col("horizon") == f"_{h}", F.col("mean_ic"))).alias(f"ic_{h}") for h in horizons])
    out = one.join(groups, "factor", "left").join(far, "factor", "left").withColumn("long_short", F.col("q1") - F.col(f"q{g}"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("icir"), "factor")))  # one row a factor


def factor_report(tests: DataFrame) -> DataFrame:
    """factor, section, item, value: the rows of `factor_tests` as a table to print."""
    items = [c for c, t in tests.dtypes if c not in ("factor", "rank") and t in ("double", "bigint")]
    section = F.when(F.col("item").rlike("^(q[0-9]+|long_short)$"), "quantiles").when(F.col("item").rlike("^ic_[0-9]+$"), "decay").otherwise("ic")
    return tests.select("factor", *[F.col(c).cast("double").alias(c) for c in items]).unpivot(["factor"], items, "item", "value").select("factor", section.alias("section"), "item", "value")
