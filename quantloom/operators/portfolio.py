"""Weights, caps, turnover, trades and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.scalars import let, ratio

BOOK = ("portfolio", "date")


def normalise(weights: DataFrame, x: str = "weight") -> DataFrame:
    return weights.withColumn(x, ratio(F.col(x), F.sum(x).over(Window.partitionBy(*BOOK))))


def _sum(values: Column, of=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + of(x))


def capped(w: Column, cap: float | Column, rounds: int = 10, mode: str = "selector") -> Column:
    """An array of weights with each at most `cap` (a number or a column): what is over goes to the others pro rata, for `rounds` rounds.

    At the end the modes `optimizer` and `engine` clip once more, and `selector` and `optimizer` let the array sum to 1.
    """

    cap = cap if isinstance(cap, Column) else F.lit(float(cap))

    def spread(acc: Column, _: Column) -> Column:
        part = ratio(_sum(acc, lambda x: F.greatest(x - cap, F.lit(0.0))), _sum(acc, lambda x: F.when(x < cap, x).otherwise(0.0)))
        return let(part, lambda p: F.transform(acc, lambda x: F.when(x >= cap, cap).otherwise(x + F.coalesce(x * p, F.lit(0.0)))))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), w, spread)
    if mode != "selector":
        out = F.transform(out, lambda x: F.least(x, cap))
    return out if mode == "engine" else let(out, lambda x: let(_sum(x), lambda total: F.transform(x, lambda y: ratio(y, total))))


def weight_cap(weights: DataFrame, cap: float, rounds: int = 10, mode: str = "selector") -> DataFrame:
    """weights with each book capped (see `capped`): a book is one array in order of code, so all rounds are one fold after one shuffle."""
    others = [c for c in weights.columns if c not in (*BOOK, "code", "weight")]
    rows = F.array_sort(F.collect_list(F.struct("code", "weight", *others)))
    books = weights.groupBy(*BOOK).agg(rows.alias("_rows"))
    books = books.withColumn("_w", capped(F.transform("_rows", lambda x: x["weight"]), cap, rounds, mode))
    out = books.select(*BOOK, F.posexplode("_rows").alias("_i", "_x"), "_w").withColumn("_v", F.get("_w", F.col("_i")))
    return out.select(*[F.col(c) if c in BOOK else F.col("_v").alias(c) if c == "weight" else F.col(f"_x.{c}") for c in weights.columns])


def constrain(weights: DataFrame, old: DataFrame | None, cap: float, industry_cap: float | None = None, limit: float | None = None, least: int = 0, floor: float = 1e-6) -> DataFrame:
    """portfolio, date, code, weight, n, enough: each book capped by name, by industry, held to a one-way turnover against `old`, without what is under the floor.

    weights has portfolio, date, code, weight and, for an industry cap, industry; old is keyed by the same books, and a book that has none there has no limit.
    An industry over its cap is scaled down and what is cut isn't spread. `enough` tells whether `least` names are left. A book is one array, so
    the chain is one fold after the shuffle that merges old and new.
    """
    industry = F.col("industry") if industry_cap is not None else F.lit(None).cast("string")
    rows = weights.select(*BOOK, "code", industry.alias("industry"), F.col("weight").alias("w"), F.lit(None).cast("double").alias("o"))
    if old is not None:
        rows = rows.unionByName(old.select(*BOOK, "code", F.lit(None).cast("string").alias("industry"), F.lit(None).cast("double").alias("w"), F.col("weight").alias("o")))
    names = rows.groupBy(*BOOK, "code").agg(F.max("industry").alias("industry"), F.sum("w").alias("w"), F.sum("o").alias("o"))
    books = names.groupBy(*BOOK).agg(F.array_sort(F.collect_list(F.struct("code", "industry", "w", "o"))).alias("x")).where(F.exists("x", lambda x: x["w"].isNotNull()))
    name = lambda x, w: F.struct(x["code"].alias("code"), F.coalesce(x["industry"], F.lit("")).alias("industry"), w.alias("w"), F.coalesce(x["o"], F.lit(0.0)).alias("o"))

    # Each value that a lambda reads is bound by let: a column that is read once, but in a lambda, would be computed for every element.
    def by_name(x: Column) -> Column:
        """x with capped weights; names that only old has weigh 0."""
        new = F.filter(x, lambda y: y["w"].isNotNull())
        gone = F.transform(F.filter(x, lambda y: y["w"].isNull()), lambda y: name(y, F.lit(0.0)))
        w = capped(F.transform(new, lambda y: y["w"]), cap, mode="optimizer")
        return F.concat(F.zip_with(new, w, name), gone)

    def by_industry(x: Column) -> Column:
        if industry_cap is None:
            return x
        own = lambda i: _sum(F.filter(x, lambda z: z["industry"] == i), lambda z: z["w"])
        totals = F.map_from_entries(F.transform(F.array_distinct(F.transform(x, lambda y: y["industry"])), lambda i: F.struct(i, own(i))))
        part = lambda t, y: F.when(y["industry"] == "", 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(ratio(F.lit(float(industry_cap)), F.element_at(t, y["industry"])), F.lit(1.0))))
        return let(totals, lambda t: F.transform(x, lambda y: name(y, y["w"] * part(t, y))))

    def by_turnover(x: Column) -> Column:
        if limit is None:
            return x
        turned = _sum(x, lambda y: F.abs(y["w"] - y["o"])) / 2
        part = let(turned, lambda t: F.when(F.col("had") & (t > limit), limit / t).otherwise(1.0))
        return let(part, lambda p: F.transform(x, lambda y: name(y, y["o"] + (y["w"] - y["o"]) * p)))

    chain = let(by_name(F.col("x")), lambda x: let(by_industry(x), lambda y: F.filter(by_turnover(y), lambda z: z["w"] > floor)))
    books = books.withColumn("had", F.exists("x", lambda x: x["o"].isNotNull())).select(*BOOK, F.explode(F.array(chain)).alias("x"))
    return books.select(*BOOK, F.explode("x").alias("y"), F.size("x").alias("n")).select(*BOOK, "y.code", F.col("y.w").alias("weight"), "n", (F.col("n") >= least).alias("enough"))


def pool_weights(pools: DataFrame) -> DataFrame:
    """date, pool, weight: an equal share for each pool (of date, pool) that a date has."""
    return pools.select("date", "pool").distinct().withColumn("weight", 1 / F.count("*").over(Window.partitionBy("date")))


def turnover(weights: DataFrame) -> DataFrame:
    """portfolio, date, turnover: half the absolute change against the previous date of the portfolio; missing names weigh 0."""
    dates = weights.select(*BOOK).distinct()
    dates = dates.withColumn("prev", F.lag("date").over(Window.partitionBy("portfolio").orderBy("date"))).where("prev is not null")
    new = dates.join(weights, [*BOOK]).select("portfolio", "date", "code", F.col("weight").alias("d"))
    old = dates.join(weights.withColumnRenamed("date", "prev"), ["portfolio", "prev"]).select("portfolio", "date", "code", (-F.col("weight")).alias("d"))
    change = new.unionByName(old).groupBy(*BOOK, "code").agg(F.sum("d").alias("d"))
    return change.groupBy(*BOOK).agg((F.sum(F.abs("d")) / 2).alias("turnover"))


def concentration(weights: DataFrame) -> DataFrame:
    return weights.groupBy(*BOOK).agg(F.sum(F.col("weight") * F.col("weight")).alias("hhi"), F.count("*").alias("n"))


def position_ledger(trades: DataFrame, order: list[str]) -> DataFrame:
    """trades plus running shares by (account, code)."""
    signed = F.when(F.col("side") == "sell", -F.col("qty")).otherwise(F.col("qty"))
    w = Window.partitionBy("account", "code").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return trades.withColumn("shares", F.sum(signed).over(w))


def rebalance_dates(calendar: DataFrame, freq: str, weekday: int | None = None) -> DataFrame:
    """First traded day of each day, week, two weeks, month or quarter; with `weekday` (0 is Monday) that day where it is traded."""
    unit = "week" if freq == "biweek" else freq
    first = F.min("date") if weekday is None else F.coalesce(F.min(F.when(F.weekday("date") == weekday, F.col("date"))), F.min("date"))
    out = calendar.groupBy(F.date_trunc(unit, "date").cast("date").alias("period")).agg(first.alias("date"))
    if freq == "biweek":  # every second week that is there
        out = out.withColumn("_k", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("period"))).where("_k % 2 = 1").drop("_k")
    return out


def weekday_dates(calendar: DataFrame, weekday: int) -> DataFrame:
    """The traded days that fall on the weekday, without a substitute."""
    return calendar.where(F.weekday("date") == weekday).select("date").distinct()


def equal_weight(names: DataFrame, by=BOOK) -> DataFrame:
    return names.withColumn("weight", 1 / F.count("*").over(Window.partitionBy(*by)))


def inverse_vol_weight(names: DataFrame, vol: str, floor: float = 0.01, default: float = 0.02) -> DataFrame:
    """1 over the volatility, which is `default` where unknown and `floor` at least, normalised by book."""
    return normalise(names.withColumn("weight", 1 / F.greatest(F.coalesce(F.col(vol), F.lit(default)), F.lit(floor))))


def strength_weight(names: DataFrame, strength: str) -> DataFrame:
    """Industries by max(strength, 0), equal inside; equal weights where a value lacks or all are 0. names: portfolio, date, industry, code."""
    inside = F.count("*").over(Window.partitionBy(*BOOK, "industry"))
    book = Window.partitionBy(*BOOK)
    up = F.greatest(F.col(strength), F.lit(0.0)) / inside
    whole = F.count(strength).over(book) == F.count("*").over(book)
    rows = names.withColumn("_u", up).withColumn("_ok", whole).withColumn("_n", F.count("*").over(book))
    total = F.sum("_u").over(book)
    return rows.withColumn("weight", F.when(F.col("_ok") & (total > 0), ratio(F.col("_u"), total)).otherwise(1 / F.col("_n"))).drop("_u", "_ok", "_n")


def industry_weights(weights: DataFrame) -> DataFrame:
    return weights.groupBy(*BOOK, "industry").agg(F.sum("weight").alias("weight"))


def industry_cap(weights: DataFrame, cap: float) -> DataFrame:
    """Scale down the names of an industry over the cap; what is cut is not spread."""
    total = F.sum("weight").over(Window.partitionBy(*BOOK, "industry"))
    return weights.withColumn("weight", F.col("weight") * F.least(F.lit(1.0), ratio(F.lit(cap), total)))


def changes(weights: DataFrame) -> DataFrame:
    """portfolio, date, code, old, new against the portfolio's previous date, over the union of names; the first date has no row."""
    dates = weights.select(*BOOK).distinct()
    dates = dates.withColumn("prev", F.lag("date").over(Window.partitionBy("portfolio").orderBy("date"))).where("prev is not null")
    new = dates.join(weights, [*BOOK]).select(*BOOK, "code", F.lit(0.0).alias("o"), F.col("weight").alias("n"))
    old = dates.join(weights.withColumnRenamed("date", "prev"), ["portfolio", "prev"]).select(*BOOK, "code", F.col("weight").alias("o"), F.lit(0.0).alias("n"))
    return new.unionByName(old).groupBy(*BOOK, "code").agg(F.sum("o").alias("old"), F.sum("n").alias("new"))


def turnover_limit(changed: DataFrame, limit: float) -> DataFrame:
    """changed plus weight: the new weights, or the part of the way to them that the one-way turnover allows."""
    total = F.sum(F.abs(F.col("new") - F.col("old"))).over(Window.partitionBy(*BOOK)) / 2
    part = F.when(total > limit, limit / F.nullif(total, F.lit(0.0))).otherwise(1.0)
    return changed.withColumn("weight", F.col("old") + part * (F.col("new") - F.col("old")))


def smooth_step(changed: DataFrame, limit: float, new_share: float = 0.25) -> DataFrame:
    """changed plus weight: a blend of new and old where the total change passes the limit, normalised by book."""
    total = F.sum(F.abs(F.col("new") - F.col("old"))).over(Window.partitionBy(*BOOK))
    blend = F.when(total > limit, new_share * F.col("new") + (1 - new_share) * F.col("old")).otherwise(F.col("new"))
    return normalise(changed.withColumn("weight", blend))


def holdings_check(weights: DataFrame, least: int) -> DataFrame:
    """portfolio, date, n active names, ok."""
    n = F.count(F.when(F.col("weight") > 1e-6, 1))
    return weights.groupBy(*BOOK).agg(n.alias("n"), (n >= least).alias("ok"))


def scale_by_market(weights: DataFrame, scale: DataFrame) -> DataFrame:
    """weights times the date's scale (of date, scale); a date without one counts as 1."""
    return weights.join(scale.select("date", "scale"), "date", "left").withColumn("weight", F.col("weight") * F.coalesce("scale", F.lit(1.0))).drop("scale")


def effective_weights(weights: DataFrame, scale: DataFrame, cap: float, pools: DataFrame | None = None) -> DataFrame:
    """Weights of a book that is bought: names by pool weight (of date, pool, weight) summed over pools, times the date's scale, capped without a final
    normalisation; names under 1e-6 are dropped, so scale 0 gives an empty book."""
    if pools is not None:
        of = pools.select("date", "pool", F.col("weight").alias("_p"))
        weights = weights.join(of, ["date", "pool"]).groupBy(*BOOK, "code").agg(F.sum(F.col("weight") * F.col("_p")).alias("weight"))
    return weight_cap(scale_by_market(weights, scale), cap, mode="engine").where("weight > 1e-6")


def holdings_diff(weights: DataFrame) -> DataFrame:
    """portfolio, date, counts and sorted names added and removed against the previous date, and the name-based turnover."""
    c = changes(weights)
    come, go = (F.col("old") == 0) & (F.col("new") > 0), (F.col("old") > 0) & (F.col("new") == 0)
    names = lambda test: F.array_join(F.array_sort(F.collect_list(F.when(test, F.col("code")))), ",")
    add, cut = F.count(F.when(come, 1)), F.count(F.when(go, 1))
    return c.groupBy(*BOOK).agg(add.alias("added"), cut.alias("removed"), ((add + cut) / F.count("*")).alias("name_turnover"), names(come).alias("names_added"), names(go).alias("names_removed"))
