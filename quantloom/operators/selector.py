"""The rotation selector as one plan: many versions and all decision dates at once.

A version is a `Rotation`. The measures that any version asks for are computed once per code or industry; at the decision dates each version
becomes rows of its own, and every rule is a window over (version, date). Only chosen industries meet their codes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import portfolio, rotation
from quantloom.operators.windows import own_rows, pct_change, rolling


@dataclass(frozen=True)
class Rotation:
    """A version of the selector; a rule whose parameter is None is off."""

    name: str
    short: int = 20
    long: int = 60
    w_short: float = 0.5
    w_long: float = 0.5
    industries: int = 5
    per_industry: int = 2
    #: Relative strength: window of the ratio, weight of the vote of each span, votes needed, leaders needed.
    strength: int | None = None
    votes: dict[int, float] = field(default_factory=dict)
    need: float = 0.5
    leaders: int = 3
    #: What cheapness adds to a vote: weights in a trend and out of it, and of the second measure.
    cheap_votes: tuple[float, float, float] | None = None
    #: Span of the risk filter and the industries that stay at least; triggers of the crowding filter; limit of the valuation filter.
    risk: tuple[int, int] | None = None
    crowding: tuple[int, int] | None = None
    cheapness: tuple[float, int] | None = None
    #: Codes rank by the panel's `score`; in crowded industries (so many triggers) the score turns its `sign` or is replaced by the panel's `reversal`.
    by_score: bool = False
    turn: tuple[int, str] | None = None
    #: equal, inverse_vol (of so many rows) or strength.
    weighting: str = "equal"
    vol_rows: int = 20
    cap: float | None = None
    #: steps: (long, short) means; binary: (mean, span, threshold).
    market: tuple | None = None


#: Rows of the industry's history that crowding and cheapness look at, and the values they need.
CROWDED = (250, 30)
CHEAP = (250, 30)


def _momentum(c: Rotation) -> str:
    return "mom_" + "_".join(str(x).replace(".", "p").replace("-", "m") for x in (c.short, c.long, c.w_short, c.w_long))


def _codes(panel: DataFrame, versions: list[Rotation]) -> DataFrame:
    """panel's code, date, industry, score, reversal, and per version's parameters momentum, risk momentum and volatility; one shuffle by code."""
    close = F.col("close")
    blends = {_momentum(c): c.w_short * pct_change(close, c.short) + c.w_long * pct_change(close, c.long) for c in versions}
    risks = {f"risk_{c.risk[0]}": pct_change(close, c.risk[0]) for c in versions if c.risk}
    vols = {c.vol_rows for c in versions if c.weighting == "inverse_vol"}
    keep = [F.col(x) if x in panel.columns else F.lit(None).cast("double").alias(x) for x in ("score", "reversal")]
    rows = panel.select("code", "date", "industry", "close", *keep).withColumn("ret", pct_change(close, 1))
    frame = lambda n: own_rows().rowsBetween(-(n - 1), 0)
    sd = {f"vol_{n}": F.when(F.count("ret").over(frame(n)) > 1, F.stddev_samp("ret").over(frame(n))) for n in vols}
    return rows.select("code", "date", "industry", "score", "reversal", *[x.alias(n) for n, x in (blends | risks | sd).items()])


def _industries(panel: DataFrame, index: DataFrame, versions: list[Rotation], crowd: list[str], crowded: tuple, cheap: tuple) -> DataFrame:
    """date, industry, crowded, ep, bp (percentiles), and ratio_<n>, mom_<n>_<span> of relative strength; a shuffle by (date, industry), one by industry."""
    means = [F.avg(x).alias(x) for x in dict.fromkeys(["close", *crowd, *[c for c in ("ep", "bp") if c in panel.columns]])]
    rows = panel.groupBy("date", "industry").agg(*means)
    spans = {}
    for c in versions:
        if c.strength:
            spans.setdefault(c.strength, set()).update(c.votes)
    w = Window.partitionBy("industry").orderBy("date")
    rows = rows.join(index.select("date", F.col("close").alias("_index")), "date", "left").withColumn("_rs", F.col("close") / F.nullif(F.col("_index"), F.lit(0.0)))
    rows = rows.select("*", *[(100 * F.col("_rs") / rolling(F.avg, F.col("_rs"), n, w)).alias(f"ratio_{n}") for n in spans])
    moms = [(100 * F.col(f"ratio_{n}") / F.lag(f"ratio_{n}", k).over(w)).alias(f"mom_{n}_{k}") for n, ks in spans.items() for k in sorted(ks)]
    share = lambda x: rotation.industry_percentile(x, *cheap) if x in panel.columns else F.lit(None).cast("double")
    over = rotation.crowding(crowd, n=crowded[0], least=crowded[1]) if crowd else F.lit(0)
    return rows.select("date", "industry", *[f"ratio_{n}" for n in spans], *moms, over.alias("crowded"), share("ep").alias("ep"), share("bp").alias("bp"))


def _scale_name(c: Rotation) -> str:
    return "scale_" + "_".join(str(x).replace(".", "p").replace("-", "m") for x in c.market)


def _scales(index: DataFrame, versions: list[Rotation]) -> DataFrame:
    """date and a column for each market rule; one row a date."""
    out = index.select("date").distinct()
    for name, rule in {_scale_name(c): c.market for c in versions if c.market}.items():
        found = rotation.step_scale(index, *rule) if len(rule) == 2 else rotation.binary_scale(index, *rule)
        out = out.join(found.withColumnRenamed("scale", name), "date")
    return out


def _version_rows(rows: DataFrame, versions: list[Rotation]) -> DataFrame:
    """rows once per version, with the version's own measures and parameters under common names."""
    null = F.lit(None).cast("double")

    def of(c: Rotation) -> Column:
        scale = F.coalesce(F.col(_scale_name(c)), F.lit(1.0)) if c.market else F.lit(1.0)
        vote, ratio = null, null
        if c.strength:
            ratio = F.col(f"ratio_{c.strength}")
            vote = sum((w * F.coalesce((F.col(f"mom_{c.strength}_{k}") >= 100).cast("double"), F.lit(0.0)) for k, w in c.votes.items()), F.lit(0.0))
            if c.cheap_votes:
                vote = vote + rotation.valuation_votes(F.col("ep"), F.col("bp"), scale, *c.cheap_votes)
        values = {
            "version": F.lit(c.name), "scale": scale, "momentum": F.col(_momentum(c)), "ratio": ratio, "vote": vote, "top": F.lit(c.industries), "need": F.lit(float(c.need)),
            "leaders": F.lit(c.leaders), "risk": F.coalesce(F.col(f"risk_{c.risk[0]}"), F.lit(0.0)) if c.risk else F.lit(0.0), "risk_least": F.lit(c.risk[1] if c.risk else 0),
            "triggers": F.lit(c.crowding[0] if c.crowding else None).cast("int"), "crowd_least": F.lit(c.crowding[1] if c.crowding else 0),
            "limit": F.lit(c.cheapness[0] if c.cheapness else None).cast("double"), "cheap_least": F.lit(c.cheapness[1] if c.cheapness else 0),
        }
        return F.struct(*[v.alias(k) for k, v in values.items()])

    return rows.withColumn("_v", F.explode(F.array(*[of(c) for c in versions]))).select("date", "industry", "crowded", F.coalesce("ep", F.lit(0.5)).alias("cheap"), "scored", "_v.*")


def chosen_industries(rows: DataFrame) -> DataFrame:
    """The industries that each version holds on each date: momentum or votes, then the risk, crowding and valuation rules, each of which fills up to its least.

    All windows share the partitioning by (version, date). A date without relative strength falls back to momentum. Ties go by industry.
    """
    w = Window.partitionBy("version", "date")
    at = lambda *order: F.row_number().over(w.orderBy(*order, "industry"))
    known = F.col("ratio").isNotNull()
    rows = rows.withColumn("scored", F.max("scored").over(w)).withColumn("_any", F.max(known.cast("int")).over(w) == 1)
    plain = F.when(F.col("_any"), F.when(known, at(F.desc_nulls_last("ratio")))).otherwise(F.when(F.col("momentum").isNotNull(), at(F.desc_nulls_last("momentum"))))
    rows = rows.withColumn("_plain", plain).where("_plain <= 2 * top")
    lead = (F.col("_any") & (F.col("vote") >= F.col("need"))).cast("int")
    rows = rows.withColumn("_lead", lead).withColumn("_n", F.sum("_lead").over(w)).withColumn("_at", at(F.desc("_lead"), F.desc_nulls_last("vote"), F.desc_nulls_last("ratio")))
    by_vote = F.col("_any") & (F.col("_n") >= F.col("leaders"))
    rows = rows.withColumn("rank", F.when(by_vote, F.when(F.col("_lead") == 1, F.col("_at"))).otherwise(F.col("_plain"))).where("rank <= top")

    def keep(rows: DataFrame, ok: Column, order: list, least: str) -> DataFrame:
        rows = rows.withColumn("_ok", ok).withColumn("_n", F.sum(F.col("_ok").cast("int")).over(w)).withColumn("_at", at(*order, "rank"))
        return rows.where(F.when(F.col("_n") >= F.col(least), F.col("_ok")).otherwise(F.col("_at") <= F.col(least)))

    rows = keep(rows, F.col("risk") >= 0, [], "risk_least")
    off = F.col("triggers").isNull()
    rows = keep(rows, off | (F.col("crowded") < F.col("triggers")), [F.when(~off, F.col("crowded"))], "crowd_least")
    off = F.col("limit").isNull()
    rows = keep(rows, off | (F.col("cheap") >= F.col("limit")), [F.when(~off, -F.col("cheap"))], "cheap_least")
    return rows.select("version", "date", "industry", "rank", "ratio", "crowded", "scale", "scored")


def _turned(c: Rotation) -> Column:
    """The score of a code, turned or replaced in crowded industries where the version says so."""
    plain = F.col("_s")
    if c.turn is None:
        return plain
    return rotation.crowding_reversal(plain, F.col("crowded"), c.turn[0], None if c.turn[1] == "sign" else F.coalesce("reversal", "_s"))


def select(panel: DataFrame, index: DataFrame, versions: list[Rotation], decisions: DataFrame, crowd: list[str] = (), crowded: tuple = CROWDED, cheap: tuple = CHEAP) -> DataFrame:
    """version, date (of the signal), scale, code, industry, weight: the book of each version on each date of decisions; it's held from the next day.

    panel: date, code, industry, close, the measures named in crowd and, optionally, ep and bp (cheapness), score and reversal; index: date, close.
    A market scale of 0 gives one row without a code; a date on which no chosen industry has a code with both momenta gives no row.
    A code without a score ranks last; a date on which no code has a score falls back to momentum. Volatility looks back from the signal. The
    cap doesn't bind on inverse volatility, and is met before the scale.
    """
    days = decisions.select("date").distinct()
    codes = _codes(panel, versions).join(days, "date", "left_semi")
    moms, risks = sorted({_momentum(c) for c in versions}), sorted({f"risk_{c.risk[0]}" for c in versions if c.risk})
    by_mom = {c.name: F.col(_momentum(c)) for c in versions}
    rows = codes.groupBy("date", "industry").agg(*[F.avg(m).alias(m) for m in moms], *[F.avg(r).alias(r) for r in risks], F.count("score").alias("scored"))
    measures = _industries(panel, index, versions, list(crowd), crowded, cheap).join(days, "date", "left_semi")
    rows = rows.join(measures, ["date", "industry"]).join(_scales(index, versions), "date", "left")
    chosen = chosen_industries(_version_rows(rows, versions))

    pick = lambda value: F.coalesce(*[F.when(F.col("version") == c.name, value(c)) for c in versions])
    names = codes.join(chosen, ["date", "industry"]).withColumn("_mom", pick(lambda c: by_mom[c.name])).where("_mom is not null")
    score = F.when(pick(lambda c: F.lit(c.by_score)) & (F.col("scored") > 0), F.col("score")).otherwise(F.col("_mom"))
    names = names.withColumn("_s", score).withColumn("_score", pick(_turned))
    best = F.row_number().over(Window.partitionBy("version", "date", "industry").orderBy(F.desc_nulls_last("_score"), "code"))
    names = names.withColumn("_at", best).where(F.col("_at") <= pick(lambda c: F.lit(c.per_industry)))
    vol = pick(lambda c: F.col(f"vol_{c.vol_rows}") if c.weighting == "inverse_vol" else F.lit(None).cast("double"))
    names = names.withColumn("_vol", vol).withColumn("_kind", pick(lambda c: F.lit(c.weighting)))

    # Every weighting in one pass: raw weights by kind, shares of the book, then the cap as a fold over the book's array.
    book = Window.partitionBy("version", "date")
    inside = F.count("*").over(Window.partitionBy("version", "date", "industry"))
    names = names.withColumn("_up", F.greatest("ratio", F.lit(0.0)) / inside)
    whole = (F.count("ratio").over(book) == F.count("*").over(book)) & (F.sum("_up").over(book) > 0)
    raw = F.when(F.col("_kind") == "inverse_vol", 1 / F.greatest(F.coalesce("_vol", F.lit(0.02)), F.lit(0.01))).when((F.col("_kind") == "strength") & whole, F.col("_up"))
    names = names.withColumn("weight", F.coalesce(raw, F.lit(1.0)))
    names = names.withColumn("weight", F.col("weight") / F.sum("weight").over(book))
    books = names.groupBy("version", "date", "scale").agg(F.array_sort(F.collect_list(F.struct("code", "industry", "weight"))).alias("_x"))
    # A cap of 1 changes nothing.
    caps = pick(lambda c: F.lit(float(c.cap if c.cap is not None and c.weighting != "inverse_vol" else 1.0)))
    books = books.withColumn("_cap", caps).withColumn("_w", portfolio.capped(F.transform("_x", lambda x: x["weight"]), F.col("_cap")))
    empty = F.array(F.struct(F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("industry"), F.lit(None).cast("double").alias("weight")))
    held = F.zip_with("_x", "_w", lambda x, v: F.struct(x["code"].alias("code"), x["industry"].alias("industry"), (v * F.col("scale")).alias("weight")))
    return books.select("version", "date", "scale", F.explode(F.when(F.col("scale") > 0, held).otherwise(empty)).alias("_y")).select("version", "date", "scale", "_y.*")
