"""Queries of industry rotation, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.operators import evaluation, rotation, selector
from quantloom.operators.windows import pct_change, rolling
from quantloom.queries_factors import bars_sql, rounded
from quantloom.queries_returns import IND
from quantloom.sources import market

VOTES = {"rs_mom_1": 0.5, "rs_mom_3": 0.3, "rs_mom_6": 0.2}


def _index(spark, sf_dir):
    return market.bars(spark, sf_dir).groupBy("date").agg((F.sum("money") / F.sum("volume")).alias("close"))


def _strength(spark, sf_dir):
    ind = market.bars(spark, sf_dir).join(market.industry(spark, sf_dir), "code").groupBy("date", "industry").agg(F.avg("close").alias("close"))
    return rotation.strength(ind.join(_index(spark, sf_dir).withColumnRenamed("close", "index"), "date"), 6, [1, 3, 6])


def blended_momentum(spark, sf_dir):
    c = F.col("close")
    return rounded(market.bars(spark, sf_dir).select("date", "code", rotation.blend_momentum(c, 1, 6, 0.4, 0.6).alias("mom")))


def residual_momentum(spark, sf_dir):
    """The beta of a code is its turnover share of the month, unknown where under 1 %."""
    c, b = F.col("close"), market.bars(spark, sf_dir)
    share = F.col("money") / F.sum("money").over(Window.partitionBy("date"))
    m = b.withColumn("beta", F.when(share >= 0.01, share * 20)).withColumn("mom", pct_change(c, 3))
    index = _index(spark, sf_dir)
    index = index.select("date", pct_change(c, 3, Window.partitionBy(F.lit(1)).orderBy("date")).alias("market"))
    out = m.join(F.broadcast(index), "date")  # one row per date
    return rounded(out.select("date", "code", rotation.residual_momentum(F.col("mom"), F.col("beta"), F.col("market")).alias("mom")))


def equal_votes(spark, sf_dir):
    return rounded(rotation.vote(_strength(spark, sf_dir), dict.fromkeys(VOTES, 1.0), 2, 5, 3))


def weighted_votes(spark, sf_dir):
    return rounded(rotation.vote(_strength(spark, sf_dir), VOTES, 0.5, 5, 3))


def risk_filtered(spark, sf_dir):
    b = market.bars(spark, sf_dir).select("date", "code", pct_change(F.col("close"), 2).alias("m")).join(market.industry(spark, sf_dir), "code")
    mom = b.groupBy("date", "industry").agg(F.avg("m").alias("mom"))
    return rounded(rotation.risk_filter(rotation.vote(_strength(spark, sf_dir), VOTES, 0.5, 5, 3), mom, 2).select("date", "industry", "rank", "mom"))


def absolute_scale(spark, sf_dir):
    return rotation.binary_scale(_index(spark, sf_dir), 12, 6, -0.01)


def _groups(spark, sf_dir):
    """Weekly bars of brands as industries."""
    return market.bars(spark, sf_dir, "week", "brand").withColumnRenamed("code", "industry")


def _picked(rows):
    w = Window.partitionBy("industry").orderBy("date")
    rows = rows.withColumn("mom", pct_change(F.col("close"), 20, w)).where("mom is not null")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("mom"), "industry"))).where("rank <= 8").select("date", "industry", "rank")


def _crowded(rows):
    return rows.select("date", "industry", rotation.crowding(["volume", "money", "close"]).alias("crowded"))


def industry_crowding(spark, sf_dir):
    return _crowded(_groups(spark, sf_dir))


def crowding_filtered(spark, sf_dir):
    g = _groups(spark, sf_dir)
    return rotation.crowding_filter(_picked(g), _crowded(g), 1, 7)


def valuation_filtered(spark, sf_dir):
    g = _groups(spark, sf_dir).withColumn("ep", 1 / F.col("close"))
    cheap = g.select("date", "industry", rotation.industry_percentile("ep", 250, 30).alias("cheap"))
    return rounded(rotation.valuation_filter(_picked(g), cheap, 0.1, 7))


def valuation_voted(spark, sf_dir):
    """Percentiles of the mean close and volume of an industry's codes; the market scale of 12 and 4 months."""
    m = market.bars(spark, sf_dir).join(market.industry(spark, sf_dir), "code").groupBy("date", "industry").agg((1 / F.avg("close")).alias("ep"), (1 / F.avg("volume")).alias("bp"))
    m = m.select("date", "industry", *[rotation.industry_percentile(c, 24, 6).alias(c) for c in ("ep", "bp")])
    scale = rotation.binary_scale(_index(spark, sf_dir), 12, 6, -0.01)
    rs = _strength(spark, sf_dir).join(m, ["date", "industry"], "left").join(F.broadcast(scale), "date")  # one row per date
    extra = rotation.valuation_votes(F.col("ep"), F.col("bp"), F.col("scale"), 0.4, 0.1, 0.2)
    return rounded(rotation.vote(rs, VOTES, 0.5, 5, 3, extra))


def _factor_ic(spark, sf_dir):
    """Scores of two factors, long, and the rank IC of each as known on the date (a year back, one row ahead, 31 days of embargo), beside the market scale."""
    c = F.col("close")
    p = market.bars(spark, sf_dir).select("date", "code", "close", pct_change(c, 3).alias("mom"), F.col("volume").alias("vol"))
    scores = p.unpivot(["date", "code"], ["mom", "vol"], "factor", "score")
    ic = evaluation.rolling_factor_ic(scores, p, p.select("date").distinct(), 365, 1, 31)
    z = (F.col("score") - F.avg("score").over(Window.partitionBy("date", "factor"))) / F.nullif(F.stddev_samp("score").over(Window.partitionBy("date", "factor")), F.lit(0.0))
    return scores.withColumn("score", z), ic.join(F.broadcast(rotation.binary_scale(_index(spark, sf_dir), 12, 6, -0.01)), "date")  # one row per date


def ic_boosted(spark, sf_dir):
    return rounded(rotation.ic_weights(_factor_ic(spark, sf_dir)[1], {"mom": 0.6, "vol": -0.4}, 0.5, confirm=True))


def ic_scored(spark, sf_dir):
    """Weights of the IC's size; vol is off where the market scale is under 1."""
    scores, ic = _factor_ic(spark, sf_dir)
    gate = ic.where("factor = 'vol' and scale < 1").select("date", "factor")
    weights = rotation.ic_weights(ic, {"mom": 0.6, "vol": -0.4}, replace=True).join(gate, ["date", "factor"], "left_anti")
    return rounded(rotation.weighted_scores(scores, weights))


def reversed_scores(spark, sf_dir):
    g = _groups(spark, sf_dir)
    w = Window.partitionBy("industry").orderBy("date")
    s = g.withColumn("score", pct_change(F.col("close"), 20, w)).withColumn("crowded", rotation.crowding(["volume", "money", "close"]))
    mean = rolling(F.avg, F.col("close"), 20, w)
    s = s.withColumn("bias", (F.col("close") - mean) / mean)
    by = Window.partitionBy("date")
    z = -(F.col("bias") - F.avg("bias").over(by)) / F.nullif(F.stddev_samp("bias").over(by), F.lit(0.0))  # bias counts against a name
    turned, instead = rotation.crowding_reversal(F.col("score"), F.col("crowded"), 1), rotation.crowding_reversal(F.col("score"), F.col("crowded"), 1, z)
    return rounded(s.select("date", "industry", turned.alias("turned"), instead.alias("instead")))


_SAME = {"strength": 6, "votes": {1: 0.5, 3: 0.3, 6: 0.2}}
VERSIONS = [
    selector.Rotation("momentum", 1, 6, 0.4, 0.6, risk=(2, 2), market=(12, 4)),
    selector.Rotation("voted", 1, 6, 0.4, 0.6, **_SAME, cheap_votes=(0.4, 0.1, 0.2), crowding=(1, 3), weighting="inverse_vol", vol_rows=6, market=(12, 6, -0.01)),
    selector.Rotation("scored", 3, 6, cheapness=(0.3, 3), by_score=True, turn=(1, "reversal"), weighting="strength", cap=0.101, **_SAME),
    selector.Rotation("turned", 3, 6, per_industry=1, turn=(1, "sign"), **_SAME),
]


def _rotation_panel(spark, sf_dir):
    """Monthly codes of nations: a score that small codes lack, and the distance from the mean of three months as reversal."""
    c, b = F.col("close"), market.bars(spark, sf_dir).join(market.industry(spark, sf_dir), "code")
    mean = rolling(F.avg, c, 3)
    return b.select(
        "date", "code", "industry", "close", "volume", "money", (1 / c).alias("ep"), (1 / F.col("volume")).alias("bp"),
        F.when(F.col("volume") >= 150, -F.col("volume")).alias("score"), (1 - c / mean).alias("reversal"),
    )


def rotation_books(spark, sf_dir):
    """Four versions of the selector on the first traded month of each quarter."""
    p = _rotation_panel(spark, sf_dir)
    days = p.groupBy(F.date_trunc("quarter", "date")).agg(F.min("date").alias("date"))
    return rounded(selector.select(p, _index(spark, sf_dir), VERSIONS, days, ["volume", "money"], (24, 6), (24, 6)))


_MORE = (rotation_books, industry_crowding, crowding_filtered, valuation_filtered, valuation_voted, ic_boosted, ic_scored, reversed_scores)
QUERIES = {f.__name__: f for f in (blended_momentum, residual_momentum, equal_votes, weighted_votes, risk_filtered, absolute_scale, *_MORE)}

B = bars_sql()
INDEX = "idx as (select date, sum(money) / sum(volume) as c from bars group by 1)"
RS = f"""{B}, {IND}, {INDEX}, g as (select date, industry, avg(close) as close from bars join ind using (code) group by 1, 2), r as (select date, industry, close / c as rs from g join idx using (date)),
    r1 as (select *, 100 * rs / case when count(rs) over w6 = 6 then avg(rs) over w6 end as rr from r window w6 as (partition by industry order by date rows 5 preceding)),
    r2 as (select date, industry, rr, """ + ", ".join(f"100 * rr / lag(rr, {k}) over w as m{k}" for k in (1, 3, 6)) + " from r1 window w as (partition by industry order by date))"


def _vote(weights: tuple[float, ...], need: float) -> str:
    total = " + ".join(f"{w} * coalesce(cast(m{k} >= 100 as integer), 0)" for w, k in zip(weights, (1, 3, 6)))
    return f"""p as (select *, row_number() over (partition by date order by rr desc, industry) as plain, {total} as vote from r2 where rr is not null),
        l as (select *, row_number() over (partition by date order by vote >= {need} desc, vote desc, rr desc, industry) as lead_at, count(*) filter (where vote >= {need}) over (partition by date) as n from p where plain <= 10),
        v as (select date, industry, cast(vote as double) as vote, cast(case when n < 3 then plain when vote >= {need} then lead_at end as integer) as rank from l), t as (select * from v where rank <= 5)"""


def _over(x: str) -> str:
    w = "over (partition by industry order by date rows 249 preceding)"
    return f"case when count({x}) {w} >= 30 and {x} > quantile_cont({x}, 0.95) {w} then 1 else 0 end"


def _share(x: str, n: int, least: int) -> str:
    held = f"list({x}) over (partition by industry order by date rows {n - 1} preceding)"
    return f"case when len({held}) >= {least} then len(list_filter({held}, lambda v: v <= {x})) / len({held}) end"


def _kept(rows: str, ok: str, order: str) -> str:
    return f"""k as (select *, count(*) filter (where {ok}) over (partition by date) as n, row_number() over (partition by date order by {order}, rank, industry) as place from {rows})"""


GROUPS = f"{bars_sql('week', 'brand')}, g as (select date, code as industry, close, volume, money from bars)"
PICKED = "m as (select date, industry, close / lag(close, 20) over (partition by industry order by date) - 1 as mom from g), p as (select date, industry, cast(row_number() over (partition by date order by mom desc, industry) as integer) as rank from m where mom is not null qualify rank <= 8)"
CROWD = f"c as (select *, cast({_over('volume')} + {_over('money')} + {_over('close')} as integer) as crowded from g)"
SCALE = """sm as (select date, c, row_number() over (order by date) as pos, avg(c) over (order by date rows 11 preceding) as a, c / lag(c, 6) over (order by date) - 1 as r from idx),
    sc as (select date, case when pos < 13 then 1 when c < a or r < -0.01 then 0 else 1 end as scale from sm)"""
_RANK = lambda x: f"rank() over (partition by factor, date order by {x}) + (count(*) over (partition by factor, date, {x}) - 1) / 2.0"
FIC = f"""{B}, {INDEX}, {SCALE}, s1 as (select date, code, close / lag(close, 3) over w - 1 as mom, volume as vol, lead(close) over w / close - 1 as fwd from bars window w as (partition by code order by date)),
    lf as (select date, code, 'mom' as factor, mom as x, fwd from s1 union all select date, code, 'vol', vol, fwd from s1),
    rk as (select factor, date, {_RANK('x')} as a, {_RANK('fwd')} as b from lf where x is not null and fwd is not null),
    dy as (select factor, date, case when count(*) >= 2 then nullif(round(corr(a, b), 12), 0) end as ic, count(*) as n from rk group by 1, 2),
    kn as (select d.date, factor, case when sum(n) filter (where dy.date between d.date - 365 and d.date - 31) >= 20 and count(ic) filter (where dy.date between d.date - 365 and d.date - 31) >= 5 then avg(ic) filter (where dy.date between d.date - 365 and d.date - 31) end as ic
    from (select distinct date from s1) d cross join dy group by 1, 2),
    i as (select date, factor, ic, cast(case when factor = 'mom' then 0.6 else -0.4 end as double) as w, scale from kn join sc using (date))"""
_WEIGHTED = _vote((0.5, 0.3, 0.2), 0.5)
_V = lambda k: f"coalesce(cast(m{k} >= 100 as integer), 0)"
_VOTES = f"0.5 * {_V(1)} + 0.3 * {_V(3)} + 0.2 * {_V(6)}"
_OVER24 = lambda x: f"case when count({x}) over h >= 6 and {x} > quantile_cont({x}, 0.95) over h then 1 else 0 end"
_W = "over (partition by version, date)"


def _rule(out: str, rows: str, ok: str, order: str, least: str) -> str:
    """The rows that are ok, or the first in the order where fewer are."""
    return f"""{out}0 as (select *, count(*) filter (where {ok}) {_W} as n_ok, row_number() over (partition by version, date order by {order} rank, industry) as place from {rows}),
        {out} as (select * exclude (n_ok, place) from {out}0 where case when n_ok >= {least} then {ok} else place <= {least} end)"""


_RULES = f"""{_rule('c1', 'c0', 'risk >= 0', '', 'risk_least')}, {_rule('c2', 'c1', '(triggers is null or crowded < triggers)', 'case when triggers is not null then crowded end,', 'crowd_least')},
    {_rule('c3', 'c2', '("limit" is null or cheap >= "limit")', 'case when "limit" is not null then -cheap end,', 'cheap_least')}"""
_CAPS = ", ".join(
    f"""x{i + 1} as (select * replace (case when weight >= cap then cap else weight + coalesce(weight * sum(greatest(weight - cap, 0)) {_W} / nullif(sum(case when weight < cap then weight end) {_W}, 0), 0) end as weight) from x{i})"""
    for i in range(10)
)
ORACLE = {
    "rotation_books": f"""with {RS}, {SCALE}, ss as (select date, case when pos < 13 or c is null then 1 when c < a then 0 when c < b then 0.5 else 1 end as scale from
        (select date, c, row_number() over (order by date) as pos, avg(c) over (order by date rows 11 preceding) as a, avg(c) over (order by date rows 3 preceding) as b from idx)),
        k0 as (select date, code, industry, close, volume, money, close / lag(close) over w - 1 as p1, close / lag(close, 2) over w - 1 as p2, close / lag(close, 3) over w - 1 as p3, close / lag(close, 6) over w - 1 as p6,
        case when volume >= 150 then -volume end as score, case when count(*) over w3 = 3 then 1 - close / avg(close) over w3 end as reversal from bars join ind using (code) window w as (partition by code order by date), w3 as (partition by code order by date rows 2 preceding)),
        k as (select *, 0.4 * p1 + 0.6 * p6 as ma, 0.5 * p3 + 0.5 * p6 as mb, case when count(p1) over w6 > 1 then stddev_samp(p1) over w6 end as vol from k0 window w6 as (partition by code order by date rows 5 preceding)),
        days as (select min(date) as date from bars group by date_trunc('quarter', date)),
        x as (select date, industry, avg(volume) as volume, avg(money) as money, avg(1 / close) as ep, avg(1 / volume) as bp from k group by 1, 2),
        y as (select date, industry, {_OVER24('volume')} + {_OVER24('money')} as crowded, coalesce({_share('ep', 24, 6)}, 0.5) as ep, coalesce({_share('bp', 24, 6)}, 0.5) as bp from x window h as (partition by industry order by date rows 23 preceding)),
        gg as (select date, industry, avg(ma) as ma, avg(mb) as mb, coalesce(avg(p2), 0) as p2, count(score) as scored from k group by 1, 2),
        j as (select date, industry, ma, mb, p2, sum(scored) over (partition by date) as scored, crowded, ep, bp, rr, {_VOTES} as vote, sc.scale as s1, ss.scale as s2
        from gg join days using (date) join y using (date, industry) join r2 using (date, industry) join sc using (date) join ss using (date)),
        v as (select 'momentum' as version, date, industry, ma as mom, null::double as rr, null::double as vote, p2 as risk, 2 as risk_least, null as triggers, 0 as crowd_least, null::double as "limit", 0 as cheap_least, crowded, ep as cheap, s2 as scale, scored from j
        union all select 'voted', date, industry, ma, rr, vote + case when s1 < 1 then 0.1 else 0.4 end * (ep - 0.5) + 0.2 * (bp - 0.5), 0, 0, 1, 3, null, 0, crowded, ep, s1, scored from j
        union all select 'scored', date, industry, mb, rr, vote, 0, 0, null, 0, 0.3, 3, crowded, ep, 1, scored from j
        union all select 'turned', date, industry, mb, rr, vote, 0, 0, null, 0, null, 0, crowded, ep, 1, scored from j),
        a1 as (select *, count(rr) {_W} > 0 as any_rr from v),
        a2 as (select *, case when any_rr then case when rr is not null then row_number() over (partition by version, date order by rr desc nulls last, industry) end
        when mom is not null then row_number() over (partition by version, date order by mom desc nulls last, industry) end as plain from a1),
        a3 as (select *, any_rr and coalesce(vote >= 0.5, false) as lead from a2 where plain <= 10),
        a4 as (select *, count(*) filter (where lead) {_W} as leads, row_number() over (partition by version, date order by lead desc, vote desc nulls last, rr desc nulls last, industry) as lead_at from a3),
        c0 as (select * from (select *, case when any_rr and leads >= 3 then case when lead then lead_at end else plain end as rank from a4) where rank <= 5), {_RULES},
        n1 as (select c3.version, c3.date, c3.industry, code, rr, scale, vol, case when version in ('momentum', 'voted') then ma else mb end as m, score, reversal, scored, c3.crowded from c3 join k on k.date = c3.date and k.industry = c3.industry),
        n2 as (select *, case version when 'scored' then case when crowded >= 1 then coalesce(reversal, case when scored > 0 then score else m end) when scored > 0 then score else m end when 'turned' then case when crowded >= 1 then -m else m end else m end as s from n1 where m is not null),
        n3 as (select *, count(*) over (partition by version, date, industry) as inside from (select * from n2 qualify row_number() over (partition by version, date, industry order by s desc nulls last, code) <= case when version = 'turned' then 1 else 2 end)),
        n4 as (select *, case version when 'voted' then 1 / greatest(coalesce(vol, 0.02), 0.01) when 'scored' then case when count(rr) {_W} = count(*) {_W} then rr / inside else 1 end else 1 end as raw from n3),
        x0 as (select version, date, industry, code, scale, raw / sum(raw) {_W} as weight, case when version = 'scored' then 0.101 else 1.0 end as cap from n4), {_CAPS}
        select version, date, cast(scale as double) as scale, code, industry, round(weight / sum(weight) {_W} * scale, 6) as weight from x10 where scale > 0
        union all select distinct version, date, 0.0, null, null, null from x10 where scale <= 0""",
    "blended_momentum": f"""with {B}, m as (select date, code, 0.4 * (close / lag(close) over w - 1) + 0.6 * (close / lag(close, 6) over w - 1) as m from bars window w as (partition by code order by date))
        select date, code, round(lag(m) over (partition by code order by date), 6) as mom from m""",
    "residual_momentum": f"""with {B}, {INDEX}, i as (select date, c / lag(c, 3) over (order by date) - 1 as market from idx),
        m as (select *, close / lag(close, 3) over (partition by code order by date) - 1 as m, money / sum(money) over (partition by date) as share from bars)
        select date, code, round(m - case when share >= 0.01 then share * 20 else 1 end * market, 6) as mom from m join i using (date)""",
    "equal_votes": f"with {RS}, {_vote((1, 1, 1), 2)} select date, industry, vote, rank from t",
    "weighted_votes": f"with {RS}, {_WEIGHTED} select date, industry, round(vote, 6) as vote, rank from t",
    "risk_filtered": f"""with {RS}, {_WEIGHTED}, k as (select date, code, close / lag(close, 2) over (partition by code order by date) - 1 as m from bars), a as (select date, industry, avg(m) as m from k join ind using (code) group by 1, 2),
        j as (select t.date, t.industry, rank, coalesce(m, 0) as mom from t left join a on a.date = t.date and a.industry = t.industry), n as (select *, count(*) filter (where mom >= 0) over (partition by date) as n from j)
        select date, industry, rank, round(mom, 6) as mom from n where case when n >= 2 then mom >= 0 else rank <= 2 end""",
    "absolute_scale": f"""with {B}, {INDEX}, m as (select date, c, row_number() over (order by date) as pos, avg(c) over (order by date rows 11 preceding) as a, c / lag(c, 6) over (order by date) - 1 as r from idx)
        select date, cast(case when pos < 13 then 1 when c < a or r < -0.01 then 0 else 1 end as double) as scale from m""",
    "industry_crowding": f"with {GROUPS}, {CROWD} select date, industry, crowded from c",
    "crowding_filtered": f"with {GROUPS}, {PICKED}, {CROWD}, j as (select date, industry, rank, crowded from p join c using (date, industry)), {_kept('j', 'crowded < 1', 'crowded')} select date, industry, rank, crowded from k where case when n >= 7 then crowded < 1 else place <= 7 end",
    "valuation_filtered": f"""with {GROUPS}, {PICKED}, e as (select date, industry, 1 / close as ep from g), c as (select date, industry, {_share('ep', 250, 30)} as cheap from e),
        j as (select date, industry, rank, coalesce(cheap, 0.5) as cheap from p join c using (date, industry)), {_kept('j', 'cheap >= 0.1', 'cheap desc')}
        select date, industry, rank, round(cheap, 6) as cheap from k where case when n >= 7 then cheap >= 0.1 else place <= 7 end""",
    "valuation_voted": f"""with {RS}, {SCALE}, x as (select date, industry, 1 / avg(close) as ep, 1 / avg(volume) as bp from bars join ind using (code) group by 1, 2),
        y as (select date, industry, coalesce({_share('ep', 24, 6)}, 0.5) as ep, coalesce({_share('bp', 24, 6)}, 0.5) as bp from x),
        z as (select r2.*, case when scale < 1 then 0.1 else 0.4 end * (ep - 0.5) + 0.2 * (bp - 0.5) as extra from r2 join y using (date, industry) join sc using (date)),
        {_vote((0.5, 0.3, 0.2), 0.5).replace('from r2', 'from z').replace('as vote from z', '+ extra as vote from z')} select date, industry, round(vote, 6) as vote, rank from t""",
    "ic_boosted": f"""with {FIC}, b as (select *, case when sign(ic) = sign(w) then abs(ic) when ic is not null then 0 end as size from i), m as (select *, max(size) over (partition by date) as most from b)
        select date, factor, round(w * (1 + 0.5 * case when scale >= 1 and most > 1e-10 then coalesce(size / most, 0) else 0 end), 6) as weight from m""",
    "ic_scored": f"""with {FIC}, l as (select date, code, 'mom' as factor, mom as x from s1 union all select date, code, 'vol', vol from s1),
        z as (select date, code, factor, (x - avg(x) over q) / nullif(stddev_samp(x) over q, 0) as z from l window q as (partition by date, factor)),
        g as (select date, factor, coalesce(sign(w) * abs(ic), w) as weight from i where not (factor = 'vol' and scale < 1))
        select date, code, round(sum(weight * z) / nullif(sum(abs(weight)), 0), 6) as score from z join g using (date, factor) where z is not null group by 1, 2""",
    "reversed_scores": f"""with {GROUPS}, {CROWD}, m as (select *, close / lag(close, 20) over w - 1 as score, case when count(close) over w20 = 20 then close / avg(close) over w20 - 1 end as bias from c
        window w as (partition by industry order by date), w20 as (partition by industry order by date rows 19 preceding)),
        z as (select *, -(bias - avg(bias) over (partition by date)) / nullif(stddev_samp(bias) over (partition by date), 0) as z from m)
        select date, industry, round(case when crowded >= 1 then -score else score end, 6) as turned, round(case when crowded >= 1 then z else score end, 6) as instead from z""",
}
