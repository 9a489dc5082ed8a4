"""Queries of evaluation, weights, costs, trades and experts, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions import codes
from quantloom.operators import cross_section as xs
from quantloom.operators import evaluation, experts, factors, portfolio, trading
from quantloom.operators.windows import fwd_return, pct_change, rolling
from quantloom.queries_factors import W, bars_sql, rounded, roll
from quantloom.queries_returns import BARS, BOOK, IND
from quantloom.sources import market

FACTORS = ["mom_1m", "rev_5d", "bias_20", "volume_ratio"]


def _table(spark, sf_dir):
    b = market.bars(spark, sf_dir, "week", "brand")
    f = factors.compute_factors(b, FACTORS).join(b.select("date", "code", fwd_return(F.col("close"), 1).alias("fwd")), ["date", "code"])
    return evaluation.ic_table(f, FACTORS, "fwd")


def ic_tables(spark, sf_dir):
    return rounded(_table(spark, sf_dir))


def factor_summaries(spark, sf_dir):
    return rounded(evaluation.factor_summary(_table(spark, sf_dir), 0.95))


def factor_correlations(spark, sf_dir):
    return rounded(evaluation.factor_correlations(_table(spark, sf_dir)))


def _moms(spark, sf_dir):
    c = F.col("close")
    return market.bars(spark, sf_dir).select("date", "code", pct_change(c, 3).alias("a"), pct_change(c, 6).alias("b"))


def mad_filtered(spark, sf_dir):
    return rounded(xs.mad_filter(_moms(spark, sf_dir).where("a is not null").select("date", "code", "a"), "a"))


def orthogonal_scores(spark, sf_dir):
    z = _moms(spark, sf_dir).where("a is not null and b is not null").select("date", "code", xs.zscore("a").alias("a"), xs.zscore("b").alias("b"))
    z = z.select("date", "code", "a", "b", xs.orthogonalize("a", "b").alias("o"))
    return rounded(z.select("date", "code", "o", xs.composite_score({"a": 0.6, "o": -0.4}).alias("score")))


def train_scaled(spark, sf_dir):
    m = _moms(spark, sf_dir).select("date", "code", "a")
    return rounded(xs.preprocess(m, "a", 0.01, m.where("date < '1995-01-01'")))


def _book(spark, sf_dir):
    return portfolio.normalise(market.book(spark, sf_dir))


def _leaders(spark, sf_dir):
    """Books of the eight largest names, so that names come and go."""
    w = market.book(spark, sf_dir)
    at = F.row_number().over(Window.partitionBy("portfolio", "date").orderBy(F.desc("weight"), "code"))
    return portfolio.normalise(w.withColumn("_at", at).where("_at <= 8").drop("_at"))


def weight_schemes(spark, sf_dir):
    b = market.bars(spark, sf_dir).select("date", "code", pct_change(F.col("close"), 1).alias("r"))
    vol = b.select("date", "code", rolling(F.stddev_samp, F.col("r"), 6).alias("vol"))
    w = _book(spark, sf_dir).join(vol, ["date", "code"], "left")
    w = portfolio.inverse_vol_weight(w.withColumnRenamed("weight", "own"), "vol").withColumnRenamed("weight", "inverse")
    return rounded(portfolio.equal_weight(w).select("portfolio", "date", "code", F.col("weight").alias("equal"), "inverse"))


def strength_weights(spark, sf_dir):
    w = _book(spark, sf_dir).join(market.industry(spark, sf_dir), "code")
    s = w.groupBy("date", "industry").agg((F.sum("weight") - 0.1).alias("strength"))
    return rounded(portfolio.strength_weight(w.join(s, ["date", "industry"]), "strength").select("portfolio", "date", "code", "weight"))


def industry_caps(spark, sf_dir):
    w = _book(spark, sf_dir).join(market.industry(spark, sf_dir), "code")
    return rounded(portfolio.industry_weights(portfolio.industry_cap(w, 0.2)))


def limited_turnover(spark, sf_dir):
    c = portfolio.changes(_book(spark, sf_dir))
    return rounded(portfolio.turnover_limit(c, 0.3).select("portfolio", "date", "code", "weight"))


def smoothed_weights(spark, sf_dir):
    return rounded(portfolio.smooth_step(portfolio.changes(_book(spark, sf_dir)), 0.4).select("portfolio", "date", "code", "weight"))


def holdings_checks(spark, sf_dir):
    w = _leaders(spark, sf_dir)
    return rounded(portfolio.holdings_check(w, 8).join(portfolio.holdings_diff(w), ["portfolio", "date"], "left"))


def _listed(code):
    """Suppliers as listed names: every third one is a fund."""
    return F.concat(F.when(code.cast("int") % 3 == 0, "51").otherwise("60"), F.lpad(code, 4, "0"), F.lit(".XSHG"))


def rebalance_costs(spark, sf_dir):
    c = portfolio.changes(_book(spark, sf_dir))
    c = c.withColumn("listed", _listed(F.col("code"))).withColumn("days", F.length("code") * 4)
    kind, days = codes.asset_type(F.col("listed")), F.col("days")
    return rounded(trading.rebalance_cost(c, kind, days).join(trading.flat_cost(c, 0.001).withColumnRenamed("cost", "flat"), ["portfolio", "date"]), 8)


def trade_sides(spark, sf_dir):
    return rounded(trading.trades(portfolio.changes(_book(spark, sf_dir))))


def cost_benefit(spark, sf_dir):
    s = market.bars(spark, sf_dir).select("date", "code", pct_change(F.col("close"), 3).alias("score"))
    c = portfolio.changes(_leaders(spark, sf_dir)).join(s, ["date", "code"], "left").withColumn("hold_days", F.when(F.col("code") != "7", F.length("code") * 20 - F.col("code").cast("int") % 4 * 10))
    out = trading.decide(c, 0.05, 15, codes.asset_type(_listed(F.col("code"))))
    return rounded(out.select("portfolio", "date", "code", "action", "benefit", "unit_cost", "weight"))


def plain_decisions(spark, sf_dir):
    c = portfolio.changes(_book(spark, sf_dir))
    rows = [f(c).select(F.lit(n).alias("rule"), "portfolio", "date", "code", "action", "weight") for n, f in (("simple", trading.decide_simple), ("none", trading.decide_none))]
    return rounded(rows[0].unionByName(rows[1]))


def lot_trades(spark, sf_dir):
    b = _book(spark, sf_dir).join(market.bars(spark, sf_dir).select("date", "code", (F.floor(F.col("close") * 10000) / 10000).alias("price")), ["date", "code"])
    account = F.concat_ws("/", F.col("portfolio").cast("string"), F.col("date").cast("string")).alias("account")
    rows = b.select(account, "code", F.when(F.length("code") == 2, 300).alias("prev_shares"), "weight", "price", F.lit(1e7).alias("cash"))
    return rounded(trading.trade_list(rows), 2)


def _ledger(spark, sf_dir):
    amount = F.sum("l_extendedprice")
    t = market.table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("account"), F.col("l_partkey").alias("code"), F.col("l_shipdate").cast("date").alias("date"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side")
    ).agg(F.sum("l_quantity").alias("qty"), amount.alias("amount"), F.round(amount * 0.001, 2).alias("fee"), F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return portfolio.position_ledger(t, ["date", "side"])


def ledger_checks(spark, sf_dir):
    return trading.ledger_checks(_ledger(spark, sf_dir), 10)


def trade_summaries(spark, sf_dir):
    return rounded(trading.trade_summary(_ledger(spark, sf_dir)), 2)


def weekday_rebalances(spark, sf_dir):
    days = market.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return portfolio.rebalance_dates(days, "biweek", 2).select("period", "date", F.weekday("date").alias("weekday"))


def _predictions(spark, sf_dir):
    e = market.table(spark, sf_dir, "embeddings").select(F.col("label").alias("date"), F.col("vec_id").alias("code"), F.get("embedding", F.lit(63)).cast("double").alias("label"), F.posexplode(F.slice("embedding", 1, 8)).alias("expert", "prediction"))
    return e.withColumn("prediction", F.col("prediction").cast("double"))


def expert_ics(spark, sf_dir):
    return rounded(experts.expert_ic(_predictions(spark, sf_dir)))


def expert_summaries(spark, sf_dir):
    return rounded(experts.expert_summary(experts.expert_ic(_predictions(spark, sf_dir))))


def ensembles(spark, sf_dir):
    p = _predictions(spark, sf_dir)
    ic = experts.expert_ic(p)
    out = experts.ensemble(p).withColumnRenamed("score", "equal")
    for name, args in (("by_ic", (ic,)), ("rank", (None, True)), ("ic_rank", (ic, True))):
        out = out.join(experts.ensemble(p, *args).withColumnRenamed("score", name), ["date", "code"])
    return rounded(out)


def ensemble_ic(spark, sf_dir):
    p = _predictions(spark, sf_dir)
    score = experts.ensemble(p, ranks=True).join(p.where("expert = 0").select("date", "code", "label"), ["date", "code"])
    return rounded(evaluation.compute_ic(score.withColumn("score", F.round("score", 9)), "score", "label"))


def expert_pairs(spark, sf_dir):
    p = _predictions(spark, sf_dir)
    return rounded(experts.redundant(experts.expert_correlations(p), experts.overlap(p, 10), -1.0, 0.0))


def expert_votes(spark, sf_dir):
    return rounded(experts.votes(_predictions(spark, sf_dir), 10))


def group_discrimination(spark, sf_dir):
    p = _predictions(spark, sf_dir)
    groups = p.select("expert", (F.col("expert") % 2).alias("grp")).distinct()
    return rounded(experts.group_discrimination(experts.expert_correlations(p), groups))


def expert_groups(spark, sf_dir):
    """Eight experts, two to a model type; the holdout IC is that of the dates from 6 on."""
    ic = experts.expert_ic(_predictions(spark, sf_dir))
    one = experts.expert_summary(ic).join(ic.where("date >= 6").groupBy("expert").agg(F.avg("ic").alias("holdout")), "expert")
    e = F.col("expert")
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))
    name = F.concat_ws("_", pick(["rf", "et", "lgb", "xgb"], e), pick(["conservative", "moderate"], F.floor(e / 4)), pick(["momentum", "fundamental"], e), F.concat(F.lit("w"), pick([252, 504], F.floor(e / 3)).cast("string")))
    s = one.select(*codes.expert_parts(name), F.col("mean").alias("ic"), "ir", "positive", "holdout")
    return rounded(experts.group_stats(s, ["model_type", "hyper_set", "feature_set", "train_window"]))


def excess_labels(spark, sf_dir):
    b = market.bars(spark, sf_dir).select("date", "code", "close", "money", "volume")
    return rounded(experts.excess_label(b, b.groupBy("date").agg((F.sum("money") / F.sum("volume")).alias("close")), 3))


def holdout_rows(spark, sf_dir):
    return rounded(experts.time_holdout(market.bars(spark, sf_dir).select("date", "code", "close")))


QUERIES = {
    f.__name__: f
    for f in (
        ic_tables, factor_summaries, factor_correlations, mad_filtered, orthogonal_scores, train_scaled, weight_schemes, strength_weights,
        industry_caps, limited_turnover, smoothed_weights, holdings_checks, rebalance_costs, trade_sides, cost_benefit, plain_decisions, lot_trades, ledger_checks, trade_summaries, weekday_rebalances,
        expert_ics, expert_summaries, ensembles, ensemble_ic, expert_pairs, expert_votes, group_discrimination, expert_groups, excess_labels, holdout_rows,
    )
}

_rank = lambda x, by: f"rank() over (partition by {by} order by {x}) + (count(*) over (partition by {by}, {x}) - 1) / 2.0"
_ma = roll("avg", "close", 20)
_WEEK = bars_sql("week", "brand")
_TAB = f"""{_WEEK}, f as (select date, code, lead(close) over {W} / close - 1 as fwd, close / lag(close, 20) over {W} - 1 as mom_1m, close / lag(close, 5) over {W} - 1 as rev_5d,
    (close - {_ma}) / ({_ma} + 1e-8) as bias_20, volume / ({roll('avg', 'volume', 20)} + 1e-8) as volume_ratio from bars),
    l as ({' union all '.join(f"select '{n}' as factor, date, fwd, {n} as x from f" for n in FACTORS)}),
    k as (select factor, date, {_rank('x', 'factor, date')} as a, {_rank('fwd', 'factor, date')} as b from l where x is not null and fwd is not null),
    c as (select factor, date, case when count(*) >= 10 then nullif(round(corr(a, b), 12), 0) end as ic, count(*) as n from k group by 1, 2),
    t as (select d.factor, d.date, ic, coalesce(n, 0) as n from (select distinct factor, date from l) d left join c on c.factor = d.factor and c.date = d.date)"""
_MOM = f"{BARS}, m as (select date, code, close / lag(close, 3) over {W} - 1 as a, close / lag(close, 6) over {W} - 1 as b from bars)"
_z = lambda x: f"case when count({x}) over p >= 5 and stddev_samp({x}) over p >= 1e-10 then ({x} - avg({x}) over p) / stddev_samp({x}) over p end"
_CHG = f"""{BOOK}, dp as (select portfolio, date, lag(date) over (partition by portfolio order by date) as prev from (select distinct portfolio, date from w)),
    u as (select dp.portfolio, dp.date, code, 0.0::double as o, weight as n from dp join w on w.portfolio = dp.portfolio and w.date = dp.date where prev is not null union all
    select dp.portfolio, dp.date, code, weight, 0.0::double from dp join w on w.portfolio = dp.portfolio and w.date = dp.prev), ch as (select portfolio, date, code, sum(o) as old, sum(n) as new from u group by 1, 2, 3)"""
_LEAD = f"""{BOOK}, w8 as (select portfolio, date, code, weight / sum(weight) over (partition by portfolio, date) as weight
    from (select *, row_number() over (partition by portfolio, date order by weight desc, code) as place from w) where place <= 8)""" + re.sub(r"\bw\b", "w8", _CHG.removeprefix(BOOK))
_LEDGER = """t as (select l_suppkey as account, l_partkey as code, cast(l_shipdate as date) as date, case when l_returnflag = 'R' then 'sell' else 'buy' end as side, sum(l_quantity) as qty, sum(l_extendedprice) as amount,
    cast(round(cast(sum(l_extendedprice) * 0.001 as decimal(18, 6)), 2) as double) as fee, avg(l_extendedprice / l_quantity) as price from lineitem group by 1, 2, 3, 4),
    l as (select *, sum(case when side = 'sell' then -qty else qty end) over (partition by account, code order by date, side rows unbounded preceding) as shares from t)"""
_P = f"""p as (select label as date, vec_id as code, cast(embedding[64] as double) as label, cast(unnest(range(0, 8)) as integer) as expert, cast(unnest(embedding[1:8]) as double) as prediction from embeddings),
    r as (select *, {_rank('prediction', 'date, expert')} as pr, {_rank('label', 'date, expert')} as lr, count(*) over (partition by date, expert) as nn from p),
    i as (select date, expert, case when count(*) >= 10 then coalesce(nullif(round(corr(pr, lr), 12), 0), 0) end as ic, count(*) as n from r group by 1, 2)"""
_PAIR = """g as (select a.expert as a, b.expert as b, corr(a.pr, b.pr) as corr from r a join r b on a.date = b.date and a.code = b.code and a.expert < b.expert group by 1, 2)"""
_TOP = "o as (select *, row_number() over (partition by date, expert order by prediction desc, code) as rk from p), q as (select * from o where rk <= 10)"
_ens = lambda x: f"coalesce(sum(greatest(coalesce(ic, 0), 0) * {x}) / nullif(sum(greatest(coalesce(ic, 0), 0)), 0), avg({x}))"
ORACLE = {
    "ic_tables": f"with {_TAB} select factor, date, round(ic, 6) as ic, n from t",
    "factor_summaries": f"""with {_TAB}, k2 as (select *, pow(0.95, row_number() over (partition by factor order by date desc) - 1) as w from t where ic is not null),
        s as (select factor, sum(w * ic) / sum(w) as m, sum(w * ic * ic) / sum(w) as q, avg(case when ic > 0 then 1.0 else 0.0 end) as p, avg(abs(ic)) as b, count(*) as n from k2 group by 1)
        select factor, round(m, 6) as mean_ic, round(sqrt(greatest(q - m * m, 0)), 6) as std_ic, round(m / nullif(sqrt(greatest(q - m * m, 0)), 0), 6) as icir, round(p, 6) as positive_share, round(b, 6) as mean_abs_ic, n from s""",
    "factor_correlations": f"with {_TAB} select a.factor as a, b.factor as b, round(corr(a.ic, b.ic), 6) as corr from t a join t b on a.date = b.date and a.factor < b.factor where a.ic is not null and b.ic is not null group by 1, 2",
    "mad_filtered": f"""with {_MOM}, x as (select date, code, a, abs(a - quantile_cont(a, 0.5) over (partition by date)) as dev from m where a is not null), y as (select *, quantile_cont(dev, 0.5) over (partition by date) as mad from x)
        select date, code, round(a, 6) as a from y where 0.6745 * dev / nullif(mad, 0) < 5""",
    "orthogonal_scores": f"""with {_MOM}, z as (select date, code, {_z('a')} as a, {_z('b')} as b from m where a is not null and b is not null window p as (partition by date)),
        c as (select date, corr(a, b) as rho, count(*) as n from z group by 1), e as (select z.*, n, rho, b - rho * a as res from z join c using (date)), s as (select *, stddev_samp(res) over (partition by date) as sd from e),
        o as (select date, code, a, case when n >= 10 and sd >= 1e-10 then res / sd else b end as o from s) select date, code, round(o, 6) as o, round((coalesce(a * 0.6, 0) + coalesce(o * -0.4, 0))
        / nullif((case when a is not null then 0.6 else 0 end) + (case when o is not null then 0.4 else 0 end), 0), 6) as score from o""",
    "train_scaled": f"""with {_MOM}, q as (select quantile_cont(a, 0.01) as lo, quantile_cont(a, 0.99) as hi from m where date < '1995-01-01'), x as (select date, code, case when a is not null then least(greatest(a, lo), hi) end as a from m, q),
        s as (select avg(a) as mu, stddev_samp(a) as sd from x where date < '1995-01-01') select date, code, round(coalesce((a - mu) / sd, 0), 6) as a from x, s""",
    "weight_schemes": f"""with {BOOK}, r as (select date, code, close / lag(close) over {W} - 1 as r from bars), v as (select date, code, {roll('stddev_samp', 'r', 6)} as vol from r),
        x as (select portfolio, w.date, w.code, 1 / greatest(coalesce(vol, 0.02), 0.01) as i from w left join v on v.date = w.date and v.code = w.code)
        select portfolio, date, code, round(1.0 / count(*) over (partition by portfolio, date), 6) as equal, round(i / sum(i) over (partition by portfolio, date), 6) as inverse from x""",
    "strength_weights": f"""with {BOOK}, s as (select *, greatest(sum(weight) over (partition by date, industry) - 0.1, 0) / count(*) over (partition by portfolio, date, industry) as u from w),
        t as (select *, sum(u) over (partition by portfolio, date) as total, count(*) over (partition by portfolio, date) as n from s)
        select portfolio, date, code, round(case when total > 0 then u / total else 1.0 / n end, 6) as weight from t""",
    "industry_caps": f"with {BOOK} select portfolio, date, industry, round(least(sum(weight), 0.2), 6) as weight from w group by 1, 2, 3",
    "limited_turnover": f"""with {_CHG}, t as (select *, sum(abs(new - old)) over (partition by portfolio, date) / 2 as t from ch)
        select portfolio, date, code, round(old + case when t > 0.3 then 0.3 / t else 1 end * (new - old), 6) as weight from t""",
    "smoothed_weights": f"""with {_CHG}, t as (select *, sum(abs(new - old)) over (partition by portfolio, date) as t from ch), b as (select *, case when t > 0.4 then 0.25 * new + 0.75 * old else new end as x from t)
        select portfolio, date, code, round(x / nullif(sum(x) over (partition by portfolio, date), 0), 6) as weight from b""",
    "holdings_checks": f"""with {_LEAD}, a as (select portfolio, date, count(case when weight > 1e-6 then 1 end) as n from w8 group by 1, 2), d as (select portfolio, date, count(case when old = 0 and new > 0 then 1 end) as added,
        count(case when old > 0 and new = 0 then 1 end) as removed, count(*) as k, coalesce(string_agg(case when old = 0 and new > 0 then code end, ',' order by code), '') as names_added,
        coalesce(string_agg(case when old > 0 and new = 0 then code end, ',' order by code), '') as names_removed from ch group by 1, 2)
        select a.portfolio, a.date, n, n >= 8 as ok, added, removed, round((added + removed) / k, 6) as name_turnover, names_added, names_removed from a left join d on a.portfolio = d.portfolio and a.date = d.date""",
    "rebalance_costs": f"""with {_CHG} select portfolio, date, round(sum(abs(new - old) * case when abs(new - old) <= 1e-9 then 0 when cast(code as integer) % 3 = 0 then case when new < old and length(code) * 4 < 7 then 0.015 else 0 end
        when new > old then 0.00026 else 0.00076 end), 8) as cost, round(0.001 * sum(abs(new - old)) / 2, 8) as flat from ch group by 1, 2""",
    "trade_sides": f"with {_CHG} select portfolio, date, code, case when new > old then 'buy' else 'sell' end as side, round(abs(new - old), 6) as size from ch where abs(new - old) > 1e-9",
    "cost_benefit": f"""with {_LEAD}, s as (select date, code, close / lag(close, 3) over {W} - 1 as score from bars),
        x as (select ch.*, coalesce(score, 0) as score, case when ch.code <> '7' then length(ch.code) * 20 - cast(ch.code as integer) % 4 * 10 else 0 end as days from ch left join s on s.date = ch.date and s.code = ch.code),
        y as (select *, old > 0 and new = 0 as gone, coalesce(max(case when old = 0 and new > 0 then score end) over (partition by portfolio, date), 0) as best from x),
        c as (select *, case when gone then greatest(best - score, 0) * 0.1 end as benefit, case when gone then case when cast(code as integer) % 3 <> 0 then 0.00076::double when days < 7 then 0.015 else 0 end end as unit_cost from y),
        a as (select *, case when gone then case when benefit - unit_cost > 0.05 and days >= 15 then 'sell' else 'keep' end when old = 0 and new > 0 then 'buy' else 'hold' end as action from c),
        b as (select *, case when action = 'keep' then old else new end as x from a)
        select portfolio, date, code, action, round(benefit, 6) as benefit, round(unit_cost, 6) as unit_cost, round(x / nullif(sum(x) over (partition by portfolio, date), 0), 6) as weight from b""",
    "plain_decisions": f"""with {_CHG} select 'simple' as rule, portfolio, date, code, case when old > 0 and new = 0 then 'sell' when old = 0 and new > 0 then 'buy' else 'hold' end as action, round(new, 6) as weight from ch
        union all select 'none', portfolio, date, code, 'hold', round(old, 6) from ch""",
    "lot_trades": f"""with {BOOK}, x as (select portfolio || '/' || cast(w.date as varchar) as account, w.code, case when length(w.code) = 2 then 300 else 0 end as prev, weight, floor(b.close * 10000) / 10000 as price from w join bars b on b.date = w.date and b.code = w.code),
        v as (select *, sum(prev * price) over (partition by account) + 1e7 as value from x), t as (select *, cast(floor(value * weight / price / 100) * 100 as bigint) - prev as d from v)
        select account, code, case when d > 0 then 'buy' else 'sell' end as side, abs(d) as qty, round(abs(d) * price, 2) as amount, cast(round(cast(abs(d) * price * 0.001 as decimal(18, 6)), 2) as double) as fee from t where d <> 0""",
    "ledger_checks": f"""with {_LEDGER} select account, count(*) as n, count(case when qty % 10 <> 0 then 1 end) as bad_lot, count(case when abs(fee - 0.001 * amount) > 0.01 then 1 end) as bad_fee,
        count(case when abs(amount - qty * price) > 0.01 then 1 end) as bad_amount, count(case when shares < 0 then 1 end) as oversold from l group by 1""",
    "trade_summaries": f"""with {_LEDGER} select account, date, count(case when side = 'buy' then 1 end) as buys, count(case when side = 'sell' then 1 end) as sells, round(coalesce(sum(case when side = 'buy' then amount end), 0), 2) as bought,
        round(coalesce(sum(case when side = 'sell' then amount end), 0), 2) as sold, round(sum(fee), 2) as fees from l group by 1, 2""",
    "weekday_rebalances": """with d as (select distinct cast(l_shipdate as date) as date from lineitem), w as (select cast(date_trunc('week', date) as date) as period, coalesce(min(case when isodow(date) = 3 then date end), min(date)) as date from d group by 1),
        k as (select *, row_number() over (order by period) as k from w) select period, date, cast(isodow(date) - 1 as integer) as weekday from k where k % 2 = 1""",
    "expert_ics": f"with {_P} select date, expert, round(ic, 6) as ic, n from i",
    "expert_summaries": f"""with {_P} select expert, round(avg(ic), 6) as mean, round(stddev_samp(ic), 6) as std, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) as ir, round(stddev_pop(ic), 6) as std_pop,
        round(avg(case when ic > 0 then 1.0 else 0.0 end), 6) as positive, round(max(ic), 6) as best, round(min(ic), 6) as worst, count(*) as n from i where ic is not null group by 1""",
    "ensembles": f"""with {_P} select r.date, code, round(avg(prediction), 6) as equal, round({_ens('prediction')}, 6) as by_ic, round(avg(pr / nn), 6) as rank, round({_ens('pr / nn')}, 6) as ic_rank
        from r join i on r.date = i.date and r.expert = i.expert group by 1, 2""",
    "ensemble_ic": f"""with {_P}, e as (select date, code, round(avg(pr / nn), 9) as s, max(label) as l from r group by 1, 2), k as (select date, {_rank('s', 'date')} as a, {_rank('l', 'date')} as b from e)
        select date, round(case when count(*) >= 10 then nullif(round(corr(a, b), 12), 0) end, 6) as ic, count(*) as n from k group by 1""",
    "expert_pairs": f"""with {_P}, {_PAIR}, {_TOP}, c as (select date, expert, count(*) as k from q group by 1, 2), s as (select a.date, a.expert as a, b.expert as b, a.k as x, b.k as y from c a join c b on a.date = b.date and a.expert < b.expert),
        h as (select a.date, a.expert as a, b.expert as b, count(*) as c from q a join q b on a.date = b.date and a.code = b.code and a.expert < b.expert group by 1, 2, 3),
        j as (select s.a, s.b, avg(coalesce(c, 0) / (x + y - coalesce(c, 0))) as j from s left join h on h.date = s.date and h.a = s.a and h.b = s.b group by 1, 2)
        select g.a, g.b, round(corr, 6) as corr, round(j, 6) as jaccard from g join j on g.a = j.a and g.b = j.b""",
    "expert_votes": f"""with {_P}, {_TOP}, n as (select date, count(distinct expert) as n from p group by 1) select q.date, code, count(*) as votes, round(count(*) / any_value(n), 6) as share, round(avg(rk), 6) as mean_rank from q join n on n.date = q.date group by 1, 2""",
    "group_discrimination": f"with {_P}, {_PAIR} select round(avg(case when a % 2 = b % 2 then corr end), 6) as within, round(avg(case when a % 2 <> b % 2 then corr end), 6) as between from g",
    "expert_groups": f"""with {_P}, s as (select expert, avg(ic) as ic, avg(ic) / nullif(stddev_samp(ic), 0) as ir, avg(case when ic > 0 then 1.0 else 0.0 end) as positive, avg(ic) filter (where date >= 6) as holdout from i where ic is not null group by 1),
        n as (select *, ['rf', 'et', 'lgb', 'xgb'][expert % 4 + 1] as model_type, ['conservative', 'moderate'][(expert // 4) % 2 + 1] as hyper_set, ['momentum', 'fundamental'][expert % 2 + 1] as feature_set, ['252', '504'][(expert // 3) % 2 + 1] as train_window from s),
        g as (select case when grouping(model_type) = 0 then 'model_type' when grouping(hyper_set) = 0 then 'hyper_set' when grouping(feature_set) = 0 then 'feature_set' else 'train_window' end as dimension,
        coalesce(model_type, hyper_set, feature_set, train_window) as "group", count(*) as n_experts, avg(ic) as m, coalesce(stddev_samp(ic), 0) as sd, avg(ir) as ir, avg(positive) as p, avg(holdout) as h from n
        group by grouping sets ((model_type), (hyper_set), (feature_set), (train_window)))
        select dimension, "group", n_experts, round(m, 6) as ic_mean, round(sd, 6) as ic_std, round(ir, 6) as ir_mean, round(p, 6) as positive_mean, round(h, 6) as holdout_mean,
        cast(row_number() over (partition by dimension order by m desc, "group") as integer) as rank from g""",
    "excess_labels": f"""with {BARS}, m as (select date, sum(money) / sum(volume) as c from bars group by 1), n as (select date, lead(c, 3) over (order by date) / c - 1 as m from m), s as (select date, code, lead(close, 3) over {W} / close - 1 as s from bars)
        select s.date, code, round(s - m, 6) as label from s join n on n.date = s.date""",
    "holdout_rows": f"""with {BARS}, d as (select date, row_number() over (order by date) > count(*) over () * 0.8 as late from (select distinct date from bars))
        select b.date, code, round(close, 6) as close, late and (select count(*) from bars) >= 100 as holdout from bars b join d on d.date = b.date""",
}
