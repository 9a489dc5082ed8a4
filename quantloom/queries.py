"""Registered queries of the panel library and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.scalars import clip, invert, log_pos
from quantloom.operators import cross_section as xs
from quantloom.operators import evaluation, factors, performance, portfolio
from quantloom.operators.windows import densify, fwd_return, pct_change, rolling
from quantloom import queries_accounts, queries_choice, queries_exposure, queries_factors, queries_returns, queries_rotation, queries_sources, queries_sweep, queries_trading
from quantloom.sources import market

CAP = 0.08


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("close")
    return market.bars(spark, sf_dir).select("date", "code", "close", pct_change(c, 3).alias("mom"), fwd_return(c, 1).alias("fwd"))


def bars(spark, sf_dir):
    return rounded(market.bars(spark, sf_dir), 8)


def calendar_momentum(spark, sf_dir):
    grid = densify(market.bars(spark, sf_dir).select("date", "code", "close"))
    return rounded(grid.select("date", "code", pct_change(F.col("close"), 2).alias("mom_2")))


def valuation_factors(spark, sf_dir):
    rows = market.table(spark, sf_dir, "lineitem")
    p = F.col("l_extendedprice")
    code, date = F.col("l_suppkey").cast("string").alias("code"), F.date_trunc("month", "l_shipdate").cast("date").alias("date")
    v = rows.groupBy(date, code).agg(F.sum(p).alias("cap"), F.sum(p * F.col("l_discount")).alias("earn"), F.avg("l_tax").alias("turn"))
    pe = F.col("cap") / F.nullif(F.col("earn"), F.lit(0.0))
    return rounded(v.select("date", "code", invert(pe).alias("ep_ratio"), log_pos(F.col("cap")).alias("log_cap"), clip(F.col("turn"), 0.02, 0.06).alias("turn_clip")))


def cross_section(spark, sf_dir):
    s = _scored(spark, sf_dir).where("mom is not null")
    return rounded(s.select("date", "code", xs.rank_avg("mom").alias("rank_avg"), xs.rank_pct("mom").alias("rank_pct"), xs.zscore("mom").alias("z")))


def winsorized(spark, sf_dir):
    s = _scored(spark, sf_dir).where("mom is not null").select("date", "code", "mom")
    return rounded(xs.winsorize(s, "mom", 0.05))


def rank_ic(spark, sf_dir):
    return rounded(evaluation.compute_ic(_scored(spark, sf_dir), "mom", "fwd"))


def pearson_ic(spark, sf_dir):
    return rounded(evaluation.compute_ic(_scored(spark, sf_dir), "mom", "fwd", "pearson"))


def icir(spark, sf_dir):
    return rounded(evaluation.icir(evaluation.compute_ic(_scored(spark, sf_dir), "mom", "fwd"), 0.95))


def quantile_returns(spark, sf_dir):
    return rounded(evaluation.quantile_returns(_scored(spark, sf_dir), "mom", "fwd"))


def ic_decay(spark, sf_dir):
    return rounded(evaluation.ic_decay(_scored(spark, sf_dir), "mom", [1, 2, 4, 6], decay=0.97))


def industry_momentum(spark, sf_dir):
    s = _scored(spark, sf_dir).join(market.industry(spark, sf_dir), "code")
    g = s.groupBy("date", "industry").agg(F.avg("mom").alias("mom"), F.count("mom").alias("n")).where("mom is not null")
    top = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("mom"), "industry"))
    return rounded(g.withColumn("rank", top).where("rank <= 5"))


def rrg(spark, sf_dir):
    b = market.bars(spark, sf_dir)
    index = b.groupBy("date").agg((F.sum("money") / F.sum("volume")).alias("index"))
    ind = b.join(market.industry(spark, sf_dir), "code").groupBy("date", "industry").agg(F.avg("close").alias("close"))
    w = Window.partitionBy("industry").orderBy("date")
    rs = ind.join(index, "date").withColumn("rs", F.col("close") / F.col("index"))
    rs = rs.withColumn("rs_ratio", 100 * F.col("rs") / rolling(F.avg, F.col("rs"), 6, w))
    return rounded(rs.select("date", "industry", "rs_ratio", (100 * F.col("rs_ratio") / F.lag("rs_ratio", 3).over(w)).alias("rs_mom")))


def top_per_industry(spark, sf_dir):
    s = _scored(spark, sf_dir).where("mom is not null").join(market.industry(spark, sf_dir), "code")
    return rounded(xs.top_n(s, "mom", 2, ("date", "industry")).select("date", "industry", "code", "mom", "rank"))


def market_scale(spark, sf_dir):
    index = market.bars(spark, sf_dir).groupBy("date").agg((F.sum("money") / F.sum("volume")).alias("close"))
    w = Window.partitionBy(F.lit(1)).orderBy("date")  # one row per date
    long, short = rolling(F.avg, F.col("close"), 12, w), rolling(F.avg, F.col("close"), 4, w)
    scale = F.when(F.col("close") < long, 0.0).when(F.col("close") < short, 0.5).otherwise(1.0)
    return rounded(index.select("date", scale.alias("scale")))


def capped_weights(spark, sf_dir):
    return rounded(portfolio.weight_cap(portfolio.normalise(market.book(spark, sf_dir)), CAP))


def turnover(spark, sf_dir):
    return rounded(portfolio.turnover(portfolio.normalise(market.book(spark, sf_dir))))


def concentration(spark, sf_dir):
    return rounded(portfolio.concentration(portfolio.normalise(market.book(spark, sf_dir))))


def rebalance_dates(spark, sf_dir):
    days = market.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return portfolio.rebalance_dates(days, "quarter")


def position_ledger(spark, sf_dir):
    t = market.table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("account"), F.col("l_partkey").alias("code"), F.col("l_shipdate").cast("date").alias("date"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
    ).agg(F.sum("l_quantity").alias("qty"))
    out = portfolio.position_ledger(t, ["date", "side"])
    return out.select("account", "code", "date", "side", "qty", "shares")


def nav(spark, sf_dir):
    return rounded(performance.nav(market.strategy_returns(spark, sf_dir)))


def metrics(spark, sf_dir):
    return rounded(performance.metrics(market.strategy_returns(spark, sf_dir)))


def strategy_correlations(spark, sf_dir):
    return rounded(performance.correlations(market.strategy_returns(spark, sf_dir)))


def monthly_returns(spark, sf_dir):
    return rounded(performance.monthly(market.strategy_returns(spark, sf_dir)))


QUERIES = {
    f.__name__: f
    for f in (
        bars, calendar_momentum, valuation_factors, cross_section,
        winsorized, rank_ic, pearson_ic, icir, quantile_returns, ic_decay, industry_momentum, rrg, top_per_industry, market_scale,
        capped_weights, turnover, concentration, rebalance_dates, position_ledger, nav, metrics, strategy_correlations, monthly_returns,
    )
}

_BARS = """bars as (
  select cast(l_suppkey as varchar) as code, cast(date_trunc('month', l_shipdate) as date) as date,
         arg_min(px, k) as open, max(px) as high, min(px) as low, arg_max(px, k) as close, sum(l_quantity) as volume, sum(l_extendedprice) as money
  from (select *, l_extendedprice / l_quantity as px, row(l_shipdate, l_orderkey, l_linenumber, l_partkey) as k from lineitem) group by 1, 2)"""
_W = "(partition by code order by date)"
_SCORED = f"""{_BARS}, s as (select date, code, close, close / lag(close, 3) over {_W} - 1 as mom, lead(close, 1) over {_W} / close - 1 as fwd from bars)"""
_IND = "ind as (select cast(s_suppkey as varchar) as code, n_name as industry, n_regionkey as portfolio from supplier join nation on s_nationkey = n_nationkey)"
_BOOK = f"""{_BARS}, {_IND}, w as (select portfolio, date, code, money / sum(money) over (partition by portfolio, date) as weight from bars join ind using (code))"""
_RET = "ret as (select event_type as strategy, cast(ts as date) as date, (avg(value) - 49.6) / 1000 as ret from events group by 1, 2)"
_AVG = "rank() over (partition by date order by {0}) + (count(*) over (partition by date, {0}) - 1) / 2.0"


def _roll(fn: str, x: str, n: int) -> str:
    frame = f"over (partition by code order by date rows {n - 1} preceding)"
    return f"case when count({x}) {frame} = {n} then {fn}({x}) {frame} end"


def _ic(rows: str, f: str = _AVG.format("mom"), r: str = _AVG.format("fwd")) -> str:
    return f"""r as (select date, {f} as f, {r} as r from {rows} where mom is not null and fwd is not null),
        c as (select date, case when count(*) >= 10 then nullif(round(corr(f, r), 12), 0) end as ic, count(*) as n from r group by date),
        ic as (select d.date, ic, coalesce(n, 0) as n from (select distinct date from {rows}) d left join c on c.date = d.date)"""


_CAP_ROUND = """case when weight >= {c} then {c} else weight + coalesce(weight * sum(greatest(weight - {c}, 0)) over (partition by portfolio, date)
    / nullif(sum(case when weight < {c} then weight end) over (partition by portfolio, date), 0), 0) end as weight""".format(c=CAP)

ORACLE = {
    "bars": f"with {_BARS} select date, code, round(open, 8) as open, round(high, 8) as high, round(low, 8) as low, round(close, 8) as close, round(volume, 8) as volume, round(money, 8) as money from bars",
    "calendar_momentum": f"""with {_BARS}, g as (select d.date, c.code, close from (select distinct date from bars) d cross join (select distinct code from bars) c
        left join bars b on b.date = d.date and b.code = c.code) select date, code, round(close / lag(close, 2) over {_W} - 1, 6) as mom_2 from g""",
    "valuation_factors": """with v as (select cast(l_suppkey as varchar) as code, cast(date_trunc('month', l_shipdate) as date) as date, sum(l_extendedprice) as cap,
        sum(l_extendedprice * l_discount) as earn, avg(l_tax) as turn from lineitem group by 1, 2)
        select date, code, round(case when abs(cap / nullif(earn, 0)) > 1e-8 then 1 / (cap / nullif(earn, 0)) end, 6) as ep_ratio,
        round(case when cap > 0 then ln(cap) end, 6) as log_cap, round(least(greatest(turn, 0.02::double), 0.06::double), 6) as turn_clip from v""",
    "cross_section": f"""with {_SCORED}, m as (select * from s where mom is not null), r as (select *, {_AVG.format('mom')} as rk, count(*) over (partition by date) as n,
        stddev_samp(mom) over (partition by date) as sd, avg(mom) over (partition by date) as mu from m)
        select date, code, round(cast(rk as double), 6) as rank_avg, round(rk / n, 6) as rank_pct, round(case when n >= 5 and sd >= 1e-10 then (mom - mu) / sd end, 6) as z from r""",
    "winsorized": f"""with {_SCORED}, m as (select * from s where mom is not null), q as (select date, quantile_cont(mom, 0.05) as lo, quantile_cont(mom, 0.95) as hi from m group by date)
        select date, code, round(least(greatest(mom, lo), hi), 6) as mom from m join q using (date)""",
    "rank_ic": f"with {_SCORED}, {_ic('s')} select date, round(ic, 6) as ic, n from ic",
    "pearson_ic": f"with {_SCORED}, {_ic('s', 'mom', 'fwd')} select date, round(ic, 6) as ic, n from ic",
    "icir": f"""with {_SCORED}, {_ic('s')}, k as (select ic, pow(0.95, row_number() over (order by date desc) - 1) as w from ic where ic is not null),
        a as (select sum(w * ic) / sum(w) as m, sum(w * ic * ic) / sum(w) as q, avg(case when ic > 0 then 1.0 else 0.0 end) as p, avg(abs(ic)) as b, count(*) as n from k)
        select round(case when n < 10 then 0 else m end, 6) as mean_ic, round(case when n < 10 then 0 else sqrt(greatest(q - m * m, 0)) end, 6) as std_ic,
        round(case when n < 10 then 0 else m / nullif(sqrt(greatest(q - m * m, 0)), 0) end, 6) as icir, round(case when n < 10 then 0 else p end, 6) as positive_share,
        round(case when n < 10 then 0 else b end, 6) as mean_abs_ic, n from a""",
    "quantile_returns": f"""with {_SCORED}, v as (select *, count(*) over (partition by date) as n, row_number() over (partition by date order by mom desc, code) as i
        from s where mom is not null and fwd is not null), g as (select date, cast(least((i - 1) // (n // 5), 4) + 1 as integer) as grp, avg(fwd) as r from v where n >= 25 group by 1, 2)
        select grp, round(avg(r), 6) as mean_ret, count(*) as n_dates from g group by grp""",
    "ic_decay": f"""with {_SCORED}, l as (select date, code, mom, h as horizon, case h when 1 then f1 when 2 then f2 when 4 then f4 else f6 end as fwd from
        (select *, lead(close, 1) over {_W} / close - 1 as f1, lead(close, 2) over {_W} / close - 1 as f2, lead(close, 4) over {_W} / close - 1 as f4, lead(close, 6) over {_W} / close - 1 as f6 from s)
        cross join (values (1), (2), (4), (6)) t(h)), v as (select * from l where mom is not null and fwd is not null),
        r as (select horizon, date, {_AVG.format('mom').replace('partition by date', 'partition by horizon, date')} as f, {_AVG.format('fwd').replace('partition by date', 'partition by horizon, date')} as r from v),
        ic as (select horizon, date, case when count(*) >= 10 then nullif(round(corr(f, r), 12), 0) end as ic from r group by 1, 2),
        k as (select *, pow(0.97, row_number() over (partition by horizon order by date desc) - 1) as w from ic where ic is not null)
        select horizon, round(case when count(*) >= 10 then sum(w * ic) / sum(w) else 0 end, 6) as mean_ic, count(*) as n from k group by horizon""",
    "industry_momentum": f"""with {_SCORED}, {_IND}, g as (select date, industry, avg(mom) as mom, count(mom) as n from s join ind using (code) group by 1, 2),
        r as (select *, row_number() over (partition by date order by mom desc, industry) as rank from g where mom is not null)
        select date, industry, round(mom, 6) as mom, n, cast(rank as integer) as rank from r where rank <= 5""",
    "rrg": f"""with {_BARS}, {_IND}, i as (select date, sum(money) / sum(volume) as idx from bars group by 1), g as (select date, industry, avg(close) as c from bars join ind using (code) group by 1, 2),
        r as (select date, industry, c / idx as rs from g join i using (date)), f as (select *, 100 * rs / case when count(rs) over w = 6 then avg(rs) over w end as rr from r
        window w as (partition by industry order by date rows 5 preceding))
        select date, industry, round(rr, 6) as rs_ratio, round(100 * rr / lag(rr, 3) over (partition by industry order by date), 6) as rs_mom from f""",
    "top_per_industry": f"""with {_SCORED}, {_IND}, r as (select date, industry, code, mom, row_number() over (partition by date, industry order by mom desc, code) as rank
        from s join ind using (code) where mom is not null) select date, industry, code, round(mom, 6) as mom, cast(rank as integer) as rank from r where rank <= 2""",
    "market_scale": f"""with {_BARS}, i as (select date, sum(money) / sum(volume) as c from bars group by 1), m as (select date, c,
        case when count(*) over (order by date rows 11 preceding) = 12 then avg(c) over (order by date rows 11 preceding) end as a,
        case when count(*) over (order by date rows 3 preceding) = 4 then avg(c) over (order by date rows 3 preceding) end as b from i)
        select date, cast(case when c < a then 0.0 when c < b then 0.5 else 1.0 end as double) as scale from m""",
    "capped_weights": f"with {_BOOK}, w0 as (select * from w), " + ", ".join(f"w{i + 1} as (select portfolio, date, code, {_CAP_ROUND} from w{i})" for i in range(10))
    + " select portfolio, date, code, round(weight / sum(weight) over (partition by portfolio, date), 6) as weight from w10",
    "turnover": f"""with {_BOOK}, d as (select portfolio, date, lag(date) over (partition by portfolio order by date) as prev from (select distinct portfolio, date from w)),
        c as (select d.portfolio, d.date, code, weight as x from d join w on w.portfolio = d.portfolio and w.date = d.date where prev is not null union all
        select d.portfolio, d.date, code, -weight from d join w on w.portfolio = d.portfolio and w.date = d.prev), n as (select portfolio, date, code, sum(x) as x from c group by 1, 2, 3)
        select portfolio, date, round(sum(abs(x)) / 2, 6) as turnover from n group by 1, 2""",
    "concentration": f"with {_BOOK} select portfolio, date, round(sum(weight * weight), 6) as hhi, count(*) as n from w group by 1, 2",
    "rebalance_dates": "select cast(date_trunc('quarter', l_shipdate) as date) as period, min(cast(l_shipdate as date)) as date from lineitem group by 1",
    "position_ledger": """with t as (select l_suppkey as account, l_partkey as code, cast(l_shipdate as date) as date, case when l_returnflag = 'R' then 'sell' else 'buy' end as side,
        sum(l_quantity) as qty from lineitem group by 1, 2, 3, 4)
        select *, sum(case when side = 'sell' then -qty else qty end) over (partition by account, code order by date, side rows unbounded preceding) as shares from t""",
    "nav": f"""with {_RET}, n as (select *, product(1 + ret) over (partition by strategy order by date rows unbounded preceding) as nav from ret)
        select strategy, date, round(ret, 6) as ret, round(nav, 6) as nav, round(nav / max(nav) over (partition by strategy order by date rows unbounded preceding) - 1, 6) as drawdown from n""",
    "metrics": f"""with {_RET}, n as (select *, product(1 + ret) over (partition by strategy order by date rows unbounded preceding) as nav from ret),
        d as (select *, nav / max(nav) over (partition by strategy order by date rows unbounded preceding) - 1 as dd, avg(ret) over (partition by strategy) as mu,
        quantile_cont(ret, 0.05) over (partition by strategy) as v from n),
        a as (select strategy, count(*) as n, product(1 + ret) - 1 as total, stddev_samp(ret) * sqrt(242) as vol, stddev_samp(case when ret < 0 then ret end) * sqrt(242) as down,
        min(dd) as mdd, min(v) as v, avg(case when ret <= v then ret end) as cv, avg(pow(ret - mu, 3)) / pow(avg(pow(ret - mu, 2)), 1.5) as sk, avg(pow(ret - mu, 4)) / pow(avg(pow(ret - mu, 2)), 2) - 3 as ku,
        avg(case when ret > 0 then 1.0 else 0.0 end) as wr, avg(case when ret > 0 then ret end) as aw, avg(case when ret < 0 then ret end) as al,
        sum(case when ret > 0 then ret end) / nullif(-sum(case when ret < 0 then ret end), 0) as pf from d group by 1), b as (select *, pow(1 + total, 242.0 / n) - 1 as ann from a)
        select strategy, n, round(total, 6) as total_return, round(vol, 6) as volatility, round(mdd, 6) as max_drawdown, round(v, 6) as var_95, round(cv, 6) as cvar_95, round(sk, 6) as skewness,
        round(ku, 6) as kurtosis, round(wr, 6) as win_rate, round(aw, 6) as avg_win, round(al, 6) as avg_loss, round(pf, 6) as profit_factor, round(ann, 6) as annual_return,
        round((ann - 0.02) / nullif(vol, 0), 6) as sharpe, round((ann - 0.02) / nullif(down, 0), 6) as sortino, round(ann / nullif(abs(mdd), 0), 6) as calmar from b""",
    "strategy_correlations": f"with {_RET} select x.strategy as a, y.strategy as b, round(corr(x.ret, y.ret), 6) as corr, count(*) as n from ret x join ret y on x.date = y.date and x.strategy < y.strategy group by 1, 2",
    "monthly_returns": f"""with {_RET} select strategy, strftime(date, '%Y-%m') as month, round(sum(ret), 6) as total, count(ret) as n, round(avg(ret), 6) as mean, round(stddev_pop(ret), 6) as std,
        round(max(ret), 6) as best, round(min(ret), 6) as worst from ret group by 1, 2""",
}

for _part in (queries_accounts, queries_choice, queries_factors, queries_returns, queries_trading, queries_exposure, queries_rotation, queries_sources, queries_sweep):
    QUERIES |= _part.QUERIES
    ORACLE |= _part.ORACLE
