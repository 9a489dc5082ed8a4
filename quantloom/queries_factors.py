"""Queries of the factor catalogue and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import factors
from quantloom.operators.windows import above_quantile, forward_sum, historical_percentile, tail_rows
from quantloom.sources import market


def rounded(df, digits: int = 6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _weekly(spark, sf_dir):
    return market.bars(spark, sf_dir, "week", "brand")


GROUPS = {
    "momentum_factors": ["mom_1m", "mom_3m", "mom_6m", "mom_12m", "mom_skip_1m", "rev_5d", "rev_10d", "rev_20d"],
    "technical_factors": ["rsi_14", "ma_5_20_cross", "bias_20", "willr_14"],
    "volatility_factors": ["vol_20d", "vol_60d", "vol_120d"],
    "volume_factors": ["amihud_illiq", "turnover_20d", "volume_ratio", "amount_20d", "price_volume_corr", "obv_slope"],
    "derived_factors": [n for n in factors.PRICE if n.startswith("drv_")],
}


def _group(name):
    def query(spark, sf_dir):
        return rounded(factors.compute_factors(_weekly(spark, sf_dir), GROUPS[name]), 8)

    query.__name__ = name
    return query


def calendar_factors(spark, sf_dir):
    names = ["mom_1m", "rsi_14", "ma_5_20_cross", "vol_20d", "obv_slope"]
    return rounded(factors.compute_factors(market.bars(spark, sf_dir, "week"), names, grid="calendar"), 4)


def factor_params(spark, sf_dir):
    own = {"mom_gap": lambda: F.col("mom_1m") - F.col("mom_3m")}
    return rounded(factors.compute_factors(_weekly(spark, sf_dir), ["mom_1m", "mom_3m", "bias_20"], {"mom_1m": 4, "mom_3m": 13, "bias_20": 8}, own=own))


def valuation_catalogue(spark, sf_dir):
    return rounded(factors.compute_factors(market.valuation(spark, sf_dir), list(factors.VALUE)))


def flow_factors(spark, sf_dir):
    return rounded(factors.compute_factors(market.flows(spark, sf_dir), list(factors.FLOW)), 4)


def unlock_factors(spark, sf_dir):
    rows = market.flows(spark, sf_dir).select("date", "code", "rate1")
    return rounded(forward_sum(forward_sum(rows, "rate1", 20, "unlock_rate_20d"), "rate1", 60, "unlock_rate_60d").drop("rate1"))


def _panel(spark, sf_dir):
    """All factors on the rows of the brands of even number, so that the other sources have rows of their own."""
    prices = _weekly(spark, sf_dir).where(F.substring("code", -1, 1).cast("int") % 2 == 0)
    return factors.all_panel_factors(prices, market.flows(spark, sf_dir), market.valuation(spark, sf_dir, "week", "brand"))


def panel_factors(spark, sf_dir):
    return rounded(_panel(spark, sf_dir), 8)


def value_percentile(spark, sf_dir):
    rows = market.valuation(spark, sf_dir).select("date", "code", (1 / F.col("pe_ratio")).alias("ep"))
    return rounded(rows.select("date", "code", historical_percentile("ep", 24, 12).alias("ep_pct"), above_quantile("ep", 0.95, 24, 12).alias("high")))


def tail_bars(spark, sf_dir):
    return rounded(tail_rows(market.bars(spark, sf_dir), 3).select("date", "code", "close"))


def coverage(spark, sf_dir):
    return rounded(factors.coverage(_panel(spark, sf_dir)))


QUERIES = {n: _group(n) for n in GROUPS} | {
    f.__name__: f for f in (calendar_factors, factor_params, valuation_catalogue, flow_factors, unlock_factors, panel_factors, value_percentile, tail_bars, coverage)
}

W = "(partition by code order by date)"
K = "row(l_shipdate, l_orderkey, l_linenumber, l_partkey)"


def bars_sql(unit: str = "month", by: str = "supplier") -> str:
    code, join = ("cast(l_suppkey as varchar)", "") if by == "supplier" else ("p_brand", " join part on l_partkey = p_partkey")
    return f"""bars as (select {code} as code, cast(date_trunc('{unit}', l_shipdate) as date) as date, arg_min(px, k) as open, max(px) as high, min(px) as low,
        arg_max(px, k) as close, sum(l_quantity) as volume, sum(l_extendedprice) as money from (select *, l_extendedprice / l_quantity as px, {K} as k from lineitem{join}) group by 1, 2)"""


def roll(fn: str, x: str, n: int) -> str:
    frame = f"over (partition by code order by date rows {n - 1} preceding)"
    return f"case when count({x}) {frame} = {n} then {fn}({x}) {frame} end"


def steps(rows: str = "bars") -> str:
    return f"""d as (select *, close - lag(close) over {W} as dc, close / nullif(lag(close) over {W}, 0) - 1 as ret, volume / nullif(lag(volume) over {W}, 0) - 1 as dvol from {rows}),
        e as (select *, case when dc > 0 then dc else 0 end as gain, case when dc < 0 then -dc else 0 end as loss, ret * dvol as rv, abs(ret) / (money + 1e-8) as il,
        case when volume * sign(dc) is not null then sum(volume * sign(dc)) over (partition by code order by date rows unbounded preceding) end as obv from d)"""


def _lag(x: str, n: int) -> str:
    return f"lag({x}, {n}) over {W}"


def _pct(x: str, n: int) -> str:
    return f"{x} / nullif({_lag(x, n)}, 0) - 1"


def factor_sql() -> dict[str, str]:
    ma = lambda n: roll("avg", "close", n)
    vol = lambda n: roll("stddev_samp", "ret", n)
    rs = f"({roll('avg', 'gain', 14)} / ({roll('avg', 'loss', 14)} + 1e-8))"
    hh, ll = roll("max", "high", 14), roll("min", "low", 14)
    out = {f"mom_{m}m": _pct("close", 20 * m) for m in (1, 3, 6, 12)} | {f"rev_{n}d": _pct("close", n) for n in (5, 10, 20)}
    out |= {"mom_skip_1m": f"{_lag('close', 20)} / {_lag('close', 260)} - 1", "rsi_14": f"100 * {rs} / (1 + {rs})"}
    out |= {"ma_5_20_cross": f"case when {ma(5)} > {ma(20)} then 1.0::double else 0.0::double end", "bias_20": f"(close - {ma(20)}) / ({ma(20)} + 1e-8)"}
    out |= {"willr_14": f"-100 * ({hh} - close) / ({hh} - {ll} + 1e-8)"} | {f"vol_{n}d": vol(n) for n in (20, 60, 120)}
    out |= {"amihud_illiq": roll("avg", "il", 20), "turnover_20d": roll("avg", "volume", 20), "volume_ratio": f"volume / ({roll('avg', 'volume', 20)} + 1e-8)"}
    out |= {"amount_20d": roll("avg", "money", 20), "price_volume_corr": roll("avg", "rv", 20), "obv_slope": f"(obv - {_lag('obv', 20)}) / 20"}
    out |= {f"drv_MA{n}": ma(n) for n in (5, 10, 20, 60)} | {f"drv_BIAS{n}": f"(close - {ma(n)}) / {ma(n)} * 100" for n in (5, 10, 20, 60)}
    out |= {f"drv_MOM_{n}d": _pct("close", n) for n in (1, 5, 10, 20, 60)} | {f"drv_VOL_{n}": vol(n) for n in (5, 10, 20, 60)}
    out |= {f"drv_VR_{n}": f"volume / {roll('avg', 'volume', n)}" for n in (5, 20)} | {f"drv_R{n}": f"-({_pct('close', n)})" for n in (5, 20)}
    return out | {"drv_VRatio_20_60": f"{vol(20)} / {vol(60)}"}


SQL = factor_sql()
select = lambda names, digits: ", ".join(f"round({SQL[n]}, {digits}) as {n}" for n in names)
GRID = """, g as (select x.date, c.code, high, low, close, volume, money from (select distinct date from bars) x cross join (select distinct code from bars) c
    left join bars b on b.date = x.date and b.code = c.code)"""
FLOWS = """flows as (select p_brand as code, cast(date_trunc('week', l_shipdate) as date) as date, sum(l_tax) as share_ratio, sum(l_extendedprice) as fin_value, sum(l_quantity) as sec_value,
    coalesce(sum(case when l_returnflag <> 'R' and l_quantity >= 30 then l_extendedprice end), 0) as big_in, coalesce(sum(case when l_returnflag = 'R' and l_quantity >= 30 then l_extendedprice end), 0) as big_out,
    sum(l_extendedprice) as flow, sum(case when l_returnflag = 'R' then l_discount end) as rate1 from lineitem join part on l_partkey = p_partkey group by 1, 2),
    f as (select *, big_in - big_out as net, case when flow > 0 then (big_in - big_out) / flow else 0 end as share from flows)"""
VALUATION = """v as (select cast(l_suppkey as varchar) as code, cast(date_trunc('month', l_shipdate) as date) as date, sum(l_extendedprice) / nullif(sum(l_extendedprice * l_discount), 0) as pe_ratio,
    avg(l_extendedprice) / 1000 as pb_ratio, sum(l_extendedprice) / nullif(sum(l_extendedprice * l_tax), 0) as ps_ratio, sum(l_extendedprice) as market_cap, avg(l_discount) as dividend_ratio,
    avg(l_tax) as turnover_ratio from lineitem group by 1, 2)"""
_inv = lambda x: f"case when abs({x}) > 1e-8 then 1 / {x} end"
_unlock = lambda n: f"round(coalesce(sum(rate1) over (partition by code order by idx range between 1 following and {n} following), 0), 6) as unlock_rate_{n}d"
_FLOW = {f"hk_hold_ratio_change_{n}d": f"share_ratio - {_lag('share_ratio', n)}" for n in (5, 20)} | {f"margin_fin_chg{n}d": _pct("fin_value", n) for n in (5, 20)}
_FLOW |= {f"mf_net_big_{n}d": roll("avg", "net", n) for n in (5, 20)} | {"margin_sec_chg5d": _pct("sec_value", 5), "mf_big_ratio_5d": roll("avg", "share", 5)}
_FLOW |= {f"unlock_rate_{n}d": f"coalesce(sum(rate1) over (partition by code order by idx range between 1 following and {n} following), 0)" for n in (20, 60)}
_VALUE = {"pe_ttm": "pe_ratio", "pb_ratio": "pb_ratio", "ps_ratio": "ps_ratio", "market_cap": "ln(market_cap)", "ep_ratio": _inv("pe_ratio"), "bp_ratio": _inv("pb_ratio"), "sp_ratio": _inv("ps_ratio")}
_VALUE |= {"turnover_ratio": "turnover_ratio", "dividend_yield": "dividend_ratio", "log_market_cap": "ln(market_cap)"}
ALL_NAMES = [*SQL, *_FLOW, *_VALUE]
_cols = lambda c: ", ".join(f'{x} as "{n}"' for n, x in c.items())
_ALL = f"""{bars_sql('week', 'brand').replace('bars as', 'b0 as')}, bars as (select * from b0 where cast(code[-1:] as integer) % 2 = 0), {steps()}, {FLOWS}, fd as (select date, row_number() over (order by date) as idx from (select distinct date from flows)),
    {VALUATION.replace("cast(l_suppkey as varchar)", "p_brand").replace("'month'", "'week'").replace("from lineitem", "from lineitem join part on l_partkey = p_partkey")},
    pf as (select date, code, {_cols(SQL)} from e), f2 as (select * from f join fd using (date)), ff as (select date, code, {_cols(_FLOW)} from f2), vf as (select date, code, {_cols(_VALUE)} from v),
    al as (select * from pf left join ff using (date, code) left join vf using (date, code))"""
ORACLE = {n: f"with {bars_sql('week', 'brand')}, {steps()} select date, code, {select(names, 8)} from e" for n, names in GROUPS.items()} | {
    "calendar_factors": f"with {bars_sql('week')}{GRID}, {steps('g')} select date, code, {select(['mom_1m', 'rsi_14', 'ma_5_20_cross', 'vol_20d', 'obv_slope'], 4)} from e",
    "factor_params": f"""with {bars_sql('week', 'brand')}, r as (select date, code, {_pct('close', 4)} as a, {_pct('close', 13)} as b, (close - {roll('avg', 'close', 8)}) / ({roll('avg', 'close', 8)} + 1e-8) as c from bars)
        select date, code, round(a, 6) as mom_1m, round(b, 6) as mom_3m, round(c, 6) as bias_20, round(a - b, 6) as mom_gap from r""",
    "valuation_catalogue": f"""with {VALUATION} select date, code, round(pe_ratio, 6) as pe_ttm, round(pb_ratio, 6) as pb_ratio, round(ps_ratio, 6) as ps_ratio, round(ln(market_cap), 6) as market_cap,
        round({_inv('pe_ratio')}, 6) as ep_ratio, round({_inv('pb_ratio')}, 6) as bp_ratio, round({_inv('ps_ratio')}, 6) as sp_ratio, round(turnover_ratio, 6) as turnover_ratio,
        round(dividend_ratio, 6) as dividend_yield, round(ln(market_cap), 6) as log_market_cap from v""",
    "flow_factors": f"""with {FLOWS} select date, code, """
    + ", ".join(f"round(share_ratio - {_lag('share_ratio', n)}, 4) as hk_hold_ratio_change_{n}d, round({_pct('fin_value', n)}, 4) as margin_fin_chg{n}d, round({roll('avg', 'net', n)}, 4) as mf_net_big_{n}d" for n in (5, 20))
    + f", round({_pct('sec_value', 5)}, 4) as margin_sec_chg5d, round({roll('avg', 'share', 5)}, 4) as mf_big_ratio_5d from f",
    "unlock_factors": f"""with {FLOWS}, d as (select date, row_number() over (order by date) as idx from (select distinct date from flows)), r as (select f.date, code, rate1, idx from f join d on f.date = d.date)
        select date, code, {_unlock(20)}, {_unlock(60)} from r""",
    "panel_factors": f"with {_ALL} select date, code, " + ", ".join(f'round("{n}", 8) as "{n}"' for n in ALL_NAMES) + " from al",
    "value_percentile": f"""with {VALUATION}, e as (select date, code, 1 / pe_ratio as ep from v), h as (select *, list(ep) filter (where ep is not null) over w as hist, quantile_cont(ep, 0.95) over w as q from e
        window w as (partition by code order by date rows 23 preceding)) select date, code, round(case when ep is not null and len(hist) >= 12 then len(list_filter(hist, lambda x: x <= ep)) / len(hist) end, 6) as ep_pct,
        cast(case when len(hist) >= 12 and ep > q then 1 else 0 end as integer) as high from h""",
    "tail_bars": f"with {bars_sql()}, r as (select *, row_number() over (partition by code order by date desc) as i from bars) select date, code, round(close, 6) as close from r where i <= 3",
    "coverage": f"with {_ALL} " + " union all ".join(f"""select '{n}' as factor, round(count("{n}") / count(*), 6) as share, count("{n}") / count(*) >= 0.8 as kept from al""" for n in ALL_NAMES),
}
