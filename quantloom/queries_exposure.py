"""Queries of exposure signals over weekly brand returns, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import exposure
from quantloom.operators.windows import pct_change
from quantloom.queries_factors import bars_sql, rounded
from quantloom.sources import market


def _returns(spark, sf_dir):
    b = market.bars(spark, sf_dir, "week", "brand")
    k = F.substring("code", 7, 9).cast("int")  # series of several deviations and drifts reach every rule
    ret = pct_change(F.col("close"), 1) / (60 * (1 + 4 * F.pmod(k, F.lit(5)))) - 0.001 * F.pmod(k, F.lit(4))
    return b.select(F.col("code").alias("strategy"), "date", ret.alias("ret"))


def risk_figures(spark, sf_dir):
    return rounded(exposure.figures(_returns(spark, sf_dir)).select("strategy", "date", "vol", "cvar", "var"))


def market_regimes(spark, sf_dir):
    return rounded(exposure.signals(_returns(spark, sf_dir)).select("strategy", "date", "regime", "confidence"))


def exposure_signals(spark, sf_dir):
    out = exposure.signals(_returns(spark, sf_dir))
    ladder = exposure.managed_vol_scale(exposure.Limits(trend_mode="trend")).alias("ladder")
    return rounded(out.select("strategy", "date", "vol_target", "cvar_scale", "trend", "drawdown", "managed", ladder, "tail"))


def composite_exposure(spark, sf_dir):
    """From a held exposure of 0.6."""
    return rounded(exposure.composite(_returns(spark, sf_dir), 0.6))


QUERIES = {f.__name__: f for f in (risk_figures, market_regimes, exposure_signals, composite_exposure)}


def _smoothed(target: str) -> str:
    raw = f"({target} / vol * case when cvar < -1.5 * {target} / sqrt(242) then 1 - 0.5 * least(1, pow(abs(cvar) / (1.5 * {target} / sqrt(242)), 1.5)) else 1 end)"
    long = f"coalesce({target} / nullif(v120, 0), {raw})"
    mixed = f"case when i < 120 then {raw} when {raw} < 1 then 0.7 * {raw} + 0.3 * {long} else 0.3 * {raw} + 0.7 * {long} end"
    return f"case when n < 20 or vol <= 0 then 1 when n < 40 then least(greatest({target} / vol, 0.5), 1.5) else least(greatest({mixed}, 0.5), 1.5) end"


_P = "partition by strategy order by date rows between"
SIGNALS = f"""{bars_sql('week', 'brand')}, x as (select code as strategy, date, coalesce((close / lag(close) over (partition by code order by date) - 1) / (60 * (1 + 4 * (cast(code[7:] as integer) % 5))) - 0.001 * (cast(code[7:] as integer) % 4), 0) as ret from bars),
    a as (select *, row_number() over o - 1 as i, exp(sum(ln(1 + ret)) over o) as level, stddev_samp(ret) over ({_P} 19 preceding and current row) as s20 from x window o as (partition by strategy order by date)),
    f as (select *, least(i, 60) as n, coalesce(stddev_samp(ret) over b60, 0) * sqrt(242) as vol, coalesce(stddev_samp(ret) over ({_P} 120 preceding and 1 preceding), 0) * sqrt(242) as v120,
        list(ret) over b60 as held, case when i >= 10 then quantile_cont(ret, 0.05) over b60 else 0 end as v, lag(level) over (partition by strategy order by date) as last,
        avg(level) over b20 as ma20, avg(level) over ({_P} 40 preceding and 1 preceding) as ma40, avg(level) over ({_P} 120 preceding and 1 preceding) as ma120,
        sum(ret) over ({_P} 5 preceding and 1 preceding) as sum5, sum(ret) over b20 as sum20, regr_slope(level, i) over b60 / first(level) over b60 * 242 as slope,
        avg(case when ret > 0 then 1.0 else 0.0 end) over b60 as up, 1 - level / max(level) over ({_P} unbounded preceding and current row) as depth, max(level) over ({_P} unbounded preceding and 1 preceding) as peak,
        avg(s20) over ({_P} 41 preceding and 1 preceding) * sqrt(242) as short from a window b60 as ({_P} 60 preceding and 1 preceding), b20 as ({_P} 20 preceding and 1 preceding)),
    c as (select *, coalesce(case when n < 10 then list_avg(held) else list_avg(list_sort(held)[1:greatest(cast(floor(n * 0.05) as integer), 5)]) end, 0) as cvar, list_avg([y for y in held if y <= v]) as worst,
        case when i < 80 then 'weak_trend' when vol > 0.325 then 'high_vol' when abs(slope) > 0.15 and last > ma20 and last > ma40 then 'strong_trend' when last > ma20 or last > ma40 then 'weak_trend' else 'sideway' end as regime from f),
    g as (select *, 0.25 * case when n < 20 then 1 when regime = 'high_vol' then 0.85 when regime = 'sideway' then 0.95 when regime = 'strong_trend' then case when vol < 0.2 then 1.15 else 1 end
        when vol < 0.175 then 1.1 when vol > 0.375 then 0.8 else 1 end as vol_target,
        case when i < 80 then 0.5 when regime = 'high_vol' then least((vol - 0.325) / 0.325 + 0.5, 1) when regime = 'strong_trend' then least(abs(slope) / 0.3, 1) when regime = 'weak_trend' then 0.6
        when up < 0.5 then least(1.3 - up, 0.9) else 0.5 end as confidence,
        least(greatest(case regime when 'strong_trend' then 1 when 'weak_trend' then 0.95 when 'sideway' then 0.85 else 0.75 end * case when i >= 120 and last / ma120 - 1 < -0.05 then 0.85 when i >= 120 and last / ma120 - 1 < -0.03 then 0.92 else 1 end, 0.4), 1) as trend,
        case when depth > 0.18 then 0.3 when depth > 0.12 then 0.45 when depth > 0.08 then 0.6 when depth > 0.04 then 0.8 else 1 end * case when i >= 5 and sum5 < -0.05 then 1 - 0.3 * least(abs(sum5) / 0.1, 1) else 1 end as step,
        case when i < 60 or short <= 0 then 1 else 1 + (least(greatest(0.25 / short, 0.5), 1.2) - 1) * 2 end as managed, short / nullif(stddev_samp(ret) over ({_P} 60 preceding and 1 preceding) * sqrt(242), 0) as q,
        case when i >= 60 and worst < -0.03 then greatest(0.5, 1 - 0.3 * abs(worst + 0.03) / 0.03) else 1 end as tail from c),
    s as (select *, {_smoothed('0.25')} as cvar_scale, {_smoothed('vol_target')} as vol_scale,
        case when i < 60 then 1 else 1 + (case when q > 1.5 then 0.55 when q > 1.3 then 0.7 when q > 1.15 then 0.85 when q > 1 then 0.95 when q < 0.7 then 1.1 when q < 0.85 then 1.05 else 1 end - 1) * 2 end as ladder,
        case when i < 1 then 1 when step < 1 then greatest(0.15, step) when i >= 20 and depth > 0.02 and sum20 <= 0 then greatest(0.7, 1 - 2 * depth) else 1 end as drawdown,
        greatest(0, 1 - coalesce(1 - last / peak, 0) / 0.1) as near from g)"""
ORACLE = {
    "risk_figures": f"with {SIGNALS} select strategy, date, round(vol, 6) as vol, round(cvar, 6) as cvar, round(v, 6) as var from s",
    "market_regimes": f"with {SIGNALS} select strategy, date, regime, round(cast(confidence as double), 6) as confidence from s",
    "exposure_signals": f"with {SIGNALS} select strategy, date, "
    + ", ".join(f"round(cast({c} as double), 6) as {c}" for c in ("vol_target", "cvar_scale", "trend", "drawdown", "managed", "ladder", "tail"))
    + " from s",
    "composite_exposure": f"""with {SIGNALS}, h as (select *, case when drawdown < 0.6 then drawdown else least(0.6 + case when i = 0 then 0 when i < 20 or sum20 > 0 then 0.01 + 0.04 * near else 0.005 + 0.015 * near end, drawdown) end as held_at from s)
        select strategy, date, regime, round(cast(least(greatest(vol_scale * greatest(0.7, trend * held_at) * least(greatest(managed * tail, 0.3), 1.3), 0.5), 1.5) as double), 6) as exposure from h""",
}
