"""Factor catalogue: one column expression each; `compute_factors` adds many in one pass over one window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.scalars import invert, log_pos, ratio
from quantloom.operators.windows import cum_sum, densify, diff, forward_sum, own_rows, pct_change, rolling

EPS = 1e-8
C = F.col


def _with_steps(panel: DataFrame) -> DataFrame:
    """ret, gain, loss, dvol, obv as columns, since window functions can't nest; a missing change is a gain and loss of 0."""
    d = diff(C("close"), 1)
    steps = panel.withColumn("ret", pct_change(C("close"), 1)).withColumn("dvol", pct_change(C("volume"), 1))
    steps = steps.withColumn("gain", F.when(d > 0, d).otherwise(0.0)).withColumn("loss", F.when(d < 0, -d).otherwise(0.0))
    return steps.withColumn("signed", C("volume") * F.signum(d)).withColumn("obv", cum_sum(C("signed")))


def _mean(x, n) -> Column:
    return rolling(F.avg, x if isinstance(x, Column) else C(x), n)


def _vol(n) -> Column:
    return rolling(F.stddev_samp, C("ret"), n)


def _bias(n) -> Column:
    return (C("close") - _mean("close", n)) / (_mean("close", n) + EPS)


def _rsi(n) -> Column:
    rs = _mean("gain", n) / (_mean("loss", n) + EPS)
    return 100 * rs / (1 + rs)


def _willr(n) -> Column:
    high, low = rolling(F.max, C("high"), n), rolling(F.min, C("low"), n)
    return -100 * (high - C("close")) / (high - low + EPS)


#: name: (function of the windows, default windows, direction, columns read)
PRICE = {
    **{f"mom_{m}m": (lambda n: pct_change(C("close"), n), (20 * k,), 1, ("close",)) for m, k in ((1, 1), (3, 3), (6, 6), (12, 12))},
    "mom_skip_1m": (lambda a, b: ratio(F.lag("close", a).over(own_rows()), F.lag("close", b).over(own_rows())) - 1, (20, 260), 1, ("close",)),
    **{f"rev_{d}d": (lambda n: pct_change(C("close"), n), (d,), -1, ("close",)) for d in (5, 10, 20)},
    "rsi_14": (_rsi, (14,), 1, ("close",)),
    "ma_5_20_cross": (lambda a, b: F.when(_mean("close", a) > _mean("close", b), 1.0).otherwise(0.0), (5, 20), 1, ("close",)),
    "bias_20": (_bias, (20,), -1, ("close",)),
    "willr_14": (_willr, (14,), 1, ("high", "low", "close")),
    **{f"vol_{n}d": (_vol, (n,), -1, ("close",)) for n in (20, 60, 120)},
    "amihud_illiq": (lambda n: _mean(F.abs("ret") / (C("money") + EPS), n), (20,), -1, ("close", "money")),
    "turnover_20d": (lambda n: _mean("volume", n), (20,), -1, ("volume",)),
    "volume_ratio": (lambda n: C("volume") / (_mean("volume", n) + EPS), (20,), 1, ("volume",)),
    "amount_20d": (lambda n: _mean("money", n), (20,), 1, ("money",)),
    "price_volume_corr": (lambda n: _mean(C("ret") * C("dvol"), n), (20,), 1, ("close", "volume")),
    "obv_slope": (lambda n: (C("obv") - F.lag("obv", n).over(own_rows())) / n, (20,), 1, ("close", "volume")),
    **{f"drv_MA{n}": (lambda n: _mean("close", n), (n,), 1, ("close",)) for n in (5, 10, 20, 60)},
    **{f"drv_BIAS{n}": (lambda n: ratio(C("close") - _mean("close", n), _mean("close", n)) * 100, (n,), 1, ("close",)) for n in (5, 10, 20, 60)},
    **{f"drv_MOM_{n}d": (lambda n: pct_change(C("close"), n), (n,), 1, ("close",)) for n in (1, 5, 10, 20, 60)},
    **{f"drv_VOL_{n}": (_vol, (n,), 1, ("close",)) for n in (5, 10, 20, 60)},
    **{f"drv_VR_{n}": (lambda n: ratio(C("volume"), _mean("volume", n)), (n,), 1, ("volume",)) for n in (5, 20)},
    **{f"drv_R{n}": (lambda n: -pct_change(C("close"), n), (n,), 1, ("close",)) for n in (5, 20)},
    "drv_VRatio_20_60": (lambda a, b: ratio(_vol(a), _vol(b)), (20, 60), 1, ("close",)),
}
VALUE = {
    "pe_ttm": (lambda: C("pe_ratio"), (), -1, ("pe_ratio",)),
    "pb_ratio": (lambda: C("pb_ratio"), (), -1, ("pb_ratio",)),
    "ps_ratio": (lambda: C("ps_ratio"), (), -1, ("ps_ratio",)),
    "market_cap": (lambda: log_pos(C("market_cap")), (), -1, ("market_cap",)),
    "ep_ratio": (lambda: invert(C("pe_ratio")), (), 1, ("pe_ratio",)),
    "bp_ratio": (lambda: invert(C("pb_ratio")), (), 1, ("pb_ratio",)),
    "sp_ratio": (lambda: invert(C("ps_ratio")), (), 1, ("ps_ratio",)),
    "turnover_ratio": (lambda: C("turnover_ratio"), (), -1, ("turnover_ratio",)),
    "dividend_yield": (lambda: C("dividend_ratio"), (), 1, ("dividend_ratio",)),
    "log_market_cap": (lambda: log_pos(C("market_cap")), (), -1, ("market_cap",)),
}
FLOW = {
    **{f"hk_hold_ratio_change_{n}d": (lambda n: diff(C("share_ratio"), n), (n,), 1, ("share_ratio",)) for n in (5, 20)},
    **{f"margin_fin_chg{n}d": (lambda n: pct_change(C("fin_value"), n), (n,), 1, ("fin_value",)) for n in (5, 20)},
    "margin_sec_chg5d": (lambda n: pct_change(C("sec_value"), n), (5,), 1, ("sec_value",)),
    **{f"mf_net_big_{n}d": (lambda n: _mean(C("big_in") - C("big_out"), n), (n,), 1, ("big_in", "big_out")) for n in (5, 20)},
    "mf_big_ratio_5d": (lambda n: _mean(F.when(C("flow") > 0, (C("big_in") - C("big_out")) / C("flow")).otherwise(0.0), n), (5,), 1, ("big_in", "big_out", "flow")),
}
CATALOGUE = PRICE | VALUE | FLOW


def compute_factors(panel: DataFrame, names: list[str] | None = None, params: dict | None = None, grid: str = "own", own: dict | None = None) -> DataFrame:
    """date, code and the named factors, all that the panel has the columns for by default.

    `params` gives other windows by factor; `grid` counts windows in a code's own rows or in days of the union calendar; `own` adds
    factors of the caller: a name and a function of no argument that returns a column, which may read factors named before it.
    """
    known = [n for n in (names or CATALOGUE) if n in CATALOGUE and set(CATALOGUE[n][3]) <= set(panel.columns)]
    rows = densify(panel) if grid == "calendar" else panel
    if {"close", "volume"} <= set(panel.columns):
        rows = _with_steps(rows)
    made = []
    for n in known:
        fn, windows, _, _ = CATALOGUE[n]
        windows = (params or {}).get(n, windows)
        made.append(fn(*(windows if isinstance(windows, tuple) else (windows,))).alias(n))
    if not own:
        return rows.select("date", "code", *made)
    out = rows.select("*", *made)
    for n, fn in own.items():
        out = out.withColumn(n, fn())
    return out.select("date", "code", *known, *own)


def merged_panel(sources: dict[str, DataFrame], base: str) -> DataFrame:
    """date, code and the factors of all sources, on the rows of the base source: one union and one grouping in place of a join per source.

    Sources are keyed by (date, code) and their factor names differ. Rows that other sources alone have are left out; what a source lacks is null.
    """
    rows = None
    for name, df in sources.items():
        part = df.withColumn("_base", F.lit(name == base))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    names = [c for c in rows.columns if c not in ("date", "code", "_base")]
    one = rows.groupBy("date", "code").agg(F.max("_base").alias("_base"), *[F.first(c, ignorenulls=True).alias(c) for c in names])
    return one.where("_base").drop("_base")


def all_panel_factors(prices: DataFrame, flows: DataFrame | None = None, valuation: DataFrame | None = None, params: dict | None = None, unlock: str = "rate1") -> DataFrame:
    """Every factor of the catalogue that the panels allow, and the unlock sums of the next 20 and 60 days of the flows' calendar, on the rows of the prices."""
    sources = {"prices": compute_factors(prices, list(PRICE), params)}
    if flows is not None:
        sources["flows"] = compute_factors(flows, list(FLOW), params)
        if unlock in flows.columns:
            sums = flows.select("date", "code", unlock)
            for n in (20, 60):
                sums = forward_sum(sums, unlock, n, f"unlock_rate_{n}d")
            sources["unlock"] = sums.drop(unlock)
    if valuation is not None:
        sources["valuation"] = compute_factors(valuation, list(VALUE), params)
    return merged_panel(sources, "prices")


def coverage(panel: DataFrame, least: float = 0.8) -> DataFrame:
    """factor, share of rows with a value, kept: all columns in one pass."""
    names = [c for c in panel.columns if c not in ("date", "code")]
    share = panel.agg(*[(F.count(c) / F.nullif(F.count("*"), F.lit(0))).alias(c) for c in names])
    return share.unpivot([], names, "factor", "share").withColumn("kept", F.coalesce(F.col("share") >= least, F.lit(False)))


def covered(panel: DataFrame, least: float = 0.8) -> DataFrame:
    """panel without the factors of less coverage; the choice is one row per factor."""
    kept = {r.factor for r in coverage(panel, least).where("kept").collect()}
    return panel.select("date", "code", *[c for c in panel.columns if c in kept])
