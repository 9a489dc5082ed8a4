"""Queries of sweeps, triggered dates, books at scale and tree experts, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.tables import cut
from quantloom.operators import evaluation, experts, portfolio, resample, sweep, training, trees
from quantloom.operators.windows import fwd_return, pct_change
from quantloom.queries_factors import bars_sql, rounded
from quantloom.queries_returns import BOOK, IND, RET
from quantloom.queries_rotation import INDEX, SCALE
from quantloom.sources import market

TREND = {"window": (5, 5, 4), "margin": [0.0, 0.01, 0.02]}
MOMENTUM = {"span": (1, 1, 40), "least": (-0.05, 0.005, 50)}


def _index(spark, sf_dir, unit):
    return market.bars(spark, sf_dir, unit).groupBy("date").agg((F.sum("money") / F.sum("volume")).alias("close"))


def _series(spark, sf_dir):
    return _index(spark, sf_dir, "week").withColumn("series", F.lit("index"))


def trend_sweep(spark, sf_dir):
    return rounded(sweep.best_points(resample.sweep(_series(spark, sf_dir), TREND, resample.trend), by="total_return"))


def momentum_sweep(spark, sf_dir):
    """2,000 points on the price of two halves of the codes."""
    b = market.bars(spark, sf_dir, "week").groupBy("date", (F.col("code").cast("int") % 2).alias("series")).agg((F.sum("money") / F.sum("volume")).alias("close"))
    return rounded(sweep.best_points(resample.sweep(b, MOMENTUM, resample.momentum), by="total_return", n=3))


def volatility_dates(spark, sf_dir):
    """The first day of each week, and days of an annual volatility over 0.1 in the ten days before, five days or more apart."""
    r = market.strategy_returns(spark, sf_dir)
    weeks = portfolio.rebalance_dates(r.select("date").distinct(), "week").select("date")
    return sweep.rebalance_or_triggered(r, weeks, 0.1, 10, 5)


def equal_weights(spark, sf_dir):
    names = market.bars(spark, sf_dir).join(market.industry(spark, sf_dir), "code").select("date", "industry", "code")
    return rounded(portfolio.equal_weight(names, ("date", "industry")))


def wednesdays(spark, sf_dir):
    return portfolio.weekday_dates(market.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")), 2)


def group_spread(spark, sf_dir):
    c = F.col("close")
    p = market.bars(spark, sf_dir).select("date", "code", pct_change(c, 3).alias("mom"), fwd_return(c, 1).alias("fwd"))
    return rounded(evaluation.long_short(evaluation.quantile_returns(p, "mom", "fwd")))


def yearly_ic(spark, sf_dir):
    c = F.col("close")
    p = market.bars(spark, sf_dir).select("date", "code", F.col("volume").alias("v"), fwd_return(c, 1).alias("fwd"))
    ic = evaluation.compute_ic(p, "v", "fwd", "pearson").select(F.lit("volume").alias("expert"), F.year("date").alias("year"), "ic")
    return rounded(experts.monthly_ic(ic, "year"))


FEATURES = ["mom_1", "mom_3", "mom_6", "vol", "price", "size"]
WINDOWS = [12, 24]
SETS = {"momentum": [0, 1, 2], "fundamental": [3, 4, 5]}
KINDS = {
    "forest": {"conservative": {"trees": 3, "depth": 2, "columns": 0.7}, "moderate": {"trees": 3, "depth": 3, "columns": 0.7}},
    "extra": {"conservative": {"trees": 3, "depth": 2}, "moderate": {"trees": 3, "depth": 3}},
    "boosted": {"conservative": {"trees": 2, "depth": 2, "rate": 0.1}, "moderate": {"trees": 2, "depth": 2, "rate": 0.3}},
    "boosted-sparse": {"conservative": {"trees": 2, "depth": 2, "rate": 0.1, "columns": 0.7}, "moderate": {"trees": 2, "depth": 2, "rate": 0.3, "columns": 0.7}},
}


def _training(spark, sf_dir):
    """A panel of six features and the next month's log return, its decisions, and the training sets of 12 and 24 months with a month of purge."""
    c = F.col("close")
    p = market.bars(spark, sf_dir).select(
        "date", "code", *[pct_change(c, n).alias(f"mom_{n}") for n in (1, 3, 6)], F.col("volume").alias("vol"), F.log("close").alias("price"), F.log("money").alias("size"), F.log(fwd_return(c, 1) + 1).alias("label")
    )
    days = p.where("month(date) = 1 and year(date) between 1997 and 1999").select("date").distinct()
    return p, days, training.training_sets(p, days, WINDOWS, 1, "label", 10, 100)


def training_stats(spark, sf_dir):
    return rounded(training.window_stats(_training(spark, sf_dir)[2], FEATURES, 0.02))


def scaled_rows(spark, sf_dir):
    """The prediction rows of each decision, scaled by each of its training sets."""
    p, days, sets = _training(spark, sf_dir)
    new = training.for_windows(training.prediction_rows(p, days), WINDOWS).drop("label")
    return rounded(training.scaled(new, training.window_stats(sets, FEATURES, 0.02), FEATURES))


def tree_experts(spark, sf_dir):
    """Predictions of 32 experts at each decision, fitted in one job: four kinds, two hyper sets, two feature sets, two windows."""
    p, days, sets = _training(spark, sf_dir)
    stats = cut(training.window_stats(sets, FEATURES, 0.02))
    rows = training.binned(sets.withColumnRenamed("label", "y"), stats, FEATURES)
    models = trees.fit(rows, trees.expert_grid(spark, SETS, WINDOWS, KINDS))
    new = training.for_windows(training.prediction_rows(p, days), WINDOWS)
    return rounded(trees.predict(models, training.binned(new, stats, FEATURES)))


QUERIES = {f.__name__: f for f in (trend_sweep, momentum_sweep, volatility_dates, equal_weights, wednesdays, group_spread, yearly_ic, training_stats, scaled_rows, tree_experts)}

B = bars_sql()
_SWEPT = """e as (select *, case when hold then ret else 0 end as x from r where ret is not null), v as (select *, product(1 + x) over w as nav from e window w as (partition by series, {k} order by date)),
        d as (select *, nav / max(nav) over (partition by series, {k} order by date) - 1 as dd from v), a as (select series, {k}, arg_max(nav, date) - 1 as total, count(*) as n, stddev_samp(x) * sqrt(242) as vol, min(dd) as mdd from d group by all),
        z as (select *, (pow(1 + total, 242.0 / n) - 1 - 0.02) / nullif(case when vol > 1e-10 then vol end, 0) as sharpe, cast(row_number() over (partition by series order by total desc, {k}) as integer) as rank from a)"""
_STATS = f"""{B}, f as (select date, code, close / lag(close) over w - 1 as mom_1, close / lag(close, 3) over w - 1 as mom_3, close / lag(close, 6) over w - 1 as mom_6, volume as vol, ln(close) as price, ln(money) as size, ln(lead(close) over w / close) as label
    from bars window w as (partition by code order by date)), dx as (select date, row_number() over (order by date) - 1 as idx from (select distinct date from f)),
    dec as (select date as decision, idx as t from dx where month(date) = 1 and year(date) between 1997 and 1999),
    tr as (select decision, "window", f.* from dec cross join (values (12), (24)) v("window") join dx on idx >= t - "window" and idx < t - 1 join f on f.date = dx.date where label is not null),
    lg as ({' union all '.join(f"select decision, \"window\", '{n}' as feature, cast({n} as double) as x from tr" for n in FEATURES)}),
    qt as (select decision, "window", feature, quantile_cont(x, 0.02) as lo, quantile_cont(x, 0.98) as hi from lg where x is not null group by 1, 2, 3),
    st as (select decision, "window", feature, any_value(lo) as lo, any_value(hi) as hi, avg(least(greatest(x, lo), hi)) as mean, case when stddev_samp(least(greatest(x, lo), hi)) < 1e-10 then 1 else stddev_samp(least(greatest(x, lo), hi)) end as std,
    count(*) as n from lg join qt using (decision, "window", feature) where x is not null group by 1, 2, 3)"""
ORACLE = {
    "trend_sweep": f"""with {bars_sql('week')}, {INDEX}, p as (select 'index' as series, date, c from idx), g as (select cast(5 + 5 * a as bigint) as "window", b as margin from range(4) x(a), (values (0.0::double), (0.01), (0.02)) y(b)),
        h as (select series, date, "window", margin, c, c / lag(c) over w - 1 as ret, list(c) over w as l from p, g window w as (partition by series, "window", margin order by date)),
        s as (select *, case when len(l) >= "window" then c > list_avg(l[len(l) - "window" + 1:len(l)]) * (1 + margin) end as held from h),
        r as (select series, date, "window", margin, ret, lag(held) over (partition by series, "window", margin order by date) as hold from s), {_SWEPT.format(k='"window", margin')}
        select series, "window", round(margin, 6) as margin, round(total, 6) as total_return, round(sharpe, 6) as sharpe, round(mdd, 6) as max_drawdown, n, rank from z where rank <= 5""",
    "momentum_sweep": f"""with {bars_sql('week')}, p as (select cast(code as integer) % 2 as series, date, sum(money) / sum(volume) as c from bars group by 1, 2), g as (select cast(1 + a as bigint) as span, -0.05 + b * 0.005::double as least from range(40) x(a), range(50) y(b)),
        h as (select series, date, c, c / lag(c) over w - 1 as ret, list(c) over w as l from p window w as (partition by series order by date)),
        s as (select series, date, ret, span, least, case when len(l) > span then c > l[len(l) - span] * (1 + least) end as held from h, g),
        r as (select series, date, span, least, ret, lag(held) over (partition by series, span, least order by date) as hold from s), {_SWEPT.format(k='span, least')}
        select series, span, round(least, 6) as least, round(total, 6) as total_return, round(sharpe, 6) as sharpe, round(mdd, 6) as max_drawdown, n, rank from z where rank <= 3""",
    "volatility_dates": f"""with recursive {RET}, i as (select strategy, date, row_number() over w - 1 as i, count(ret) over (w rows between 10 preceding and 1 preceding) as n, stddev_samp(ret) over (w rows between 10 preceding and 1 preceding) as s
        from ret window w as (partition by strategy order by date)), c as (select strategy, date, i from i where i >= 10 and n >= 10 and s * sqrt(242) > 0.1),
        t as (select strategy, min(i) as i from c group by 1 union all select t.strategy, (select min(c.i) from c where c.strategy = t.strategy and c.i >= t.i + 5) from t where t.i is not null),
        k as (select strategy, min(date) as date, true as scheduled from ret group by strategy, date_trunc('week', date) union all select strategy, date, false from t join c using (strategy, i))
        select strategy, date, bool_or(scheduled) as scheduled from k group by 1, 2""",
    "equal_weights": f"with {B}, {IND} select date, industry, code, round(1 / count(*) over (partition by date, industry), 6) as weight from bars join ind using (code)",
    "wednesdays": "select distinct cast(o_orderdate as date) as date from orders where isodow(o_orderdate) = 3",
    "group_spread": f"""with {B}, p as (select date, code, close / lag(close, 3) over w - 1 as mom, lead(close) over w / close - 1 as fwd from bars window w as (partition by code order by date)),
        r as (select *, count(*) over (partition by date) as n, row_number() over (partition by date order by mom desc, code) as place from p where mom is not null and fwd is not null),
        g as (select date, least((place - 1) // (n // 5), 4) + 1 as grp, avg(fwd) as m from r where n >= 25 group by 1, 2), a as (select grp, avg(m) as m from g group by 1)
        select round(max(m) filter (where grp = 1) - max(m) filter (where grp = 5), 6) as long_short from a""",
    "yearly_ic": f"""with {B}, p as (select date, volume, lead(close) over (partition by code order by date) / close - 1 as fwd from bars),
        c as (select date, corr(volume, fwd) as ic from p where fwd is not null group by 1 having count(*) >= 10)
        select 'volume' as expert, cast(year(date) as integer) as period, round(avg(ic), 6) as ic from c where ic <> 0 group by 2""",
    "training_stats": f"with {_STATS} select decision, \"window\", feature, round(lo, 6) as lo, round(hi, 6) as hi, round(mean, 6) as mean, round(std, 6) as std, n from st",
    "scaled_rows": f"""with {_STATS}, nw as (select decision, "window", date, code, {', '.join(FEATURES)} from dec join f on f.date = dec.decision, (values (12), (24)) v("window") where (select count(distinct code) from f g where g.date = dec.decision) >= 5)
        select nw.decision, nw."window", date, code, {', '.join(f"round(coalesce((case when {n} is not null then least(greatest({n}, s{i}.lo), s{i}.hi) end - s{i}.mean) / s{i}.std, 0), 6) as {n}" for i, n in enumerate(FEATURES))}
        from nw {' '.join(f'join st s{i} on s{i}.decision = nw.decision and s{i}."window" = nw."window" and s{i}.feature = {chr(39)}{n}{chr(39)}' for i, n in enumerate(FEATURES))}""",
}
