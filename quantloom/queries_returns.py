"""Queries of joins along time, returns and comparison, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions.scalars import ratio
from quantloom.operators import compare, joins, performance, portfolio, resample
from quantloom.operators.windows import fwd_return, pct_change
from quantloom.queries_factors import bars_sql, rounded
from quantloom.sources import market


def _returns(spark, sf_dir):
    return market.strategy_returns(spark, sf_dir)


def _book(spark, sf_dir):
    return portfolio.normalise(market.book(spark, sf_dir))


def latest_row(spark, sf_dir):
    """As-of cross-section on the last traded month of each quarter."""
    b = market.bars(spark, sf_dir).select("code", "date", "close")
    days = b.groupBy(F.date_trunc("quarter", "date")).agg(F.max("date").alias("date")).select("date")
    return rounded(joins.asof_cross_section(b, days))


def lookback_prices(spark, sf_dir):
    b = market.bars(spark, sf_dir, "week")
    wanted = joins.with_calendar(b.select("code"), b.select("date").distinct())
    return rounded(joins.lookback_price(wanted, b))


def common_days(spark, sf_dir):
    return rounded(joins.common_dates(_returns(spark, sf_dir), "strategy"))


def weight_changes(spark, sf_dir):
    w = _book(spark, sf_dir).withColumn("year", F.year("date")).groupBy("portfolio", "code", "year").agg(F.avg("weight").alias("weight"))
    return rounded(joins.weight_diff(w.where("year = 1994"), w.where("year = 1995")))


def training_windows(spark, sf_dir):
    b = market.bars(spark, sf_dir).select("date", "code", "close")
    days = b.where(F.month("date") == 1).select("date").distinct()
    rows = joins.training_rows(b, days, 12, 2)
    return rounded(rows.groupBy("decision").agg(F.count("*").alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.avg("close").alias("mean")))


def trade_days(spark, sf_dir):
    b = market.bars(spark, sf_dir)
    return joins.nth_trade_day(b, 3).withColumnRenamed("day", "third_after").join(joins.nth_trade_day(b, -2).withColumnRenamed("day", "second_before"), "date")


def _book_returns(spark, sf_dir, lag):
    c = F.col("close")
    r = market.bars(spark, sf_dir).select("date", "code", (pct_change(c, 1) / 100).alias("ret")).where("ret is not null")
    w = _book(spark, sf_dir).where(F.month("date") % 3 == 1)
    return compare.portfolio_returns(w, r, lag)


def book_returns(spark, sf_dir):
    return rounded(_book_returns(spark, sf_dir, 0))


def lagged_book_returns(spark, sf_dir):
    costs = portfolio.turnover(_book(spark, sf_dir).where(F.month("date") % 3 == 1)).select("portfolio", "date", (F.col("turnover") * 0.001).alias("cost"))
    return rounded(compare.net_returns(_book_returns(spark, sf_dir, 1), costs).select("portfolio", "date", "ret", "net", "nav"))


def sharpe_methods(spark, sf_dir):
    return rounded(compare.sharpe(_returns(spark, sf_dir)))


def benchmark_relative(spark, sf_dir):
    return rounded(compare.relative(_returns(spark, sf_dir), market.benchmark_returns(spark, sf_dir)))


def weekly_win_rate(spark, sf_dir):
    return rounded(compare.win_rate(_returns(spark, sf_dir), "week"))


def period_nav(spark, sf_dir):
    return rounded(compare.monthly_nav(_returns(spark, sf_dir)))


def return_histogram(spark, sf_dir):
    return compare.histogram(_returns(spark, sf_dir))


def drawdown_spans(spark, sf_dir):
    return rounded(compare.drawdown_duration(performance.nav(_returns(spark, sf_dir))))


def position_contribution(spark, sf_dir):
    r = market.bars(spark, sf_dir).select("date", "code", (fwd_return(F.col("close"), 1) / 100).alias("ret")).where("ret is not null")
    return rounded(compare.contribution(_book(spark, sf_dir), r))


def quarter_contribution(spark, sf_dir):
    r = market.bars(spark, sf_dir).select("date", "code", (fwd_return(F.col("close"), 1) / 100).alias("ret")).where("ret is not null")
    return rounded(compare.period_contribution(_book(spark, sf_dir), r))


def factor_contributions(spark, sf_dir):
    """Exposure: the mean of a column over a month's codes; return: the month's change of the other column, unknown in January."""
    w = Window.partitionBy("factor").orderBy("date")
    e = market.bars(spark, sf_dir).groupBy("date").agg((F.avg("close") / 1000).alias("price"), (F.avg("volume") / 100).alias("size")).unpivot(["date"], ["price", "size"], "factor", "exposure")
    r = e.select("date", "factor", (F.col("exposure") / F.lag("exposure").over(w) - 1).alias("ret")).where("ret is not null and month(date) > 1")
    return rounded(compare.factor_contribution(e, r))


def run_differences(spark, sf_dir):
    """The run with all days against one without the first five, and without a strategy."""
    r = _returns(spark, sf_dir)
    later = r.withColumn("_i", F.row_number().over(Window.partitionBy("strategy").orderBy("date"))).where("_i > 5 and strategy <> 'click'").drop("_i")
    return rounded(compare.run_diff(performance.metrics(r), performance.metrics(later)))


def rolling_correlations(spark, sf_dir):
    return rounded(compare.rolling_correlation(_returns(spark, sf_dir), market.benchmark_returns(spark, sf_dir), 10))


def least_correlated_pairs(spark, sf_dir):
    return rounded(compare.least_correlated(performance.correlations(_returns(spark, sf_dir)), 3))


def pair_allocations(spark, sf_dir):
    return rounded(compare.pair_allocation(_returns(spark, sf_dir), 0.1))


def t_statistics(spark, sf_dir):
    """Of the excess over the benchmark, and of the plain mean of each strategy's first 29 days and 12 days, so that odd and even degrees occur."""
    r = _returns(spark, sf_dir)
    at = F.row_number().over(Window.partitionBy("strategy").orderBy("date"))
    some = [resample.t_test(r.withColumn("_i", at).where(f"_i <= {n}").drop("_i")).withColumn("kind", F.lit(f"first {n}")) for n in (29, 12)]
    return rounded(resample.t_test(r, market.benchmark_returns(spark, sf_dir)).withColumn("kind", F.lit("excess")).unionByName(some[0]).unionByName(some[1]), 8)


def bootstrap_sharpe(spark, sf_dir):
    return rounded(resample.sharpe_interval(_returns(spark, sf_dir)))


def deflated_sharpes(spark, sf_dir):
    return rounded(resample.deflated_sharpe(_returns(spark, sf_dir)))


def walk_forward(spark, sf_dir):
    return rounded(compare.stability(compare.split_windows(_returns(spark, sf_dir), 10, 5, 6)))


def strategy_ensemble(spark, sf_dir):
    r = _returns(spark, sf_dir)
    w = compare.ensemble_weights(compare.sharpe(r), "arithmetic")
    return rounded(performance.nav(compare.weighted(joins.common_dates(r, "strategy"), w).withColumn("strategy", F.lit("ensemble"))))


def window_figures(spark, sf_dir):
    """All figures of every overlapping window of ten days, against the benchmark."""
    windows = compare.split_windows(_returns(spark, sf_dir), 10, 5, 6)
    return rounded(performance.full_metrics(windows, ("strategy", "window"), market.benchmark_returns(spark, sf_dir)), 5)


def window_reports(spark, sf_dir):
    return rounded(compare.window_report(performance.full_metrics(compare.split_windows(_returns(spark, sf_dir), 10, 5, 6), ("strategy", "window"))))


def ensemble_constituents(spark, sf_dir):
    """Each weighting's constituents."""
    r, b = _returns(spark, sf_dir), market.benchmark_returns(spark, sf_dir)
    kinds = [compare.ensemble_members(r, k, b).withColumn("weighting", F.lit(k)) for k in ("equal", "sharpe", "information_ratio")]
    return rounded(kinds[0].unionByName(kinds[1]).unionByName(kinds[2]))


def ensemble_figures(spark, sf_dir):
    """All figures of the ensemble weighted by information ratio."""
    r, b = _returns(spark, sf_dir), market.benchmark_returns(spark, sf_dir)
    e = compare.weighted(joins.common_dates(r, "strategy"), compare.ensemble_members(r, "information_ratio", b))
    return rounded(performance.full_metrics(e.withColumn("strategy", F.lit("ensemble")), benchmark=b), 5)


QUERIES = {
    f.__name__: f
    for f in (
        window_figures, window_reports, ensemble_constituents, ensemble_figures, latest_row, lookback_prices, common_days, weight_changes, training_windows, trade_days, book_returns, lagged_book_returns, sharpe_methods, benchmark_relative,
        weekly_win_rate, period_nav, return_histogram, drawdown_spans, position_contribution, quarter_contribution, factor_contributions, run_differences, rolling_correlations, least_correlated_pairs, pair_allocations, t_statistics,
        bootstrap_sharpe, deflated_sharpes, walk_forward, strategy_ensemble,
    )
}

BARS = bars_sql()


def _figures(rows: str, keys: str) -> str:
    """f: all figures of rows (keys, date, ret, bench)."""
    w = f"over (partition by {keys} order by date rows unbounded preceding)"
    return f"""f1 as (select *, ret - bench as e, row_number() over (partition by {keys} order by date) as i, product(1 + ret) {w} as nav, quantile_cont(ret, 0.05) over (partition by {keys}) as v, avg(ret) over (partition by {keys}) as mu from {rows}),
        f2 as (select *, max(nav) {w} as top, case when nav > coalesce(max(nav) over (partition by {keys} order by date rows between unbounded preceding and 1 preceding), -1) then i end as high from f1),
        f3 as (select *, nav / top - 1 as dd, max(high) {w} as peak from f2),
        f4 as (select {keys}, min(date) as first_day, max(date) as last_day, count(*) as n, product(1 + ret) as final_nav, stddev_samp(ret) * sqrt(242) as vol, stddev_samp(case when ret < 0 then ret end) * sqrt(242) as down,
        min(dd) as mdd, arg_min(i - peak, dd) as duration, min(v) as v, avg(case when ret <= v then ret end) as cv, avg(pow(ret - mu, 3)) / pow(avg(pow(ret - mu, 2)), 1.5) as sk, avg(pow(ret - mu, 4)) / pow(avg(pow(ret - mu, 2)), 2) - 3 as ku,
        avg(case when ret > 0 then 1.0 else 0.0 end) as wr, coalesce(avg(case when ret > 0 then ret end), 0) as aw, coalesce(avg(case when ret < 0 then ret end), 0) as al,
        sum(case when ret > 0 then ret else 0 end) as gain, -sum(case when ret < 0 then ret else 0 end) as loss, pow(product(1 + ret), 242.0 / count(*)) - 1 as ann,
        stddev_samp(e) * sqrt(242) as te, pow(product(1 + e), 242.0 / count(e)) - 1 as ea, avg(e) as em from f3 group by all),
        f as (select *, coalesce((ann - 0.02) / nullif(vol, 0), 0) as sharpe, coalesce(ea / nullif(te, 0), 0) as ir from f4)"""


def _all_figures(keys: str) -> str:
    return f"""select {keys}, first_day, last_day, n, round(final_nav, 5) as final_nav, round(vol, 5) as volatility, round(v, 5) as var_95, round(cv, 5) as cvar_95, round(sk, 5) as skewness, round(ku, 5) as kurtosis, round(wr, 5) as win_rate,
        round(aw, 5) as avg_win, round(al, 5) as avg_loss, round(case when loss > 0 then gain / loss when gain > 0 then 'inf'::double else 0 end, 5) as profit_factor, round(final_nav - 1, 5) as total_return, round(ann, 5) as annual_return,
        round(mdd, 5) as max_drawdown, cast(duration as integer) as duration, round(sharpe, 5) as sharpe, round(coalesce((ann - 0.02) / nullif(down, 0), 0), 5) as sortino, round(coalesce(ann / nullif(abs(mdd), 0), 0), 5) as calmar, round(te, 5) as tracking_error,
        round(ir, 5) as information_ratio, round(coalesce(em * 242 / nullif(te, 0), 0), 5) as daily_ratio from f"""


RET = "ret as (select event_type as strategy, cast(ts as date) as date, (avg(value) - 49.6) / 1000 as ret from events group by 1, 2)"
BENCH = "bench as (select cast(ts as date) as date, (avg(value) - 49.6) / 1000 as bench from events group by 1)"
_WINDOWS = f"""{RET}, {BENCH}, wi as (select *, row_number() over (partition by strategy order by date) - 1 as i0, count(*) over (partition by strategy) as n0 from ret), wg as (select range as "window" from range(0, 100)),
        wd as (select wi.strategy, "window", wi.date, ret, bench from wi join wg on i0 >= "window" * 5 and i0 < "window" * 5 + 10 left join bench on bench.date = wi.date where least(10, n0 - "window" * 5) >= 6)"""
BOTH = f"{RET}, {BENCH}, x as (select strategy, date, ret, bench, ret - bench as e from ret join bench using (date))"
IND = "ind as (select cast(s_suppkey as varchar) as code, n_name as industry, n_regionkey as portfolio from supplier join nation on s_nationkey = n_nationkey)"
BOOK = f"{BARS}, {IND}, w as (select portfolio, date, code, industry, money / sum(money) over (partition by portfolio, date) as weight from bars join ind using (code))"
NAV = "n as (select *, product(1 + ret) over (partition by strategy order by date rows unbounded preceding) as nav from {0}), dd as (select *, nav / max(nav) over (partition by strategy order by date rows unbounded preceding) - 1 as drawdown from n)"
_HELD = """q as (select * from w where month(date) % 3 = 1), r as (select date, code, (close / lag(close) over (partition by code order by date) - 1) / 100 as ret from bars),
    h as (select p.portfolio, d.date, max(q.date) as decision from (select distinct portfolio from q) p cross join (select distinct date from r where ret is not null) d
    join (select distinct portfolio, date from q) q on q.portfolio = p.portfolio and q.date {0} d.date group by 1, 2),
    b as (select h.portfolio, h.date, sum(q.weight * r.ret) as ret from h join q on q.portfolio = h.portfolio and q.date = h.decision join r on r.date = h.date and r.code = q.code where r.ret is not null group by 1, 2)"""
_SH = "avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(242)"
_P, _SQ = "2147483647", lambda x: f"(({x}) * ({x})) % 2147483647"
_DRAWN = f"""i as (select strategy, ret, row_number() over (partition by strategy order by date) - 1 as i, count(*) over (partition by strategy) as k from ret),
    h1 as (select strategy, k, i, range as sample, (range * 48271 + i * 16807 + 7) % {_P} as x from i, range({{n}})), h2 as (select strategy, k, i, sample, ({_SQ('x')} * 69621 + i + 7) % {_P} as x from h1),
    h3 as (select strategy, sample, {_SQ('x')} % k as place from h2), b as (select h3.strategy, sample, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(242) as s from h3 join i on i.strategy = h3.strategy and i.i = h3.place group by 1, 2)"""
ORACLE = {
    "latest_row": f"""with {BARS}, d as (select max(date) as d from bars group by date_trunc('quarter', date))
        select d as decision, code, max(date) as last_date, round(arg_max(close, date), 6) as close from bars join d on date <= d group by 1, 2""",
    "lookback_prices": f"""with {bars_sql('week')}, g as (select d.date, c.code from (select distinct date from bars) d cross join (select distinct code from bars) c)
        select g.code, g.date, round(coalesce(any_value(b.open) filter (where b.date = g.date), arg_max(b.close, b.date) filter (where b.date < g.date)), 6) as price
        from g left join bars b on b.code = g.code and b.date between g.date - 10 and g.date group by 1, 2""",
    "common_days": f"with {RET}, k as (select date from ret group by date having count(distinct strategy) = (select count(distinct strategy) from ret)) select strategy, date, round(ret, 6) as ret from ret where date in (select date from k)",
    "weight_changes": f"""with {BOOK}, y as (select portfolio, code, year(date) as y, avg(weight) as weight from w group by 1, 2, 3), a as (select * from y where y = 1994), b as (select * from y where y = 1995)
        select coalesce(a.portfolio, b.portfolio) as portfolio, coalesce(a.code, b.code) as code, round(coalesce(a.weight, 0), 6) as w_old, round(coalesce(b.weight, 0), 6) as w_new,
        round(coalesce(b.weight, 0) - coalesce(a.weight, 0), 6) as delta from a full join b on a.portfolio = b.portfolio and a.code = b.code""",
    "training_windows": f"""with {BARS}, d as (select date, row_number() over (order by date) - 1 as idx from (select distinct date from bars)), t as (select * from d where month(date) = 1)
        select t.date as decision, count(*) as n, min(b.date) as first_day, max(b.date) as last_day, round(avg(close), 6) as mean from t join d on d.idx >= t.idx - 12 and d.idx < t.idx - 2 join bars b on b.date = d.date group by 1""",
    "trade_days": f"with {BARS}, d as (select distinct date from bars) select date, lead(date, 3) over (order by date) as third_after, lag(date, 2) over (order by date) as second_before from d",
    "book_returns": f"with {BOOK}, {_HELD.format('<=')} select portfolio, date, round(ret, 6) as ret from b",
    "lagged_book_returns": f"""with {BOOK}, {_HELD.format('<')}, p as (select portfolio, date, lag(date) over (partition by portfolio order by date) as prev from (select distinct portfolio, date from q)),
        t as (select p.portfolio, p.date, code, weight as x from p join q using (portfolio, date) where prev is not null union all select p.portfolio, p.date, code, -weight from p join q on q.portfolio = p.portfolio and q.date = p.prev),
        c as (select portfolio, date, sum(abs(x)) / 2 * 0.001 as cost from (select portfolio, date, code, sum(x) as x from t group by 1, 2, 3) group by 1, 2),
        m as (select b.portfolio, b.date, ret, ret - coalesce(cost, 0) as net from b left join c using (portfolio, date)), v as (select *, product(1 + net) over (partition by portfolio order by date rows unbounded preceding) as nav from m)
        select portfolio, date, round(ret, 6) as ret, round(net, 6) as net, round(nav / first(nav) over (partition by portfolio order by date), 6) as nav from v""",
    "sharpe_methods": f"""with {RET} select strategy, round((pow(product(1 + ret), 242.0 / count(*)) - 1 - 0.02) / nullif(stddev_samp(ret) * sqrt(242), 0), 6) as geometric, round({_SH}, 6) as arithmetic,
        round((avg(ret) - 0.02 / 242) / nullif(stddev_samp(ret), 0) * sqrt(242), 6) as excess from ret group by 1""",
    "benchmark_relative": f"""with {BOTH} select strategy, round(avg(e) * 242, 6) as excess, round(covar_pop(ret, bench) / nullif(var_pop(bench), 0), 6) as beta, round(corr(ret, bench), 6) as corr,
        round(stddev_samp(e) * sqrt(242), 6) as tracking_error, round(avg(e) / nullif(stddev_samp(e), 0) * sqrt(242), 6) as information_ratio from x group by 1""",
    "weekly_win_rate": f"with {RET}, p as (select strategy, date_trunc('week', date) as w, product(1 + ret) - 1 as r from ret group by 1, 2) select strategy, round(avg(case when r > 0 then 1.0 else 0.0 end), 6) as win_rate, count(*) as n from p group by 1",
    "period_nav": f"with {RET} select strategy, cast(date_trunc('month', date) as date) as period, round(product(1 + ret) - 1, 6) as ret, min(date) as first_day, max(date) as last_day from ret group by 1, 2",
    "return_histogram": f"""with {RET}, r as (select *, min(ret) over (partition by strategy) as lo, max(ret) over (partition by strategy) as hi from ret)
        select strategy, cast(least(coalesce(floor((ret - lo) / nullif((hi - lo) / 50, 0)), 0), 49) as integer) as bin, count(*) as n from r group by 1, 2""",
    "drawdown_spans": f"""with {RET}, {NAV.format('ret')}, i as (select *, row_number() over (partition by strategy order by date) as i from dd), p as (select *, max(case when drawdown = 0 then i end) over (partition by strategy order by date rows unbounded preceding) as peak from i),
        f as (select *, row_number() over (partition by strategy order by drawdown, i) as k from p) select strategy, round(drawdown, 6) as max_drawdown, cast(i - peak as integer) as duration from f where k = 1""",
    "position_contribution": f"""with {BOOK}, r as (select date, code, (lead(close) over (partition by code order by date) / close - 1) / 100 as ret from bars), c as (select portfolio, w.date, w.code, weight * ret as c from w join r on r.date = w.date and r.code = w.code where ret is not null),
        u as (select portfolio, date, code, c from c union all select portfolio, date, 'TOTAL', sum(c) from c group by 1, 2)
        select portfolio, code, round(sum(c), 6) as total, round(avg(c), 6) as mean, round(max(c), 6) as best, round(min(c), 6) as worst, round(stddev_pop(c), 6) as std from u group by 1, 2""",
    "quarter_contribution": f"""with {BOOK}, r as (select date, code, (lead(close) over (partition by code order by date) / close - 1) / 100 as ret from bars), c as (select portfolio, w.date, w.code, weight * ret as c from w join r on r.date = w.date and r.code = w.code where ret is not null),
        u as (select portfolio, date, code, c from c union all select portfolio, date, 'TOTAL', sum(c) from c group by 1, 2)
        select portfolio, cast(date_trunc('quarter', date) as date) as period, code, round(sum(c), 6) as total, round(avg(c), 6) as mean, count(*) as n from u group by 1, 2, 3""",
    "factor_contributions": f"""with {BARS}, e as (select date, 'price' as factor, avg(close) / 1000 as x from bars group by 1 union all select date, 'size', avg(volume) / 100 from bars group by 1),
        r as (select date, factor, x, x / lag(x) over (partition by factor order by date) - 1 as ret from e), c as (select date, factor, x, x * case when month(date) > 1 then coalesce(ret, 0) else 0 end as c from r),
        u as (select * from c union all select date, 'TOTAL', null, sum(c) from c group by 1)
        select factor, round(sum(c), 6) as total, round(avg(c), 6) as mean, round(max(c), 6) as best, round(min(c), 6) as worst, round(stddev_pop(c), 6) as std, round(avg(x), 6) as exposure from u group by 1""",
    "run_differences": f"""with {RET}, i as (select *, row_number() over (partition by strategy order by date) as i from ret), s as (select 'a' as run, strategy, date, ret from ret union all select 'b', strategy, date, ret from i where i > 5 and strategy <> 'click'),
        n as (select *, product(1 + ret) over (partition by run, strategy order by date rows unbounded preceding) as nav from s), d as (select *, nav / max(nav) over (partition by run, strategy order by date rows unbounded preceding) - 1 as dd from n),
        m as (select run, strategy, product(1 + ret) - 1 as total_return, pow(product(1 + ret), 242.0 / count(*)) - 1 as annual_return, (pow(product(1 + ret), 242.0 / count(*)) - 1 - 0.02) / nullif(stddev_samp(ret) * sqrt(242), 0) as sharpe, min(dd) as max_drawdown from d group by 1, 2),
        l as (unpivot m on total_return, annual_return, sharpe, max_drawdown into name metric value v), p as (select strategy, metric, coalesce(max(v) filter (where run = 'a'), 0) as a, coalesce(max(v) filter (where run = 'b'), 0) as b from l group by 1, 2)
        select strategy, metric, round(a, 6) as a, round(b, 6) as b, round(a - b, 6) as delta from p""",
    "rolling_correlations": f"with {BOTH} select strategy, date, round(case when count(ret) over w = 10 then corr(ret, bench) over w end, 6) as corr from x window w as (partition by strategy order by date rows between 10 preceding and 1 preceding)",
    "least_correlated_pairs": f"""with {RET}, p as (select a.strategy as a, b.strategy as b, corr(a.ret, b.ret) as c, count(*) as n from ret a join ret b on a.date = b.date and a.strategy < b.strategy group by 1, 2)
        select a, b, round(c, 6) as corr, n from p order by abs(c), a, b limit 3""",
    "pair_allocations": f"""with {RET}, p as (select a.strategy as a, b.strategy as b, stddev_samp(a.ret) as sx, stddev_samp(b.ret) as sy, covar_samp(a.ret, b.ret) as c from ret a join ret b on a.date = b.date and a.strategy < b.strategy group by 1, 2),
        w as (select *, sy / (sx + sy) as wa from p) select a, b, round(wa, 6) as w_a, round(1 - wa, 6) as w_b, round(0.1 / (sqrt(pow(wa * sx, 2) + pow((1 - wa) * sy, 2) + 2 * wa * (1 - wa) * c) * sqrt(242)), 6) as scale from w""",
    "t_statistics": f"""with {BOTH}, i as (select strategy, ret, row_number() over (partition by strategy order by date) as i from ret), e as (select 'excess' as kind, strategy, e from x union all select 'first 29', strategy, ret from i where i <= 29
        union all select 'first 12', strategy, ret from i where i <= 12), a as (select kind, strategy, avg(e) as m, stddev_samp(e) as s, count(*) as n from e group by 1, 2),
        t as (select *, m / (s / sqrt(n)) as t, n - 1 as df, atan(abs(m / (s / sqrt(n))) / sqrt(n - 1)) as th from a),
        j as (select kind, strategy, th, df, unnest(range(0, case when df % 2 = 0 then df // 2 else (df - 1) // 2 end)) as j from t),
        k as (select kind, strategy, sum(pow(cos(th), 2 * j) * coalesce(list_product(list_transform(range(1, j + 1), lambda q: case when df % 2 = 0 then (2 * q - 1) / (2.0 * q) else 2.0 * q / (2 * q + 1) end)), 1)) as z from j group by 1, 2)
        select kind, strategy, round(t, 8) as t, round(1 - case when df % 2 = 0 then sin(th) * z else 2 / pi() * (th + sin(th) * cos(th) * z) end, 8) as p, round(m / s * sqrt(242), 8) as sharpe, n from t join k using (kind, strategy)""",
    "bootstrap_sharpe": f"""with {RET}, {_DRAWN.format(n=1000)} select strategy, round(quantile_cont(s, 0.025), 6) as low, round(quantile_cont(s, 0.975), 6) as high from b group by 1""",
    "deflated_sharpes": f"""with {RET}, {_DRAWN.format(n=100000)}, g as (select strategy, sample // 100 as g, max(s) as best from b group by 1, 2), o as (select strategy, avg(ret) / stddev_samp(ret) * sqrt(242) as sharpe from ret group by 1)
        select strategy, round(sharpe, 6) as sharpe, round(avg(case when best >= sharpe then 1.0 else 0.0 end), 6) as dsr from g join o using (strategy) group by 1, sharpe""",
    "window_figures": f"""with {_WINDOWS}, {_figures('wd', 'strategy, "window"')} {_all_figures('strategy, "window"')}""",
    "window_reports": f"""with {_WINDOWS}, {_figures('wd', 'strategy, "window"')} select strategy, count(*) as windows, round(avg(sharpe), 6) as mean_sharpe, round(coalesce(stddev_samp(sharpe), 0), 6) as std_sharpe, round(avg(ann), 6) as mean_annual,
        round(coalesce(stddev_samp(ann), 0), 6) as std_annual, count(*) filter (where sharpe > 0) as positive, round(count(*) filter (where sharpe > 0) / count(*), 6) as consistency from f group by 1""",
    "ensemble_constituents": f"""with {BOTH}, {_figures('x', 'strategy')}, u as (select 'equal' as weighting, strategy, 1.0 as u, sharpe, n from f union all select 'sharpe', strategy, greatest(sharpe, 0), sharpe, n from f
        union all select 'information_ratio', strategy, greatest(ir, 0), sharpe, n from f)
        select weighting, strategy, round(coalesce(u / nullif(sum(u) over (partition by weighting), 0), 1.0 / count(*) over (partition by weighting)), 6) as w, round(sharpe, 6) as sharpe, n from u""",
    "ensemble_figures": f"""with {BOTH}, {_figures('x', 'strategy')}, g as (select strategy, coalesce(greatest(ir, 0) / nullif(sum(greatest(ir, 0)) over (), 0), 1.0 / count(*) over ()) as w from f),
        k as (select date from ret group by date having count(distinct strategy) = (select count(distinct strategy) from ret)),
        e0 as (select 'ensemble' as strategy, date, sum(w * ret) / nullif(sum(w), 0) as ret from ret join g using (strategy) where date in (select date from k) group by date), e1 as (select strategy, date, ret, bench from e0 join bench using (date)),
        {_figures('e1', 'strategy').replace('f1', 'h1').replace('f2', 'h2').replace('f3', 'h3').replace('f4', 'h4').replace('f as (', 'h as (')} {_all_figures('strategy').replace('from f', 'from h')}""",
    "walk_forward": f"""with {RET}, i as (select *, row_number() over (partition by strategy order by date) - 1 as i, count(*) over (partition by strategy) as n from ret), g as (select range as k from range(0, 100)),
        a as (select strategy, k, product(1 + ret) - 1 as total, {_SH} as s from i join g on i >= k * 5 and i < k * 5 + 10 where least(10, n - k * 5) >= 6 group by 1, 2)
        select strategy, count(*) as n, round(avg(s), 6) as mean_sharpe, round(stddev_samp(s), 6) as std_sharpe, round(avg(case when total > 0 then 1.0 else 0.0 end), 6) as positive from a group by 1""",
    "strategy_ensemble": f"""with {RET}, s as (select strategy, greatest({_SH}, 0) as u from ret group by 1), g as (select strategy, coalesce(u / nullif(sum(u) over (), 0), 1.0 / count(*) over ()) as w from s),
        k as (select date from ret group by date having count(distinct strategy) = (select count(distinct strategy) from ret)),
        e as (select 'ensemble' as strategy, date, sum(w * ret) / nullif(sum(w), 0) as ret from ret join g using (strategy) where date in (select date from k) group by date), {NAV.format('e')}
        select strategy, date, round(ret, 6) as ret, round(nav, 6) as nav, round(drawdown, 6) as drawdown from dd""",
}
