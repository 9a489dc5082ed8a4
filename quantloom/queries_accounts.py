"""Queries of accounts, constrained books and books at scale, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.operators import accounts, portfolio, rotation
from quantloom.queries_factors import bars_sql, rounded
from quantloom.queries_returns import BOOK, IND
from quantloom.queries_rotation import INDEX, SCALE
from quantloom.sources import market

CAPITAL = 2e7
CAP, INDUSTRY_CAP, LIMIT, LEAST, ROUNDS = 0.07, 0.15, 0.2, 14, 10


def _book(spark, sf_dir):
    return portfolio.normalise(market.book(spark, sf_dir))


def _trades(spark, sf_dir):
    """Weekly trades of 25 accounts in brands, all at the week's close."""
    line, part = market.table(spark, sf_dir, "lineitem"), market.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = line.join(part, line["l_partkey"] == part["p_partkey"])
    side = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") > 2), "sell").otherwise("buy")
    t = rows.groupBy((F.col("l_suppkey") % 25).alias("account"), F.col("p_brand").alias("code"), F.date_trunc("week", "l_shipdate").cast("date").alias("date"), side.alias("side")).agg(F.sum("l_quantity").alias("qty"))
    t = t.join(_prices(spark, sf_dir), ["code", "date"]).withColumn("amount", F.col("qty") * F.col("close"))
    return t.select("account", "date", "code", "side", "qty", F.col("close").alias("price"), "amount", (F.floor(F.col("amount") * 0.1) / 100).alias("fee"))


def _prices(spark, sf_dir):
    return market.bars(spark, sf_dir, "week", "brand").select("date", "code", (F.floor(F.col("close") * 100) / 100).alias("close"))


def _nav(spark, sf_dir):
    return accounts.account_nav(_trades(spark, sf_dir), _prices(spark, sf_dir), CAPITAL)


def account_navs(spark, sf_dir):
    return rounded(_nav(spark, sf_dir), 4)


def account_costs(spark, sf_dir):
    return rounded(accounts.cost_summary(_trades(spark, sf_dir), _nav(spark, sf_dir), CAPITAL), 4)


def account_checks(spark, sf_dir):
    """Cash below 0, and dates missing or extra against the first week of each month."""
    t = _trades(spark, sf_dir)
    weeks = portfolio.rebalance_dates(_prices(spark, sf_dir), "month").select("date")
    return rounded(accounts.cash_checks(_nav(spark, sf_dir)).join(accounts.date_checks(t, weeks), "account"), 4)


def account_rebalances(spark, sf_dir):
    return rounded(accounts.rebalance_summary(_trades(spark, sf_dir), _nav(spark, sf_dir)), 4)


def _target(spark, sf_dir):
    """A first book in odd months, a move from 300 shares of names of two digits in even ones; every tenth name has no price."""
    b = _book(spark, sf_dir).join(market.bars(spark, sf_dir).select("date", "code", F.col("close").alias("price")), ["date", "code"])
    account = F.concat_ws("/", F.col("portfolio").cast("string"), F.col("date").cast("string")).alias("account")
    prev = F.when((F.length("code") == 2) & (F.month("date") % 2 == 0), 300).alias("prev_shares")
    weight = F.when(F.col("code").cast("int") % 7 != 0, F.col("weight")).alias("weight")
    return b.select(account, "code", prev, weight, F.when(F.col("code").cast("int") % 10 != 3, F.floor(F.col("price") * 10000) / 10000).alias("price"), F.lit(1e6).alias("cash"), F.lit(5e6).alias("capital"))


def rebuilt_trades(spark, sf_dir):
    return rounded(accounts.rebuild(_target(spark, sf_dir))[0], 4)


def rebuilt_books(spark, sf_dir):
    """Shares after the trades, and the account's cash."""
    _, shares, cash = accounts.rebuild(_target(spark, sf_dir))
    return rounded(cash.join(shares, "account", "left"), 2)


def constrained_books(spark, sf_dir):
    w = _book(spark, sf_dir).join(market.industry(spark, sf_dir), "code")
    days = w.select("portfolio", "date").distinct().withColumn("next", F.lead("date").over(Window.partitionBy("portfolio").orderBy("date")))
    old = w.join(days, ["portfolio", "date"]).where("next is not null").select("portfolio", F.col("next").alias("date"), "code", "weight")
    return rounded(portfolio.constrain(w, old, CAP, INDUSTRY_CAP, LIMIT, LEAST))


def cap_modes(spark, sf_dir):
    """The three modes of the cap; a cap of 0.04 can't be met by 20 names or fewer."""
    rows = [portfolio.weight_cap(_book(spark, sf_dir), 0.04, ROUNDS, m).select(F.lit(m).alias("mode"), "portfolio", "date", "code", "weight") for m in ("selector", "optimizer", "engine")]
    return rounded(rows[0].unionByName(rows[1]).unionByName(rows[2]))


def scaled_books(spark, sf_dir):
    """Two pools of a region's names, by parity of the code, of which odd months have one; a cap that binds."""
    w = _book(spark, sf_dir).withColumn("pool", F.col("code").cast("int") % 2)
    pools = portfolio.pool_weights(w.where("pool = 0 or month(date) % 2 = 0"))
    index = market.bars(spark, sf_dir).groupBy("date").agg((F.sum("money") / F.sum("volume")).alias("close"))
    return rounded(portfolio.effective_weights(w, rotation.binary_scale(index, 12, 6, -0.01), 0.05, pools))


QUERIES = {f.__name__: f for f in (account_navs, account_costs, account_checks, account_rebalances, rebuilt_trades, rebuilt_books, constrained_books, cap_modes, scaled_books)}

_TRADES = f"""{bars_sql('week', 'brand').replace('bars as', 'b0 as')}, bars as (select date, code, floor(close * 100) / 100 as close from b0), q as (select l_suppkey % 25 as account, p_brand as code, cast(date_trunc('week', l_shipdate) as date) as date, case when l_returnflag = 'R' and l_linenumber > 2 then 'sell' else 'buy' end as side,
    sum(l_quantity) as qty from lineitem join part on l_partkey = p_partkey group by 1, 2, 3, 4), tr as (select q.*, close as price, qty * close as amount, floor(qty * close * 0.1) / 100 as fee from q join bars using (code, date))"""
_NAV = f"""{_TRADES}, cal as (select distinct date from bars), ac as (select account, min(date) as since from tr group by 1), g as (select account, date from ac join cal on date >= since),
    sh as (select account, code, date, sum(sum(case when side = 'sell' then -qty else qty end)) over (partition by account, code order by date) as shares from tr group by 1, 2, 3),
    st as (select g.account, g.date, c.code, (select arg_max(shares, s.date) from sh s where s.account = g.account and s.code = c.code and s.date <= g.date) as shares from g join (select distinct account, code from tr) c on c.account = g.account),
    mv as (select st.account, st.date, coalesce(sum(shares * close), 0) as mv, count(case when shares <> 0 then 1 end) as n from st left join bars b on b.date = st.date and b.code = st.code group by 1, 2),
    ca as (select account, date, sum(case when side = 'sell' then -amount else amount end + fee) as spent from tr group by 1, 2),
    cs as (select g.account, g.date, {CAPITAL} - sum(coalesce(spent, 0)) over (partition by g.account order by g.date) as cash from g left join ca on ca.account = g.account and ca.date = g.date),
    nav as (select mv.account, mv.date, (cash + mv) / {CAPITAL} as nav, cash, mv as market_value, n as n_holdings from mv join cs on cs.account = mv.account and cs.date = mv.date)"""
_TARGET = f"""{BOOK}, t as (select portfolio || '/' || cast(w.date as varchar) as account, w.code, case when length(w.code) = 2 and month(w.date) % 2 = 0 then 300 else 0 end as prev,
    case when cast(w.code as integer) % 7 <> 0 then weight else 0 end as weight, case when cast(w.code as integer) % 10 <> 3 then floor(b.close * 10000) / 10000 end as price from w join bars b on b.date = w.date and b.code = w.code),
    v as (select *, case when max(prev) over (partition by account) > 0 then 1e6 + sum(prev * coalesce(price, 0)) over (partition by account) else 5e6 end as value from t),
    s as (select *, case when price > 0 then cast(floor(value * weight / price / 100) * 100 as bigint) else prev end as shares from v),
    d as (select account, code, case when shares > prev then 'buy' else 'sell' end as side, abs(shares - prev) as qty, price, cast(round(cast(abs(shares - prev) * price as decimal(18, 6)), 2) as double) as amount,
    cast(round(cast(abs(shares - prev) * price * 0.001 as decimal(18, 6)), 2) as double) as fee from s where shares <> prev)"""
_ROUND = "case when weight >= {c} then {c} else weight + coalesce(weight * sum(greatest(weight - {c}, 0)) over b / nullif(sum(case when weight < {c} then weight else 0 end) over b, 0), 0) end as weight"


def _capped(source: str, c: float, name: str) -> str:
    """name0 to name<ROUNDS>, then the three modes."""
    rounds = [f"{name}0 as (select portfolio, date, code, weight from {source})"]
    rounds += [f"{name}{i + 1} as (select portfolio, date, code, {_ROUND.format(c=c)} from {name}{i} window b as (partition by portfolio, date))" for i in range(ROUNDS)]
    last = f"{name}{ROUNDS}"
    rounds += [f"{name}_selector as (select portfolio, date, code, weight / sum(weight) over (partition by portfolio, date) as weight from {last})"]
    rounds += [f"{name}_engine as (select portfolio, date, code, least(weight, {c}) as weight from {last})"]
    rounds += [f"{name}_optimizer as (select portfolio, date, code, weight / sum(weight) over (partition by portfolio, date) as weight from {name}_engine)"]
    return ", ".join(rounds)


ORACLE = {
    "account_navs": f"with {_NAV} select account, date, round(nav, 4) as nav, round(cash, 4) as cash, round(market_value, 4) as market_value, n_holdings from nav",
    "account_costs": f"""with {_NAV}, t as (select account, sum(amount) as traded, sum(fee) as cost, count(distinct date) as k from tr group by 1),
        n as (select account, avg(cash / nullif(cash + market_value, 0)) as share, avg(cash + market_value) as asset, count(*) as days from nav group by 1)
        select account, round(traded, 4) as traded, round(cost, 4) as cost, round(cost / {CAPITAL}, 4) as cost_of_capital, round(cost / traded, 4) as cost_of_traded, round(cost / k, 4) as cost_per_date, round(share, 4) as cash_share,
        round(traded / 2 / asset, 4) as one_way, round(traded / 2 / asset * 242 / days, 4) as annual_turnover from t join n using (account)""",
    "account_checks": f"""with {_NAV}, c as (select account, count(case when cash < -0.005 then 1 end) as overdrawn, min(cash) as lowest from nav group by 1), m as (select min(date) as date from cal group by date_trunc('month', date)),
        x as (select distinct account, date from tr), y as (select account, m.date from ac cross join m),
        z as (select coalesce(x.account, y.account) as account, x.date as done, y.date as due from x full join y on x.account = y.account and x.date = y.date)
        select account, overdrawn, round(lowest, 4) as lowest, missing, extra from c join (select account, count(case when done is null then 1 end) as missing, count(case when due is null then 1 end) as extra from z group by 1) using (account)""",
    "account_rebalances": f"""with {_NAV}, t as (select account, date, count(case when side = 'buy' then 1 end) as buys, count(case when side = 'sell' then 1 end) as sells, coalesce(sum(case when side = 'buy' then amount end), 0) as bought,
        coalesce(sum(case when side = 'sell' then amount end), 0) as sold, sum(fee) as fees from tr group by 1, 2)
        select t.account, t.date, buys, sells, round(bought, 4) as bought, round(sold, 4) as sold, round(fees, 4) as fees, n_holdings, round(market_value, 4) as market_value, round(cash, 4) as cash,
        round((bought + sold) / 2 / (market_value + cash), 4) as turnover from t join nav on nav.account = t.account and nav.date = t.date""",
    "rebuilt_trades": f"with {_TARGET} select * from d",
    "rebuilt_books": f"""with {_TARGET}, c as (select account, 1e6 - coalesce((select sum(case when side = 'sell' then -amount else amount end + fee) from d where d.account = a.account), 0) as cash from (select distinct account from t) a)
        select c.account, round(cash, 2) as cash, code, shares from c left join (select account, code, shares from s where shares > 0) using (account)""",
    "constrained_books": f"""with {BOOK}, {_capped('w', CAP, 'k')}, i as (select k.portfolio, k.date, k.code, k.weight, w.industry from k_optimizer k join w on w.portfolio = k.portfolio and w.date = k.date and w.code = k.code),
        j as (select portfolio, date, code, weight * least(1, {INDUSTRY_CAP} / nullif(sum(weight) over (partition by portfolio, date, industry), 0)) as n from i),
        p as (select portfolio, date, lead(date) over (partition by portfolio order by date) as next from (select distinct portfolio, date from w)), o as (select w.portfolio, next as date, code, weight as o from w join p on p.portfolio = w.portfolio and p.date = w.date where next is not null),
        u as (select coalesce(j.portfolio, o.portfolio) as portfolio, coalesce(j.date, o.date) as date, coalesce(j.code, o.code) as code, coalesce(n, 0) as n, coalesce(o, 0) as o, o is not null as had from j full join o on o.portfolio = j.portfolio and o.date = j.date and o.code = j.code),
        t as (select *, sum(abs(n - o)) over b / 2 as t, bool_or(had) over b as old from u window b as (partition by portfolio, date)),
        f as (select portfolio, date, code, case when old and t > {LIMIT} then o + (n - o) * {LIMIT} / t else n end as weight from t)
        select portfolio, date, code, round(weight, 6) as weight, cast(count(*) over (partition by portfolio, date) as integer) as n, count(*) over (partition by portfolio, date) >= {LEAST} as enough from f where weight > 1e-6""",
    "cap_modes": f"with {BOOK}, {_capped('w', 0.04, 'k')} " + " union all ".join(f"select '{m}' as mode, portfolio, date, code, round(weight, 6) as weight from k_{m}" for m in ("selector", "optimizer", "engine")),
    "scaled_books": f"""with {BOOK}, {INDEX}, {SCALE}, x as (select *, cast(code as integer) % 2 as pool from w), y as (select distinct date, pool from x where pool = 0 or month(date) % 2 = 0),
        z as (select *, 1.0 / count(*) over (partition by date) as share from y), e as (select portfolio, date, code, weight * share * scale as weight from x join z using (date, pool) join sc using (date)), {_capped('e', 0.05, 'k')}
        select portfolio, date, code, round(weight, 6) as weight from k_engine where weight > 1e-6""",
}
