"""Queries of factor choice: rolling ICs, strong factors, weights and test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import evaluation, factors
from quantloom.operators.windows import fwd_return
from quantloom.queries_factors import SQL, W, bars_sql, rounded, steps
from quantloom.sources import market

NAMES = ["mom_1m", "rev_5d", "rev_10d", "bias_20", "volume_ratio", "vol_20d", "drv_R5", "drv_BIAS10"]
DECISIONS = ("1995-02-06", "1996-06-30", "1998-01-05", "2000-01-03")
HORIZONS = (1, 2, 4)


def _panel(spark, sf_dir):
    b = market.bars(spark, sf_dir, "week", "brand")
    return factors.compute_factors(b, NAMES, own={"close": lambda: F.col("close")})


def _table(spark, sf_dir):
    p = _panel(spark, sf_dir)
    return evaluation.ic_table(p.withColumn("fwd", fwd_return(F.col("close"), 1)), NAMES, "fwd")


def _decisions(spark):
    return spark.createDataFrame([(d,) for d in DECISIONS], "date string").select(F.to_date("date").alias("date"))


def rolling_ic(spark, sf_dir):
    """Known at the first day of each quarter: 365 calendar days back, four rows ahead, 28 days of embargo."""
    p = _panel(spark, sf_dir)
    days = p.groupBy(F.date_trunc("quarter", "date").cast("date").alias("q")).agg(F.min("date").alias("date")).select("date")
    return rounded(evaluation.rolling_factor_ic(p.unpivot(["date", "code"], NAMES, "factor", "score"), p, days, 365, 4, 28))


def strong_factors(spark, sf_dir):
    return rounded(evaluation.strong_factors(_table(spark, sf_dir), _decisions(spark), 0.004, 0.02, 0.6, 3))


def icir_weights(spark, sf_dir):
    return rounded(evaluation.icir_weights(_table(spark, sf_dir)))


def top_factors(spark, sf_dir):
    return rounded(evaluation.top_factors(_table(spark, sf_dir), "1998-06-30", 4))


def factor_tests(spark, sf_dir):
    return rounded(evaluation.factor_tests(_panel(spark, sf_dir), NAMES, 2, 5, HORIZONS))


def factor_report(spark, sf_dir):
    return rounded(evaluation.factor_report(evaluation.factor_tests(_panel(spark, sf_dir), NAMES, 2, 5, HORIZONS)))


QUERIES = {f.__name__: f for f in (rolling_ic, strong_factors, icir_weights, top_factors, factor_tests, factor_report)}

_LEADS = ", ".join(f"lead(close, {h}) over {W} / close - 1 as f{h}" for h in sorted({1, 2, 4}))
_LONG = " union all ".join(f"select '{n}' as factor, date, code, f1, f2, f4, {n} as x from p" for n in NAMES)
_PANEL = f"{bars_sql('week', 'brand')}, {steps()}, p as (select date, code, {_LEADS}, {', '.join(f'{SQL[n]} as {n}' for n in NAMES)} from e), l as ({_LONG})"
_rank = lambda x: f"rank() over (partition by factor, date order by {x}) + (count(*) over (partition by factor, date, {x}) - 1) / 2.0"


def _ic(h: int, least: int = 10) -> str:
    """k<h>, c<h>: daily rank ICs of the h-row return."""
    return f"""k{h} as (select factor, date, {_rank('x')} as a, {_rank(f'f{h}')} as b from l where x is not null and f{h} is not null),
        c{h} as (select factor, date, case when count(*) >= {least} then nullif(round(corr(a, b), 12), 0) end as ic, count(*) as n from k{h} group by 1, 2),
        t{h} as (select d.factor, d.date, ic, coalesce(n, 0) as n from (select distinct factor, date from l) d left join c{h} c on c.factor = d.factor and c.date = d.date)"""


_TEST = f"""{_PANEL}, {_ic(1)}, {_ic(2)}, {_ic(4)}, s as (select factor, avg(ic) as m, stddev_pop(ic) as sd, avg(case when ic > 0 then 1.0 else 0.0 end) as pos, avg(abs(ic)) as am, count(*) as n from t2 where ic is not null group by 1),
    g as (select factor, date, f2, row_number() over (partition by factor, date order by x desc, code) as pl, count(*) over (partition by factor, date) as n from l where x is not null and f2 is not null),
    gg as (select factor, date, least((pl - 1) // (n // 5), 4) + 1 as grp, avg(f2) as r from g where n >= 25 group by 1, 2, 3), gm as (select factor, grp, avg(r) as r from gg group by 1, 2),
    q as (select factor, {', '.join(f'max(r) filter (where grp = {i}) as q{i}' for i in range(1, 6))} from gm group by 1),
    h as (select factor, {', '.join(f'(select case when count(ic) >= 10 then avg(ic) else 0 end from t{i} where t{i}.factor = s.factor and ic is not null) as ic_{i}' for i in HORIZONS)} from s)"""
_ROW = f"""select s.factor, round(m, 6) as mean_ic, round(sd, 6) as std_ic, round(m / nullif(sd, 0), 6) as icir, round(pos, 6) as positive_share, round(am, 6) as mean_abs_ic, n,
    {', '.join(f'round(q{i}, 6) as q{i}' for i in range(1, 6))}, {', '.join(f'round(ic_{i}, 6) as ic_{i}' for i in HORIZONS)}, round(q1 - q5, 6) as long_short,
    cast(row_number() over (order by m / nullif(sd, 0) desc nulls last, s.factor) as integer) as rank from s left join q on q.factor = s.factor left join h on h.factor = s.factor"""
_ITEMS = ["mean_ic", "std_ic", "icir", "positive_share", "mean_abs_ic", "n", *[f"q{i}" for i in range(1, 6)], *[f"ic_{i}" for i in HORIZONS], "long_short"]
_FADE = lambda x: f"list_sum(list_transform(h, lambda v, i: {x} * pow(0.65, len(h) - i))) / list_sum(list_transform(h, lambda v, i: pow(0.65, len(h) - i)))"
_DAYS = " union all ".join(f"select date '{d}' as date" for d in DECISIONS)
ORACLE = {
    "rolling_ic": f"""with {_PANEL}, {_ic(4, 2)}, q as (select min(date) as date from p group by date_trunc('quarter', date)), f as (select distinct factor from l where x is not null and f4 is not null)
        select q.date, f.factor, round((select case when sum(n) >= 20 and count(ic) >= 5 then avg(ic) end from c4 where c4.factor = f.factor and c4.date between q.date - 365 and q.date - 28), 6) as ic from q cross join f""",
    "strong_factors": f"""with recursive {_PANEL}, {_ic(1)}, dec as ({_DAYS}), i as (select factor, date, ic from t1 where ic is not null),
        s as (select dec.date, factor, avg(ic) as m, case when stddev_pop(ic) > 1e-8 then avg(ic) / stddev_pop(ic) else 0 end as r, count(*) as n from dec join i on i.date <= dec.date group by 1, 2),
        o as (select *, row_number() over (partition by date order by m desc, factor) as pl from s where n >= 10 and abs(m) >= 0.004 and abs(r) >= 0.02),
        c as (select dec.date, a.factor as a, b.factor as b from dec join i a on a.date <= dec.date join i b on b.date = a.date and a.factor <> b.factor group by 1, 2, 3 having abs(corr(a.ic, b.ic)) > 0.6),
        w as (select date, 0::bigint as pl, []::varchar[] as held from dec union all
              select w.date, o.pl, case when len(held) < 3 and not exists (select 1 from c where c.date = w.date and c.a = o.factor and list_contains(w.held, c.b)) then list_append(held, o.factor) else held end
              from w join o on o.date = w.date and o.pl = w.pl + 1),
        z as (select date, arg_max(held, pl) as held from w group by 1), u as (select date, unnest(held) as factor, generate_subscripts(held, 1) as rank from z)
        select u.date, cast(rank as integer) as rank, u.factor, round(m, 6) as mean_ic, round(r, 6) as icir from u join o on o.date = u.date and o.factor = u.factor""",
    "icir_weights": f"""with {_PANEL}, {_ic(1)}, h as (select date, factor, coalesce(list(ic) filter (where ic is not null) over (partition by factor order by date rows between 60 preceding and 1 preceding), []) as h from t1),
        m as (select *, {_FADE('v')} as m from h), s as (select *, sqrt({_FADE('(v - m) * (v - m)')}) as sd from m), x as (select date, factor, case when len(h) >= 5 and sd > 1e-8 then greatest(m / sd, 0) else 0 end as x from s)
        select date, factor, round(coalesce(x / nullif(sum(x) over (partition by date), 0), 0), 6) as weight from x""",
    "top_factors": f"with {_PANEL}, {_ic(1)} select factor, round(coalesce(avg(ic) filter (where date <= date '1998-06-30'), 0), 6) as mean_ic from t1 group by 1 order by round(abs(coalesce(avg(ic) filter (where date <= date '1998-06-30'), 0)), 12) desc, factor limit 4",
    "factor_tests": f"with {_TEST} {_ROW}",
    "factor_report": f"""with {_TEST}, r as ({_ROW}), v as ({' union all '.join(f"select factor, '{c}' as item, cast({c} as double) as value from r" for c in _ITEMS)})
        select factor, case when item in ('q1', 'q2', 'q3', 'q4', 'q5', 'long_short') then 'quantiles' when item in ({', '.join(f"'ic_{i}'" for i in HORIZONS)}) then 'decay' else 'ic' end as section, item, value from v""",
}
