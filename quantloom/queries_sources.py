"""Queries of sources and code functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions import codes
from quantloom.queries_factors import bars_sql, rounded
from quantloom.queries_returns import IND
from quantloom.sources import market, readers

AS_OF = "1995-06-20"


def _members(spark, sf_dir):
    """Suppliers with a line in the month, by region."""
    s, n, r = (market.table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    of = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return market.bars(spark, sf_dir).join(of.select(F.col("s_suppkey").cast("string").alias("code"), F.col("r_name").alias("index")), "code").select("date", "code", "index")


def code_forms(spark, sf_dir):
    k = F.col("s_suppkey")
    suffix = F.element_at(F.array(*map(F.lit, (".SH", ".sz", ".XSHE", ".xshg", "", ".HK"))), (k % 6 + 1).cast("int"))
    raw = market.table(spark, sf_dir, "supplier").select("s_suppkey", F.concat((k % 90 + 10).cast("string"), F.lpad(k.cast("string"), 4, "0"), suffix).alias("raw"))
    c = F.col("raw")
    return raw.select("s_suppkey", codes.normalize_code(c).alias("standard"), codes.denormalize_code(c).alias("short"), codes.asset_type(c).alias("asset"))


def expert_parts(spark, sf_dir):
    p = market.table(spark, sf_dir, "part")
    name = F.when(F.col("p_size") % 5 == 0, F.col("p_brand")).otherwise(F.concat_ws("_", F.lit("rf"), F.substring("p_brand", 1, 5), "p_brand", F.concat(F.lit("w"), F.col("p_size").cast("string"))))
    return p.select("p_partkey", *codes.expert_parts(name))


def price_range(spark, sf_dir):
    b = market.bars(spark, sf_dir).withColumn("postfq_close", F.col("close") * 2)
    of = market.industry(spark, sf_dir).where("code like '%1'")
    return rounded(readers.daily_price(b, of, "1994-02-01", "1996-03-01", "post"), 8)


def codes_at(spark, sf_dir):
    return readers.all_codes(market.bars(spark, sf_dir, "week"), AS_OF)


def tradable_codes(spark, sf_dir):
    v = F.col("volume")
    flags = market.bars(spark, sf_dir).select("date", "code", (v < 60).alias("paused"), F.when(v <= 400, v > 300).alias("is_st"))
    return readers.tradable(flags, AS_OF)


def industry_at(spark, sf_dir):
    line, part = market.table(spark, sf_dir, "lineitem"), market.table(spark, sf_dir, "part")
    rows = line.join(part, line["l_partkey"] == part["p_partkey"])
    return readers.industry_map(rows.select(F.col("l_shipdate").cast("date").alias("date"), F.col("l_suppkey").cast("string").alias("code"), F.col("p_brand").alias("industry")), AS_OF)


def pool_members(spark, sf_dir):
    pools = {"main": {"index": "ASIA+EUROPE"}, "few": ["1", "2"], "more": {"stocks": ["2", "3", "3"]}, "none": {}}
    return readers.resolve_pools(_members(spark, sf_dir), pools, AS_OF)


def weekdays(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return readers.weekday_calendar(market.table(spark, sf_dir, "orders").agg(F.min(d).alias("start"), F.max(d).alias("end")))


def wide_panel(spark, sf_dir):
    b = market.bars(spark, sf_dir).select("date", "code", "close", "money")
    v = market.valuation(spark, sf_dir).where("dividend_ratio > 0.05").select("date", "code", "pe_ratio", F.col("market_cap").alias("money"))
    return rounded(readers.wide_table(b, {"val": v}, market.industry(spark, sf_dir)), 8)


def factor_long(spark, sf_dir):
    return rounded(readers.factor_long(market.valuation(spark, sf_dir), ["pb_ratio", "turnover_ratio"], start="1996-01-01"))


QUERIES = {f.__name__: f for f in (code_forms, expert_parts, price_range, codes_at, tradable_codes, industry_at, pool_members, weekdays, wide_panel, factor_long)}

B = bars_sql()
V = """val as (select cast(date_trunc('month', l_shipdate) as date) as date, cast(l_suppkey as varchar) as code, sum(l_extendedprice) / nullif(sum(l_extendedprice * l_discount), 0) as pe_ratio,
    avg(l_extendedprice) / 1000 as pb_ratio, sum(l_extendedprice) as market_cap, avg(l_discount) as dividend_ratio, avg(l_tax) as turnover_ratio from lineitem group by 1, 2)"""
LAST = f"(select max(date) from {{0}} where date <= date '{AS_OF}')"
ORACLE = {
    "code_forms": """with r as (select s_suppkey, cast(s_suppkey % 90 + 10 as varchar) || lpad(cast(s_suppkey as varchar), 4, '0') as num, ['.SH', '.sz', '.XSHE', '.xshg', '', '.HK'][s_suppkey % 6 + 1] as suf from supplier)
        select s_suppkey, num || case upper(suf) when '.SH' then '.XSHG' when '.XSHG' then '.XSHG' when '.SZ' then '.XSHE' when '.XSHE' then '.XSHE' else suf end as standard,
        num || case upper(suf) when '.XSHG' then '.SH' when '.XSHE' then '.SZ' else suf end as short,
        case when suf <> '' and num[1:2] in ('15', '16', '51', '52', '56', '59') then 'etf' else 'stock' end as asset from r""",
    "expert_parts": """select p_partkey, case when p_size % 5 = 0 then '?' else 'rf' end as model_type, case when p_size % 5 = 0 then '?' else p_brand[1:5] end as hyper_set,
        case when p_size % 5 = 0 then '?' else p_brand end as feature_set, cast(case when p_size % 5 = 0 then 0 else p_size end as integer) as train_window from part""",
    "price_range": f"""with {B}, {IND} select date, code, round(open, 8) as open, round(high, 8) as high, round(low, 8) as low, round(close * 2, 8) as close, round(volume, 8) as volume, round(money, 8) as money
        from bars where code in (select code from ind where code like '%1') and date between date '1994-02-01' and date '1996-03-01'""",
    "codes_at": f"with {bars_sql('week')} select distinct code from bars where date = {LAST.format('bars')}",
    "tradable_codes": f"with {B} select distinct code from bars where date = {LAST.format('bars')} and volume >= 60 and volume <= 300",
    "industry_at": f"""select cast(l_suppkey as varchar) as code, arg_max(p_brand, (cast(l_shipdate as date), p_brand)) as industry from lineitem join part on l_partkey = p_partkey
        where cast(l_shipdate as date) <= date '{AS_OF}' group by 1""",
    "pool_members": f"""with {B}, m as (select date, code, r_name as i from bars join supplier on code = cast(s_suppkey as varchar) join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
        l as (select i, max(date) as date from m where date <= date '{AS_OF}' and i in ('ASIA', 'EUROPE') group by 1)
        select distinct 'main' as pool, code from m join l using (i, date) union all select * from (values ('few', '1'), ('few', '2'), ('more', '2'), ('more', '3')) v(pool, code)""",
    "weekdays": """select cast(d as date) as date from (select unnest(generate_series(min(cast(o_orderdate as date))::timestamp, max(cast(o_orderdate as date))::timestamp, interval 1 day)) as d from orders) where isodow(d) < 6""",
    "wide_panel": f"""with {B}, {IND}, {V} select b.date, b.code, round(close, 8) as close, round(money, 8) as money, round(pe_ratio, 8) as pe_ratio, round(market_cap, 8) as money_val, industry
        from bars b left join val v on v.date = b.date and v.code = b.code and dividend_ratio > 0.05 left join ind on ind.code = b.code""",
    "factor_long": f"""with {V} select date, code, 'pb_ratio' as factor, round(pb_ratio, 6) as value from val where date >= date '1996-01-01'
        union all select date, code, 'turnover_ratio', round(turnover_ratio, 6) from val where date >= date '1996-01-01'""",
}
