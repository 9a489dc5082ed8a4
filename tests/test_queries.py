import math

import duckdb
import pytest

from quantloom import queries
from quantloom.operators import cross_section, evaluation, portfolio, resample

SF = "/root/testdata/sf0.01"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or abs(a - b) <= 1.5e-6 + 1e-9 * abs(a)
    return a == b


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.ORACLE])
def test_matches_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(queries.ORACLE[name])
    assert sorted(d[0] for d in cur.description) == cols
    keys = [c for c, t in df.dtypes if t != "double"]
    order = [d[0] for d in cur.description]
    want = [dict(zip(order, r)) for r in cur.fetchall()]
    got = [r.asDict() for r in df.collect()]
    by = lambda r: tuple(str(r[k]) for k in sorted(keys))
    got.sort(key=by), want.sort(key=by)
    assert len(got) == len(want) > 0
    bad = [(g, w) for g, w in zip(got, want) if not all(same(g[c], w[c]) for c in cols)]
    assert not bad, (len(bad), bad[0])


def test_average_rank(spark):
    df = spark.createDataFrame([("d", x) for x in (3.0, 1.0, 2.0, 1.0, None)], "date string, v double")
    got = df.select("v", cross_section.rank_avg("v").alias("r")).collect()
    assert sorted((r.v, r.r) for r in got if r.v is not None) == [(1.0, 1.5), (1.0, 1.5), (2.0, 3.0), (3.0, 4.0)]


def test_perfect_ic_and_too_few(spark):
    rows = [(d, str(i), float(i), float(i)) for d in ("a", "b") for i in range(10)] + [("c", str(i), float(i), 1.0) for i in range(5)]
    ic = evaluation.compute_ic(spark.createDataFrame(rows, "date string, code string, f double, r double"), "f", "r", "pearson")
    got = {r.date: r.ic for r in ic.collect()}
    assert got["a"] == pytest.approx(1.0) and got["c"] is None


def test_weight_cap(spark):
    rows = [("p", "d", str(i), w) for i, w in enumerate((0.4, 0.3, 0.2, 0.1))]
    got = [r.weight for r in portfolio.weight_cap(spark.createDataFrame(rows, "portfolio string, date string, code string, weight double"), 0.25).collect()]
    assert max(got) <= 0.25 + 1e-9 and sum(got) == pytest.approx(1.0)


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries()"], cwd=Path(__file__).resolve().parents[1], capture_output=True)
    assert run.returncode == 0, run.stderr[-500:]


def test_bootstrap_is_deterministic(spark):
    rows = [("s", f"2024-01-{i + 1:02}", x) for i, x in enumerate((0.01, 0.02, -0.01, 0.03, 0.005) * 5)]
    df = spark.createDataFrame(rows, "strategy string, date string, ret double")
    one, two = (resample.sharpe_interval(d, 50).collect() for d in (df, df.repartition(7)))
    assert [(round(r.low, 9), round(r.high, 9)) for r in one] == [(round(r.low, 9), round(r.high, 9)) for r in two] and one[0].low < one[0].high
