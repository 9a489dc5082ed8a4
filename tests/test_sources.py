import datetime as dt
import json

import pytest

from quantloom.sources import readers

PANEL = "date date, code string, x double"
ROWS = [(dt.date(y, 3, 1), c, float(y)) for y in (2022, 2023) for c in ("a", "b")]


def test_years_are_rebuilt_one_by_one(spark, tmp_path):
    root = str(tmp_path)
    readers.write_by_year(spark.createDataFrame(ROWS, PANEL), root, "bars")
    changed = spark.createDataFrame([(d, c, -x) for d, c, x in ROWS], PANEL)
    readers.write_by_year(changed, root, "bars", year=2023)
    got = {(r.date, r.code): r.x for r in readers.read_partitioned(spark, root, "bars").collect()}
    assert got == {(d, c): (-x if d.year == 2023 else x) for d, c, x in ROWS}


def test_columns_of_years_merge(spark, tmp_path):
    spark.createDataFrame(ROWS[:2], PANEL).write.parquet(f"{tmp_path}/t/year=2022")
    spark.createDataFrame([(ROWS[2][0], "a", 5)], "date date, code string, y int").write.parquet(f"{tmp_path}/t/year=2023")
    got = readers.read_partitioned(spark, str(tmp_path), "t")
    assert set(got.columns) == {"date", "code", "x", "y"} and got.count() == 3


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("date,code,x\n2024-01-02,a,1.5\n2024-01-03,b,\n")
    got = [tuple(r) for r in readers.read_csv(spark, str(path), PANEL).orderBy("date").collect()]
    assert got == [(dt.date(2024, 1, 2), "a", 1.5), (dt.date(2024, 1, 3), "b", None)]
    assert readers.read_csv(spark, str(tmp_path / "none.csv"), PANEL).count() == 0


def test_results(spark, tmp_path):
    for n, days in (("one", 2), ("two", 0)):
        (tmp_path / f"{n}.json").write_text(json.dumps({"name": n, "dates": [f"2024-01-0{i + 1}" for i in range(days)], "returns": [0.1 * i for i in range(days)]}))
    got = readers.read_results(spark, [str(tmp_path / "one.json"), str(tmp_path / "two.json")])
    assert sorted(tuple(r) for r in got.collect()) == [("one", dt.date(2024, 1, 1), 0.0), ("one", dt.date(2024, 1, 2), 0.1)]
    for form in ("csv", "json"):
        readers.write_results(got, str(tmp_path / form), form)
    assert spark.read.json(str(tmp_path / "json")).count() == spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


@pytest.mark.parametrize("flags, kept", [((False, False), 1), ((True, False), 0), ((None, False), 0), ((False, None), 0)])
def test_unknown_flags_are_not_tradable(spark, flags, kept):
    df = spark.createDataFrame([(dt.date(2024, 1, 2), "a", *flags)], "date date, code string, paused boolean, is_st boolean")
    assert readers.tradable(df).count() == kept and readers.tradable(df, "2024-01-01").count() == 0
