import pytest

from quantloom import queries, queries_rotation

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["crowding_filtered", "valuation_filtered"])
def test_filters_keep_seven_of_eight(spark, name):
    picked = {r.date: r["count"] for r in queries_rotation._picked(queries_rotation._groups(spark, SF)).groupBy("date").count().collect()}
    kept = {r.date: r["count"] for r in queries.QUERIES[name](spark, SF).groupBy("date").count().collect()}
    assert kept.keys() == picked.keys()
    assert all(kept[d] >= min(7, n) for d, n in picked.items())
