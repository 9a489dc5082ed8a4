from quantloom.operators import evaluation


def test_ranks_of_dates_are_not_merged(spark):
    rows = [(f"2024-01-{d:02}", str(c), float((c * 7 + d * 3) % 11), float(10 + c + (d * c) % 5)) for d in range(1, 20) for c in range(12)]
    out = evaluation.ic_decay(spark.createDataFrame(rows, "date string, code string, mom double, close double"), "mom", [1, 2])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and f", {2 * evaluation.DATES})" in plan
    assert {r.horizon: r.n for r in out.collect()}.keys() == {1, 2}
