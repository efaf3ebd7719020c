"""what a task sorts doesn't grow with the table."""

import random

import pytest

from annulus.operators import contracts, intervals, shared


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(shared, "ROWS_OF_A_TASK", 20)


def test_tasks_follow_the_rows(spark, few):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    assert shared.dealt(rows, "k").rdd.getNumPartitions() == 51
    assert shared.dealt(rows.limit(5), "k").count() == 5
    ranges = rows.selectExpr("k div 4 as k", "k as start", "k + 2 as end")
    plans = (contracts.disordered(ranges, ["k"]), contracts.dangling(ranges, "k", rows, "k"))
    assert all("51" in p._jdf.queryExecution().executedPlan().toString().split("hashpartitioning", 1)[1][:40] for p in plans)
    assert contracts.disordered(ranges, ["k"]).count() == 750 and contracts.dangling(ranges, "k", rows.where("k <> 3"), "k").count() == 4


@pytest.mark.parametrize("gap", [1, 26])
def test_merged_ranges_hold_no_table_beside_the_sort(spark, gap):
    rng = random.Random(gap)
    rows = [(k, s, s + rng.randrange(1, 60)) for k in range(30) for s in (rng.randrange(400) for _ in range(rng.randrange(1, 12)))]
    want = []
    for k in range(30):
        mine = []
        for _, s, e in sorted(r for r in rows if r[0] == k):
            if mine and s <= mine[-1][1] + gap:
                mine[-1][1] = max(mine[-1][1], e)
            else:
                mine.append([s, e])
        want += [(k, s, e) for s, e in mine]
    found = intervals.merged(spark.createDataFrame(rows, "k int, start long, end long"), ["k"], gap=gap)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString()
