"""Components of rows that are near each other in two values, against all pairs; dense rows form no pairs."""

import random

import pytest

from annulus.operators import evidence


def brute(rows, wx, wy):
    root = {k: k for k, *_ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (k, x, y) in enumerate(rows):
        for m, u, v in rows[:i]:
            if None not in (x, y, u, v) and abs(x - u) <= wx and abs(y - v) <= wy:
                a, b = find(k), find(m)
                root[max(a, b)] = min(a, b)
    return {k: find(k) for k in root}


@pytest.mark.parametrize("seed, reach, wx, wy", [(1, 60, 3, 5), (2, 120, 7, 2), (3, 30, 1, 1), (4, 200, 9, 9)])
def test_components_equal_those_of_all_pairs(spark, seed, reach, wx, wy):
    r = random.Random(seed)
    rows = [(i, r.randint(-reach, reach), r.randint(-reach, reach)) for i in r.sample(range(1000), 150)] + [(2000, None, 1), (2001, None, 1), (2002, 4, None)]
    found = evidence.band_components(spark.createDataFrame(rows, "id long, x long, y long"), "id", {"x": wx, "y": wy})
    assert {r.id: r.component for r in found.collect()} == brute(rows, wx, wy)


def test_a_hundred_thousand_rows_at_one_place_are_one_component(spark):
    rows = spark.range(100_000).selectExpr("id", "id % 5 as x", "id % 7 as y")  # five thousand million pairs
    found = evidence.band_components(rows, "id", {"x": 30, "y": 800})
    assert [(r.component, r.n) for r in found.groupBy("component").agg({"*": "count"}).toDF("component", "n").collect()] == [(0, 100_000)]
