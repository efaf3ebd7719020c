"""Mean levels are summed in the table's order, whatever the tasks."""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.parquet as pq

from annulus.plans import comparisons


def test_levels_in_the_order_of_the_table(spark, tmp_path):
    r = random.Random(3)
    rows = [("F", r.randrange(40), "N", r.randrange(11) / 100) for _ in range(4000)]
    pq.write_table(pa.table({n: list(c) for n, c in zip(("l_linestatus", "l_partkey", "l_returnflag", "l_discount"), zip(*rows))}), tmp_path / "lineitem.parquet", row_group_size=100)
    sums, n = {}, {}
    for _, k, _, x in rows:
        sums[k], n[k] = sums.get(k, 0.0) + x * 10, n.get(k, 0) + 1
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {x.position: (x.level, x.depth) for x in comparisons._sets(spark, str(tmp_path))[0].collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == {k: (sums[k] / n[k], n[k]) for k in sums}
