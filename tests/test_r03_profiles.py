"""what an item of a profile is parsed into is computed once a row."""

import re

import __spark_entry__ as entry
from annulus.sources import tables
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_ranges_are_parsed_once(spark):
    plan = entry.queries()["profile_fields"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    ranges = next(part for part in plan.split(" AS ") if "transform" in part)
    assert len(re.findall("regexp|RLIKE|rlike", ranges)) <= 4


def test_items_that_are_no_ranges(spark):
    rows = spark.createDataFrame([(x,) for x in ("5-", "-5", "0-3", "1-2;x", "", None, "5-99999999999999999999", '"7; 3 - 4"', "16569-1")], "raw string")
    got = [r.r and [tuple(x) for x in r.r] for r in rows.select(tables.profile_ranges(F.col("raw")).alias("r")).collect()]
    assert got == [None] * 7 + [[(3, 4), (7, 7)], [(1, 1), (16569, 16569)]]
