"""what both bounds of an interval share is computed once a row."""

import contextlib
import io
import re

import __spark_entry__ as entry
from annulus.functions import stats
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_bounds_are_code_that_the_jvm_compiles(spark):
    """The JVM only interprets methods of 8,000 bytes or more."""
    with contextlib.redirect_stdout(io.StringIO()) as out:
        entry.queries()["numeric_functions"](spark, SMALL).explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]
    assert sizes and max(sizes) < 8000


def test_bounds_without_a_count(spark):
    rows = spark.createDataFrame([(1.0, 4.0), (0.0, 0.0), (0.0, None), (None, 4.0), (1.0, -2.0), (4.0, 4.0)], "k double, n double")
    low, high = stats.wilson(F.col("k"), F.col("n"))
    got = [(round(r.low, 6), round(r.high, 6)) for r in rows.select(low.alias("low"), high.alias("high")).collect()]
    assert got == [(0.045587, 0.699358), (0.0, 0.0), (0.0, 0.0), (0.0, 1.0), (0.0, 0.0), (0.510109, 1.0)]
