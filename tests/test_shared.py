"""Intermediate tables: what is written inside a scope goes at its end."""

import pytest
from pyspark.sql import functions as F

from annulus.operators import shared
from annulus.sources import tables


def folders(spark):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared.shared_dir(spark))
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return {str(x.getPath().getName()) for x in found}


def test_scopes(spark):
    before = folders(spark)
    with shared.temporary(spark):
        a = shared.written(spark.range(3), "a")
        with shared.temporary(spark):
            b = shared.written(spark.range(4), "b")
            kept = shared.written(b, "kept", keep=True)
        assert a.count() == 3 and kept.count() == 4 and len(folders(spark) - before) == 2
    assert kept.count() == 4 and len(folders(spark) - before) == 1
    with pytest.raises(ZeroDivisionError), shared.temporary(spark):
        shared.written(spark.range(1), "lost")
        raise ZeroDivisionError
    shared.dropped(kept)
    assert folders(spark) == before


def test_offsets_of_long_difference_strings(spark):
    """Many blocks of edits: every place is the sum of what stands before it."""
    ops, place, want = [], 100, []
    for i in range(700):
        ops.append("=ACG"[: 2 + i % 3])
        place += 1 + i % 3
        if i % 4 == 0:
            want.append((place, 1, "T"))
            ops.append("*at")
            place += 1
        elif i % 4 == 1:
            want.append((place, 0, "GG"))
            ops.append("+gg")
        elif i % 4 == 2:
            want.append((place, 3, ""))
            ops.append("-acg")
            place += 3
    rows = spark.createDataFrame([(1, 100, "".join(ops)), (2, 5, ""), (3, 7, None)], "k int, start long, cs string")
    got = [(r.position, r.deleted, r.inserted) for r in tables.difference_edits(rows).orderBy(F.monotonically_increasing_id()).collect()]
    assert got == want
