"""Positions of a line don't turn at the origin of a genome; those of a genome do."""

from __future__ import annotations

from annulus.operators import lineage


def test_deleted_bases_behind_the_origin(spark):
    calls = spark.createDataFrame([(16568, "ACC", "A", 0.9, True)], "position long, ref string, alt string, fraction double, pass boolean")
    names = lambda **k: {r.encoded for r in lineage.consensus_markers(calls, **k).collect()}
    assert names(length=None) == {"16569d", "16570d"}
    assert names() == {"16569d", "1d"}
