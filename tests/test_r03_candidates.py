"""Definitions with the same markers are matched once; the ranking holds the first of them by name."""

from __future__ import annotations

from annulus.operators import lineage


def test_equal_definitions_are_matched_once(spark, monkeypatch):
    kept, plain = {}, lineage.written
    monkeypatch.setattr(lineage, "written", lambda df, name, **k: kept.setdefault(name, plain(df, name, **k)))
    defined = [(d, m) for d in range(40) for m in ((1, 2) if d % 2 else (2, 3, 4))]
    seen = [(7, 1), (7, 2), (8, 3), (8, 9)]
    got = lineage.ranked_candidates(spark.createDataFrame(seen, "cluster long, marker long"), spark.createDataFrame(defined, "definition long, marker long"), 3)
    assert {(r.cluster, r.definition, r["rank"], r.matched, r.missing, r.extra) for r in got.collect()} == {
        *((7, 2 * i + 1, i + 1, 2, 0, 0) for i in range(3)), *((8, 2 * i, i + 1, 1, 2, 1) for i in range(3))}
    assert kept["definitions"].count() == 5
