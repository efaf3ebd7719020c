"""F16: definitions with the same markers are one set, and the marks of molecules are counted without holding the molecules."""

import pytest

from annulus.operators import lineage
from annulus.plans import annotations

MARKER = "position long, kind string, index string, bases string, encoded string"


def _substitutions(*tokens):
    return [(int(t[:-1]), "substitution", None, t[-1], t) for t in tokens]


def _called(spark, defined):
    seen = [(c, *m) for c, tokens in ((1, ("10G", "20A", "30T")), (2, ("10G", "90C"))) for m in _substitutions(*tokens)]
    ranges = spark.createDataFrame([(1, 1, 300), (2, 1, 300)], "cluster long, start long, end long")
    rows = [(name, order, *m) for name, order, tokens in defined for m in _substitutions(*tokens)]
    found = lineage.lineage_calls(spark.createDataFrame(seen, f"cluster long, {MARKER}"), spark.createDataFrame(rows, f"name string, source_order int, {MARKER}"), ranges)
    return {(r.cluster, r["rank"]): (r.name, round(r.score, 6), tuple(r.matched), tuple(r.missing), tuple(r.extra)) for r in found.collect()}


def test_equal_definitions_are_scored_once(spark, monkeypatch):
    kept, plain = {}, lineage.written
    monkeypatch.setattr(lineage, "written", lambda df, name, **k: kept.setdefault(name, plain(df, name, **k)))
    defined = [(f"H{i}", 40 - i, ("10G", "20A") if i % 2 else ("20A", "10G", "40C")) for i in range(20)]
    got = _called(spark, defined)
    assert kept["sets"].count() == 5 and kept["members"].count() == 6
    whole, part = (("10G", "20A"), (), ("30T",)), (("10G",), ("20A",), ("90C",))
    assert got == {**{(1, n): (f"H{21 - 2 * n}", 83.333333, *whole) for n in (1, 2, 3)}, **{(2, n): (f"H{21 - 2 * n}", 50.0, *part) for n in (1, 2, 3)}}


def test_sets_with_equal_scores_go_by_source_order(spark):
    # single markers score the same in cluster 1: the orders of both sets are merged, names break ties
    defined = [("b", 5, ("10G",)), ("d", 1, ("10G",)), ("c", 5, ("20A",)), ("a", 5, ("20A",)), ("e", 0, ("77T",))]
    got = _called(spark, defined)
    assert [got[1, n][0] for n in (1, 2, 3)] == ["d", "a", "b"] and [got[2, n][0] for n in (1, 2)] == ["d", "b"] and len(got) == 5


@pytest.mark.parametrize("rows", [annotations._marks, annotations._definitions])
def test_rows_are_not_held_before_they_are_counted(spark, rows):
    assert "Aggregate" not in rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
