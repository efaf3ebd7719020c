"""Lineage trees, rules, weights and the store of snapshots."""

import pytest

from annulus.errors import AnalysisError
from annulus.sources import lineages, snapshots

TREE = """<?xml version="1.0"?><tree>
<haplogroup name="root"><haplogroup name="A"><details><poly>73G</poly><poly>263G</poly><poly>523d</poly></details>
  <haplogroup name="A1"><details><poly>73G!</poly><poly>263C</poly><poly>315.1C</poly><poly>523A</poly></details></haplogroup>
  <haplogroup name="A2"><details><poly>315.XC</poly></details></haplogroup></haplogroup></haplogroup></tree>"""


def test_tree(spark, tmp_path):
    (tmp_path / "t.xml").write_text(TREE)
    got = {}
    for r in lineages.read_tree(spark, str(tmp_path / "t.xml")).collect():
        got.setdefault((r.source_order, r.definition), []).append(r.marker)
    assert got == {(0, "root"): [None], (1, "A"): ["73G", "263G", "523d"], (2, "A1"): ["263C", "315.1C", "523A"], (3, "A2"): ["73G", "263G", "315.XC", "523d"]}
    for bad in ("<p><haplogroup name='x'><poly>73Z</poly></haplogroup></p>", "<p><haplogroup name='x'>", "<p/>", "<p><haplogroup><poly>73G</poly></haplogroup></p>"):
        with pytest.raises(AnalysisError, match="E1302"):
            lineages.tree_definitions(bad)


def test_weights_and_rules(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("73G\t2.5\n263G\tx\n1C\t-1\n73G\t3\nalone\n")
    assert {r.marker: r.weight for r in lineages.read_weights(spark, str(tmp_path / "w.tsv")).collect()} == {"73G": 3.0}
    (tmp_path / "r.csv").write_text('error,expected\n"a b",c\n"c,d",e\n')
    rules = lineages.read_rules(spark, str(tmp_path / "r.csv"))
    observed = spark.createDataFrame([(1, m) for m in "abdx"] + [(2, "a")], "cluster long, marker string")
    assert {(r.cluster, r.marker) for r in lineages.corrected(observed, rules).collect()} == {(1, "e"), (1, "x"), (2, "a")}
    assert lineages.apply_rules(["a"], [(["a"], ["b"]), (["b"], ["a"])]) == ["a"]


def table(path, rows):
    path.write_text("\n".join(["\t".join(snapshots.COLUMNS), *("\t".join([str(p), "A", "G", *["x"] * 8, source, *["y"] * 10]) for p, source in rows)]) + "\n")
    return str(path)


def test_snapshots(spark, tmp_path):
    clock = [1_000_000]
    store = snapshots.Store(spark, f"file://{tmp_path}/store", now=lambda: clock[0])
    assert store.status() == {"active_snapshot": None, "verified": False}
    first = store.stage(table(tmp_path / "1.tsv", [(1, "S"), (2, "T"), (2, "S")]), "v1", "CC0", "public", activate=True)
    assert first["active_snapshot"] == "v1" and first["previous_snapshot"] is None
    assert store.verify("v1")["summary"] == {"assertion_count": 3, "variant_count": 2, "sources": ["S", "T"]}
    store.stage(table(tmp_path / "2.tsv", [(9, "S")]), "v2", "CC0", "public")
    assert store.data().count() == 3
    assert store.activate("v2")["previous_snapshot"] == "v1" and store.data().count() == 1
    assert store.rollback()["active_snapshot"] == "v1" and store.status()["verified"]
    assert store.rollback()["active_snapshot"] == "v2"
    clock[0] += 10 * snapshots.DAY
    with pytest.raises(AnalysisError, match="stale"):
        store.status(max_age_days=9)
    with pytest.raises(AnalysisError, match="exists"):
        store.stage(str(tmp_path / "2.tsv"), "v2", "CC0", "public")
    with pytest.raises(AnalysisError, match="E1001"):
        store.stage(str(tmp_path / "2.tsv"), "../v3", "CC0", "public")
    (tmp_path / "bad.tsv").write_text("position\n1\n")
    with pytest.raises(AnalysisError, match="header"):
        store.stage(str(tmp_path / "bad.tsv"), "v3", "CC0", "public")
    store.data("v1").limit(1).write.mode("append").parquet(f"file://{tmp_path}/store/snapshots/v1/data")
    with pytest.raises(AnalysisError, match="isn't what was staged"):
        store.verify("v1")
