"""Typed matching, lineage calls of clusters, structures, complex paths."""

import pytest
from pyspark.sql import functions as F

from annulus.operators import annotation, lineage, paths

MARKER = "position long, kind string, index string, bases string, encoded string"


def marker(token):
    if token.endswith("d"):
        return (int(token[:-1]), "deletion", None, None, token)
    if "." in token:
        place, rest = token.split(".")
        index = rest.rstrip("ACGT")
        return (int(place), "insertion", index, rest[len(index) :], token)
    return (int(token[:-1]), "substitution", None, token[-1], token)


@pytest.mark.parametrize(
    "expected,observed,fits",
    [
        ("73G", "73G", True), ("73G", "73A", False), ("73G", "74G", False), ("100d", "100d", True), ("100d", "100G", False),
        ("309.1C", "309.1CC", True), ("309.2C", "309.1CC", True), ("309.3C", "309.1CC", False), ("309.2C", "309.1CT", False), ("309.1CCT", "309.1CC", False),
        ("309.XC", "309.1CCC", True), ("309.XCA", "309.1CAC", True), ("309.XC", "309.1CCT", False), ("309.1C", "309.2C", False),
    ],
)
def test_typed_match(spark, expected, observed, fits):
    frame = spark.createDataFrame([(marker(expected), marker(observed))], f"e struct<{MARKER.replace(' ', ':').replace(',:', ',')}>, o struct<{MARKER.replace(' ', ':').replace(',:', ',')}>")
    assert frame.select(lineage.typed_match(F.col("e"), F.col("o")).alias("x")).first().x is fits


def test_lineages_of_clusters(spark):
    """Majority among callable members; markers outside the ranges count neither way; a rule changes a marker; close macro groups warn."""
    members = spark.createDataFrame([(1, f"m{i}") for i in range(5)] + [(2, "s")] + [(3, f"u{i}") for i in range(3)], "cluster long, molecule string")
    ranges = spark.createDataFrame([(f"m{i}", 1, 200 if i < 3 else 100) for i in range(5)] + [("s", 1, 300)], "molecule string, start long, end long")
    shown = {"m0": ["10G", "150T"], "m1": ["10G", "150T"], "m2": ["10G", "20d"], "m3": ["10G"], "m4": ["20d"], "s": ["10G", "250C", "60A"], "u0": ["10G"]}
    rows = [(m, *marker(t)) for m, tokens in shown.items() for t in tokens]
    markers = spark.createDataFrame(rows + rows[:3], f"molecule string, {MARKER}")  # a repeated marker counts once
    found = {(r.cluster, r.encoded): (r.carriers, r.callable) for r in lineage.majority_markers(members, markers, ranges).collect()}
    assert found == {(1, "10G"): (4, 5), (1, "150T"): (2, 3), (2, "10G"): (1, 1), (2, "250C"): (1, 1), (2, "60A"): (1, 1)}
    spans = {(r.cluster, r.start, r.end, r.known) for r in lineage.majority_ranges(members, ranges).collect()}
    assert spans == {(1, 1, 200, True), (2, 1, 300, True), (3, 1, 16569, False)}
    defined = [("H1", 2, "10G"), ("H1", 2, "150T"), ("H1", 2, "280A"), ("J2", 1, "10G"), ("J2", 1, "150T"), ("J2", 1, "60A"), ("K9", 0, "500A")]
    definitions = spark.createDataFrame([(n, o, *marker(t)) for n, o, t in defined], f"name string, source_order int, {MARKER}")
    got = {(r.cluster, r.rank): r for r in lineage.cluster_lineages(members, markers, ranges, definitions).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2)}  # cluster 3 has no ranges
    best = got[1, 1]
    assert (best.name, best.score, best.matched, best.missing, best.extra) == ("H1", 100.0, ["10G", "150T"], [], []) and not best.contamination
    assert got[1, 2].name == "J2" and got[1, 2].missing == ["60A"]
    assert (got[2, 1].name, got[2, 1].matched, got[2, 1].extra) == ("J2", ["10G", "60A"], ["250C"])
    close = definitions.where("name <> 'J2'").unionByName(definitions.where("name = 'H1'").withColumn("name", F.lit("U5")).withColumn("source_order", F.lit(1)))
    tied = {(r.cluster, r.rank): (r.name, r.contamination) for r in lineage.cluster_lineages(members, markers, ranges, close).collect()}
    assert tied[1, 1] == ("U5", True)  # equal scores go by source order
    ruled = lineage.cluster_lineages(members, markers, ranges, definitions, corrected=lambda seen: seen.where("encoded <> '150T'"))
    assert {r.name for r in ruled.where("cluster = 1 and rank = 1").collect()} == {"J2"} or ruled.where("cluster = 1").first().missing


def test_structures_and_primary_effects(spark):
    effects = spark.createDataFrame([("g1", 5, "M", "missense_variant", "protein_coding"), ("g1", 6, "*", "stop_lost", "protein_coding"), ("g1", 7, "A", "missense_variant", "protein_coding")], "gene string, residue long, ref_aa string, consequence string, biotype string")
    catalogue = spark.createDataFrame([("g1", "1abc", "A", "complex I", 1, 9, [7])], "gene string, model string, chain string, complex string, first int, last int, differs array<int>")
    found = {r.residue: r.structure for r in annotation.on_structure(effects, catalogue).collect()}
    assert found[5].model == "1abc" and found[6] is None and found[7] is None
    chosen = annotation.on_structure(effects, catalogue).groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("residue", "consequence", "biotype", "structure"))).alias("all"))
    assert chosen.select(annotation.primary_effect(F.col("all")).alias("e")).first().e.residue == 5
    rows = spark.createDataFrame([("Met", "FME"), ("Leu", "leu"), ("Leu", "ILE"), ("Met", None)], "a string, b string")
    assert [r.x for r in rows.select(annotation.residue_matches(F.col("a"), F.col("b")).alias("x")).collect()] == [True, True, False, None]


def test_a_path_and_its_reverse_are_one_event(spark):
    there, back = [("j1", "+/-"), ("j2", "+/+")], [("j2", "-/-"), ("j1", "+/-")]
    rows = [(r, i, *j) for r, path in (("a", there), ("b", back), ("c", there[:1])) for i, j in enumerate(path)]
    events = paths.complex_events(spark.createDataFrame(rows, "read string, place int, id string, orientation string"))
    assert {(r.event, r.support, r.junctions) for r in paths.merged_paths(events).collect()} == {("complex:j1@+/-|j2@+/+", 2, 2)}
