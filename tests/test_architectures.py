"""Architectures and the evidence graph on small cases whose results are plain."""

from pyspark.sql import functions as F

from annulus.config import Config
from annulus.operators import architectures, events


def observed(spark, rows):
    return spark.createDataFrame(rows, "molecule long, event string, state string")


def inferred(spark, rows, molecules, config=Config()):
    obs = observed(spark, rows)
    weights = obs.select("event").distinct().selectExpr("event", "1.0D as weight")
    return architectures.infer(spark.createDataFrame([(m,) for m in molecules], "molecule long"), obs, weights, config)


def test_two_patterns_and_a_stray(spark):
    states = {"a": {"A": "ALTERNATE", "B": "ALTERNATE", "C": "REFERENCE"}, "b": {"A": "REFERENCE", "B": "REFERENCE", "C": "ALTERNATE"}}
    rows = [(m, e, s) for m, k in enumerate("aaabb") for e, s in states[k].items()] + [(5, "A", "ALTERNATE"), (5, "B", "REFERENCE"), (5, "C", "ALTERNATE")]
    got = inferred(spark, rows, range(6))
    assert got.status == "CANDIDATES_INFERRED" and not got.flags
    by = {r.molecule: r for r in got.assignments.collect()}
    assert [by[m].architecture for m in range(5)] == ["architecture:v1:1#A1#B"] * 3 + ["architecture:v1:1#C"] * 2
    assert by[5].status == "UNASSIGNED" and by[5].confidence == 0.0 and by[0].confidence == 1.0
    found = {r.architecture: r for r in got.architectures.collect()}
    assert found["architecture:v1:1#A1#B"].members == 3 and found["architecture:v1:1#A1#B"].defining == ["A", "B"]
    assert found["architecture:v1:1#C"].fraction == 2 / 6 and found["architecture:v1:1#C"].representatives == [3, 4]


def test_single_events_seed_when_no_signature_repeats(spark):
    rows = [(0, "A", "ALTERNATE"), (0, "x", "ALTERNATE"), (1, "A", "ALTERNATE"), (1, "y", "ALTERNATE")]
    signed = architectures.signatures(spark.createDataFrame([(0,), (1,)], "molecule long"), observed(spark, rows))
    assert {tuple(r.signature) for r in architectures.seeds(signed, Config()).collect()} == {("A",)}


def test_ends_without_support(spark):
    assert inferred(spark, [(0, "A", "ALTERNATE")], [0]).status == "INSUFFICIENT_ELIGIBLE_MOLECULES"
    lone = inferred(spark, [(0, "A", "ALTERNATE"), (1, "B", "ALTERNATE")], [0, 1])
    assert lone.status == "NO_SUPPORTED_SEEDS" and {r.status for r in lone.assignments.collect()} == {"UNASSIGNED"}


def test_reference_like_without_observations(spark):
    got = inferred(spark, [(9, "A", "ALTERNATE")], [0, 1, 2])
    assert {r.architecture for r in got.assignments.collect()} == {"architecture:v1:reference-like"}


def test_indel_states(spark):
    supports = spark.createDataFrame(
        [("i1", "SMALL_INSERTION", 10, 10, "", "A", 0, 0, 30), ("i1", "SMALL_INSERTION", 10, 10, "", "A", 0, 1, 40), ("i2", "SMALL_INSERTION", 10, 10, "", "C", 1, 2, 20), ("d1", "SMALL_DELETION", 20, 22, "GGG", "", 1, 2, None)],
        "event string, type string, start long, end long, reference string, alternate string, molecule long, fragment long, quality int",
    )
    molecules = spark.createDataFrame([(m,) for m in range(5)], "molecule long")
    ranges = spark.createDataFrame([(2, 0, 1, 30), (3, 0, 5, 21), (4, 0, 1, 10), (4, 1, 11, 40)], "molecule long, alignment long, start long, end long")
    broken = spark.createDataFrame([(2, 0, 10)], "molecule long, alignment long, anchor long")
    got = {(r.event, r.molecule): (r.state, r.allele, r.quality, r.source) for r in events.small_indels(supports, molecules, ranges, broken).collect()}
    assert got == {
        ("i1", 0): ("ALTERNATE", "A", 40, "cigar_small_indel"),
        ("i1", 1): ("EVENT_ABSENT", "C", 20, "cigar_alternative_small_indel"),
        ("i2", 1): ("ALTERNATE", "C", 20, "cigar_small_indel"),
        ("i2", 0): ("EVENT_ABSENT", "A", 40, "cigar_alternative_small_indel"),
        ("i1", 3): ("EVENT_ABSENT", "", None, "callable_reference_path"),
        ("i2", 3): ("EVENT_ABSENT", "", None, "callable_reference_path"),
        ("d1", 1): ("ALTERNATE", "", None, "cigar_small_indel"),
        ("d1", 2): ("EVENT_ABSENT", "GGG", None, "callable_reference_path"),
        ("d1", 4): ("EVENT_ABSENT", "GGG", None, "callable_reference_path"),
    }


def test_structural_states(spark):
    supports = spark.createDataFrame([("deletion:100-200", "deletion", 100, 200, 0), ("inversion:5-9", "inversion", 5, 9, 0), ("deletion:16000-50", "deletion", 16000, 50, 0)], "event string, type string, start long, end long, molecule long")
    molecules = spark.createDataFrame([(0,), (1,), (2,)], "molecule long")
    ranges = spark.createDataFrame([(1, 0, 1, 16569), (2, 0, 101, 300)], "molecule long, alignment long, start long, end long")
    broken = spark.createDataFrame([], "molecule long, alignment long, anchor long")
    rows = events.structural(supports, molecules, ranges, broken).collect()
    assert {(r.event, r.molecule, r.state) for r in rows} == {(e, 0, "ALTERNATE") for e in ("deletion:100-200", "inversion:5-9", "deletion:16000-50")} | {("deletion:100-200", 1, "EVENT_ABSENT")}


def test_median_callable_fraction(spark):
    molecules = spark.range(6).select(F.col("id").cast("string").alias("molecule"))
    seen = spark.createDataFrame([(str(m), "e" if m < 4 else "f", "ALTERNATE") for m in range(6)], "molecule string, event string, state string")
    weights = spark.createDataFrame([("e", 3.0), ("f", 3.0)], "event string, weight double")
    shares = spark.createDataFrame([(str(m), x) for m, x in enumerate((0.9, 0.1, 0.5, 0.6, 0.2, 0.8))], "molecule string, callable_fraction double")
    found = architectures.infer(molecules, seen, weights, Config(), shares).architectures
    assert {tuple(r.defining): round(r.median_callable_fraction, 9) for r in found.collect()} == {("e",): 0.55, ("f",): 0.5}
