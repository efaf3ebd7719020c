"""Callability, small indels and large deletions on made reads."""

import random

from annulus.config import Config
from annulus.functions import text
from annulus.operators import callability, deletions, events
from pyspark.sql import functions as F

SCHEMA = "molecule long, record_index long, flags int, mapping_quality int, reference_name string, reference_start int, cigar string, sequence string, qualities string"


def reads(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("cigar_operations", text.cigar_operations(F.col("cigar")))


def test_callability_by_alignment_and_molecule(spark):
    reference = "ACGTNACGTA"
    rows = [
        (0, 0, 0, 60, "MT", 9, "3M1I2M2D1M", "TAAGCGC", "IIIIII!"),
        (0, 1, 0, 60, "MT", 2, "4M", "CGTA", "IIII"),
        (1, 2, 0, 5, "MT", 1, "2M", "AC", "II"),
        (2, 3, 0, 60, "MT", 1, "2M", "AC", "!!"),
        (3, 4, 0, 60, "MT", 1, "2M", "AC", "II"),
    ]
    found = callability.alignments(reads(spark, rows), reference, Config()).cache()
    by = {r.alignment: r for r in found.collect()}
    assert [(x.start, x.end) for x in by[0].ranges] == [(1, 3), (9, 10)] and by[0].anchors == [1] and by[0].inserted == 1
    assert by[0].exclusions == {"DELETION_FROM_REFERENCE_PATH": 2, "LOW_OR_INVALID_BASE_QUALITY": 1}
    assert [(x.start, x.end) for x in by[1].ranges] == [(2, 4)] and by[1].exclusions == {"NON_CANONICAL_REFERENCE_BASE": 1}
    assert by[2].status == "LOW_MAPPING_QUALITY" and by[2].ranges == []
    nuclear = spark.createDataFrame([(3,)], "molecule long")
    got = {r.molecule: (r.status, r.callable_bases) for r in callability.molecules(found, nuclear).collect()}
    assert got == {0: ("ASSESSED", 6), 1: ("NOT_ASSESSABLE", 0), 2: ("ASSESSED_EMPTY", 0), 3: ("EXCLUDED_NUMT", 0)}


def test_small_indels_and_their_absence(spark):
    reference = "GATTTTACAGCCCATG"
    rows = [
        (0, 0, 0, 60, "MT", 1, "2M1D13M", "GATTTACAGCCCATG", "I" * 15),
        (1, 1, 0, 60, "MT", 1, "4M1D11M", "GATTTACAGCCCATG", "I" * 15),
        (2, 2, 0, 60, "MT", 1, "16M", reference, "I" * 16),
        (3, 3, 0, 60, "MT", 1, "10M1I6M", "GATTTTACAGCCCCATG", "I" * 17),
        (4, 4, 0, 60, "MT", 1, "10M1I6M", "GATTTTACAGCCCCATG", "I" * 10 + "!" + "I" * 6),
    ]
    made = reads(spark, rows)
    calls = deletions.small_indels(made, reference, Config()).cache()
    assert {(r.event, r.molecule, r.reference, r.alternate) for r in calls.collect()} == {
        ("indel:deletion:6-6:T", 0, "TT", "T"),
        ("indel:deletion:6-6:T", 1, "TT", "T"),
        ("indel:insertion:13:C", 3, "C", "CC"),
    }
    assessed = callability.alignments(made, reference, Config()).cache()
    seen = events.small_indels(calls, made.select("molecule").distinct(), callability.ranges(assessed), callability.disrupted(assessed), 16)
    got = {(r.event, r.molecule): r.state for r in seen.collect()}
    deletion, insertion = "indel:deletion:6-6:T", "indel:insertion:13:C"
    assert got == {(deletion, m): "ALTERNATE" if m < 2 else "EVENT_ABSENT" for m in range(5)} | {(insertion, m): "ALTERNATE" if m == 3 else "EVENT_ABSENT" for m in range(5)}


def test_large_deletions(spark):
    rng = random.Random(3)
    n = 2000
    genome = "".join(rng.choice("ACGT") for _ in range(n))
    a, b = 600, 1101  # kept positions beside the deletion
    genome = genome[: b - 1] + genome[a : a + 6] + genome[b + 5 :]  # the six bases behind the left one again, before the right end
    rows = []
    for m in range(40):
        if m < 12:
            move = m % 7  # aligners place the gap anywhere within the repeat
            rows.append((m, m, 16 * (m % 2), 60, "MT", 301, f"{300 + move}M500D{300 - move}M", "A" * 600, "I" * 600))
        else:
            rows.append((m, m, 16 * (m % 2), 60, "MT", 301, "1200M", "A" * 1200, "I" * 1200))
    rows.append((40, 40, 0, 60, "MT", 101, "150M900D150M", "A" * 300, "I" * 300))
    made = reads(spark, rows)
    junctions = deletions.cigar_junctions(made, n)
    assert junctions.count() == 13 and {r.length for r in junctions.collect()} == {500, 900}
    stretches = spark.createDataFrame([(m, 301, 600) for m in range(12)] + [(m, 1101, 1400) for m in range(12)] + [(m, 301, 1500) for m in range(12, 40)], "molecule long, start long, end long")
    (found,) = deletions.large_deletions(junctions, stretches, genome, 41).collect()
    assert (found.length, found.support, found.wild_left, found.wild_right) == (500, 12, 28, 28) and found["pass"] and found.filters == []
    assert found.end - found.start == 499 and len(found.microhomology) >= 6 and found.fraction == 12 / 40 and found.ci_low < 0.3 < found.ci_high


def test_split_junctions(spark):
    parts = spark.createDataFrame([(0, "+", 1, 300, 100, 399, 60), (0, "+", 296, 600, 900, 1204, 60), (1, "+", 1, 300, 1700, 1999, 60), (1, "+", 301, 600, 1, 300, 60), (2, "+", 1, 300, 100, 399, 60), (2, "-", 301, 600, 900, 1199, 60)],
                                  "molecule long, strand string, query_start long, query_end long, reference_start long, reference_end long, mapping_quality int")
    got = [(r.molecule, r.left, r.right, r.length) for r in deletions.split_junctions(parts, Config(), 2000).collect()]
    assert got == [(0, 394, 900, 505)]
