"""The placement search of large deletions on made reads: repeats, gaps that aligners put wrongly, split reads."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annulus.config import Config
from annulus.functions import haplotypes, indels, text
from annulus.operators import breakpoints, deletions

N = 2000
RNG = random.Random(11)
GENOME = "".join(RNG.choice("ACGT") for _ in range(N))
LEFT, RIGHT = 600, 1101  # kept positions beside the deletion
READS = "molecule long, record_index long, flags int, mapping_quality int, reference_name string, reference_start int, cigar string, sequence string, qualities string"


def frame(spark, rows):
    return spark.createDataFrame(rows, READS).withColumn("cigar_operations", text.cigar_operations(F.col("cigar")))


def deleted(genome, start, left, right, n=600):
    return (genome[start - 1 : left] + genome[right - 1 :])[:n]


def noisy(sequence, rng, rate=0.02):
    return "".join(rng.choice("ACGT") if rng.random() < rate else b for b in sequence)


def called(spark, genome, rows):
    made = frame(spark, rows)
    junctions = deletions.cigar_junctions(made, N)
    pieces = made.select("molecule", F.col("reference_start").cast("long").alias("start"), (F.col("reference_start") + 299).cast("long").alias("end"))
    return {refine: deletions.large_deletions(junctions, pieces, genome, len(rows), reads=made if refine else None).collect() for refine in (False, True)}


def test_reads_decide_where_a_gap_is(spark):
    """Most aligners' gaps are two to four bases off; what the reads hold is the deletion of 601-1100."""
    rng, rows = random.Random(1), []
    for m in range(30):
        start, off = 280 + m, (3, -2, 4)[m % 3]
        before = LEFT + off - start + 1
        sequence = noisy(deleted(GENOME, start, LEFT, RIGHT), rng)
        rows.append((m, m, 16 * (m % 2), 60, "MT", start, f"{before}M500D{600 - before}M", sequence, "5" * 600))
    found = called(spark, GENOME, rows)
    (plain,), (best,) = found[False], found[True]
    left, right, shift = indels.junction(GENOME, LEFT, RIGHT)
    assert (best.start, best.end) == (left + 1 + shift, right + shift - 1) and best.length == 500 and best.support == 30
    assert (plain.start, plain.end) != (best.start, best.end)  # the commonest placement is a wrong one
    assert best.breakpoint_variants == plain.breakpoint_variants >= 3


@pytest.mark.parametrize("first", (601, 614))
def test_a_gap_within_a_repeat_is_one_event(spark, first):
    """A direct repeat of 13 bases: the gap at its one or other end is called at the right end in its whole length."""
    genome = GENOME[: RIGHT - 1] + GENOME[LEFT : LEFT + 13] + GENOME[RIGHT + 12 :]
    rng, rows = random.Random(2), []
    for m in range(24):
        start = 250 + rng.randrange(40)
        before = first - start
        rows.append((m, m, 16 * (m % 2), 60, "MT", start, f"{before}M500D{600 - before}M", deleted(genome, start, LEFT, RIGHT), "I" * 600))
    (best,) = called(spark, genome, rows)[True]
    assert best.length == 500 and best.start >= 614 and best.end == best.start + 499 and len(best.microhomology) >= 13
    assert "direct_repeat_flanked" in best.flags


def test_split_reads_have_windows_on_both_strands(spark):
    """Primary records of both strands with the junction told by supplementary alignments: windows run as the reference does."""
    forward = deleted(GENOME, 401, LEFT, RIGHT, 400)
    back = forward[::-1].translate(str.maketrans("ACGT", "TGCA"))
    whole = frame(spark, [(0, 0, 0, 60, "MT", 401, "200M200S", forward, "I" * 400), (1, 1, 16, 60, "MT", 401, "200M200S", forward, "I" * 400), (2, 2, 0, 60, "MT", 401, "400M", back, "I" * 400)])
    parts = [(0, "+", 1, 200, 401, 600, 60), (0, "+", 201, 400, 1101, 1300, 60), (1, "-", 1, 200, 1101, 1300, 60), (1, "-", 201, 400, 401, 600, 60), (2, "-", 1, 200, 1101, 1300, 60), (2, "-", 201, 400, 401, 600, 60)]
    rows = spark.createDataFrame(parts, "molecule long, strand string, query_start long, query_end long, reference_start long, reference_end long, mapping_quality int")
    junctions = deletions.split_junctions(rows, Config(), N).withColumn("cluster", F.lit("a")).withColumn("raw_left", F.col("left"))
    got = breakpoints.read_windows(junctions, whole, N).collect()
    assert {r.molecule: r.sequence for r in got} == dict.fromkeys(range(3), forward[160:240])


def test_candidates_are_few_and_distinct(spark):
    counted = spark.createDataFrame([("a", 600, 1101, 5), ("a", 603, 1104, 2), ("b", 3, 1999, 1)], "cluster string, left long, right long, n long")
    rows = breakpoints.candidates(counted, GENOME).collect()
    for cluster in "ab":
        own = [r for r in rows if r.cluster == cluster]
        assert len({r.haplotype for r in own}) == len(own) <= 6 + 81 and all(1 <= r.left <= N and 1 <= r.right <= N for r in own)
    twice = GENOME * 2
    (first,) = [r for r in rows if r.cluster == "b" and r["rank"] == 1]
    assert first.haplotype == twice[N + 3 - 50 : N + 3] + twice[1998 : 1998 + 50]


def test_scores_are_sums_of_likelihoods(spark):
    rng = random.Random(4)
    spelt = {"x": GENOME[100:200], "y": GENOME[101:201]}
    reads = [(k, noisy(GENOME[110:190], rng), "".join(rng.choice("!5I") for _ in range(80))) for k in range(7)]
    found = spark.createDataFrame([("c", i, i, i, s) for i, s in enumerate(spelt.values())], "cluster string, rank int, left long, right long, haplotype string")
    windows = spark.createDataFrame([("c", *r) for r in reads], "cluster string, molecule long, sequence string, qualities string")
    got = {r["rank"]: r.score for r in breakpoints.scores(found, windows).collect()}
    for i, s in enumerate(spelt.values()):
        want = sum(haplotypes.pair_hmm(q, [ord(c) - 33 for c in p], s, band=16) for _, q, p in reads)
        assert got[i] == pytest.approx(want) and np.isfinite(want)
    tied = spark.createDataFrame([("c", 3, 1, 1, -5.0), ("c", 1, 2, 2, -5.0), ("c", 2, 3, 3, -6.0), ("d", 1, 1, 1, float("-inf"))], "cluster string, rank int, left long, right long, score double")
    assert [tuple(r) for r in breakpoints.likeliest(tied).collect()] == [("c", 2, 2)]
