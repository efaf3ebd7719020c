"""Substitution calls on reads with known errors and variants, and the fits they rest on."""

import random

import numpy as np
import pytest

from annulus.config import Config
from annulus.functions import stats, text
from annulus.operators import calls
from annulus.sources.alignments import reference_table
from pyspark.sql import functions as F

LENGTH = 300


@pytest.fixture(scope="module")
def genome():
    rng = random.Random(4)
    return "".join(rng.choice("ACGT") for _ in range(LENGTH))


def reads(spark, rows):
    made = spark.createDataFrame(rows, "molecule long, record_index long, flags int, reference_start int, cigar string, sequence string, qualities string")
    return made.withColumn("cigar_operations", text.cigar_operations(F.col("cigar")))


def test_pileup_folds_and_counts_a_molecule_once(spark):
    rows = [(0, 0, 0, 9, "4M", "ACGT", "IIII"), (0, 1, 0x10, 10, "1M1D2M", "CTT", "I!I"), (1, 2, 0x10, 1, "2M", "GN", "II")]
    got = {(r.position, r.base): r for r in calls.pileup(calls.read_bases(reads(spark, rows), Config(), 10)).collect()}
    # positions 9, 10, 1, 2 of the first record; the second adds what is new: position 3 (its base at 2 is poor)
    assert {k: (r.forward, r.reverse, r.near_gap) for k, r in got.items()} == {
        (9, "A"): (1, 0, 0),
        (10, "C"): (1, 0, 0),
        (1, "G"): (1, 1, 0),
        (2, "T"): (1, 0, 0),
        (3, "T"): (0, 1, 1),
    }
    assert got[9, "A"].quality == [0] * 7 + [1] and got[9, "A"].proximity == [1, 0, 0, 0, 0]


def test_calls_find_the_variants_and_little_else(spark, genome):
    rng = random.Random(9)
    swap = {"A": "G", "C": "T", "G": "A", "T": "C"}
    share = {40: 1.0, 120: 0.3, 250: 0.1}
    rows = []
    for m in range(200):
        s = [rng.choice("ACGT".replace(c, "")) if rng.random() < 0.01 else c for c in genome]
        for p, f in share.items():
            s[p - 1] = swap[genome[p - 1]] if rng.random() < f else genome[p - 1]
        if m == 7:  # a stray molecule, far from the rest
            s = [swap[c] if i % 5 == 0 else c for i, c in enumerate(genome)]
        rows.append((m, m, 0x10 if m % 2 else 0, 1, f"{LENGTH}M", "".join(s), "I" * LENGTH))
    reference = reference_table(spark, genome)
    bases = calls.read_bases(reads(spark, rows), Config(), LENGTH)
    assert [r.molecule for r in calls.divergent(bases, calls.consensus(calls.pileup(bases), reference)).where("outlier").collect()] == [7]
    found = calls.call_substitutions(reads(spark, rows), reference, Config(), LENGTH).toPandas()
    passed = found[found["pass"]]
    assert {(r.position, r.alt) for r in passed.itertuples()} == {(p, swap[genome[p - 1]]) for p in share}
    for r in passed.itertuples():
        assert abs(r.fraction - share[r.position]) < 0.08 and r.ci_low <= r.fraction <= r.ci_high and r.depth == 199
    assert set(sum(found[~found["pass"]].filters.map(list), [])) <= {"below_error_floor", "low_support", "not_significant", "one_strand_support", "strand_bias"}


def test_nothing_from_nothing(spark, genome):
    assert calls.call_substitutions(reads(spark, []), reference_table(spark, genome), Config(), LENGTH).isEmpty()


def test_fit_recovers_mean_and_spread():
    rng = np.random.default_rng(1)
    n = np.full(4000, 500)
    mean, rho = 0.02, 0.01
    size = (1 - rho) / rho
    k = rng.binomial(n, rng.beta(mean * size, (1 - mean) * size, 4000))
    got = stats.fit_beta_binomial(k, n, 0.0, 1e-5, 1e-4)
    assert got[0] == pytest.approx(mean, rel=0.05) and got[1] == pytest.approx(rho, rel=0.25) and got[2] == 4000
    assert stats.fit_beta_binomial([], [], 0.01, 2e-5, 2e-4) == (2e-5, 2e-4, 0)


def test_tail_is_pareto():
    rng = np.random.default_rng(2)
    x = 0.001 * (1 - rng.random(50_000)) ** (-1 / 4)
    tail = stats.fit_tail(x, 0, 1e-6)
    assert tail[1] == pytest.approx(0.01) and tail[2] == pytest.approx(4, rel=0.15)
    assert stats.tail_probability(tail, tail[0] * 2) == pytest.approx(0.01 * 2 ** -tail[2]) and stats.tail_probability(tail, 0.0) == 1.0
    assert stats.fit_tail([], 5, 0.1) == (0.1, 0.01, 8.0)
