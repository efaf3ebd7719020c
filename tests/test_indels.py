"""Placements of indels on a circle against brute force; likelihoods and mixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annulus.functions import haplotypes, indels


def changed(reference, position, bases, insertion):
    """The changed circle, turned to its least rotation."""
    n = len(reference)
    turned = reference[position % n :] + reference[: position % n] if insertion else reference[position - 1 :] + reference[: position - 1]
    s = bases + turned if insertion else turned[len(bases) :]
    return min(s[i:] + s[:i] for i in range(len(s)))


@pytest.mark.parametrize("insertion", [True, False])
def test_placements_give_the_same_circle(insertion):
    rng = random.Random(insertion)
    for _ in range(300):
        reference = "".join(rng.choice("AC") for _ in range(14)) + "GT"
        position, size = rng.randrange(1, 17), rng.randrange(1, 4)
        bases = "".join(rng.choice("AC") for _ in range(size)) if insertion else "".join(indels._at(reference, position + i) for i in range(size))
        place = indels.placements(reference, position, bases, insertion)
        circle = changed(reference, position, bases, insertion)
        assert changed(reference, place.left, place.left_bases, insertion) == circle
        assert changed(reference, place.right, place.right_bases, insertion) == circle
        again = indels.placements(reference, place.right, place.right_bases, insertion)
        assert (again.left, again.right, again.shift) == (place.left, place.right, place.shift)


def test_names_and_repeats(spark):
    reference = "GACACACTTTTTTGCA"
    assert indels.hgvs(2, "AC", False, reference) == "m.6_7del"
    assert indels.hgvs(7, "T", True, reference) == "m.13dup" and indels.hgvs(1, "CC", True, reference) == "m.1_2insCC"
    assert indels.homopolymer_run(reference, 9) == 6 and indels.homopolymer_run("ACGA", 1) == 2
    context = indels.repeat_context(reference)
    assert context[2] == (2, 6) and context[9] == (1, 6) and context[14] == (0, 0)
    assert indels.applied("ACGT", [(2, "C", "TT"), (4, "", "G")]) == "ATTGGT"
    kept = "TTACGAAAAACGCC"
    assert indels.junction(kept, 5, 13) == (2, 10, 3)  # ACG stands at either end of what is deleted
    assert kept[:5] + kept[12:] == kept[:2] + kept[9:] and indels.junction_haplotype(kept, 2, 10, 2) == "TTAC"
    assert indels.junction(kept, 5, 12)[2] == 0
    frame = spark.createDataFrame([(12, "T", False)], "p long, b string, i boolean")
    got = frame.select(indels.leftmost(reference)("p", "b", "i").alias("x")).first().x
    assert (got.position, got.bases) == (8, "T") and frame.select(F.col("p")).count() == 1


def test_pair_hmm_prefers_the_true_haplotype():
    a, b = "ACGTTGCAACGGTACCGATTACA", "ACGTTGCAACGGACCGATTACA"
    read = b[3:20]
    q = [30] * len(read)
    assert haplotypes.pair_hmm(read, q, b) > haplotypes.pair_hmm(read, q, a) + 1
    assert haplotypes.pair_hmm(read, q, b, band=8) == pytest.approx(haplotypes.pair_hmm(read, q, b), abs=0.5)
    assert haplotypes.pair_hmm("", [], a) == -np.inf
