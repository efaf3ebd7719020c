"""The indel model and calls on made counts and reads, the batch likelihood, stability of architectures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annulus.config import Config
from annulus.functions import haplotypes
from annulus.operators import indel_calls, stability

CORE = "".join(random.Random(1).choices("ACGT", k=600))
SEQUENCE = CORE[:300] + "TG" + "A" * 9 + "C" + CORE[300:]
EVENT = "deletion boolean, left long, right long, allele string, forward long, reverse long"


def test_context_bins():
    context = indel_calls.Context.of(SEQUENCE)
    run = SEQUENCE.index("A" * 9) + 1
    assert context.bin(True, run, "A") == 9 and context.bin(False, run - 1, "A") == 9  # in the run
    assert context.bin(True, run - 1, SEQUENCE[run - 2]) >= 9  # beside it
    repeat = indel_calls.Context.of("GT" + "CAG" * 5 + "TTCG" * 3)
    assert repeat.bin(True, 3, "CAG") == 15 // 3 + 1 and repeat.bin(True, 3, "CA") in (1, 2)
    loci = context.loci()
    assert sum(n for (d, size, _), n in loci.items() if d and size == 1) == sum(SEQUENCE[i] != SEQUENCE[i - 1] for i in range(len(SEQUENCE)))


def test_placeholders(spark):
    reference = "ACGTN" + "ACGT" * 20
    rows = [(True, 8, 8, "A", 1, 1), (True, 40, 40, "A", 1, 1), (True, 8, 8, "ACGTACG", 1, 1)]
    left = indel_calls.without_placeholders(spark.createDataFrame(rows, EVENT), reference).collect()
    assert {(r.left, r.allele) for r in left} == {(40, "A"), (8, "ACGTACG")}


def test_calls_find_what_stands_out(spark):
    rng, n = random.Random(2), len(SEQUENCE)
    noise = [(rng.random() < 0.5, p, p, SEQUENCE[p - 1], rng.randrange(3), rng.randrange(3)) for p in rng.sample(range(1, n), 250)]
    noise = [r for r in noise if r[4] + r[5]]
    true = [(True, 100, 101, SEQUENCE[99:101], 60, 55), (False, 500, 500, "TTTG", 30, 35)]
    one_strand = [(True, 200, 200, SEQUENCE[199], 40, 0)]
    seen = {(r[0], r[1], r[3]) for r in true + one_strand}
    rows = [r for r in noise if (r[0], r[1], r[3]) not in seen] + true + one_strand
    spans = spark.range(1, n + 1).select(F.col("id").alias("position"), F.lit(200).cast("long").alias("n0"), F.lit(190).cast("long").alias("n1"))
    got = {r.id: r for r in indel_calls.call_indels(spark.createDataFrame(rows, EVENT), spans, SEQUENCE, SEQUENCE).collect()}
    passed = {k for k, r in got.items() if r["pass"]}
    assert passed == {f"pdel:100:{SEQUENCE[99:101]}", "pins:500:TTTG"}
    found = got[f"pdel:100:{SEQUENCE[99:101]}"]
    assert found.fraction == pytest.approx(115 / 390, abs=0.01) and found.ci_low < 115 / 390 < found.ci_high
    assert (found.vcf_position, found.vcf_ref, found.vcf_alt) == (99, SEQUENCE[98:101], SEQUENCE[98]) and "counted_without_rescoring" in found.flags
    assert got[f"pdel:200:{SEQUENCE[199]}"].filters[:1] and "strand_bias" in got[f"pdel:200:{SEQUENCE[199]}"].filters
    again = indel_calls.call_indels(spark.createDataFrame(rows[::-1], EVENT).repartition(5), spans, SEQUENCE, SEQUENCE).collect()
    assert {(r.id, round(r.q, 9), tuple(r.filters)) for r in again} == {(k, round(r.q, 9), tuple(r.filters)) for k, r in got.items()}


def test_realignment(spark):
    """Reads of which two fifths lack seven bases, as windows cut from their alignments."""
    rng, left, gone = random.Random(3), 150, 7
    allele = SEQUENCE[left - 1 : left - 1 + gone]
    events = spark.createDataFrame([(True, left, left, allele, 15, 15)], EVENT)
    reads, bases = [], []
    for i in range(50):
        short = i % 5 < 2
        sequence, at = "", []
        for p in range(80, 230):
            if short and left <= p < left + gone:
                continue
            at.append(p)
            sequence += SEQUENCE[p - 1] if rng.random() > 0.02 else rng.choice("ACGT")
        reads.append((i, f"m{i}", i % 2, sequence, "5" * len(sequence)))
        bases += [(i, p, q + 1) for q, p in enumerate(at)]
    windows = indel_calls.read_windows(events, spark.createDataFrame(bases, "record long, position long, query int"), spark.createDataFrame(reads, "record long, molecule string, strand int, sequence string, qualities string"))
    assert windows.count() == 50
    model = indel_calls.Model({}, {(d, z, 0): (0.1, 0.01, 8.0) for d in (True, False) for z in (1, 2, 3)}, {r: 1e-3 for r in range(1, 13)})
    row = indel_calls.realigned(windows, SEQUENCE, model, indel_calls.Context.of(SEQUENCE)).first()
    assert row.fraction == pytest.approx(0.4, abs=0.02) and row.lod > 10 and row.depth0 + row.depth1 == 50
    assert row.alternate0 + row.alternate1 == pytest.approx(20, abs=0.5) == pytest.approx(row.effective, abs=0.5)


def test_batch_likelihood_is_that_of_each_read():
    """Against the plain recursion, cell by cell."""

    def plain(read, error, haplotype, a=1e-3, b=0.3):
        m, stay = len(haplotype), 1 - 2e-3
        match, insert, delete = [0.0] * (m + 1), [0.0] * (m + 1), [1 / m] * (m + 1)
        for base, e in zip(read, error):
            new = [0.0] + [(1 - e if haplotype[j - 1] == base else e / 3) * (stay * match[j - 1] + (1 - b) * (insert[j - 1] + delete[j - 1])) for j in range(1, m + 1)]
            ins = [0.25 * (a * match[j] + b * insert[j]) for j in range(m + 1)]
            gone = [0.0]
            for j in range(1, m + 1):
                gone.append(a * new[j - 1] + b * gone[j - 1])
            match, insert, delete = new, ins, gone
        return np.log10(sum(match) + sum(insert))

    rng = random.Random(4)
    haplotype = "".join(rng.choice("ACGT") for _ in range(40))
    reads = [haplotype[:20], haplotype[5:18] + haplotype[20:33], "ACGT" * 3, "T", ""]
    quality = [[20] * len(r) for r in reads]
    got = haplotypes.pair_hmm_batch(reads, quality, haplotype)
    for r, x in zip(reads[:4], got):
        assert x == pytest.approx(plain(r, [0.01] * len(r), haplotype), abs=1e-9)
    assert got[4] == -np.inf


def test_matching_of_architectures():
    weight = {"a": 3.0, "b": 1.0, "c": 1.0}
    assert stability.similarity({"a", "b"}, {"a"}, weight) == 0.75 and stability.similarity(set(), set(), weight) == 1.0
    found = stability.matched({"x": {"a", "b"}, "y": {"a"}}, {"p": {"a"}, "q": {"c"}}, weight)
    assert found == {"y": ("p", 1.0)}  # the most similar pair first; x finds p taken


def test_stability(spark):
    """Two clear groups of forty molecules come back in every replicate."""
    rows = [(f"m{i}", f"e{1 + i % 2}", "ALTERNATE") for i in range(80)] + [(f"m{i}", f"e{2 - i % 2}", "REFERENCE") for i in range(80)]
    observed = spark.createDataFrame(rows, "molecule string, event string, state string")
    weights = spark.createDataFrame([("e1", 1.0), ("e2", 2.0)], "event string, weight double")
    got = stability.stability(observed.select("molecule").distinct(), observed, weights, Config(architecture_stability_replicates=2)).collect()
    assert len(got) == 2 and all(r.signature_stability == 1.0 and r.recovery_rate == 1.0 and 0 <= r.abundance_sd < 0.2 for r in got)
