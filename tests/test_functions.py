"""Functions against closed forms and golden numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from annulus.config import Config
from annulus.errors import AnalysisError
from annulus.functions import coords, genome, stats, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_special_functions():
    assert stats.log_gamma(1001) == pytest.approx(5912.128178488163, rel=1e-12)
    assert stats.beta_binomial_tail(3, 10, 0.1, 0.0) == pytest.approx(0.0701908264, abs=1e-9)
    assert stats.beta_binomial_tail(3, 9, 0.5, 1 / 3) == pytest.approx(0.7)  # uniform on 0 .. 9
    assert stats.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857143, abs=1e-7)
    assert stats.rank_sum_p([5, 0], [0, 5]) < 0.01 and stats.rank_sum_p([3, 3], [3, 3]) == pytest.approx(1)
    rng = np.random.default_rng(1)
    alt = np.where(rng.random(4000) < 0.3, -1.0, -6.0)
    assert stats.allele_fraction(-7.0 - alt, alt)[0] == pytest.approx(0.3, abs=0.02)
    assert stats.fnv1a("") == 0xCBF29CE484222325 and stats.fnv1a("a") == 0xAF63DC4C8601EC8C
    assert int(stats.splitmix64(np.uint64(0))) == 0xE220A8397B1DCDAF


def test_column_statistics(spark):
    low, high = stats.wilson(F.lit(100), F.lit(1000))
    assert value(spark, low) == pytest.approx(0.0829, abs=5e-4) and value(spark, high) == pytest.approx(0.1203, abs=5e-4)
    assert [value(spark, x) for x in stats.wilson(F.lit(0), F.lit(0))] == [0, 0]
    assert value(spark, stats.fisher_combined(F.lit(0.05), F.lit(0.05))) == pytest.approx(0.0025 * (1 - math.log(0.0025)))
    rows = spark.createDataFrame([(i, p) for i, p in enumerate((0.01, 0.04, 0.03, 0.2))], "i int, p double")
    q = {r.i: r.q for r in stats.benjamini_hochberg(rows, "p", ["i"]).collect()}
    assert [q[i] for i in range(4)] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.2])
    one = stats.benjamini_hochberg(rows.where("i = 0"), "p", ["i"], total=F.lit(1000)).first()
    assert one.q == 1
    kept = spark.range(2000).select(stats.in_sample(F.col("id").cast("string"), 3, 7).alias("k")).where("k").count()
    assert 1500 < kept < 1700


def test_circular_coordinates(spark):
    c = lambda x: F.lit(x).cast("long")
    assert [value(spark, coords.fold(c(p))) for p in (0, 1, 16569, 16570)] == [16569, 1, 16569, 1]
    assert value(spark, coords.previous_position(c(1))) == 16569 and value(spark, coords.next_position(c(16569))) == 1
    assert [tuple(x) for x in value(spark, coords.spans(c(16000), c(10)))] == [(16000, 16569), (1, 10)]
    assert value(spark, coords.overlap(c(16000), c(600), c(577), c(647))) == 24
    assert value(spark, coords.interval_length(c(16569), c(1))) == 2
    assert value(spark, coords.midpoint(c(16569), c(3))) in (1, 2)


def test_text_functions(spark):
    s = F.lit
    assert value(spark, text.reverse_complement(s("AACGT"))) == "ACGTT"
    ops = value(spark, text.cigar_operations(s("3S10M2D5I")))
    assert [tuple(o) for o in ops] == [(3, "S"), (10, "M"), (2, "D"), (5, "I")]
    spans = [value(spark, f(text.cigar_operations(s("3S10M2D5I")))) for f in (text.reference_span, text.query_span, text.aligned_bases)]
    assert spans == [12, 18, 10]
    assert [value(spark, text.cigar_is_valid(s(x))) for x in ("10M", "*", "0M", "M", "10M0S", "10M10S")] == [True, True, False, False, False, True]
    words = {"": "not_provided", "Likely Pathogenic": "likely_pathogenic", "Benign/Likely benign": "benign_or_likely_benign", "VUS": "uncertain_significance", "pathogenic; benign": "conflicting", "drug response": "drug_response", "x": "other"}
    for raw, want in words.items():
        assert value(spark, text.significance(s(raw))) == want
    assert value(spark, text.mean_phred(s("II"))) == 40 and value(spark, text.gc_fraction(s("GCAT"))) == 0.5
    assert [value(spark, text.nuclear_contig(s(x))) for x in ("chr1", "22", "MT", "chrM", "X")] == [True, True, False, False, True]
    assert value(spark, text.macro_group(s("L3e"))) == "L3" and value(spark, text.macro_group(s("H1"))) == "H"


def test_genetic_code(spark):
    codes = {"ATG": "M", "ATA": "M", "TGA": "W", "AGA": "*", "TTT": "F", "NNN": "X"}
    assert {k: value(spark, genome.translate_codon(F.lit(k))) for k in codes} == codes
    assert genome.grantham("L", "R") == 102 and genome.grantham("R", "H") == 29 and genome.grantham("X", "A") is None
    assert len(genome.GENES) == 37 and value(spark, genome.three_letter(F.lit("W"))) == "Trp"


def test_configuration_rules():
    Config()
    for wrong in ({"numt_threshold": 1.5}, {"sv_min_length": 0}, {"min_base_quality": 94}, {"umi_tag": "RX"}, {"architecture_optional_fraction": 0.9}):
        with pytest.raises(AnalysisError) as e:
            Config(**wrong)
        assert e.value.code == "E1001"
    assert Config(result_schema="0.6", umi_tag="RX").umi_tag == "RX"
