"""From a SAM file to calls, a document and exports."""

import json
import random

import pytest
from pyspark.sql import functions as F

from annulus.analyze import analyze
from annulus.config import Config
from annulus.errors import AnalysisError
from annulus.functions.coords import L
from annulus.operators import contracts, documents, result_contracts

REFERENCE = "".join(random.Random(41).choices("ACGT", k=L))
OTHER = {b: "ACGT"[("ACGT".index(b) + 1) % 4] for b in "ACGT"}


@pytest.fixture(scope="module")
def sample(tmp_path_factory):
    """160 reads of 900 bases over a stretch: half with a changed base, a third without three bases, a few with a large gap."""
    rng, rows = random.Random(42), []
    for i in range(160):
        start = 5000 + rng.randrange(300)
        noisy = lambda s: "".join(b if rng.random() > 0.004 else OTHER[b] for b in s)
        sequence, cigar = REFERENCE[start - 1 : start + 899], "900M"
        if i % 2 == 0:
            at = 5600 - start
            sequence = sequence[:at] + OTHER[sequence[at]] + sequence[at + 1 :]
        if i % 3 == 0:
            at = 5700 - start
            sequence, cigar = sequence[:at] + sequence[at + 3 :], f"{at}M3D{897 - at}M"
        if i % 20 == 1:
            at = 5450 - start
            sequence, cigar = REFERENCE[start - 1 : start - 1 + at] + REFERENCE[5949 : 5949 + 900 - at], f"{at}M500D{900 - at}M"
        rows.append((f"r{i}", 16 * (i // 2 % 3 % 2), "MT", start, 60, cigar, "*", 0, 0, noisy(sequence), "5" * len(sequence)))
    rows.append(("nuclear", 0, "chr1", 5200, 60, "300M", "*", 0, 0, REFERENCE[5199:5499], "5" * 300))
    path = tmp_path_factory.mktemp("sam") / "reads.sam"
    head = "@HD\tVN:1.6\n@SQ\tSN:MT\tLN:16569\n@SQ\tLN:9\tSN:chr1\n"
    path.write_text(head + "".join("\t".join(map(str, r)) + "\n" for r in rows))
    return str(path)


@pytest.fixture(scope="module")
def found(spark, sample):
    base = OTHER[REFERENCE[5599]]
    rows = [("H1", 0, 5600, "substitution", None, base, f"5600{base}"), ("H1", 0, 9000, "substitution", None, "A", "9000A"), ("K2", 1, 5600, "deletion", None, None, "5600d")]
    definitions = spark.createDataFrame(rows, "name string, source_order int, position long, kind string, index string, bases string, encoded string")
    return analyze(spark, sample, REFERENCE, Config(), definitions)


def test_calls(found):
    assert {r.id for r in found.reads.where("numt").collect()} == {"nuclear"}
    changed = {(r.position, r.alt): r for r in found.substitutions.where("pass").collect()}
    assert set(changed) == {(5600, OTHER[REFERENCE[5599]])}
    row = changed[5600, OTHER[REFERENCE[5599]]]
    assert row.fraction == pytest.approx(80 / 152, abs=0.03)  # eight reads lack the place
    (indel,) = found.indels.where("pass").collect()
    assert indel.deletion and indel.length == 3 and indel.left <= 5700 <= indel.right and indel.rescored and indel.fraction == pytest.approx(1 / 3, abs=0.06)
    (large,) = found.deletions.collect()
    assert large.length == 500 and large.support == 8 and large.wild_left > 20 and large.depth_ratio is None  # most of the genome has no reads


def test_lineage_and_effects(found):
    assert [(r.name, r.matched, r.missing) for r in found.lineages.collect()] == [("H1", [f"5600{OTHER[REFERENCE[5599]]}"], [])]
    assert {r.gene for r in found.effects.collect()} == {"MT-TA"}  # 5587-5655


def test_document_fits_the_contract(spark, found, tmp_path):
    """The document holds all sections of its schema, whole and as sections of lines."""
    whole = found.document("me").select(F.lit("me").alias("name"), "json").cache()
    contracts.require(contracts.document(whole))
    assert result_contracts.broken(whole).collect() == []
    held = json.loads(whole.first().json)
    stats = held["filter_stats"]
    assert stats["input_alignment_records"] == 161 and stats["passed_reads"] == 160 == len([r for r in held["reads"] if not r["filtered_numt"]])
    assert stats["numt_assessment"] == {"mode": "mt_only_or_unknown", "nuclear_contigs_present": True, "specificity_assessable": False, "provenance_status": "NOT_VERIFIED", "provenance_reason": "competitive mapping manifest is absent or malformed"}
    assert any(x["event_id"] == "deletion:5450-5949" and x["support"] == 8 for x in held["svs"]) and held["clusters"][0]["cluster"] == -1
    documents.write_sections(spark, str(tmp_path / "s"), found.metadata("me"), {"reads": (found.features, ["record_index"]), "coverage": (found.coverage, ["bin"])}, {"filter_stats": stats})
    rows = [json.loads(x) for p in sorted((tmp_path / "s/sections/reads").glob("part-*")) for x in p.read_text().splitlines()]
    assert rows == held["reads"] and [r["record_index"] for r in rows] == sorted(r["record_index"] for r in rows)
    assert {r.section: r.rows for r in spark.read.json(str(tmp_path / "s/manifest")).collect()} == {"reads": 161, "coverage": 180}
    with pytest.raises(AnalysisError, match="E1601"):
        documents.document(spark, {}, {"reads": (spark.range(11), ["id"])}, most=10)


def test_input_budget(spark, sample):
    with pytest.raises(AnalysisError, match="E1601.*161 records"):
        analyze(spark, sample, REFERENCE, Config(max_input_records=100))
    with pytest.raises(AnalysisError, match="E1601.*bases"):
        analyze(spark, sample, REFERENCE, Config(max_input_bases=1000))


def test_document_and_exports(spark, found, tmp_path):
    found.write(str(tmp_path), "me")
    text = "".join(p.read_text() for p in (tmp_path / "document").glob("part-*"))
    held = json.loads(text)
    assert held["metadata"]["sample"] == "me" and [x["position"] for x in held["substitutions"]] == [5600] and len(held["indels"]) == 1 and len(held["coverage"]) == 180
    vcf = [x for p in sorted((tmp_path / "vcf").glob("part-*")) for x in p.read_text().splitlines() if not x.startswith("#")]
    assert len(vcf) == 1 and vcf[0].split("\t")[1] == "5600" and "GENE=MT-TA" in vcf[0]
    assert found.coverage.agg(F.max("mean_depth")).first()[0] > 100


def test_one_haplotype_is_the_sample(found):
    assert [(r.haplotype, r.fraction) for r in found.haplotypes.summary.collect()] == [(0, 1.0)]
    assert [(r.name, r.cluster) for r in found.haplotype_lineages.collect()] == [("H1", 0)]
    assert found.clusters.where("not outlier and cluster = 0").count() == found.haplotypes.members.count() > 140


def test_two_haplotypes_from_a_file(spark, tmp_path):
    """A quarter of the reads has its own bases at four places, the others at two more."""
    rng, rows = random.Random(7), []
    minor, major = (5350, 5480, 5610, 5740), (5400, 5660)
    for i in range(200):
        start, sites = 5000 + rng.randrange(250), minor if i % 4 == 0 else major
        bases = list(REFERENCE[start - 1 : start + 899])
        for p in sites:
            bases[p - start] = OTHER[bases[p - start]]
        bases = "".join(b if rng.random() > 0.003 else OTHER[b] for b in bases)
        rows.append((f"r{i}", 16 * (i // 4 % 2), "MT", start, 60, "900M", "*", 0, 0, bases, "5" * 900))
    path = tmp_path / "two.sam"
    path.write_text("".join("\t".join(map(str, r)) + "\n" for r in rows))
    known = [(name, order, p, "substitution", None, OTHER[REFERENCE[p - 1]], f"{p}{OTHER[REFERENCE[p - 1]]}") for order, (name, sites) in enumerate((("H5", major), ("U2", minor))) for p in sites]
    definitions = spark.createDataFrame(known, "name string, source_order int, position long, kind string, index string, bases string, encoded string")
    found = analyze(spark, str(path), REFERENCE, Config(), definitions, realign=False)
    told = {r.haplotype: r for r in found.haplotypes.summary.collect()}
    assert told[0].fraction == pytest.approx(0.75, abs=0.02) and told[1].molecules == 50
    own = {int(x.split(":")[1]) for x in told[1].defining}
    assert len(own) >= 4 and own <= {*minor, *major}  # a call may miss one of the filters
    assert {(r.cluster, r.name) for r in found.haplotype_lineages.where("rank = 1").collect()} == {(0, "H5"), (1, "U2")}
    assert {r.cluster: r["count"] for r in found.clusters.groupBy("cluster").count().collect()} == {0: 150, 1: 50}
