"""Resource tables, search, contracts, documents, simulated reads."""

import gzip
import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from annulus.errors import AnalysisError
from annulus.functions import indels
from annulus.operators import comparison, contracts, documents, exports, ordered, reports, search
from annulus.sources import simulator, tables


def test_profiles(spark, tmp_path):
    path = tmp_path / "p.hsd"
    path.write_text('s1\t"16024-576;1000"\t?\t73G\t249DEL\t\n\ns2\t1-16569\t?\t263G\r\n')
    got = {r["sample"]: r for r in tables.read_profiles(spark, str(path)).collect()}
    assert [tuple(x) for x in got["s1"].ranges] == [(1, 576), (1000, 1000), (16024, 16569)] and got["s1"].markers == ["73G", "249d"] and got["s2"].markers == ["263G"]
    for bad in ("s1\t1-2\t?", "s1\t0-2\t?\t1G", "s1\t1-2\t?\t99999DEL", "s 1\t1-2\t?\t1G", "s1\t1-2\t?\t1G\t1G", "s1\t1-2\t?\t1G\ns1\t1-2\t?\t1G", ""):
        path.write_text(bad + "\n")
        with pytest.raises(AnalysisError, match="E1302"):
            tables.read_profiles(spark, str(path))


def test_comparator_table(spark, tmp_path):
    row = dict(zip(tables.COMPARATOR, ("x", "PASS", "150", "c", "T", "0.4", "C", "0.6", "T", "0.4", "10", "6", "4", "1", "150T")))
    path = tmp_path / "v.txt"
    write = lambda r: path.write_text("\t".join([*tables.COMPARATOR, "Extra"]) + "\n" + "\t".join([*r.values(), "e"]) + "\n")
    write(row)
    got = tables.read_comparator(spark, str(path)).first()
    assert (got["sample"], got.position, got.ref, got.alt, got.level, got.coverage, got.forward) == ("x", 150, "C", "T", 0.4, 10, 6)
    for name, value in (("Coverage", "11"), ("Pos", "0"), ("Pos", "x"), ("VariantLevel", "1.2"), ("Ref", "Q"), ("Type", "")):
        write(row | {name: value})
        with pytest.raises(AnalysisError, match="E1302"):
            tables.read_comparator(spark, str(path))


def test_clinical_summary_from_gzip(spark, tmp_path):
    names = ["#AlleleID", "Assembly", "Chromosome", "PositionVCF", "ReferenceAlleleVCF", "AlternateAlleleVCF", "VariationID", "RCVaccession"]
    rows = [["1", "GRCh38", "MT", "10", "A", "G", "77", "R1|R2"], ["2", "GRCh37", "MT", "10", "A", "G", "78", ""], ["3", "GRCh38", "MT", "11", "AT", "G", "79", ""], ["4", "GRCh38", "7", "12", "A", "G", "80", ""]]
    with gzip.open(tmp_path / "s.txt.gz", "wt") as f:
        f.write("\n".join("\t".join(r) for r in [names, *rows]) + "\n")
    curated = spark.createDataFrame([["5", "C", "T", *[""] * 19]], list(tables.ASSERTION))
    got = tables.read_clinical_summary(spark, str(tmp_path / "s.txt.gz"), 9, curated).orderBy("position").collect()
    assert [(r.position, r.accession, r.allele_id) for r in got] == [("10", "R1;R2", "1"), ("5", "", "")] and got[0].url.endswith("/77/")


def test_manifests_and_provenance(spark, tmp_path):
    path = tmp_path / "m.tsv"
    path.write_text("\t".join(tables.MANIFEST) + "\n" + "\t".join("abcdefg") + "\n")
    listed = tables.read_manifest(spark, str(path))
    assert listed.first().path == "c" and tables.overridden(listed, "a", "/x").first().sha256 == "not-verified"
    with pytest.raises(AnalysisError):
        tables.overridden(listed, "z", "/x")
    path.write_text("header\na\tb\n")
    with pytest.raises(AnalysisError):
        tables.read_manifest(spark, str(path))
    import hashlib

    sha = lambda p: hashlib.sha256(p.read_bytes()).hexdigest()
    fields = lambda p, d: p.write_text("field\tvalue\n" + "".join(f"{k}\t{v}\n" for k, v in d.items()))
    bam, bai, index, ref = (tmp_path / n for n in ("competitive.bam", "competitive.bam.bai", "r.fai", "ref.tsv"))
    for p in (bam, bai, index):
        p.write_bytes(p.name.encode())
    fields(ref, {"schema_version": "competitive-reference-1.0", "nuclear_fasta_sha256": "0" * 64, "mitochondrial_fasta_sha256": "1" * 64, "reference_index_path": index, "reference_index_sha256": sha(index)})
    told = {"schema_version": "competitive-mapping-1.1", "numt_assessability": "ASSESSABLE_BY_VERSIONED_COMPETITIVE_ALIGNMENT_INPUT", "output_bam_sha256": sha(bam), "output_bai_sha256": sha(bai),
            "reference_manifest_path": ref, "reference_manifest_sha256": sha(ref), "reference_index_path": index, "reference_index_sha256": sha(index)}
    manifest = tmp_path / "competitive-mapping-manifest.tsv"
    assert tables.numt_provenance(spark, str(bam), True)[1:] == (False, "competitive mapping manifest is absent or malformed")
    fields(manifest, told)
    assert tables.numt_provenance(spark, str(bam), True)[:2] == ("VERIFIED", True)
    assert tables.numt_provenance(spark, str(bam), False)[1] is False and tables.numt_provenance(spark, str(bam), True, False)[0] == "NOT_APPLICABLE"
    for broken in ({"output_bam_sha256": "2" * 64}, {"schema_version": "x"}, {"reference_manifest_sha256": "3" * 64}):
        manifest.unlink()
        fields(manifest, told | broken)
        spark.catalog.clearCache()
        assert not tables.numt_provenance(spark, str(bam), True)[1]
    fields(manifest, told)
    manifest.write_text(manifest.read_text() + "schema_version\tagain\n")
    assert tables.read_fields(spark, str(manifest)) is None


def test_structures(spark, tmp_path):
    path = tmp_path / "s.tsv"
    path.write_text("gene\tx\tpdb\tchain\tcomplex\ty\tranges\tdiffers\nMT-ND1\t.\t1abc\tB\tI\t.\t1-3,9\tA2T,L9F\n")
    got = tables.read_structures(spark, str(path)).orderBy("first").collect()
    assert [(r.first, r.last, r.differs) for r in got] == [(1, 3, [2, 9]), (9, 9, [2, 9])]
    path.write_text("gene\tx\tpdb\tchain\tcomplex\ty\tranges\tdiffers\nMT-ND1\t.\t1abc\tB\tI\t.\t3-1\t\n")
    with pytest.raises(AnalysisError):
        tables.read_structures(spark, str(path))


def test_simulated_reads_are_the_same_whatever_the_partitioning(spark):
    rng = random.Random(5)
    reference = "".join(rng.choice("ACGT") for _ in range(3000))
    edits = [(100, "", "TT"), (500, reference[499:502], ""), (900, reference[899], "ACGT"[("ACGT".index(reference[899]) + 1) % 4])]
    variant = simulator.edited(reference, edits)
    reads = lambda: simulator.simulated_reads(spark, [(reference, 0.7), (variant, 0.3)], 300, simulator.Platform(mean_length=900), seed=8)
    a = reads().collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, reads().repartition(7).collect())) and len(a) == 300
    assert abs(sum(r.component for r in a) / 300 - 0.3) < 0.1 and all(len(r.sequence) == len(r.qualities) for r in a)
    levels = {(p, d, i): v for p, d, i, v in simulator.truth(reference, [([], 0.7), (edits, 0.3)])}
    assert len(levels) == 3 and list(levels.values()) == [pytest.approx(0.3)] * 3
    assert simulator.spiked([(10, "A", "C"), (50, "A", "C")], (49, "AAA", "")) == [(10, "A", "C"), (49, "AAA", "")]
    old = simulator.diverged(reference, 0.1, 3)
    assert abs(len(old) / 3000 - 0.1) < 0.03 and indels.applied(reference, old) != reference
    assert simulator.prefix(reads(), "read", 50, 10_000).agg(F.sum(F.length("sequence"))).first()[0] <= 10_000


def test_search_meets_the_filters(spark):
    rng = random.Random(6)
    rows = [(i, f"m{rng.randrange(4)}", f"e{rng.randrange(3)}", rng.choice(["A", "R"])) for i in range(9000)]
    frame = spark.createDataFrame(rows, "id long, molecule string, event string, state string")
    lists = search.postings(frame, "id")
    for wanted in ({"molecule": "m1"}, {"molecule": "m2", "state": "A", "event": " "}, {"event": "e9"}, {"molecule": None}):
        keep = [r for r in rows if all(not v or not v.strip() or r[1 + search.FIELDS.index(f)] == v for f, v in wanted.items())]
        got = search.search(frame, lists, "id", wanted, 5, 20).collect()
        assert [r.id for r in got] == [r[0] for r in keep[5:25]]
        assert all(r.total == len(keep) and r.next_cursor == (25 if len(keep) > 25 else None) for r in got)
    with pytest.raises(ValueError):
        ordered.page(frame, "id", 0, 501)


def test_architecture_contract(spark):
    molecules = spark.createDataFrame([(f"m{i}",) for i in range(6)], "molecule string")
    found = spark.createDataFrame([("a", 2, ["m0"]), ("b", 2, ["m2"])], "architecture string, members long, representatives array<string>")
    rows = [("m0", "ASSIGNED", "a", []), ("m1", "ASSIGNED", "a", []), ("m2", "ASSIGNED", "b", []), ("m3", "ASSIGNED", "b", []), ("m4", "AMBIGUOUS", None, ["a", "b"]), ("m5", "UNASSIGNED", None, [])]
    table = lambda rows: spark.createDataFrame(rows, "molecule string, status string, architecture string, candidates array<string>")
    assert contracts.architecture_partition(molecules, found, table(rows)).count() == 0
    broken = {"repeated": rows + rows[:1], "unassigned molecule without a row": rows[:5], "dangling": [*rows, ("x", "UNASSIGNED", None, [])], "assigned to no architecture": [("m0", "ASSIGNED", "z", []), *rows[1:]],
              "ambiguous without candidates": [*rows[:4], ("m4", "AMBIGUOUS", None, ["a"]), rows[5]], "kept by an architecture": [*rows[:5], ("m5", "UNASSIGNED", "a", [])],
              "representative isn't a member": [("m0", "ASSIGNED", "b", []), *rows[1:]]}
    for rule, wrong in broken.items():
        assert rule in {r.rule for r in contracts.architecture_partition(molecules, found, table(wrong)).collect()}


def test_documents_and_pages(spark, tmp_path):
    frame = spark.createDataFrame([(2, "b\"\n", 1 / 3), (1, None, float("nan"))], "k long, s string, x double")
    one = documents.document(spark, {"schema_version": "0.5"}, {"rows": (frame, ["k"]), "none": (frame.limit(0), ["k"])}).first().json
    assert json.loads(one) == {"metadata": {"schema_version": "0.5"}, "rows": [{"k": 1, "s": None, "x": None}, {"k": 2, "s": "b\"\n", "x": 0.333333}], "none": []}
    assert "�" in spark.sql("select X'61ff62' as b").select(documents.valid_text(F.col("b")).alias("t")).first().t
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    manifest = exports.write_pages(rows, "id", f"{tmp_path}/pages", 300)
    assert {(r.page, r["first"], r.n, len(r.sha256)) for r in manifest.collect()} == {(0, 0, 300, 64), (1, 300, 300, 64), (2, 600, 300, 64), (3, 900, 100, 64)}
    assert exports.noncontiguous(exports.pages(rows, "id", 300), 300).count() == 0
    assert exports.noncontiguous(exports.pages(rows.where("id <> 5"), "id", 300), 300).count() == 1
    with pytest.raises(AnalysisError):
        documents.projected(rows, ["id", "w"])
    variants = spark.createDataFrame([(9, "A", "G", "b\tc", ["x", "y"], 0.5), (3, "A", "T", None, None, None)], "position long, ref string, alt string, gene string, qc_flags array<string>, heteroplasmy double")
    exports.write_variant_table(variants, f"{tmp_path}/table")
    lines = [x for p in sorted((tmp_path / "table").glob("part-*")) for x in p.read_text().splitlines() if not x.startswith("event_id")]
    assert [x.split("\t")[2] for x in lines] == ["3", "9"] and lines[1].split("\t")[11] == "0.50000000" and "x;y\t" in lines[1] and "b c" in lines[1]
    lost = spark.createDataFrame([("e", False)], "event string, representable boolean")
    with pytest.raises(AnalysisError, match="origin"):
        exports.evidence_vcf_lines(lost)


def test_deletions_are_matched_one_to_one(spark):
    rng = random.Random(7)
    make = lambda n: [(i, rng.randrange(400), rng.choice([60, 61])) for i in range(n)]
    calls, truth = make(60), make(50)
    schema = "event long, start long, length long"
    got = {(r.call, r.true_event) for r in comparison.matched_deletions(spark.createDataFrame(calls, schema), spark.createDataFrame(truth, schema)).collect()}
    pairs = sorted((abs(a[1] - b[1]), a[0], b[0]) for a in calls for b in truth if a[2] == b[2] and abs(a[1] - b[1]) <= 15)
    want, used, taken = set(), set(), set()
    for _, a, b in pairs:
        if a not in used and b not in taken:
            want.add((a, b))
            used.add(a)
            taken.add(b)
    assert got == want
    row = comparison.deletion_scores(spark.createDataFrame(calls, schema), spark.createDataFrame(truth, schema)).first()
    assert (row.tp, row.fp, row.fn) == (len(want), 60 - len(want), 50 - len(want))
    none = spark.createDataFrame([], schema)
    assert comparison.deletion_scores(none, none).first().precision == 1.0


def test_lanes_hold_no_two_at_one_place(spark):
    rng = random.Random(8)
    rows = [(i, i % 2, s, s + rng.randrange(80)) for i in range(200) for s in [rng.randrange(1000)]]
    got = reports.lanes(spark.createDataFrame(rows, "k long, view long, start long, end long"), "view", "start", "end", gap=3).collect()
    held = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.view, r.start, r.end, r.k)):
        free = next((i for i in range(len(held[r.view]) + 1) if i == len(held[r.view]) or held[r.view][i] + 3 < r.start), None)
        assert r.lane == free
        held[r.view][free:free + 1] = [r.end]
    assert Counter(r.k for r in got) == Counter(r[0] for r in rows)
