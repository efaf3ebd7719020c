"""From SAM text to levels and structural events."""

import pytest
from pyspark.sql import functions as F

from annulus.config import Config
from annulus.errors import AnalysisError
from annulus.operators import alignments, evidence, intervals
from annulus.sources import alignments as source

L = 16569


def sam(tmp_path, *rows):
    path = tmp_path / "reads.sam"
    path.write_text("@HD\tVN:1.6\n" + "".join("\t".join(map(str, r)) + "\n" for r in rows))
    return str(path)


def row(name, position, cigar, sequence, flags=0, mapq=60, contig="MT", quality=None, *tags):
    return (name, flags, contig, position, mapq, cigar, "*", 0, 0, sequence, quality or "I" * len(sequence), *tags)


def test_levels_with_interval(spark, tmp_path):
    """Three molecules with T and two with C at 1504; one on a nuclear contig is no molecule."""
    rows = [row(f"m{i}", 1500, "10M", "TTGA" + ("T" if i < 3 else "C") + "CAGTC") for i in range(5)] + [row("elsewhere", 1500, "10M", "T" * 10, contig="chr3")]
    reads = source.read_sam(spark, sam(tmp_path, *rows))
    config = Config()
    scored = alignments.with_numt(reads, config)
    assert {r.id for r in scored.where("numt").collect()} == {"elsewhere"}
    bases = alignments.aligned_bases(scored.where(~F.col("numt")).where(alignments.passes_filters(config)))
    best = evidence.best_observation(bases.select(F.col("id").alias("molecule"), F.col("record_index").alias("fragment"), "position", "query", "base", "quality"))
    reference = source.reference_table(spark, "N" * 1499 + "TTGACCAGTC")
    found = evidence.variants(evidence.locus_levels(best), reference).collect()
    assert len(found) == 1 and (found[0].position, found[0].ref, found[0].alt, found[0].support, found[0].callable) == (1504, "C", "T", 3, 5)
    # the bounds are the shares q at which 3 of 5 is 1.96 standard errors away: (q - 0.6)^2 = z^2 q (1 - q) / 5
    for bound in (found[0].ci_low, found[0].ci_high):
        assert (bound - 0.6) ** 2 == pytest.approx(1.959963984540054**2 * bound * (1 - bound) / 5)
    assert found[0].level == 0.6 and found[0].ci_low < 0.6 < found[0].ci_high


def test_bases_wrap_the_origin(spark, tmp_path):
    reads = source.read_sam(spark, sam(tmp_path, row("a", L - 1, "2S2M1D2M", "TTACGT")))
    got = {(r.position, r.base) for r in alignments.aligned_bases(reads).collect()}
    assert got == {(L - 1, "A"), (L, "C"), (2, "G"), (3, "T")}


def test_split_events(spark, tmp_path):
    rows = [
        row("del", 100, "10M10S", "A" * 20, 0, 60, "MT", None, "SA:Z:MT,300,+,10S10M,60,0;"),
        row("origin", 16550, "10M10S", "A" * 20, 0, 60, "MT", None, "SA:Z:MT,20,+,10S10M,60,0;"),
        row("dup", 1000, "10M10S", "A" * 20, 0, 60, "MT", None, "SA:Z:MT,1000,+,10S10M,60,0;"),
        row("inv", 500, "10M10S", "A" * 20, 0, 60, "MT", None, "SA:Z:MT,800,-,10M10S,60,0;"),
        row("ins", 1200, "10M20S", "A" * 30, 0, 60, "MT", None, "SA:Z:MT,1210,+,20S10M,60,0;"),
        row("far", 1200, "10M20S", "A" * 30, 0, 60, "MT", None, "SA:Z:chr1,1210,+,20S10M,60,0;"),
    ]
    reads = source.read_sam(spark, sam(tmp_path, *rows))
    got = {r.id: r.event_id for r in alignments.split_events(alignments.segments(reads), Config()).collect()}
    assert got == {"del": "deletion:110-299", "origin": "circular_origin:16559-20", "dup": "duplication:1000-1009", "inv": "inversion:509-809", "ins": "insertion:1209+10"}
    again = source.read_sam(spark, sam(tmp_path, *rows, ("del2", *rows[0][1:])))
    events = alignments.split_events(alignments.segments(again), Config())
    merged = {r.event_id: (r.support, r.length, r.orientations) for r in alignments.merged_events(events).collect()}
    assert merged["deletion:110-299"] == (2, 190, ["+/+"]) and len(merged) == 5
    assert {tuple(r) for r in alignments.event_members(events).where("event_id like 'del%'").collect()} == {("deletion:110-299", "del"), ("deletion:110-299", "del2")}


def test_cigar_events(spark, tmp_path):
    rows = [row("a", 100, "10M12D10M15I10M13S", "A" * 58)]
    got = sorted(r.event_id for r in alignments.cigar_events(source.read_sam(spark, sam(tmp_path, *rows)), Config()).collect())
    assert got == ["deletion:110-121", "insertion:131+15", "soft_clip_right:141+13"]


@pytest.mark.parametrize(
    "bad",
    [
        row("a", 1, "9M", "ACGTACGTAC"),
        row("a", 1, "0M10M", "ACGTACGTAC"),
        row("a", 1, "10M", "ACGTACGTAC", 70000),
        row("a", 1, "10M", "ACGTACGTAC", 0, 256),
        row("a", 1, "10M", "ACGTACGTAC", 0, 60, "MT", "II"),
        row("a", 1, "10M", "ACGTACGTAC", 0, 60, "MT", None, "SA:Z:MT,0,+,10M,60,0;"),
    ],
)
def test_malformed_records_fail(spark, tmp_path, bad):
    with pytest.raises(Exception, match="E1103"):
        source.read_sam(spark, sam(tmp_path, bad)).collect()


def test_fastq_and_reference(spark, tmp_path):
    (tmp_path / "r.fastq").write_text("".join(f"@read{i} note\nACGT\n+\nII@I\n\n" for i in range(50)))
    got = source.read(spark, str(tmp_path / "r.fastq")).orderBy("record_index").collect()
    assert [r.id for r in got] == [f"read{i}" for i in range(50)] and got[0].qualities == "II@I"
    (tmp_path / "x.fa").write_text(">one\nACGT\nNN\n")
    assert source.read_reference(spark, str(tmp_path / "x.fa")) == "ACGTNN"
    (tmp_path / "y.fa").write_text(">one\nACGT\n>two\nA\n")
    with pytest.raises(AnalysisError, match="E1202"):
        source.read_reference(spark, str(tmp_path / "y.fa"))
    with pytest.raises(AnalysisError, match="E1101"):
        source.read(spark, "x.bam")


def test_ranges(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 6, 9), ("a", 12, 20), ("a", 13, 14), ("b", 3, 4)], "k string, start long, end long")
    assert {tuple(r) for r in intervals.merged(rows, ["k"]).collect()} == {("a", 1, 9), ("a", 12, 20), ("b", 3, 4)}
    points = spark.createDataFrame([(1,), (2,), (4,), (5,), (6,)], "position long")
    assert {tuple(r) for r in intervals.islands(points, [], "position").collect()} == {(1, 2), (4, 6)}
    deep = {r.position: r.depth for r in intervals.depth(rows.select("start", "end"), 20).collect()}
    assert deep == {p: sum(a <= p <= b for a, b in ((1, 5), (6, 9), (12, 20), (13, 14), (3, 4))) for p in range(1, 21)}


def test_header_contigs_and_costs(spark, tmp_path):
    line = lambda name, cigar, seq: f"{name}\t0\tMT\t5\t60\t{cigar}\t*\t0\t0\t{seq}\t{'I' * len(seq)}\n"
    one, two = tmp_path / "a.sam", tmp_path / "b.sam"
    one.write_text("@HD\tVN:1.6\n@SQ\tSN:MT\tLN:9\r\n@SQ\tLN:9\tSN:chr2\n@PG\tSN:chr9\n" + line("r1", "4M9000N4M", "ACGTACGT") + "@SQ\tSN:chr7\tLN:1\n")
    two.write_text(line("r2", "200M", "ACGT" * 50))
    assert source.header_contigs(spark, str(one)) == ["MT", "chr2"] and source.header_contigs(spark, str(two)) == []
    assert source.nuclear(spark, ["MT", "chr2"]) and not source.nuclear(spark, ["MT"]) and not source.nuclear(spark, [])
    assert source.numt_assessment(spark, str(two))["provenance_reason"] == "alignment header has no nuclear contigs"
    assert source.numt_assessment(spark, str(one))["nuclear_contigs_present"]
    costs = {r.id: r.cost for r in source.read_sam(spark, str(two)).union(source.read_sam(spark, str(one)).where("id = 'r1'")).collect()}
    assert costs == {"r1": 9008, "r2": 200}
    (tmp_path / "g.fa").write_text(">g\nACGT\n")
    assert source.read_reference(spark, str(tmp_path / "g.fa"), 4) == "ACGT"
    with pytest.raises(AnalysisError, match="E1202"):
        source.read_reference(spark, str(tmp_path / "g.fa"), 16569)
