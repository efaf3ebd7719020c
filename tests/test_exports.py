"""Exports, contracts and the stream of files."""

import pytest
from pyspark.sql import functions as F

from annulus.errors import AnalysisError
from annulus.operators import contracts, exports
from annulus.streaming import reads

VARIANT = "position long, ref string, alt string, support long, callable long, level double, ci_low double, ci_high double, gene string, significance string, sources array<string>"


def test_vcf(spark, tmp_path):
    rows = [(9021, "C", "T", 7, 28, 0.25, 0.126828, 0.433592, "MT-ATP6", "likely benign", ["first source", "second"]), (44, "G", "A", 5, 5, 1.0, 0.565509, 1.0, None, None, None)]
    frame = spark.createDataFrame(rows, VARIANT)
    got = {r.position: r.line for r in exports.vcf_lines(frame).collect()}
    info = "AC=7;DP=28;HF=0.250000;GENE=MT-ATP6;CLNSIG=likely_benign;CLNSRC=first_source,second;HF_CI95=0.126828,0.433592"
    assert got[9021] == f"NC_012920.1\t9021\t.\tC\tT\t.\tPASS\t{info}\tGT:HF\t0/1:0.250000"
    assert got[44].endswith("AC=5;DP=5;HF=1.000000;HF_CI95=0.565509,1.000000\tGT:HF\t1/1:1.000000")
    exports.write_vcf(frame, f"{tmp_path}/out", "sample")
    parts = sorted(p for p in (tmp_path / "out").glob("part-*"))
    lines = [x for p in parts for x in p.read_text().splitlines()]
    assert [x[0] == "#" for x in lines] == [True] * 3 + [False] * 2 and "\t44\t" in lines[3]


def test_tsv_and_pages(spark):
    frame = spark.createDataFrame([(1, "a\tb", 0.5), (2, None, None)], "i long, s string, x double")
    assert [r.line for r in exports.tsv_lines(frame, 4).orderBy("line").collect()] == ["1\ta b\t0.5000", "2\t\t"]
    rows = spark.range(10_000).select("id", (F.col("id") * 3).alias("v"))
    paged = exports.pages(rows, "id")
    assert [(r.page, r["first"], r.n) for r in paged.orderBy("page").collect()] == [(0, 0, 4096), (1, 4096, 4096), (2, 8192, 1808)]
    assert exports.unpaged(paged, ["id", "v"]).exceptAll(rows).count() == 0


def test_digests(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    assert exports.digests(spark, [str(tmp_path / "x")]).first().sha256.startswith("ba7816bf8f01cfea")


def test_contracts(spark):
    molecules = spark.createDataFrame([("m",), ("n",)], "molecule string")
    events = spark.createDataFrame([("e", 1), ("f", 0)], "event string, support long")
    seen = spark.createDataFrame([("m", "e", "ALTERNATE"), ("n", "f", "REFERENCE")], "molecule string, event string, state string")
    ranges = spark.createDataFrame([("m", 1, 5), ("m", 7, 9)], "molecule string, start long, end long")
    contracts.require(contracts.evidence_graph(molecules, events, seen, ranges))
    more = seen.union(spark.createDataFrame([("m", "e", "ALTERNATE"), ("o", "g", "REFERENCE")], seen.schema))
    wide = ranges.union(spark.createDataFrame([("m", 4, 6)], ranges.schema))
    broken = {(r.rule, r.what) for r in contracts.evidence_graph(molecules, events, more, wide).collect()}
    assert broken == {("repeated", "m:e"), ("dangling", "o"), ("dangling", "g"), ("disordered", "m"), ("unsupported", "e")}
    with pytest.raises(AnalysisError, match="E9001"):
        contracts.require(contracts.repeated(more, ["molecule", "event"]))
    with pytest.raises(AnalysisError, match="E1601"):
        contracts.within_budget(spark.range(11), 10, "rows")


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        rows = "".join(f"r{i}{k}\t0\tMT\t{k + 1}\t{10 * (k % 2)}\t1M\t*\t0\t0\tA\tI\n" for k in range(4))
        (tmp_path / "in" / f"{i}.sam").write_text("@SQ\tSN:MT\tLN:16569\n" + rows)
    stream = reads.quality_histogram(reads.placements(reads.lines(spark, str(tmp_path / "in"), 1)))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("histogram").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r.mapping_quality, r.n) for r in spark.sql("select * from histogram").collect()} == {(0, 6), (10, 6)}
