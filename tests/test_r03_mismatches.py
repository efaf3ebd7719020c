"""Only alignments longer than the genome become a row for each base."""

from __future__ import annotations

from annulus.config import Config
from annulus.functions import text
from annulus.operators import alignments
from annulus.sources.alignments import reference_table
from pyspark.sql import functions as F


def test_mismatches_within_the_row(spark, monkeypatch):
    reference, n = "ACGTTGCAAN", 10
    rows = [(1, 1, "4M", "ACGA"), (2, 8, "5M", "AANCC"), (3, 1, "2M1D3M", "ACTGG"), (4, 3, "12M", "GTTGCAANACCT"), (5, 2, "4M", "cgtt")]
    reads = spark.createDataFrame([(i, f"r{i}", s, c, q, "I" * len(q)) for i, s, c, q in rows], "record_index long, id string, reference_start int, cigar string, sequence string, qualities string")
    reads = reads.withColumn("cigar_operations", text.cigar_operations(F.col("cigar")))
    table, names = reference_table(spark, reference), ("record_index", "position", "ref", "alt")
    plain, exploded = alignments.aligned_bases, []
    want = {tuple(r) for r in alignments.mismatches(plain(reads, n), table, Config()).select(*names).collect()}
    monkeypatch.setattr(alignments, "aligned_bases", lambda df, length: exploded.append({r.record_index for r in df.collect()}) or plain(df, length))
    got = [tuple(r) for r in alignments.read_mismatches(reads, reference, table, Config()).select(*names).collect()]
    assert set(got) == want and len(got) == len(want) and exploded == [{4}]
