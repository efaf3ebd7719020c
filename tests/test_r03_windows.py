"""what is asked of reads is asked of few of them, and few slow rows are dealt to all tasks."""

from annulus.operators import breakpoints

MEMBERS = "cluster string, molecule long, left long, right long, length long, raw_left long, strand string, record long, query int, size int"


def _reads(spark):
    rows = [(m, m, 0, "ACGT" * 50, "I" * 200) for m in range(60)]
    return spark.createDataFrame(rows, "record_index long, molecule long, flags int, sequence string, qualities string")


def test_only_split_alignments_ask_for_their_molecule(spark, monkeypatch):
    asked, plain = [], breakpoints.representatives
    monkeypatch.setattr(breakpoints, "representatives", lambda reads: asked.append({r.molecule for r in reads.collect()}) or plain(reads))
    gaps = [("c", m, 10, 90, 79, 10, "+", m, 100, 200) for m in range(5)]
    split = [("d", m, 10, 90, 79, 10, "+", None, 100, None) for m in (7, 8)]
    got = breakpoints.read_windows(spark.createDataFrame(gaps + split, MEMBERS), _reads(spark), 900).collect()
    assert asked == [{7, 8}]
    assert {(r.cluster, r.molecule, r.i) for r in got} == {*(("c", m, m + 1) for m in range(5)), ("d", 7, 1), ("d", 8, 2)}
    assert {(r.sequence, r.qualities) for r in got} == {(("ACGT" * 50)[60:140], "I" * 80)}


def test_reads_are_not_shuffled_with_their_bases(spark):
    gaps = [("c", m, 10, 90, 79, 10, "+", m, 100, 200) for m in range(50)]
    found = breakpoints.read_windows(spark.createDataFrame(gaps, MEMBERS), _reads(spark), 900)
    assert found.count() == breakpoints.READS
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_fits_are_dealt_to_all_tasks(spark):
    found = spark.createDataFrame([("c", i, 10, 90 + i, "ACGT" * 25) for i in range(40)], "cluster string, rank int, left long, right long, haplotype string")
    windows = spark.createDataFrame([("c", "ACGT" * 20, "I" * 80)] * 3, "cluster string, sequence string, qualities string")
    scored = breakpoints.scores(found, windows)
    assert scored.count() == 40
    assert 'REPARTITION_BY_NUM' in scored._jdf.queryExecution().executedPlan().toString()
