"""Assembly of molecules by name and by tag."""

from annulus.config import Config
from annulus.operators import molecules

SCHEMA = "record_index long, id string, flags int, mapping_quality int, aux_tags map<string,string>"


def assembled(spark, rows, config):
    return {r.molecule: r for r in molecules.assemble(spark.createDataFrame(rows, SCHEMA), config).collect()}


def test_by_name(spark):
    rows = [(0, "one", 0, 9, {}), (1, "one", 0x800, 60, {}), (2, "two", 0, 1, {}), (3, "two", 0, 50, {}), (4, "none", 0x100, 60, {}), (5, "dup", 0x400, 60, {}), (6, "gone", 4, 0, {})]
    got = assembled(spark, rows, Config())
    assert {k: r.exclusion_reasons for k, r in got.items()} == {
        "one": [],
        "two": ["multiple_primary_alignments"],
        "none": ["no_primary_alignment", "no_usable_primary_alignment"],
        "dup": ["no_usable_primary_alignment"],
        "gone": ["no_usable_primary_alignment"],
    }
    assert got["one"].fragments == [0, 1] and got["one"].representative == 0 and got["two"].representative == 2


def test_by_tag(spark):
    rows = [
        (0, "a1", 0, 30, {"MI": "A", "RX": "ACGT"}),
        (1, "a2", 0x10, 60, {"MI": "A", "RX": "ACGT"}),
        (2, "b1", 0, 60, {"MI": "B", "RX": "AAAA"}),
        (3, "b2", 0, 60, {"MI": "B", "RX": "CCCC"}),
        (4, "m", 0, 60, {"RX": "ACGT"}),
        (5, "c", 0x400, 60, {"MI": "C"}),
        (6, "d", 0, 60, {"MI": "D"}),
        (7, "d", 0x800, 60, {}),
        (8, "x", 0, 60, {"MI": "X"}),
        (9, "x", 0x800, 60, {"MI": "Y"}),
    ]
    got = assembled(spark, rows, Config(result_schema="0.6", molecule_id_tag="MI", umi_tag="RX"))
    assert {k for k, r in got.items() if r.analysis_eligible} == {"A", "D"}
    assert got["A"].source_qnames == ["a1", "a2"] and got["A"].representative == 1 and got["D"].fragments == [6, 7]
    assert got["B"].exclusion_reasons == ["conflicting_umi_values"] and "UNASSIGNED:MI:m" in got and "CONFLICT:MI:x" in got
