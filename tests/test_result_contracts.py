"""Result contracts: a sound document of the evidence graph, and one break of each rule."""

import copy
import json

import pytest

from annulus.operators import result_contracts

COLUMNS = result_contracts.COLUMNS


def wilson(k, n):
    z = 1.959963984540054
    p, d = k / n, 1 + z * z / n
    c, m = (p + z * z / (2 * n)) / d, z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5 / d
    return max(0.0, c - m), min(1.0, c + m)


def sound():
    seen = [("m0", "e0", "ALTERNATE"), ("m0", "e1", "ALTERNATE"), ("m1", "e0", "REFERENCE"), ("m1", "e1", "ALTERNATE"), ("m2", "e0", "LOW_QUALITY"), ("m2", "e1", "REFERENCE")]
    pages = []
    for k in range(0, len(seen), 4):
        part = seen[k : k + 4]
        columns = {c: ["x"] * len(part) for c in COLUMNS} | {"molecule_id": [r[0] for r in part], "event_id": [r[1] for r in part], "state": [r[2] for r in part]}
        pages.append({"index": k // 4, "offset": k, "count": len(part), "columns": columns})
    event = lambda i, p, support: {"id": i, "type": "SNV", "start": p, "end": p, "ref": "A", "alt": "G", "assessability": "REFERENCE_AND_ALTERNATE", "supporting_molecule_ids": support}
    variant = lambda i, p, n, support: {"event_id": i, "type": "SNV", "position": p, "start": p, "end": p, "ref": "A", "alt": "G", "alt_depth": n[0], "ref_depth": n[1], "other_depth": 0, "event_absent_depth": 0, "low_quality_depth": n[2], "conflict_depth": 0, "callable_depth": n[0] + n[1], "supporting_molecule_ids": support}
    low, high = wilson(1, 2)
    link = {"event_a_id": "e0", "event_b_id": "e1", "id": "phase:e0|e1", "assessability": "COMPLETE_FOR_BOTH_EVENTS", "both_alternate": 1, "a_alternate_b_absent": 0, "a_absent_b_alternate": 1, "neither_alternate": 0, "jointly_uncertain": 1, "jointly_callable": 2,
            "co_alternate_fraction": 0.5, "co_alternate_ci95_low": low, "co_alternate_ci95_high": high, "expected_co_alternate_fraction": 0.5, "linkage_delta": 0.0, "supporting_molecule_indices": [0], "uncertain_molecule_indices": [2], "qc_flags": ["UNCERTAIN_COOCCURRENCE_EXCLUDED"]}
    molecule = lambda i, status, alternates, **more: {"id": f"m{i}", "index": i, "evidence_eligible": status != "INELIGIBLE", "alternate_event_ids": alternates, "architecture_assignment": {"status": status, **more}}
    profile = {"event_id": "e1", "alternate": 2, "absent": 0, "uncertain": 0, "not_callable": 0, "alternate_fraction": 1.0, "consensus_state": "ALTERNATE"}
    return {
        "metadata": {"schema_version": "0.6", "sv_event_schema_version": "1", "complex_sv_event_schema_version": "1", "clinical_annotation_schema_version": "1", "engine_version": "1", "reference_length": 16569, "resources": []},
        "filter_stats": {"numt_assessment": {}, "passed_reads": 3},
        "reads": [], "svs": [], "complex_events": [], "clusters": [], "alignments": [],
        "evidence_encoding": {**result_contracts.ENCODING, "observation_count": 6, "observation_page_count": 2, "observation_page_size": 4},
        "molecules": [molecule(0, "ASSIGNED", ["e0", "e1"], architecture_id="a"), molecule(1, "ASSIGNED", ["e1"], architecture_id="a"), molecule(2, "UNASSIGNED", []), molecule(3, "INELIGIBLE", [])],
        "callability": [{"molecule_id": f"m{i}", "known": True, "callable_bases": 10} for i in range(3)],
        "events": [event("e0", 100, ["m0"]), event("e1", 200, ["m0", "m1"])],
        "observation_pages": pages,
        "variants": [variant("e0", 100, (1, 1, 1), ["m0"]), variant("e1", 200, (2, 1, 0), ["m1", "m0"])],
        "phase_links": [link],
        "architecture_inference": {"eligible_molecules": 3, "assigned_molecules": 2, "ambiguous_molecules": 0, "unassigned_molecules": 1, "candidate_count": 1},
        "architectures": [{"architecture_id": "a", "member_molecule_indices": [0, 1], "molecule_count": 2, "estimated_fraction": 2 / 3, "defining_event_signature": ["e1"], "seed_event_signature": ["e1"], "optional_event_ids": [], "ambiguous_molecule_ids": [], "event_profile": [profile], "method": {"not_callable_is_reference": False}}],
    }


def put(path, value):
    def change(d):
        *way, last = path
        for step in way:
            d = d[step]
        if value is KeyError:
            del d[last]
        else:
            d[last] = value

    return change


A, L, V, E, M, P = ("architectures", 0), ("phase_links", 0), ("variants", 0), ("events", 0), ("molecules",), ("observation_pages", 0)
BREAKS = {
    "no reads": (put(("reads",), KeyError), {"must be array"}),
    "length is text": (put(("metadata", "reference_length"), "16569"), {"must be unsigned"}),
    "negative": (put(("filter_stats", "passed_reads"), -1), {"must be unsigned"}),
    "statistics": (put(("filter_stats",), []), {"must be object", "must be unsigned"}),
    "rows": (put(("observations",), []), {"must be absent"}),
    "schema": (put(("metadata", "schema_version"), "0.7"), {"unknown schema"}),
    "encoding": (put(("evidence_encoding", "layout"), "rows"), {"unknown encoding"}),
    "page size": (put(("evidence_encoding", "observation_page_size"), 0), {"out of range", "too large"}),
    "page order": (put((*P, "offset"), 1), {"not contiguous"}),
    "page columns": (put((*P, "columns", "strand"), []), {"columns of unequal length"}),
    "pages": (put(("evidence_encoding", "observation_page_count"), 3), {"number of pages"}),
    "rows of pages": (put(("evidence_encoding", "observation_count"), 5), {"number of observations"}),
    "large page": (put(("evidence_encoding", "observation_page_size"), 3), {"too large"}),
    "event twice": (put(("events", 1, "id"), "e0"), {"repeated", "unknown event"}),
    "unassessed": (put((*E, "assessability"), None), {"incomplete"}),
    "molecule order": (put((*M, 1, "index"), 7), {"out of order or incomplete"}),
    "state": (put((*P, "columns", "state"), ["ALTERNATE", "ALTERNATE", "REFERENCE", "?"]), {"unknown state"}),
    "unknown event": (put((*P, "columns", "event_id"), ["e0", "e1", "e0", "e9"]), {"unknown event"}),
    "observed twice": (put((*P, "columns", "event_id"), ["e0", "e0", "e0", "e1"]), {"repeated"}),
    "depth": (put((*V, "ref_depth"), 9), {"not counted from observations"}),
    "variant of another event": (put((*V, "position"), 101), {"not its event"}),
    "no source": (put((*V, "event_id"), "e7"), {"no source event", "no variant"}),
    "support": (put((*V, "supporting_molecule_ids"), []), {"other support than its event"}),
    "link id": (put((*L, "id"), "phase:e1|e0"), {"id"}),
    "link order": (put((*L, "event_a_id"), "e9"), {"not derived from evidence", "missing", "id"}),
    "link counts": (put((*L, "neither_alternate"), 1), {"not derived from evidence"}),
    "link share": (put((*L, "linkage_delta"), 0.1), {"not derived from evidence"}),
    "link flags": (put((*L, "qc_flags"), []), {"not derived from evidence"}),
    "link molecules": (put((*L, "uncertain_molecule_indices"), [1]), {"not derived from evidence"}),
    "assessability": (put((*L, "assessability"), "SUPPORT_CONDITIONED"), {"not derived from evidence"}),
    "no links": (put(("phase_links",), []), {"missing"}),
    "members": (put((*A, "molecule_count"), 3), {"number of members"}),
    "abundance": (put((*A, "estimated_fraction"), 0.5), {"abundance"}),
    "semantics": (put((*A, "method", "not_callable_is_reference"), True), {"takes what isn't callable for reference"}),
    "ineligible member": (put((*A, "member_molecule_indices"), [0, 3]), {"member isn't eligible", "isn't a member of its architecture"}),
    "signature": (put((*A, "seed_event_signature"), ["e9"]), {"unknown event"}),
    "signature twice": (put((*A, "optional_event_ids"), ["e0", "e0"]), {"repeated event"}),
    "profile sum": (put((*A, "event_profile", 0, "uncertain"), 1), {"doesn't partition the members"}),
    "profile share": (put((*A, "event_profile", 0, "alternate_fraction"), 0.9), {"share of alternates"}),
    "profile state": (put((*A, "event_profile", 0, "consensus_state"), "?"), {"unknown state"}),
    "profile event": (put((*A, "event_profile", 0, "event_id"), "e9"), {"unknown event"}),
    "status": (put((*M, 2, "architecture_assignment", "status"), "?"), {"unknown status", "not the molecules' total"}),
    "eligibility": (put((*M, 2, "architecture_assignment", "status"), "INELIGIBLE"), {"eligibility", "not the molecules' total"}),
    "assigned elsewhere": (put((*M, 0, "architecture_assignment", "architecture_id"), "b"), {"isn't a member of its architecture"}),
    "ambiguous": (put((*M, 2, "architecture_assignment"), {"status": "AMBIGUOUS", "candidate_architecture_ids": ["a"]}), {"fewer than two candidates", "candidate doesn't name the molecule", "not the molecules' total"}),
    "unknown ambiguous": (put((*A, "ambiguous_molecule_ids"), ["m9"]), {"unknown ambiguous molecule"}),
    "totals": (put(("architecture_inference", "candidate_count"), 2), {"not the molecules' total"}),
    "not callable": (put(("callability", 2, "callable_bases"), 0), {"eligibility", "abundance", "not the molecules' total"}),
}


@pytest.fixture(scope="module")
def found(spark):
    """All documents are checked at once, each by its name."""
    rows = [("sound", json.dumps(sound())), ("no json", "{"), ("plain", json.dumps({k: v for k, v in sound().items() if k in ("metadata", "filter_stats", "reads", "variants", "svs", "complex_events", "clusters")} | {"metadata": sound()["metadata"] | {"schema_version": "0.5"}}))]
    for name, (change, _) in BREAKS.items():
        broken = copy.deepcopy(sound())
        change(broken)
        rows.append((name, json.dumps(broken)))
    by = {}
    for r in result_contracts.broken(spark.createDataFrame(rows, "name string, json string")).collect():
        by.setdefault(r.name, []).append((r.path, r.rule))
    return by


def test_sound_documents_break_nothing(found):
    assert "sound" not in found and "plain" not in found
    assert found["no json"] == [("metadata.schema_version", "not JSON")]


@pytest.mark.parametrize("name", BREAKS)
def test_each_break_is_named(found, name):
    assert BREAKS[name][1] <= {rule for _, rule in found[name]}, found.get(name)
