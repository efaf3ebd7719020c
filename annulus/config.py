"""Options of an analysis, with their defaults and rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from annulus.errors import AnalysisError


@dataclass(frozen=True)
class Config:
    result_schema: str = "0.5"
    filter_numt: bool = True
    numt_threshold: float = 0.30
    allow_development_tags: bool = False
    sv_min_length: int = 10
    cluster_epsilon: float = 0.72
    min_cluster_size: int = 1
    min_mapping_quality: int = 20
    min_base_quality: int = 10
    excluded_snp_flags: int = 0xF00
    evidence_page_size: int = 4096
    molecule_id_tag: str = ""
    umi_tag: str = ""
    duplex_tag: str = ""
    max_evidence_observations: int = 5_000_000
    max_phase_links: int = 1_000_000
    max_phase_work: int = 20_000_000
    max_phase_molecule_references: int = 5_000_000
    max_input_records: int = 50_000_000
    max_input_bases: int = 10_000_000_000
    compact_result_min_molecules: int = 0
    min_architecture_molecules: int = 2
    max_candidate_architectures: int = 256
    architecture_max_distance: float = 0.20
    architecture_ambiguity_margin: float = 0.05
    architecture_min_overlap_fraction: float = 0.50
    architecture_consensus_fraction: float = 0.80
    architecture_optional_fraction: float = 0.20
    architecture_stability_replicates: int = 32
    architecture_seed: int = 0x4D49544F41524348

    def __post_init__(self):
        def rule(ok: bool, name: str) -> None:
            if not ok:
                raise AnalysisError("E1001", f"{name} = {getattr(self, name)!r} is out of range")

        rule(self.result_schema in ("0.5", "0.6"), "result_schema")
        for f in fields(self):
            if f.type == "float":
                rule(0 <= getattr(self, f.name) <= 1, f.name)
            elif f.name.startswith("max_") or f.name in ("sv_min_length", "min_cluster_size"):
                rule(getattr(self, f.name) >= 1, f.name)
        rule(self.min_base_quality <= 93, "min_base_quality")
        rule(self.min_architecture_molecules >= 2, "min_architecture_molecules")
        rule(self.max_candidate_architectures <= 4096, "max_candidate_architectures")
        rule(self.architecture_stability_replicates <= 10_000, "architecture_stability_replicates")
        rule(self.architecture_consensus_fraction > 0.5, "architecture_consensus_fraction")
        rule(self.architecture_optional_fraction <= self.architecture_consensus_fraction, "architecture_optional_fraction")
        rule(1 <= self.evidence_page_size <= 1_000_000, "evidence_page_size")
        for name in ("molecule_id_tag", "umi_tag", "duplex_tag"):
            tag = getattr(self, name)
            rule(not tag or bool(re.fullmatch("[A-Za-z][A-Za-z0-9]", tag)) and self.result_schema == "0.6", name)
