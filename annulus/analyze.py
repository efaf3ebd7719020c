"""An analysis from end to end: alignments of long reads of a circular genome to calls, lineages, coverage and a document.

Each result is a table; nothing is computed before it is asked for, but for the
tables that several results need, which are written to the shared folder once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from annulus.config import Config
from annulus.functions import coords
from annulus.operators import alignments, annotation, calls, deletions, documents, exports, features, haplotypes, indel_calls, intervals, lineage, molecules, paths, reports
from annulus.operators.shared import dropped, written
from annulus.sources import alignments as sources


#: Versions of the parts of a result document.
SCHEMAS = {"schema_version": "0.5", "sv_event_schema_version": "1.0", "complex_sv_event_schema_version": "1.0", "clinical_annotation_schema_version": "1.0", "engine_version": "0.3"}


@dataclass
class Analysis:
    """The tables of an analysis."""

    config: Config
    reference: str
    assessment: dict  # whether nuclear copies can be told apart
    reads: DataFrame  # every record with its NUMT score
    molecules: DataFrame
    coverage: DataFrame
    substitutions: DataFrame
    indels: DataFrame
    deletions: DataFrame
    effects: DataFrame
    haplotypes: haplotypes.Haplotypes
    clusters: DataFrame  # molecule, cluster, outlier: haplotypes as clusters
    lineages: DataFrame | None  # of the consensus
    haplotype_lineages: DataFrame | None  # of each haplotype

    def variants(self) -> DataFrame:
        """Calls that pass as variants for the exports: position, ref, alt, support, callable, level, ci_low, ci_high, gene."""
        own = self.substitutions.where("pass").select("position", "ref", "alt", F.col("alternate_depth").alias("support"), F.col("depth").alias("callable"), F.col("fraction").alias("level"), "ci_low", "ci_high")
        genes = self.effects.groupBy("position", "alt").agg(F.array_join(F.array_sort(F.collect_set("gene")), "/").alias("gene"))  # an effect for each gene
        return own.join(genes, ["position", "alt"], "left").withColumn("significance", F.lit(None).cast("string")).withColumn("sources", F.array().cast("array<string>"))

    @cached_property
    def features(self) -> DataFrame:
        """A row of features for each record, with its cluster; found and written when first asked for."""
        least, cut = self.config.compact_result_min_molecules, None
        if least and self.molecules.limit(least).count() >= least:  # of many reads, what calls support
            svs, complexes = self.events
            cut = features.supported(self.substitutions, self.indels, self.deletions, svs, complexes, len(self.reference))
        shown = features.read_features(self.reads, self.reference, self.config, compact=cut)
        keyed = molecules.keyed(self.reads, self.config).select("record_index", "molecule")
        return written(shown.join(keyed.join(self.clusters, "molecule"), "record_index", "left").drop("molecule"), "features")

    @cached_property
    def events(self) -> tuple[DataFrame, DataFrame]:
        """Structural events of all reads, and complex rearrangements."""
        n = len(self.reference)
        used = self.reads.where(~F.col("numt")).withColumn("id", F.col("record_index").cast("string"))
        split = alignments.split_events(alignments.segments(used), self.config, n)
        own = alignments.cigar_events(used.where(F.size("cigar_operations") > 0), self.config, n).withColumn("orientation", F.lit(None).cast("string")).withColumn("known_event", F.lit(False))
        junctions = split.select(F.col("id").alias("read"), "place", F.col("event_id").alias("id"), "orientation")
        svs = alignments.merged_events(own.unionByName(split.drop("place")))
        return written(svs, "svs"), written(paths.merged_paths(paths.complex_events(junctions)), "complex-events")

    def filter_stats(self) -> dict:
        """Counts of records and molecules, and whether nuclear copies can be told apart."""
        counts = self.reads.agg(F.count("*").alias("n"), F.count_if("numt").alias("numt")).first()
        found = self.molecules.agg(F.count("*").alias("n"), F.count_if("analysis_eligible").alias("able")).first()
        return {
            "input_alignment_records": counts.n, "input_molecules": found.n, "evidence_eligible_molecules": found.able, "passed_reads": counts.n - counts.numt, "numt_filtered_reads": counts.numt,
            "numt_threshold": self.config.numt_threshold, "numt_assessment": self.assessment,
        }

    def sections(self) -> dict[str, tuple[DataFrame, list[str]]]:
        """The result's sections: a table and its key each."""
        (svs, complexes), rows = self.events, self.features
        named = rows.select(F.col("record_index").alias("read"), F.coalesce("cluster", F.lit(-1)).alias("cluster"), "length")
        signatures = rows.select(F.col("record_index").alias("read"), F.explode("sv_ids").alias("event"))
        sections = {
            "reads": (rows, ["record_index"]),
            "variants": (self.variants(), ["position", "alt"]),
            "svs": (svs, ["event_id"]),
            "complex_events": (complexes, ["event"]),
            "clusters": (reports.cluster_summary(named, signatures), ["cluster"]),
            "coverage": (self.coverage, ["bin"]),
            "substitutions": (self.substitutions.where("pass"), ["position", "alt"]),
            "indels": (self.indels.where("pass"), ["left", "id"]),
            "deletions": (self.deletions.where("pass"), ["start", "end"]),
            "effects": (self.effects, ["position", "alt", "gene"]),
            "haplotypes": (self.haplotypes.summary, ["haplotype"]),
        }
        if self.lineages is not None:
            sections["lineages"] = (self.lineages, ["cluster", "rank"])
            sections["haplotype_lineages"] = (self.haplotype_lineages, ["cluster", "rank"])
        return sections

    def metadata(self, name: str) -> dict:
        return {"sample": name, **SCHEMAS, "reference_length": len(self.reference), "resources": []}

    def document(self, name: str = "sample") -> DataFrame:
        """One row (json) with the sections of the result, if none is too large for one value."""
        return documents.document(self.reads.sparkSession, self.metadata(name), self.sections(), {"filter_stats": self.filter_stats()})

    def write(self, folder: str, name: str = "sample", whole: bool = True) -> None:
        """The result under a folder: the document (as one value, or not `whole` as sections of lines), a VCF and a table of variants."""
        if whole:
            self.document(name).coalesce(1).write.text(f"{folder}/document")
        else:
            documents.write_sections(self.reads.sparkSession, f"{folder}/document", self.metadata(name), self.sections(), {"filter_stats": self.filter_stats()})
        exports.write_vcf(self.variants(), f"{folder}/vcf", name)
        found = self.variants().withColumnsRenamed({"support": "alt_molecules", "callable": "callable_molecules", "level": "heteroplasmy", "ci_low": "ci95_low", "ci_high": "ci95_high", "significance": "clinical_significance", "sources": "qc_flags"})
        exports.write_variant_table(found, f"{folder}/variants")


def charged(reads: DataFrame, config: Config, length: int) -> DataFrame:
    """The reads with their scores as nuclear copies, written; what they cost is summed in the same pass and must be within the budget."""
    spent = Observation("input")
    counted = reads.observe(spent, F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("cost"), F.lit(0)).alias("bases"))
    table = written(alignments.with_numt(counted.drop("cost"), config, length), "reads")
    try:
        sources.require_budget(spent.get, config)
    except Exception:
        dropped(table)
        raise
    return table


def analyze(spark: SparkSession, path: str, reference: str, config: Config = Config(), definitions: DataFrame | None = None, realign: bool = True) -> Analysis:
    """Everything of one sample. `reference` is the circular sequence; `definitions` (name, source_order, position, kind, index,
    bases, encoded) are lineages, called from the sample's consensus."""
    n = len(reference)
    reads = charged(sources.read(spark, path), config, n)
    assembled = written(molecules.assemble(reads, config), "molecules")
    eligible = assembled.where("analysis_eligible").select("molecule")
    used = molecules.keyed(reads.where(~F.col("numt")), config).where(alignments.passes_filters(config)).join(eligible, "molecule", "left_semi")
    used = written(used, "used")
    table = sources.reference_table(spark, reference)

    bases = calls.read_bases(used, config, n)
    gone = calls.divergent(bases, calls.consensus(calls.pileup(bases), table)).where("outlier").select("molecule")
    kept = written(used.join(written(gone, "divergent"), "molecule", "left_anti"), "kept")
    held = calls.read_bases(kept, config, n)
    cells = written(calls.pileup(held), "cells")
    agreed = written(calls.consensus(cells, table), "consensus")
    sequence = "".join(r.major for r in agreed.orderBy("position").select("major").toLocalIterator())  # as long as the genome
    substitutions = written(calls.substitutions(cells, agreed), "substitutions")

    pieces = written(calls.aligned_pieces(kept, n), "pieces")
    depths = intervals.depth(intervals.merged(pieces, ["molecule"]), n)
    spans = written(calls.spanning_depths(calls.aligned_pieces(kept, n, guard=8), n), "spans")
    windows = None
    if realign:
        strand = F.when(F.col("flags").bitwiseAND(F.lit(0x10)) != 0, 1).otherwise(0).cast("int")
        plain = kept.select(F.col("record_index").alias("record"), "molecule", strand.alias("strand"), "sequence", "qualities")
        places = alignments.aligned_bases(kept, n).select(F.col("record_index").alias("record"), "position", (F.col("query") + 1).cast("int").alias("query"))
        windows = lambda events: indel_calls.read_windows(events, places, plain)
    indels = written(indel_calls.call_indels(indel_calls.counted(kept, reference), spans, reference, sequence, windows), "indels")

    parts = alignments.segments(kept.withColumn("id", F.col("molecule")))
    low = kept.groupBy("molecule").agg(F.min("mapping_quality").alias("mapping_quality"))
    split = parts.withColumnRenamed("id", "molecule").join(low, "molecule")
    junctions = written(deletions.cigar_junctions(kept, n).unionByName(deletions.split_junctions(split, config, n)), "junctions")
    large = deletions.large_deletions(junctions, pieces.select("molecule", "start", "end"), sequence, kept.select("molecule").distinct().count(), depths, kept)
    large = written(deletions.with_impact(large) if n == coords.L else large, "deletions")

    passing = substitutions.where("pass")
    # genes are those of the annotated genome; on another reference nothing is annotated
    effects = written(annotation.substitution_effects(passing.select("position", "alt").where(F.lit(n == coords.L)), reference), "effects")
    mixed = haplotypes.haplotypes(held, substitutions, calls.run_lengths(spark, sequence))
    lineages = by_haplotype = None
    if definitions is not None:
        small = indels.where("pass").select(F.col("vcf_position").alias("position"), F.col("vcf_ref").alias("ref"), F.col("vcf_alt").alias("alt"), "fraction", "pass")
        marks = lineage.consensus_markers(passing.select("position", "ref", "alt", "fraction", "pass").unionByName(small)).withColumn("cluster", F.lit(0))
        ranges = intervals.deep_ranges(depths).withColumn("cluster", F.lit(0))
        lineages = lineage.lineage_calls(lineage.within_ranges(marks, ranges), definitions, ranges)
        each = ranges.drop("cluster").crossJoin(F.broadcast(mixed.summary.select(F.col("haplotype").alias("cluster"))))  # four haplotypes at most
        by_haplotype = lineage.lineage_calls(lineage.within_ranges(mixed.markers, each), definitions, each)
    coverage = reports.molecule_bins(depths, min(180, n), n)
    clusters = haplotypes.as_clusters(assembled, mixed.members)
    return Analysis(config, reference, sources.numt_assessment(spark, path), reads, assembled, coverage, substitutions, indels, large, effects, mixed, clusters, lineages, by_haplotype)
