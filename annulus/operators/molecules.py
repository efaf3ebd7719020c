"""Molecules from alignments: by read name, or by a tag that names the molecule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annulus.config import Config
from annulus.functions import text

SECONDARY, SUPPLEMENTARY = 0x100, 0x800
UNUSABLE = 0x4 | 0x200 | 0x400


def role(flags: Column) -> Column:
    """What an alignment is to its read."""
    has = lambda m: flags.bitwiseAND(F.lit(m)) != 0
    return F.when(has(0x4), "unmapped").when(has(SECONDARY), "secondary").when(has(SUPPLEMENTARY), "supplementary").otherwise("primary")


def _tag(name: str) -> Column:
    return F.nullif(F.try_element_at("aux_tags", F.lit(name)), F.lit(""))


def keyed(reads: DataFrame, c: Config) -> DataFrame:
    """Adds molecule: the name, or the tag's value where all of a name's alignments that have the tag agree."""
    if not c.molecule_id_tag:
        return reads.withColumn("molecule", F.col("id"))
    values = F.collect_set(_tag(c.molecule_id_tag)).over(Window.partitionBy("id"))  # alignments of one read
    rest = F.concat(F.lit(f":{c.molecule_id_tag}:"), F.col("id"))
    key = F.when(F.size("_v") == 1, F.get("_v", F.lit(0))).when(F.size("_v") == 0, F.concat(F.lit("UNASSIGNED"), rest)).otherwise(F.concat(F.lit("CONFLICT"), rest))
    return reads.withColumn("_v", values).withColumn("molecule", key).drop("_v")


def assemble(reads: DataFrame, c: Config) -> DataFrame:
    """A row for each molecule: representative (record_index), fragments, source_qnames, analysis_eligible and why not.

    Counts are combined before the shuffle by molecule; only names, indices and reasons travel.
    """
    rows = keyed(reads, c).withColumn("_primary", F.col("flags").bitwiseAND(F.lit(SECONDARY | SUPPLEMENTARY)) == 0)
    usable = F.col("_primary") & (F.col("flags").bitwiseAND(F.lit(UNUSABLE)) == 0)
    rows = rows.withColumn("_usable", usable)
    best = F.struct(
        F.col("_usable").cast("int").alias("u"),
        F.col("_primary").cast("int").alias("p"),
        (F.col("mapping_quality") if c.molecule_id_tag else F.lit(0)).alias("q"),
        (-F.col("record_index")).alias("i"),
    )
    tags = {name: tag for name, tag in (("umi", c.umi_tag), ("duplex", c.duplex_tag)) if tag}
    names = rows.groupBy("molecule", "id").agg(
        F.count_if("_primary").alias("_primaries"),
        F.count_if("_usable").alias("_usables"),
        F.max(best).alias("_best"),
        F.collect_list("record_index").alias("_records"),
        *(F.collect_set(_tag(tag)).alias(f"_{name}") for name, tag in tags.items()),
    )
    sets = names.groupBy("molecule").agg(
        F.array_sort(F.collect_list("id")).alias("source_qnames"),
        F.array_sort(F.flatten(F.collect_list("_records"))).alias("fragments"),
        F.max("_best").alias("_best"),
        F.count_if(F.col("_primaries") != 1).alias("_unclear"),
        F.count_if(F.col("_primaries") == 0).alias("_bare"),
        F.sum("_usables").alias("_usables"),
        *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"_{name}")))).alias(f"{name}_values") for name in tags),
    )
    reasons = [
        F.when(F.startswith("molecule", F.lit("UNASSIGNED:")), "missing_molecule_tag") if c.molecule_id_tag else F.lit(None).cast("string"),
        F.when(F.startswith("molecule", F.lit("CONFLICT:")), "conflicting_molecule_tag") if c.molecule_id_tag else F.lit(None).cast("string"),
        F.when(F.col("_bare") > 0, "no_primary_alignment").when(F.col("_unclear") > 0, "multiple_primary_alignments"),
        F.when(F.col("_usables") == 0, "no_usable_primary_alignment"),
        *(F.when(F.size(f"{name}_values") > 1, f"conflicting_{name}_values") for name in tags),
    ]
    out = sets.withColumn("exclusion_reasons", F.array_compact(F.array(*reasons))).withColumn("representative", -F.col("_best.i"))
    return out.withColumn("analysis_eligible", F.size("exclusion_reasons") == 0).drop("_best", "_unclear", "_bare", "_usables")


# Names of flags, warnings and reasons of an assembly.
_STATES = {
    "missing": ("missing_explicit_molecule_id", "MISSING_MOLECULE_ID_TAG"),
    "conflict": ("conflicting_explicit_molecule_id", "CONFLICTING_MOLECULE_ID_TAG"),
    "malformed": ("invalid_tagged_fragment_group", "INVALID_PRIMARY_COUNT_PER_QNAME"),
    "bare": ("fallback_without_primary", "NO_PRIMARY_ALIGNMENT"),
    "several": ("first_of_multiple_primaries", "MULTIPLE_PRIMARY_ALIGNMENTS"),
}
NO_EVIDENCE = "NO_ELIGIBLE_PRIMARY_EVIDENCE"


def _listed(*conditions: tuple[Column, str]) -> Column:
    """The sorted names of the conditions that hold."""
    return F.array_sort(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for c, name in conditions))))


def assembly(reads: DataFrame, c: Config, length: int) -> DataFrame:
    """A row for each molecule: molecule, molecule_id, identity_policy, assembly_status, representative (record_index), fragments, qnames
    and primaries (counts), ambiguous, analysis_eligible, exclusion_reasons, warnings, protocol_flags (each sorted) and
    protocol_metadata.

    By name, the first primary record represents a molecule; by tag the primary one of highest mapping quality, the first of equals;
    without a primary record the first. A tag that some of a name's records lack is inherited; tags that differ, and names without
    exactly one primary record, exclude the molecule. All is one aggregation by name and one by molecule of counts and extremes; lists
    of fragments stay rows (`fragments`), so a molecule may have any number of them. An empty table gives none.
    """
    tagged, flag = bool(c.molecule_id_tag), lambda m: F.col("flags").bitwiseAND(F.lit(m)) != 0
    optional = [(name, tag) for name, tag in (("UMI", c.umi_tag), ("DUPLEX", c.duplex_tag)) if tag]
    primary = ~flag(SECONDARY | SUPPLEMENTARY)
    span = F.coalesce(text.reference_span(F.col("cigar_operations")), F.lit(0))
    over = (F.col("reference_start") > 0) & (span > 0) & (span - 1 > length - F.least(F.lit(length), F.col("reference_start")))
    placed = F.nullif(F.nullif("reference_name", F.lit("*")), F.lit(""))
    best = F.struct(primary.cast("int").alias("p"), F.when(primary & F.lit(tagged), F.col("mapping_quality")).otherwise(0).alias("q"), (-F.col("record_index")).alias("i"))
    own = lambda tag: _checked(tag) if tag else F.lit(None).cast("string")
    # the aggregation sorts its rows, so they hold what it needs and no sequence
    facts = {
        "_primary": primary, "_usable": primary & ~flag(UNUSABLE), "_best": best, "_secondary": flag(SECONDARY), "_supplementary": flag(SUPPLEMENTARY), "_duplicate": flag(0x400),
        "_contig": placed, "_long": F.floor(F.length("sequence") / 2) >= length, "_over": over, "_tag": own(c.molecule_id_tag), **{f"_own{i}": own(tag) for i, (_, tag) in enumerate(optional)},
    }
    rows = reads.select("id", *(v.alias(k) for k, v in facts.items()))
    sums = [
        F.count("*").alias("n"), F.count_if("_primary").alias("primaries"), F.count_if("_usable").alias("usable"), F.max("_best").alias("best"),
        F.bool_or("_secondary").alias("secondary"), F.bool_or("_supplementary").alias("supplementary"), F.bool_or("_duplicate").alias("duplicate"),
        F.min("_contig").alias("first_contig"), F.max("_contig").alias("last_contig"), F.bool_or("_long").alias("long"), F.bool_or("_over").alias("over"),
    ]
    for i in range(len(optional)):
        sums += [F.min(f"_own{i}").alias(f"low{i}"), F.max(f"_own{i}").alias(f"high{i}"), F.count_if(F.col(f"_own{i}").isNull()).alias(f"lacking{i}")]
    name_of = F.struct(F.min("_tag").alias("low"), F.max("_tag").alias("high"), F.count_if(F.col("_tag").isNull()).alias("lacking"))
    names = rows.groupBy("id").agg(*sums, name_of.alias("tag"))
    state = F.lit("name") if not tagged else F.when(F.col("tag.low").isNull(), "missing").when(F.col("tag.low") != F.col("tag.high"), "conflict").otherwise("tag")
    names = names.withColumn("state", state)
    rest = F.concat(F.lit(f":{c.molecule_id_tag}:"), F.col("id"))
    named = F.when(F.col("state") == "missing", F.concat(F.lit("UNASSIGNED"), rest)).when(F.col("state") == "conflict", F.concat(F.lit("CONFLICT"), rest))
    names = names.withColumn("molecule", named.when(F.col("state") == "tag", F.col("tag.low")).otherwise(F.col("id")))

    added = ("n", "primaries", "usable", *(f"lacking{i}" for i in range(len(optional))))
    some = ("secondary", "supplementary", "duplicate", "long", "over")
    whole = names.groupBy("state", "molecule").agg(
        F.count("*").alias("qnames"), *(F.sum(x).alias(x) for x in added), *(F.bool_or(x).alias(x) for x in some), F.max("best").alias("best"), F.min("first_contig").alias("first_contig"),
        F.max("last_contig").alias("last_contig"), F.bool_or(F.col("primaries") != 1).alias("unclear"), F.bool_or(F.col("tag.lacking") > 0).alias("partial"),
        *(f(f"{x}{i}").alias(f"{x}{i}") for i in range(len(optional)) for x, f in (("low", F.min), ("high", F.max))),
    )
    kind = F.col("state")
    if tagged:
        problem = F.when(kind.isin("missing", "conflict"), kind).when(F.col("unclear"), "malformed")
        plain = F.when(F.col("qnames") > 1, "explicit_tag_multi_qname_group").otherwise("explicit_tag_single_qname_group")
    else:
        problem = F.when(F.col("primaries") == 0, "bare").when(F.col("primaries") > 1, "several")
        plain = F.lit("unique_primary")
    whole = whole.withColumn("problem", problem)
    wrong = [(F.col("problem") == k, reason) for k, (_, reason) in _STATES.items()]
    unlike = [(F.col(f"low{i}") != F.col(f"high{i}"), f"CONFLICTING_{name}_TAG_VALUES") for i, (name, _) in enumerate(optional)]
    useless = [((F.col("primaries") > 0) & (F.col("usable") == 0), NO_EVIDENCE)]
    absent = [(F.col(f"low{i}").isNull(), f"MISSING_{name}_TAG") for i, (name, _) in enumerate(optional)]
    inherited = [((F.col(f"low{i}") == F.col(f"high{i}")) & (F.col(f"lacking{i}") > 0), f"PARTIAL_{name}_TAG_INHERITED") for i, (name, _) in enumerate(optional)]
    if tagged:
        inherited.append(((kind == "tag") & F.col("partial"), "PARTIAL_MOLECULE_ID_TAG_INHERITED"))
    recorded = {"UMI": "UMI_RECORDED", "DUPLEX": "DUPLEX_METADATA_RECORDED"}
    marks = [(F.lit(True), "EXPLICIT_MOLECULE_ID" if tagged else "READ_PROXY_IDENTITY"), *((F.col(f"low{i}") == F.col(f"high{i}"), recorded[name]) for i, (name, _) in enumerate(optional))]
    marks += [
        (F.col("qnames") > 1, "MULTI_QNAME_MOLECULE"), (F.col("secondary"), "SECONDARY_EVIDENCE_PRESENT"), (F.col("supplementary"), "SUPPLEMENTARY_EVIDENCE_PRESENT"), (F.col("duplicate"), "SAM_DUPLICATE_FLAG_PRESENT"),
        (F.col("first_contig") != F.col("last_contig"), "MULTI_REFERENCE_ALIGNMENT"), (F.col("long"), "CONCATEMER_LENGTH_CANDIDATE"), (F.col("over"), "ORIGIN_SPANNING_ALIGNMENT"),
    ]
    facts = [("molecule_id_tag", F.lit(c.molecule_id_tag or None)), ("molecule_id_value", F.when(kind == "tag", F.col("molecule")))]
    for i, (name, tag) in enumerate(optional):
        facts += [(f"{name}_tag", F.lit(tag)), (f"{name}_value", F.when(F.col(f"low{i}") == F.col(f"high{i}"), F.col(f"low{i}")))]
    metadata = F.map_filter(F.create_map(*(x for k, v in facts for x in (F.lit(k), v.cast("string")))), lambda k, v: v.isNotNull())
    status = plain
    for k, (told, _) in _STATES.items():
        status = F.when(F.col("problem") == k, told).otherwise(status)
    excluded = _listed(*wrong, *unlike, *useless)
    return whole.select(
        "molecule",
        F.when(kind == "tag", F.concat(F.lit(f"{c.molecule_id_tag}:"), "molecule")).otherwise(F.col("molecule")).alias("molecule_id"),
        F.lit(f"sam_tag:{c.molecule_id_tag}" if tagged else "sam_qname").alias("identity_policy"),
        status.alias("assembly_status"),
        (-F.col("best.i")).alias("representative"),
        F.col("n").alias("fragments"),
        "qnames",
        "primaries",
        (F.col("problem").isNotNull() | F.exists(excluded, lambda x: x.startswith("CONFLICTING_"))).alias("ambiguous"),
        (F.size(excluded) == 0).alias("analysis_eligible"),
        excluded.alias("exclusion_reasons"),
        _listed(*wrong, *unlike, *useless, *absent, *inherited).alias("warnings"),
        _listed(*marks).alias("protocol_flags"),
        metadata.alias("protocol_metadata"),
    )


def _checked(name: str) -> Column:
    """A tag's value, which must be a sound one."""
    value = _tag(name)
    return F.when(value.isNull() | text.tag_value_is_valid(value), value).otherwise(F.raise_error(F.concat(F.lit(f"E1103: unsound value of tag {name}: "), F.col("id"))))


def fragments(reads: DataFrame, c: Config, assembled: DataFrame) -> DataFrame:
    """record_index, molecule, molecule_id, id, role, selected, flags, mapping_quality, reference_name, reference_start, cigar: each
    record and what it is to its molecule (of `assembly`)."""
    rows = keyed(reads, c).join(assembled.select("molecule", "molecule_id", "representative"), "molecule")
    return rows.select("record_index", "molecule", "molecule_id", "id", role(F.col("flags")).alias("role"), (F.col("record_index") == F.col("representative")).alias("selected"), "flags", "mapping_quality", "reference_name", "reference_start", "cigar")


def supplements(reads: DataFrame, c: Config, assembled: DataFrame) -> DataFrame:
    """molecule, place, entry: the supplementary entries of each molecule's representative: its own first, then those that its other
    supplementary records spell (by tag: all records that aren't secondary), each once, never the representative's own alignment."""
    from annulus.operators.alignments import as_supplementary

    spelt = as_supplementary(F.col("reference_name"), F.col("reference_start"), F.col("flags"), F.col("cigar"), F.col("mapping_quality"))
    rows = keyed(reads, c).join(assembled.select("molecule", "representative"), "molecule").withColumn("_entry", spelt)
    first = rows.where("record_index = representative")
    stated = F.filter(F.split(F.coalesce(_tag("SA"), F.lit("")), ";"), lambda e: e != "")
    own = first.select("molecule", F.lit(0).alias("side"), F.posexplode(stated).alias("k", "e")).select("molecule", "side", F.col("k").cast("long").alias("k"), F.concat("e", F.lit(";")).alias("entry"))
    linked = F.col("flags").bitwiseAND(F.lit(SECONDARY)) == 0 if c.molecule_id_tag else F.col("flags").bitwiseAND(F.lit(SUPPLEMENTARY)) != 0
    others = rows.where((F.col("record_index") != F.col("representative")) & linked & ~F.coalesce("reference_name", F.lit("*")).isin("", "*"))
    others = others.select("molecule", F.lit(1).alias("side"), F.col("record_index").alias("k"), F.col("_entry").alias("entry"))
    others = others.join(first.select("molecule", F.col("_entry").alias("entry")), ["molecule", "entry"], "left_anti").select("molecule", "side", "k", "entry")
    return own.unionByName(others).groupBy("molecule", "entry").agg(F.min(F.struct("side", "k")).alias("place")).select("molecule", "place", "entry")
