"""Rules over whole result documents (name, json): shapes by path, and what sections must say about each other.

A document is parsed once into a variant. Shapes are a list of (path, kind, schemas), checked in one pass with a row
for each broken path. What sections say about each other are joins of the tables inside the documents, keyed by
the document's name, so that many documents are checked at once and a large one by many tasks. Every rule gives the
rows (name, path, rule) that break it; a sound document gives none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annulus.functions import stats

BOTH, GRAPH = ("0.5", "0.6"), ("0.6",)
#: Paths that a document holds, what stands there, and in which schemas.
SHAPES = (
    *((p, "object", BOTH) for p in ("metadata", "filter_stats", "filter_stats.numt_assessment")),
    *((f"metadata.{p}", "string", BOTH) for p in ("schema_version", "sv_event_schema_version", "complex_sv_event_schema_version", "clinical_annotation_schema_version", "engine_version")),
    *((p, "unsigned", BOTH) for p in ("metadata.reference_length", "filter_stats.passed_reads")),
    *((p, "array", BOTH) for p in ("metadata.resources", "reads", "variants", "svs", "complex_events", "clusters")),
    *((p, "object", GRAPH) for p in ("evidence_encoding", "architecture_inference")),
    *((p, "array", GRAPH) for p in ("alignments", "molecules", "callability", "events", "observation_pages", "phase_links", "architectures")),
    *((f"evidence_encoding.{p}", "unsigned", GRAPH) for p in ("observation_count", "observation_page_count", "observation_page_size")),
    ("observations", "absent", GRAPH),
)
#: What the encoding of observations must say.
ENCODING = {
    "layout": "paged_columnar_molecule_event",
    "observation_storage": "embedded_columnar_pages",
    "phase_molecule_policy": "evidence_eligible_only",
    "phase_molecule_reference": "molecules[].index",
    "phase_null_model": "independent_marginals_within_jointly_callable",
}
#: Columns of a page of observations, states of observations and assignments, kinds of events with a variant.
COLUMNS = ("molecule_id", "event_id", "alignment_id", "state", "observed_allele", "base_quality", "mapping_quality", "strand", "evidence_source", "read_position")
CALLABLE, OTHER_STATES = ("REFERENCE", "ALTERNATE", "EVENT_ABSENT"), ("LOW_QUALITY", "CONFLICT")
SMALL = ("SNV", "SMALL_INSERTION", "SMALL_DELETION")
STATUSES = ("ASSIGNED", "AMBIGUOUS", "UNASSIGNED", "INELIGIBLE")
TOLERANCE = 2e-9


def parsed(documents: DataFrame) -> DataFrame:
    """name, v, schema of documents (name, json); text that is no JSON has a null variant."""
    rows = documents.select("name", F.try_parse_json("json").alias("v"))
    return rows.withColumn("schema", F.try_variant_get("v", "$.metadata.schema_version", "string"))


def _kind(path: str) -> Column:
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get("v", f"$.{path}", "variant")), "^[A-Z]+", 0)


def _is(path: str, kind: str) -> Column:
    if kind == "absent":
        return F.try_variant_get("v", f"$.{path}", "variant").isNull()
    if kind == "unsigned":
        return F.coalesce((_kind(path) == "BIGINT") & (F.try_variant_get("v", f"$.{path}", "long") >= 0), F.lit(False))
    return F.coalesce(_kind(path) == kind.upper(), F.lit(False))


def _told(rows: DataFrame, path: Column | str, rule: str) -> DataFrame:
    return rows.select("name", (F.lit(path) if isinstance(path, str) else path).alias("path"), F.lit(rule).alias("rule"))


def shapes(documents: DataFrame) -> DataFrame:
    """Paths that are missing or of another kind, and documents that aren't JSON or of no known schema."""
    broken = [F.when(F.col("schema").isin(*schemas) & ~_is(path, kind), F.struct(F.lit(path).alias("path"), F.lit(f"must be {kind}").alias("rule"))) for path, kind, schemas in SHAPES]
    broken += [F.when((F.col("schema") == "0.6") & ~F.coalesce(F.try_variant_get("v", f"$.evidence_encoding.{k}", "string") == text, F.lit(False)), F.struct(F.lit(f"evidence_encoding.{k}").alias("path"), F.lit("unknown encoding").alias("rule"))) for k, text in ENCODING.items()]
    size = F.try_variant_get("v", "$.evidence_encoding.observation_page_size", "long")
    broken.append(F.when((F.col("schema") == "0.6") & ~F.coalesce(size.between(1, 1_000_000), F.lit(False)), F.struct(F.lit("evidence_encoding.observation_page_size").alias("path"), F.lit("out of range").alias("rule"))))
    known = F.coalesce(F.col("schema").isin(*BOTH), F.lit(False))
    broken.append(F.when(~known, F.struct(F.lit("metadata.schema_version").alias("path"), F.when(F.col("v").isNull(), "not JSON").otherwise("unknown schema").alias("rule"))))
    return parsed(documents).select("name", F.explode(F.array_compact(F.array(*broken))).alias("b")).select("name", "b.path", "b.rule")


def _items(docs: DataFrame, path: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """name, place and the fields (column: path in the item, type) of a section's items."""
    rows = docs.select("name", F.posexplode(F.try_variant_get("v", f"$.{path}", "array<variant>")).alias("place", "i"))
    return rows.select("name", F.col("place").cast("long").alias("place"), *(F.try_variant_get("i", f"$.{p}", kind).alias(c) for c, (p, kind) in fields.items()))


def tables(documents: DataFrame) -> dict[str, DataFrame]:
    """The tables inside documents of the evidence graph, keyed by name; a field that is missing or of another type is null."""
    docs = parsed(documents).where("schema = '0.6'")
    same = lambda kind, *names: {n: (n, kind) for n in names}
    columns = {c: (f"columns.{c}", "array<string>") for c in COLUMNS}
    pages = _items(docs, "observation_pages", {"page": ("index", "long"), **same("long", "offset", "count"), **columns})
    shown = pages.select("name", F.explode(F.arrays_zip("molecule_id", "event_id", "state", "evidence_source")).alias("o")).select("name", "o.*")
    counts = ("alt_depth", "ref_depth", "other_depth", "event_absent_depth", "low_quality_depth", "conflict_depth", "callable_depth")
    links = ("both_alternate", "a_alternate_b_absent", "a_absent_b_alternate", "neither_alternate", "jointly_uncertain", "jointly_callable")
    shares = ("co_alternate_fraction", "co_alternate_ci95_low", "co_alternate_ci95_high", "expected_co_alternate_fraction", "linkage_delta")
    inference = ("eligible_molecules", "assigned_molecules", "ambiguous_molecules", "unassigned_molecules", "candidate_count")
    return {
        "documents": docs.select("name", *(F.try_variant_get("v", f"$.evidence_encoding.{c}", "long").alias(c) for c in ("observation_count", "observation_page_count", "observation_page_size")),
                                 *(F.try_variant_get("v", f"$.architecture_inference.{c}", "long").alias(c) for c in inference)),
        "events": _items(docs, "events", {**same("string", "id", "type", "assessability", "ref", "alt"), **same("long", "start", "end"), "support": ("supporting_molecule_ids", "array<string>")}),
        "molecules": _items(docs, "molecules", {**same("string", "id"), **same("long", "index"), **same("boolean", "evidence_eligible"), "alternates": ("alternate_event_ids", "array<string>"),
                                                "status": ("architecture_assignment.status", "string"), "architecture": ("architecture_assignment.architecture_id", "string"),
                                                "candidates": ("architecture_assignment.candidate_architecture_ids", "array<string>")}),
        "callability": _items(docs, "callability", {**same("string", "molecule_id"), **same("boolean", "known"), **same("long", "callable_bases")}),
        "pages": pages.select("name", "place", "page", "offset", "count", *(F.size(c).alias(c) for c in COLUMNS)),
        "observations": shown.withColumnsRenamed({"molecule_id": "molecule", "event_id": "event", "evidence_source": "source"}),
        "variants": _items(docs, "variants", {"event": ("event_id", "string"), **same("string", "type", "ref", "alt"), **same("long", "position", "start", "end", *counts), "support": ("supporting_molecule_ids", "array<string>")}),
        "links": _items(docs, "phase_links", {"a": ("event_a_id", "string"), "b": ("event_b_id", "string"), **same("string", "id", "assessability"), **same("long", *links), **same("double", *shares),
                                              "support": ("supporting_molecule_indices", "array<long>"), "uncertain": ("uncertain_molecule_indices", "array<long>"), "flags": ("qc_flags", "array<string>")}),
        "architectures": _items(docs, "architectures", {"id": ("architecture_id", "string"), "members": ("member_molecule_indices", "array<long>"), "count": ("molecule_count", "long"), "fraction": ("estimated_fraction", "double"),
                                                        **same("array<string>", "defining_event_signature", "seed_event_signature", "optional_event_ids"), "ambiguous": ("ambiguous_molecule_ids", "array<string>"),
                                                        "profile": ("event_profile", "array<variant>"), "as_reference": ("method.not_callable_is_reference", "boolean")}),
    }


def _at(section: str, place: str = "place") -> Column:
    return F.concat(F.lit(f"{section}/"), F.col(place).cast("string"))


def _repeated(rows: DataFrame, section: str, *keys: str) -> DataFrame:
    twice = rows.groupBy("name", *keys).agg(F.count("*").alias("n")).where("n > 1")
    return _told(twice, F.concat_ws("/", F.lit(section), *(F.coalesce(k, F.lit("null")) for k in keys)), "repeated")


def _wrong(good: Column) -> Column:
    return ~F.coalesce(good, F.lit(False))


def pages(t: dict[str, DataFrame]) -> DataFrame:
    """Pages that don't follow each other, are too large or ragged, and documents whose counts of pages or observations are wrong."""
    before = F.sum("count").over(Window.partitionBy("name").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))  # a row for each page
    rows = t["pages"].withColumn("before", F.coalesce(before, F.lit(0))).join(t["documents"], "name")
    even = reduce(lambda a, c: a & (F.col(c) == F.col("count")), COLUMNS, F.lit(True))
    totals = t["documents"].join(t["pages"].groupBy("name").agg(F.count("*").alias("n"), F.sum("count").alias("rows")), "name", "left").fillna(0, ["n", "rows"])
    return _union(
        _told(rows.where(_wrong((F.col("page") == F.col("place")) & (F.col("offset") == F.col("before")))), _at("observation_pages"), "not contiguous"),
        _told(rows.where(_wrong(F.col("count") <= F.col("observation_page_size"))), _at("observation_pages"), "too large"),
        _told(rows.where(_wrong(even)), _at("observation_pages"), "columns of unequal length"),
        _told(totals.where(_wrong(F.col("n") == F.col("observation_page_count"))), "observation_pages", "number of pages"),
        _told(totals.where(_wrong(F.col("rows") == F.col("observation_count"))), "observation_pages", "number of observations"),
    )


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def observations(t: dict[str, DataFrame]) -> DataFrame:
    """Observations of unknown events, of molecules that aren't eligible, in an unknown state or twice; events and eligible molecules twice;
    molecules out of order."""
    seen, events, able = t["observations"], t["events"], t["molecules"].where("evidence_eligible")
    named = F.concat_ws("/", F.lit("observations"), "molecule", "event")
    return _union(
        _repeated(events, "events", "id"),
        _told(events.where(_wrong(F.col("id").isNotNull() & F.col("type").isNotNull() & F.col("assessability").isNotNull())), _at("events"), "incomplete"),
        _told(t["molecules"].where(_wrong((F.col("index") == F.col("place")) & F.col("id").isNotNull() & F.col("evidence_eligible").isNotNull())), _at("molecules"), "out of order or incomplete"),
        _repeated(able, "molecules", "id"),
        _repeated(seen, "observations", "molecule", "event"),
        _told(seen.join(events.select("name", F.col("id").alias("event")), ["name", "event"], "left_anti"), named, "unknown event"),
        _told(seen.join(able.select("name", F.col("id").alias("molecule")), ["name", "molecule"], "left_anti"), named, "molecule isn't eligible"),
        _told(seen.where(_wrong(F.col("state").isin(*CALLABLE, *OTHER_STATES))), named, "unknown state"),
    )


def variants(t: dict[str, DataFrame]) -> DataFrame:
    """Variants that aren't their event or whose depths aren't those of the observations, and small events without one."""
    small = t["events"].where(F.col("type").isin(*SMALL))
    own = small.select("name", F.col("id").alias("event"), *(F.col(c).alias(f"e_{c}") for c in ("type", "start", "end", "ref", "alt", "support")))
    at = t["observations"].join(own.select("name", "event", "e_type"), ["name", "event"])
    n = lambda c: F.count_if(c)
    absent = F.col("state") == "EVENT_ABSENT"
    another = (F.col("e_type") == "SNV") | F.coalesce(F.col("source") == "cigar_alternative_small_indel", F.lit(False))
    depths = at.groupBy("name", "event").agg(
        n(F.col("state") == "ALTERNATE").alias("x_alt_depth"),
        n((F.col("state") == "REFERENCE") | (absent & ~another)).alias("x_ref_depth"),
        n(absent & another).alias("x_other_depth"),
        n(absent).alias("x_event_absent_depth"),
        n(F.col("state") == "LOW_QUALITY").alias("x_low_quality_depth"),
        n(F.col("state") == "CONFLICT").alias("x_conflict_depth"),
    )
    counted = [c for c in depths.columns if c.startswith("x_")]
    met = t["variants"].join(own, ["name", "event"]).join(depths, ["name", "event"], "left").fillna(0, counted)
    met = met.withColumn("x_callable_depth", F.col("x_alt_depth") + F.col("x_ref_depth") + F.col("x_other_depth"))
    same = (F.col("position") == F.col("e_start")) & reduce(lambda a, c: a & (F.col(c) == F.col(f"e_{c}")), ("type", "start", "end", "ref", "alt"), F.lit(True))
    place = F.concat_ws("/", F.lit("variants"), "event")
    wrong = F.array_compact(F.array(*(F.when(_wrong(F.col(c[2:]) == F.col(c)), c[2:]) for c in [*counted, "x_callable_depth"])))
    alike = lambda a, b: F.sort_array(F.array_distinct(a)) == F.sort_array(F.array_distinct(b))
    return _union(
        _repeated(t["variants"], "variants", "event"),
        _told(t["variants"].join(own.select("name", "event"), ["name", "event"], "left_anti"), place, "no source event"),
        _told(own.join(t["variants"].select("name", "event"), ["name", "event"], "left_anti"), F.concat_ws("/", F.lit("events"), "event"), "no variant"),
        _told(met.where(_wrong(same)), place, "not its event"),
        met.select("name", F.explode(wrong).alias("f"), place.alias("p")).select("name", F.concat_ws("/", "p", "f").alias("path"), F.lit("not counted from observations").alias("rule")),
        _told(met.where(_wrong(alike(F.col("support"), F.col("e_support")))), place, "other support than its event"),
    )


def phase(t: dict[str, DataFrame]) -> DataFrame:
    """Links that no molecule gives or in another order, given ones that are missing, and links whose counts, molecules, flags or
    shares don't follow from the observations. Pairs are formed within molecules, from their alternate events alone."""
    order = t["events"].select("name", F.col("id").alias("event"), F.col("place").alias("o"), (F.col("assessability") == "REFERENCE_AND_ALTERNATE").alias("full"))
    numbered = t["molecules"].where("evidence_eligible").select("name", F.col("id").alias("molecule"), F.col("place").alias("m"))
    seen = t["observations"].join(order, ["name", "event"]).join(numbered, ["name", "molecule"]).select("name", "m", "event", "o", "full", "state")
    other = seen.select("name", "m", *(F.col(c).alias(f"{c}_b") for c in ("event", "o", "full", "state")))
    pairs = seen.join(other, ["name", "m"]).where("o < o_b")
    given = pairs.where("state = 'ALTERNATE' or state_b = 'ALTERNATE'").select("name", F.col("event").alias("a"), F.col("event_b").alias("b")).distinct()
    links = t["links"]
    at = pairs.withColumnsRenamed({"event": "a", "event_b": "b"}).join(links.select("name", "a", "b").distinct(), ["name", "a", "b"], "left_semi")
    sure = F.col("state").isin(*CALLABLE) & F.col("state_b").isin(*CALLABLE)
    one, two = F.col("state") == "ALTERNATE", F.col("state_b") == "ALTERNATE"
    counted = at.groupBy("name", "a", "b").agg(
        F.count_if(sure & one & two).alias("x_both_alternate"), F.count_if(sure & one & ~two).alias("x_a_alternate_b_absent"), F.count_if(sure & ~one & two).alias("x_a_absent_b_alternate"),
        F.count_if(sure & ~one & ~two).alias("x_neither_alternate"), F.count_if(~sure).alias("x_jointly_uncertain"), F.count_if(sure).alias("x_jointly_callable"),
        F.sort_array(F.collect_list(F.when(sure & one & two, F.col("m")))).alias("x_support"), F.sort_array(F.collect_list(F.when(~sure, F.col("m")))).alias("x_uncertain"),
        F.bool_and(F.col("full") & F.col("full_b")).alias("complete"),
    )
    met = links.join(counted, ["name", "a", "b"])
    both, n = F.col("x_both_alternate"), F.col("x_jointly_callable")
    low, high = stats.wilson(both, n)
    share = lambda k: F.when(n > 0, k / n).otherwise(0.0)
    seen_share, hoped = share(both), share(both + F.col("x_a_alternate_b_absent")) * share(both + F.col("x_a_absent_b_alternate"))
    shares = {"co_alternate_fraction": seen_share, "co_alternate_ci95_low": F.when(n > 0, low).otherwise(0.0), "co_alternate_ci95_high": F.when(n > 0, high).otherwise(0.0), "expected_co_alternate_fraction": hoped, "linkage_delta": seen_share - hoped}
    numbers = [c[2:] for c in counted.columns if c.startswith("x_") and c not in ("x_support", "x_uncertain")]
    flags = F.array_compact(F.array(F.when(~F.col("complete"), "SUPPORT_CONDITIONED"), F.when(F.col("x_jointly_uncertain") > 0, "UNCERTAIN_COOCCURRENCE_EXCLUDED")))
    level = F.when(F.col("complete"), "COMPLETE_FOR_BOTH_EVENTS").otherwise("SUPPORT_CONDITIONED")
    rules = [(c, F.col(c) == F.col(f"x_{c}")) for c in numbers] + [(c, F.abs(F.col(c) - v) <= TOLERANCE) for c, v in shares.items()]
    rules += [("supporting_molecule_indices", F.col("support") == F.col("x_support")), ("uncertain_molecule_indices", F.col("uncertain") == F.col("x_uncertain")), ("qc_flags", F.col("flags") == flags), ("assessability", F.col("assessability") == level)]
    wrong = F.array_compact(F.array(*(F.when(_wrong(good), name) for name, good in rules)))
    place = F.concat(F.lit("phase_links/"), F.concat_ws("|", "a", "b"))
    return _union(
        _repeated(links, "phase_links", "a", "b"),
        _told(links.join(given, ["name", "a", "b"], "left_anti"), place, "not derived from evidence"),
        _told(given.join(links.select("name", "a", "b"), ["name", "a", "b"], "left_anti"), place, "missing"),
        _told(links.where(_wrong(F.col("id") == F.concat(F.lit("phase:"), F.concat_ws("|", "a", "b")))), place, "id"),
        met.select("name", F.explode(wrong).alias("f"), place.alias("p")).select("name", F.concat_ws("/", "p", "f").alias("path"), F.lit("not derived from evidence").alias("rule")),
    )


def eligible(t: dict[str, DataFrame]) -> DataFrame:
    """name, place, id: molecules that architectures are made of: eligible ones; where every entry of callability is detailed, those that
    are known and have a callable base or an alternate event."""
    entries = t["callability"]
    detailed = entries.groupBy("name").agg(F.bool_and(F.col("known").isNotNull() & F.col("callable_bases").isNotNull()).alias("detailed"))
    positive = t["molecules"].where(F.size("alternates") > 0).select("name", F.col("id").alias("molecule_id"), F.lit(True).alias("positive")).distinct()
    informative = entries.join(positive, ["name", "molecule_id"], "left").where("known and (callable_bases <> 0 or positive)").select("name", F.col("molecule_id").alias("id"), F.lit(True).alias("informative")).distinct()
    rows = t["molecules"].where("evidence_eligible").join(detailed, "name", "left").join(informative, ["name", "id"], "left")
    return rows.where(~F.coalesce("detailed", F.lit(True)) | (F.coalesce("detailed", F.lit(True)) & F.coalesce("informative", F.lit(False)))).select("name", "place", "id")


def architectures(t: dict[str, DataFrame]) -> DataFrame:
    """Architectures whose members, abundance, events or profiles are wrong, assignments that don't fit them, and totals of the
    inference that aren't those of its molecules."""
    found, molecules, able = t["architectures"], t["molecules"], eligible(t)
    place = F.concat_ws("/", F.lit("architectures"), F.coalesce("id", F.lit("null")))
    sizes = t["documents"].select("name").join(able.groupBy("name").agg(F.count("*").alias("total")), "name", "left").fillna(0, ["total"])
    rows = found.join(sizes, "name").withColumn("n", F.size(F.array_distinct("members")))
    share = F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0)
    members = found.select("name", "id", F.explode(F.array_distinct("members")).alias("place"))
    known = t["events"].select("name", F.col("id").alias("event")).distinct()
    lists = ("defining_event_signature", "seed_event_signature", "optional_event_ids")
    named = _union(*(found.select("name", "id", F.lit(c).alias("list"), F.explode(c).alias("event")) for c in lists))
    profile = found.select("name", "id", F.size(F.array_distinct("members")).alias("n"), F.posexplode("profile").alias("k", "p"))
    get = lambda c, kind: F.try_variant_get("p", f"$.{c}", kind).alias(c)
    profile = profile.select("name", "id", "n", "k", get("event_id", "string"), *(get(c, "long") for c in ("alternate", "absent", "uncertain", "not_callable")), get("alternate_fraction", "double"), get("consensus_state", "string"))
    called = F.col("alternate") + F.col("absent")
    inside = F.concat_ws("/", F.lit("architectures"), "id", F.lit("event_profile"), F.col("k").cast("string"))
    listed = F.concat_ws("/", F.lit("architectures"), "id", "list")
    sure = molecules.where("status = 'ASSIGNED'")
    of = members.select("name", F.col("id").alias("architecture"), "place")
    several = molecules.where("status = 'AMBIGUOUS'")
    each = several.select("name", "place", "id", F.explode("candidates").alias("candidate"))
    unsure = found.select("name", F.col("id").alias("candidate"), F.explode("ambiguous").alias("id"))
    judged = molecules.select("name", "place", "status").join(able.select("name", "place", F.lit(True).alias("able")), ["name", "place"], "left").withColumn("able", F.coalesce("able", F.lit(False)))
    counts = judged.groupBy("name").agg(F.count_if("able").alias("x_eligible_molecules"), *(F.count_if(F.col("status") == s).alias(f"x_{s.lower()}_molecules") for s in STATUSES[:3]))
    totals = t["documents"].join(counts, "name", "left").join(found.groupBy("name").agg(F.count("*").alias("x_candidate_count")), "name", "left")
    expected = ("x_eligible_molecules", "x_assigned_molecules", "x_ambiguous_molecules", "x_unassigned_molecules", "x_candidate_count")
    totals = totals.fillna(0, list(expected))
    off = F.array_compact(F.array(*(F.when(_wrong(F.col(c[2:]) == F.col(c)), F.concat(F.lit("architecture_inference/"), F.lit(c[2:]))) for c in expected)))
    return _union(
        _repeated(found, "architectures", "id"),
        _told(rows.where(_wrong(F.col("count") == F.col("n"))), place, "number of members"),
        _told(rows.where(_wrong(F.abs(F.col("fraction") - share) <= TOLERANCE)), place, "abundance"),
        _told(rows.where(_wrong(~F.col("as_reference"))), place, "takes what isn't callable for reference"),
        _told(members.join(able, ["name", "place"], "left_anti"), place, "member isn't eligible"),
        _told(members.groupBy("name", "place").agg(F.count("*").alias("n")).where("n > 1"), _at("molecules"), "member of several architectures"),
        _told(named.join(known, ["name", "event"], "left_anti"), listed, "unknown event"),
        _told(named.groupBy("name", "id", "list", "event").agg(F.count("*").alias("n")).where("n > 1"), listed, "repeated event"),
        _told(profile.join(known.withColumnRenamed("event", "event_id"), ["name", "event_id"], "left_anti"), inside, "unknown event"),
        _told(profile.groupBy("name", "id", "event_id").agg(F.count("*").alias("c"), F.max("k").alias("k")).where("c > 1"), inside, "repeated event"),
        _told(profile.where(_wrong(called + F.col("uncertain") + F.col("not_callable") == F.col("n"))), inside, "doesn't partition the members"),
        _told(profile.where(_wrong(called > 0)), inside, "no callable member"),
        _told(profile.where((called > 0) & _wrong(F.abs(F.col("alternate_fraction") - F.col("alternate") / called) <= TOLERANCE)), inside, "share of alternates"),
        _told(profile.where(_wrong(F.col("consensus_state").isin("ALTERNATE", "ABSENT", "OPTIONAL"))), inside, "unknown state"),
        _told(unsure.join(molecules.select("name", "id").distinct(), ["name", "id"], "left_anti"), F.concat_ws("/", F.lit("architectures"), "candidate"), "unknown ambiguous molecule"),
        _told(judged.where(_wrong(F.col("status").isin(*STATUSES))), _at("molecules"), "unknown status"),
        _told(judged.where(_wrong(F.col("able") != (F.col("status") == "INELIGIBLE"))), _at("molecules"), "eligibility"),
        _told(sure.join(of, ["name", "architecture", "place"], "left_anti"), _at("molecules"), "isn't a member of its architecture"),
        _told(several.where(_wrong(F.size("candidates") >= 2)), _at("molecules"), "fewer than two candidates"),
        _told(each.join(unsure, ["name", "candidate", "id"], "left_anti"), _at("molecules"), "candidate doesn't name the molecule"),
        totals.select("name", F.explode(off).alias("path")).withColumn("rule", F.lit("not the molecules' total")),
    )


def broken(documents: DataFrame) -> DataFrame:
    """Every broken rule of documents (name, json): name, path, rule."""
    t = tables(documents)
    return _union(shapes(documents), pages(t), observations(t), variants(t), phase(t), architectures(t))
