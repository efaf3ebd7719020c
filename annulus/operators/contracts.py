"""Checks of results: each gives the rows that break a rule, so that none means sound."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annulus.errors import AnalysisError
from annulus.functions import stats
from annulus.operators.shared import dealt


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(F.concat_ws(":", *keys).alias("what"), F.lit("repeated").alias("rule"))


def dangling(df: DataFrame, key: str, dim: DataFrame, dim_key: str) -> DataFrame:
    known = dim.select(F.col(dim_key).alias(key))
    lost = df.join(dealt(known, key, rows=max(df.count(), known.count())), key, "left_anti")  # Spark joins `df` before it deals it
    return lost.select(F.col(key).cast("string").alias("what"), F.lit("dangling").alias("rule"))


def disordered(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges of a key that overlap, or end before they start."""
    from pyspark.sql import Window

    before = F.max("end").over(Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    marked = dealt(ranges.select(*keys, "start", "end"), *keys).withColumn("_before", before).where((F.col("start") > F.col("end")) | (F.col("start") <= F.col("_before")))
    return marked.select(F.concat_ws(":", *keys).alias("what"), F.lit("disordered").alias("rule"))


def unsupported(events: DataFrame, observations: DataFrame) -> DataFrame:
    """Events whose support isn't their number of ALTERNATE observations."""
    counts = observations.where("state = 'ALTERNATE'").groupBy("event").agg(F.count("*").alias("_n"))
    bad = events.join(counts, "event", "left").where(F.coalesce("_n", F.lit(0)) != F.col("support"))
    return bad.select(F.col("event").cast("string").alias("what"), F.lit("unsupported").alias("rule"))


def evidence_graph(molecules: DataFrame, events: DataFrame, observations: DataFrame, ranges: DataFrame) -> DataFrame:
    checks = (
        repeated(molecules, ["molecule"]),
        repeated(events, ["event"]),
        repeated(observations, ["molecule", "event"]),
        dangling(observations, "molecule", molecules, "molecule"),
        dangling(observations, "event", events, "event"),
        disordered(ranges, ["molecule"]),
        unsupported(events, observations),
    )
    return reduce(DataFrame.unionByName, checks)


def architecture_partition(molecules: DataFrame, found: DataFrame, assignments: DataFrame) -> DataFrame:
    """Whether assignments (molecule, status, architecture, candidates) partition the molecules among the architectures found
    (architecture, members, representatives): each molecule once; ASSIGNED to one that is there; AMBIGUOUS between two or
    more that are; others to none; members as counted, two at least; representatives are members."""
    told = lambda df, what, rule: df.select(F.col(what).cast("string").alias("what"), F.lit(rule).alias("rule"))
    names = found.select(F.col("architecture").alias("_name"))
    sure = assignments.where("status = 'ASSIGNED'")
    counted = sure.groupBy("architecture").agg(F.count("*").alias("_n"))
    wrong = found.join(counted, "architecture", "left").where((F.coalesce("_n", F.lit(0)) != F.col("members")) | (F.col("members") < 2))
    several = assignments.where("status = 'AMBIGUOUS'")
    each = several.select("molecule", F.explode("candidates").alias("_name"))
    shown = found.select("architecture", F.explode("representatives").alias("molecule"))
    checks = (
        repeated(assignments, ["molecule"]),
        repeated(found, ["architecture"]),
        told(molecules.join(assignments, "molecule", "left_anti"), "molecule", "unassigned molecule without a row"),
        dangling(assignments, "molecule", molecules, "molecule"),
        told(sure.join(names, sure.architecture == names._name, "left_anti"), "molecule", "assigned to no architecture"),
        told(several.where(F.col("architecture").isNotNull() | (F.size("candidates") < 2)), "molecule", "ambiguous without candidates"),
        told(each.join(names, "_name", "left_anti"), "molecule", "ambiguous with an unknown candidate"),
        told(assignments.where("status in ('UNASSIGNED', 'INELIGIBLE') and architecture is not null"), "molecule", "kept by an architecture"),
        told(wrong, "architecture", "members miscounted"),
        told(shown.join(sure.select("molecule", "architecture"), ["molecule", "architecture"], "left_anti"), "molecule", "representative isn't a member"),
    )
    return reduce(DataFrame.unionByName, checks)


def variant_statistics(variants: DataFrame, tolerance: float = 2e-9) -> DataFrame:
    """Variants (event, alternate, reference, other, callable, level, ci_low, ci_high) whose numbers don't follow from their counts."""
    low, high = stats.wilson(F.col("alternate"), F.col("callable"))
    level = F.when(F.col("callable") > 0, F.col("alternate") / F.col("callable")).otherwise(0.0)
    far = lambda a, b: F.abs(F.col(a) - b) > tolerance
    bad = (F.col("alternate") + F.col("reference") + F.col("other") != F.col("callable")) | far("level", level) | far("ci_low", low) | far("ci_high", high)
    return variants.where(F.coalesce(bad, F.lit(True))).select(F.col("event").cast("string").alias("what"), F.lit("statistics").alias("rule"))


#: Sections that a result document holds, by its schema, and whether each is an object.
SECTIONS = {
    "0.5": {"metadata": True, "filter_stats": True, "reads": False, "variants": False, "svs": False, "complex_events": False, "clusters": False},
    "0.6": {"evidence_encoding": True, "alignments": False, "molecules": False, "callability": False, "events": False, "observation_pages": False, "phase_links": False,
            "architecture_inference": True, "architectures": False},
}


def document(documents: DataFrame) -> DataFrame:
    """Documents (name, json) with a section missing, of the wrong shape, or with a schema that isn't known."""
    at = lambda path: F.get_json_object("json", f"$.{path}")
    version = at("metadata.schema_version")
    rules = [("schema", ~F.coalesce(version.isin("0.5", "0.6"), F.lit(False)))]
    for schema, sections in SECTIONS.items():
        for name, is_object in sections.items():
            held = F.startswith(at(name), F.lit("{" if is_object else "["))
            wrong = ~F.coalesce(held, F.lit(False))
            rules.append((name, wrong if schema == "0.5" else (version == "0.6") & wrong))
    rules.append(("observations", (version == "0.6") & at("observations").isNotNull()))  # rows belong into pages
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in rules)))
    return documents.select(F.explode(found).alias("rule"), F.col("name").alias("what")).select("what", "rule")


def require(broken: DataFrame) -> None:
    """Fail with the first broken rules."""
    if found := broken.limit(5).collect():
        raise AnalysisError("E9001", "; ".join(f"{r.rule} {r.what}" for r in found))


def within_budget(df: DataFrame, most: int, what: str) -> DataFrame:
    """`df`, if it has no more than `most` rows."""
    if df.limit(most + 1).count() > most:
        raise AnalysisError("E1601", f"more than {most} {what}")
    return df
