"""Rows that reports and browsers show: events, structural events, clusters, coverage, effects, lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annulus.functions import coords
from annulus.operators.shared import written

#: Names of filters as a report shows them; others are shown as they are, with spaces.
FILTER_LABELS = {
    "not_significant": "Not significant among all tests",
    "below_error_floor": "Within the error background",
    "low_support": "Too few molecules",
    "strand_bias": "Strands differ",
    "one_strand_support": "One strand without support",
    "low_alternate_base_quality": "Low base qualities",
    "read_end_bias": "Near the ends of reads",
    "gap_adjacent": "Beside gaps",
    "low_lod": "Weak likelihood",
    "realignment_only_support": "Hardly seen before realignment",
}
#: Contacts of a residue from which it is intermediate and densely packed.
PACKING = ((22, "densely packed"), (14, "intermediate"))


def filter_label(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in FILTER_LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, code), F.replace(code, F.lit("_"), F.lit(" ")))


def qc_flags(numt_known: Column, absence_known: Column, conflicts: Column, low_quality: Column, forward: Column, reverse: Column, several: Column, run: Column) -> Column:
    """A variant's quality flags, in a fixed order, those that hold: whether nuclear copies and its absence could be judged,
    molecules in conflict or of low quality, alternate molecules by strand, several alternates at its place, the run of
    equal bases there."""
    alternate = forward + reverse
    rules = (  # fixed values
        ("NUMT_NOT_ASSESSABLE", ~numt_known),
        ("SUPPORT_ONLY_EVENT", ~absence_known),
        ("CONFLICTING_MOLECULE", conflicts > 0),
        ("LOW_QUALITY_OBSERVATIONS", low_quality > 0),
        ("SINGLE_STRAND_ALT_SUPPORT", (alternate > 0) & ((forward == 0) | (reverse == 0))),
        ("MULTI_ALLELIC_LOCUS", several),
        ("HOMOPOLYMER_CONTEXT", run > 1),
    )
    return F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), name) for name, test in rules)))


def shown_events(rows: DataFrame, kinds: list[str] | None = None, gene: str | None = None, least: float | None = None, hide_flagged: bool = False, text: str | None = None) -> DataFrame:
    """Event rows (kind, genes, level, flags and others) that fit the filters; an event without a level fails a least
    level; `text` may stand in any string column or gene, whatever its case."""
    out = rows
    if kinds:
        out = out.where(F.col("kind").isin(*kinds))
    if gene:
        out = out.where(F.array_contains("genes", gene))
    if least is not None:
        out = out.where(F.coalesce(F.col("level") >= least, F.lit(False)))
    if hide_flagged:
        out = out.where(F.size("flags") == 0)
    if text and text.strip():
        wanted = text.strip().lower()
        names = [c for c, t in rows.dtypes if t == "string"]
        hit = F.exists("genes", lambda g: F.contains(F.lower(g), F.lit(wanted)))
        for c in names:
            hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(wanted)), F.lit(False))
        out = out.where(hit)
    return out


def search_filter(value: Column) -> Column:
    """A search's filter: trimmed; null if nothing is left."""
    return F.nullif(F.trim(value), F.lit(""))


def variant_rows(variants: DataFrame) -> DataFrame:
    """event, kind, position, last, level, alternate, callable of small variants (position, ref, alt, alternate, callable)."""
    kind = F.when(F.length("ref") == F.length("alt"), "substitution").when(F.length("ref") > F.length("alt"), "deletion").otherwise("insertion")
    last = F.col("position") + F.greatest(F.length("ref"), F.lit(1)) - 1
    level = F.col("alternate") / F.nullif("callable", F.lit(0))
    return variants.select(F.concat_ws(":", F.col("position").cast("string"), "ref", "alt").alias("event"), kind.alias("kind"), "position", last.cast("long").alias("last"), level.alias("level"), "alternate", "callable")


def structural_rows(events: DataFrame) -> DataFrame:
    """event, kind, position, last, level, alternate, callable: the molecules that could show it are its own and the mean of those
    that span either side."""
    callable_ = F.floor(F.col("support") + (F.col("left_spanning") + F.col("right_spanning")) / 2 + 0.5).cast("long")
    rows = events.withColumn("callable", callable_)
    return rows.select("event", "kind", F.col("start").alias("position"), F.col("end").alias("last"), (F.col("support") / F.nullif("callable", F.lit(0))).alias("level"), F.col("support").alias("alternate"), "callable")


def event_rows(variants: DataFrame, events: DataFrame) -> DataFrame:
    """Both kinds of rows as one table, in order of position, then event."""
    return variant_rows(variants).unionByName(structural_rows(events))


def substitution_projection(calls: DataFrame, originals: DataFrame) -> DataFrame:
    """Calls that pass (position, ref, alt, depth, alternate_depth, fraction) with ref_depth and other_depth from the counted
    variant of the same name; where there is none, all that isn't alternate counts as reference."""
    found = originals.select("position", "ref", "alt", F.col("ref_depth").alias("_r"), F.col("other_depth").alias("_o"))
    rest = F.col("depth") - F.col("alternate_depth")
    rows = calls.where("pass").join(found, ["position", "ref", "alt"], "left")
    return rows.select("position", "ref", "alt", "depth", "alternate_depth", "fraction", F.coalesce("_r", rest).alias("ref_depth"), F.coalesce("_o", F.lit(0)).cast("long").alias("other_depth"))


def indel_projection(calls: DataFrame) -> DataFrame:
    """Indel calls that pass as variant rows: kind, position, ref, alt, length, fraction, depths."""
    kind = F.when(F.col("deletion"), "deletion").otherwise("insertion")
    return calls.where("pass").select("id", kind.alias("kind"), F.col("vcf_position").alias("position"), F.col("vcf_ref").alias("ref"), F.col("vcf_alt").alias("alt"), "length", "fraction", "depth", F.col("raw_alternate").alias("alternate_depth"))


def supported_calls(calls: DataFrame, originals: DataFrame, indels: DataFrame) -> DataFrame:
    """What a result shows of its calls: substitutions and indels that pass, under the same columns."""
    a = substitution_projection(calls, originals).select(F.concat_ws(":", F.col("position").cast("string"), "ref", "alt").alias("id"), F.lit("substitution").alias("kind"), "position", "ref", "alt", F.lit(1).cast("long").alias("length"), "fraction", "depth", "alternate_depth")
    return a.unionByName(indel_projection(indels))


def hidden_count(all_rows: Column, shown: Column) -> Column:
    return F.greatest(F.lit(0), all_rows - shown)


def top_filtered(calls: DataFrame, keep: int = 25) -> DataFrame:
    """The filtered calls with the smallest p."""
    return calls.where("not pass").orderBy("p", "position", "alt").limit(keep)


def key_counts(events: DataFrame) -> DataFrame:
    """One row: events, passing, low_level (below 0.5), structural, flagged."""
    return events.agg(
        F.count("*").alias("events"),
        F.count_if("pass").alias("passing"),
        F.count_if(F.col("level") < 0.5).alias("low_level"),
        F.count_if(~F.col("kind").isin("substitution", "insertion", "deletion")).alias("structural"),
        F.count_if(F.size("flags") > 0).alias("flagged"),
    )


def cluster_summary(reads: DataFrame, signatures: DataFrame) -> DataFrame:
    """cluster, reads, bases, signatures (how many of its reads' structural events, by name): reads (read, cluster, length),
    signatures (read, event)."""
    sizes = reads.groupBy("cluster").agg(F.count("*").alias("reads"), F.sum("length").alias("bases"))
    counts = reads.join(signatures.distinct(), "read").groupBy("cluster", "event").agg(F.count("*").alias("n"))
    kinds = counts.groupBy("cluster").agg(F.count("*").alias("signatures"), F.max_by("event", F.struct("n", F.col("event"))).alias("commonest"), F.max("n").alias("of_reads"))
    return sizes.join(kinds, "cluster", "left").fillna(0, ["signatures", "of_reads"])


def cluster_frequency(reads: DataFrame, changes: DataFrame) -> DataFrame:
    """cluster, change, carriers, share: how many of a cluster's reads carry each change."""
    sizes = reads.groupBy("cluster").agg(F.count("*").alias("_n"))
    rows = changes.distinct().join(reads.select("read", "cluster"), "read").groupBy("cluster", "change").agg(F.count("*").alias("carriers"))
    return rows.join(sizes, "cluster").select("cluster", "change", "carriers", (F.col("carriers") / F.col("_n")).alias("share"))


def supporter_clusters(supporters: DataFrame, reads: DataFrame) -> DataFrame:
    """change, cluster, n: supporters of each change by cluster; one whose read is unknown counts under cluster null."""
    return supporters.distinct().join(reads.select("read", "cluster"), "read", "left").groupBy("change", "cluster").agg(F.count("*").alias("n"))


def plain_variants(reads: DataFrame, changes: DataFrame) -> DataFrame:
    """change, support, share: of the reads that pass, those that carry it."""
    passed = reads.where("pass").select("read")
    total = passed.agg(F.count("*").alias("_n"))
    rows = changes.distinct().join(passed, "read").groupBy("change").agg(F.count("*").alias("support"))
    return rows.crossJoin(F.broadcast(total)).select("change", "support", (F.col("support") / F.col("_n")).alias("share"))


def with_default(counts: DataFrame, dimension: DataFrame, key: str, default: str) -> DataFrame:
    """Counts with their event's kind, `default` where the dimension (key, kind) has none."""
    return counts.join(dimension.select(key, "kind"), key, "left").withColumn("kind", F.coalesce("kind", F.lit(default)))


def coverage_summary(binned: DataFrame) -> DataFrame:
    """One row: mean depth and percent above 20, weighted by the bins' lengths, the deepest bin, bins without and with little depth."""
    length = F.col("end") - F.col("start") + 1
    d = F.col("mean_depth")
    return binned.agg(
        (F.sum(d * length) / F.sum(length)).alias("mean_depth"),
        (F.sum(F.when(d > 20, length).otherwise(0)) * 100.0 / F.sum(length)).alias("percent_over_20"),
        F.max(d).alias("max_depth"),
        F.count_if(d == 0).alias("zero_bins"),
        F.count_if((d > 0) & (d < 20)).alias("low_bins"),
    )


def molecule_bins(depths: DataFrame, bins: int, length: int = coords.L) -> DataFrame:
    """bin, start, end, mean_depth (rounded half up): bin i ends at floor((i + 1) * L / n), from position and depth."""
    numbered = depths.withColumn("bin", F.expr(f"(position * {bins} - 1) div {length}"))
    mean = F.expr("(sum(depth) + count(*) div 2) div count(*)")
    return numbered.groupBy("bin").agg(F.min("position").alias("start"), F.max("position").alias("end"), mean.alias("mean_depth"))


def lanes(rows: DataFrame, group: str, start: str, end: str, gap: int = 0) -> DataFrame:
    """Adds lane: each interval of a group, in order, goes to the first lane that is free there.

    Which lane is first free depends on all before, so a group is packed by one task: a group is what one view shows.
    """
    order = [start, end]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", lane int"

    def packed(frame):
        import heapq

        frame = frame.sort_values([*order, *[c for c in frame.columns if c not in order]], kind="stable")
        free, busy, out, used = [], [], [], 0
        for a, b in zip(frame[start], frame[end]):
            while busy and busy[0][0] + gap < a:
                heapq.heappush(free, heapq.heappop(busy)[1])
            if free:
                lane = heapq.heappop(free)
            else:
                lane, used = used, used + 1
            heapq.heappush(busy, (b, lane))
            out.append(lane)
        return frame.assign(lane=out)

    return rows.groupBy(group).applyInPandas(packed, schema)


def molecule_extents(alignments: DataFrame) -> DataFrame:
    """molecule, start, end: from its first to its last aligned position."""
    return alignments.groupBy("molecule").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def first_of_each(rows: DataFrame, group: str, order: list[str], keep: int) -> DataFrame:
    """The first `keep` rows of each group."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("_n") <= keep).drop("_n")


def contacts(residues: DataFrame, neighbours: DataFrame, cutoff: float) -> DataFrame:
    """residue, neighbour, distance: the nearest atom pair of each pair of residues within the cutoff.

    Residues with the same atoms are one shape. Shapes' atoms (residue, x, y, z) are dealt to cells as wide as the cutoff and meet those
    of the cells around; pairs of shapes become pairs of residues at the end, so nothing is shuffled for each of those.
    """
    a, mine = _shapes(residues, "residue")
    b, theirs = (a, mine) if neighbours is residues else _shapes(neighbours, "residue")
    near = written(_near(a, b, cutoff), "near")
    return near.join(mine, "shape").join(theirs.select(F.col("shape").alias("other"), F.col("residue").alias("neighbour")), "other").where("residue <> neighbour").select("residue", "neighbour", "distance")


def _shapes(atoms: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(shape, x, y, z) of each distinct set of atoms, and (shape, residue); a shape is named by its first residue."""
    sets = atoms.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("x", "y", "z"))).alias("atoms"))
    sets = written(sets, "sets")
    named = written(sets.groupBy("atoms").agg(F.min(key).alias("shape")), "shapes")
    rows = named.select("shape", F.explode("atoms").alias("p")).select("shape", "p.*")
    return rows, written(sets.join(named, "atoms").select("shape", key), "members")


def _near(residues: DataFrame, neighbours: DataFrame, cutoff: float) -> DataFrame:
    """shape, other, distance: shapes within the cutoff, a shape and itself included."""
    cell = lambda c: F.floor(F.col(c) / cutoff)
    a = residues.select("shape", "x", "y", "z", cell("x").alias("i"), cell("y").alias("j"), cell("z").alias("k"))
    b = neighbours.select(F.col("shape").alias("other"), *(F.col(c).alias(f"n{c}") for c in "xyz"), *(cell(c).alias(f"_{c}") for c in "xyz"))
    for c, name in zip("xyz", "ijk"):
        b = b.withColumn(name, F.explode(F.array(F.col(f"_{c}") - 1, F.col(f"_{c}"), F.col(f"_{c}") + 1)))
    near = a.join(b, ["i", "j", "k"]).withColumn("distance", distance(*(F.col(c) for c in ("x", "y", "z", "nx", "ny", "nz"))))
    return near.where(F.col("distance") <= cutoff).groupBy("shape", "other").agg(F.min("distance").alias("distance"))


def distance(x: Column, y: Column, z: Column, x2: Column, y2: Column, z2: Column) -> Column:
    return F.sqrt(F.pow(x - x2, F.lit(2.0)) + F.pow(y - y2, F.lit(2.0)) + F.pow(z - z2, F.lit(2.0)))


def packing_class(neighbours: Column) -> Column:
    """How densely a residue is packed, by its number of contacts."""
    return F.when(neighbours >= PACKING[0][0], PACKING[0][1]).when(neighbours >= PACKING[1][0], PACKING[1][1]).otherwise("loosely packed")


def state_name(code: Column) -> Column:
    """The name of an observation's stored state."""
    names = ("REFERENCE", "ALTERNATE", "EVENT_ABSENT", "NOT_CALLABLE", "LOW_QUALITY", "CONFLICT")  # fixed values
    return F.get(F.array(*map(F.lit, names)), code)


def capped(values: Column, most: int) -> Column:
    """The first entries of a sorted list, as a document shows them: 200 molecules, 5 candidates."""
    return F.slice(F.array_sort(values), F.lit(1), F.lit(most))
