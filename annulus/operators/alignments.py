"""From alignments to rows: filters, aligned bases, mismatches, structural events.

CIGARs are walked within the row by higher-order functions; only then are rows
exploded, narrow ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annulus.config import Config
from annulus.functions import coords, text


def passes_filters(c: Config) -> Column:
    flags = F.col("flags")
    return (
        (flags.bitwiseAND(F.lit(0x4)) == 0)
        & (flags.bitwiseAND(F.lit(c.excluded_snp_flags)) == 0)
        & (F.col("mapping_quality") >= c.min_mapping_quality)
        & (F.col("reference_start") > 0)
        & (F.coalesce(F.col("reference_name"), F.lit("*")) != "*")
        & ~text.nuclear_contig(F.col("reference_name"))
    )


def exclusion_reason(c: Config) -> Column:
    """Why an alignment isn't used for callability; the first reason that holds, null if none."""
    flag = lambda m: F.col("flags").bitwiseAND(F.lit(m)) != 0
    name = F.coalesce("reference_name", F.lit(""))
    rules = (
        (flag(0x4), "UNMAPPED_ALIGNMENT"),
        (flag(0x100), "SECONDARY_ALIGNMENT"),
        (flag(0x200), "QC_FAILED_ALIGNMENT"),
        (flag(0x400), "DUPLICATE_ALIGNMENT"),
        (flag(c.excluded_snp_flags & ~0x800), "EXCLUDED_ALIGNMENT_FLAGS"),
        (F.col("mapping_quality") < c.min_mapping_quality, "LOW_MAPPING_QUALITY"),
        ((F.col("reference_start") == 0) | name.isin("", "*"), "MISSING_REFERENCE_PLACEMENT"),
        (text.nuclear_contig(name), "NON_MITOCHONDRIAL_ALIGNMENT"),
        (F.size("cigar_operations") == 0, "MISSING_CIGAR"),
        ((F.col("sequence") == "") | (F.col("qualities") == ""), "MISSING_QUERY_OR_QUALITIES"),
    )
    out = F.lit(None).cast("string")
    for condition, reason in reversed(rules):
        out = F.when(condition, reason).otherwise(out)
    return out


def with_numt(reads: DataFrame, c: Config, length: int = coords.L) -> DataFrame:
    """Adds numt_evidence, numt_score and numt (whether the read is dropped as a nuclear copy)."""
    gc = F.col("_gc")
    named = F.regexp(F.lower("id"), F.lit("numt|nuclear")) if c.allow_development_tags else F.lit(False)
    evidence = F.array_compact(
        F.array(
            F.when(named, "read_name_heuristic"),
            F.when(text.nuclear_contig(F.col("reference_name")), "primary_nuclear_alignment"),
            F.when(F.exists("supplementary_alignments", lambda s: text.nuclear_contig(s["reference_name"])), "supplementary_nuclear_alignment"),
            F.when(F.length("sequence") / length > 1.20, "length_exceeds_mtdna"),
            F.when((gc > 0.62) | (gc < 0.25), "atypical_gc_fraction"),
        )
    )
    has = lambda name, score: F.when(F.array_contains("numt_evidence", name), score).otherwise(0.0)
    most = F.greatest(F.lit(0.05), has("primary_nuclear_alignment", 0.99), has("supplementary_nuclear_alignment", 0.90), has("read_name_heuristic", 0.82))
    score = F.least(F.lit(0.99), most + has("length_exceeds_mtdna", 0.30) + has("atypical_gc_fraction", 0.18))
    scored = reads.withColumn("_gc", text.gc_fraction(F.col("sequence"))).withColumn("numt_evidence", evidence).drop("_gc").withColumn("numt_score", score)
    return scored.withColumn("numt", (F.col("numt_score") > c.numt_threshold) & F.lit(c.filter_numt))


def walked(ops: Column) -> Column:
    """Operations with query (bases before) and reference (positions before): array of (code, length, query, reference)."""
    kind = "array<struct<code:string,length:int,query:int,reference:int>>"
    start = F.struct(F.lit(0).alias("q"), F.lit(0).alias("r"), F.array().cast(kind).alias("out"))

    def step(s, o):
        here = F.struct(o["code"].alias("code"), o["length"].alias("length"), s["q"].alias("query"), s["r"].alias("reference"))
        return F.struct(
            (s["q"] + F.when(o["code"].isin("M", "I", "S", "=", "X"), o["length"]).otherwise(0)).alias("q"),
            (s["r"] + F.when(o["code"].isin("M", "D", "N", "=", "X"), o["length"]).otherwise(0)).alias("r"),
            F.array_append(s["out"], here).alias("out"),
        )

    return F.aggregate(ops, start, step, lambda s: s["out"])


def operations(reads: DataFrame) -> Column:
    """The walked operations of reads' CIGARs, which reads that are passed several times have as a column."""
    return F.col("walked") if "walked" in reads.columns else walked(F.col("cigar_operations"))


#: Bases of a piece by which an operation that differs from the reference is compared again.
PIECE = 8


def cut(x: Column, at: Column, n: Column) -> Column:
    """`n` characters from `at` (from 1) of a string whose characters are single bytes: nothing in front of them is passed."""
    return F.substring(x.cast("binary"), at, n).cast("string")


def base_places(ops: Column, extra=None) -> Column:
    """array of (query, reference, base, quality, extra's fields) of the M, = and X among walked operations.

    Bases are cut out of the strings here, a piece for each operation, so that rows need not carry whole strings when
    they are exploded and no string is scanned anew for each base. `extra` gives fields from an operation and an offset.
    """
    piece = lambda c, o: F.split(cut(F.col(c), o["query"] + 1, o["length"]), "")

    def places(o):
        pairs = F.zip_with(piece("sequence", o), piece("qualities", o), lambda b, q: F.struct(b.alias("b"), q.alias("q")))
        return F.transform(
            pairs,
            lambda x, i: F.struct(
                (o["query"] + i).alias("query"), (o["reference"] + i).alias("reference"), F.upper(x["b"]).alias("base"), (F.ascii(x["q"]) - 33).alias("quality"), *(extra(o, i) if extra else ())
            ),
        )

    return F.flatten(F.transform(F.filter(ops, lambda o: o["code"].isin("M", "=", "X")), places))


def aligned_bases(reads: DataFrame, length: int = coords.L) -> DataFrame:
    """record_index, id, position (folded), query, base, quality: a row for each aligned base."""
    rows = reads.select("record_index", "id", "reference_start", F.explode(base_places(walked(F.col("cigar_operations")))).alias("x"))
    return rows.select(
        "record_index",
        "id",
        coords.fold(F.col("reference_start") + F.col("x.reference"), length).cast("long").alias("position"),
        F.col("x.query").alias("query"),
        F.col("x.base").alias("base"),
        F.col("x.quality").alias("quality"),
    )


def mismatches(bases: DataFrame, reference: DataFrame, c: Config) -> DataFrame:
    """record_index, id, position, ref, alt; a position that a read shows with two bases is dropped."""
    good = bases.where((F.col("quality") >= c.min_base_quality) & F.col("base").isin("A", "C", "G", "T"))
    one = good.groupBy("record_index", "id", "position").agg(F.min("base").alias("alt"), F.max("base").alias("_most")).where("alt = _most").drop("_most")
    return one.join(reference, "position").where(F.col("ref").isin("A", "C", "G", "T") & (F.col("ref") != F.col("alt")))


def read_mismatches(reads: DataFrame, reference: str, table: DataFrame, c: Config) -> DataFrame:
    """`mismatches` of reads' aligned bases, found within the row: operations that equal the reference hold none, nor do equal
    pieces of the others, and of what is left only bases that differ become rows. Alignments longer than the genome, which can
    show a position twice, go base by base."""
    n = len(reference)
    span = text.reference_span(F.col("cigar_operations"))
    place = lambda x: coords.fold(F.col("reference_start") + x, n)
    ahead = lambda o: cut(F.lit(reference + reference), place(o["reference"]).cast("int"), o["length"])
    unequal = lambda o: F.coalesce(F.upper(cut(F.col("sequence"), o["query"] + 1, o["length"])) != ahead(o), F.lit(True))
    aligned = F.filter(operations(reads), lambda o: o["code"].isin("M", "=", "X") & (o["length"] > 0) & unequal(o))
    part = lambda o, i: F.struct(o["code"].alias("code"), F.least(F.lit(PIECE), o["length"] - i).alias("length"), (o["query"] + i).alias("query"), (o["reference"] + i).alias("reference"))
    parts = F.flatten(F.transform(aligned, lambda o: F.transform(F.sequence(F.lit(0), o["length"] - 1, F.lit(PIECE)), lambda i: part(o, i))))
    own = F.split(F.lit(reference), "")
    ref = lambda x: F.get(own, (place(x) - 1).cast("int"))
    differs = lambda x: (x["quality"] >= c.min_base_quality) & x["base"].isin(*"ACGT") & ref(x["reference"]).isin(*"ACGT") & (ref(x["reference"]) != x["base"])
    once = reads.where(span <= n).select("record_index", "id", "reference_start", "sequence", "qualities", F.filter(parts, unequal).alias("ops"))
    found = once.select("record_index", "id", "reference_start", F.explode(F.filter(base_places(F.col("ops")), differs)).alias("x"))
    short = found.select("record_index", "id", place(F.col("x.reference")).cast("long").alias("position"), ref(F.col("x.reference")).alias("ref"), F.col("x.base").alias("alt"))
    long = mismatches(aligned_bases(reads.where(span > n), n), table, c)
    return short.unionByName(long.select("record_index", "id", "position", "ref", "alt"))


def cigar_events(reads: DataFrame, c: Config, length: int = coords.L) -> DataFrame:
    """id, type, start, end, length, event_id: deletions, insertions and soft clips of at least sv_min_length."""
    ops = operations(reads)
    some = F.exists("cigar_operations", lambda o: (o["length"] >= c.sv_min_length) & o["code"].isin("D", "N", "I", "S"))  # only these are walked along
    rows = reads.where(some).select("id", "reference_start", F.size("cigar_operations").alias("n"), F.posexplode(ops).alias("k", "o")).where(F.col("o.length") >= c.sv_min_length)
    at = F.col("reference_start") + F.col("o.reference")
    code = F.col("o.code")
    kind = F.when(code.isin("D", "N"), "deletion").when(code == "I", "insertion")
    kind = kind.when((code == "S") & (F.col("reference_start") + F.col("o.reference") == F.col("reference_start")), "soft_clip_left").when(code == "S", "soft_clip_right")
    before = coords.fold(at - 1, length)
    start = F.when(kind.isin("insertion", "soft_clip_right"), before).otherwise(coords.fold(at, length))
    end = F.when(kind == "deletion", coords.fold(at + F.col("o.length") - 1, length)).otherwise(start)
    named = rows.select("id", kind.alias("type"), start.cast("long").alias("start"), end.cast("long").alias("end"), F.col("o.length").cast("long").alias("length")).where("type is not null")
    plus = F.concat_ws("", "type", F.lit(":"), "start", F.lit("+"), "length")
    return named.withColumn("event_id", F.when(F.col("type") == "deletion", F.concat_ws("", "type", F.lit(":"), "start", F.lit("-"), "end")).otherwise(plus))


def segments(reads: DataFrame) -> DataFrame:
    """id, strand, query_start, query_end, reference_start, reference_end of a read's alignments, on the query's own strand."""
    own = F.struct(
        "reference_name",
        F.col("reference_start").alias("position"),
        F.when(F.col("flags").bitwiseAND(F.lit(0x10)) != 0, "-").otherwise("+").alias("strand"),
        "cigar",
    )
    more = F.transform("supplementary_alignments", lambda s: F.struct(s["reference_name"], s["position"], s["strand"], s["cigar"]))
    kind = "array<struct<reference_name:string,position:int,strand:string,cigar:string>>"
    rows = reads.select("id", F.explode(F.concat(F.array(own).cast(kind), more.cast(kind))).alias("a")).where(~text.nuclear_contig(F.col("a.reference_name")))
    ops = rows.select("id", "a", text.cigar_operations(F.col("a.cigar")).alias("ops")).where(F.size("ops") > 0)
    clip = lambda o: F.when(o["code"].isin("S", "H"), o["length"]).otherwise(0)
    first, last = clip(F.element_at("ops", 1)), F.when(F.size("ops") > 1, clip(F.element_at("ops", -1))).otherwise(0)
    used = F.aggregate(F.filter("ops", lambda o: o["code"].isin("M", "I", "=", "X")), F.lit(0), lambda s, o: s + o["length"])
    ahead = F.when(F.col("a.strand") == "+", first).otherwise(last)
    out = ops.select(
        "id",
        F.col("a.strand").alias("strand"),
        (ahead + 1).alias("query_start"),
        (ahead + used).alias("query_end"),
        F.col("a.position").alias("reference_start"),
        (F.col("a.position") + text.reference_span(F.col("ops")) - 1).alias("reference_end"),
    )
    return out.distinct()


#: Where the ends of the known common deletion lie, and bits of a record's flags.
KNOWN_START, KNOWN_END = (8400, 8500), (13400, 13550)


def _junctions(parts: DataFrame) -> DataFrame:
    """id, from_strand, strand, out, in, jump, skipped: a row for each two segments that follow on the query. `out` and `in` are
    the reference positions where the first is left and the second entered; `jump` counts the bases between them as the
    strand reads the reference, negative where they overlap; `skipped` those of the query."""
    order = Window.partitionBy("id").orderBy("query_start", "query_end", "reference_start", "strand")
    ends = F.struct("strand", "query_end", F.when(F.col("strand") == "+", F.col("reference_end")).otherwise(F.col("reference_start")).alias("out"))
    entered = F.when(F.col("strand") == "+", F.col("reference_start")).otherwise(F.col("reference_end"))
    rows = parts.select("id", "strand", "query_start", entered.alias("in"), F.lag(ends).over(order).alias("last")).where("last is not null")
    along = F.when(F.col("strand") == "+", F.lit(1)).otherwise(F.lit(-1))
    jump = along * (F.col("in") - F.col("last.out")) - 1
    return rows.select("id", F.col("last.strand").alias("from_strand"), "strand", F.col("last.out").alias("out"), "in", jump.alias("jump"), (F.col("query_start") - F.col("last.query_end") - 1).alias("skipped"), F.col("query_start").alias("place"))


def split_events(parts: DataFrame, c: Config, length: int = coords.L) -> DataFrame:
    """id, type, start, end, length, orientation, place (on the query), event_id, known_event of reads in several segments.

    A change of strand is an inversion. On one strand, a jump ahead of the least length is a deletion. A jump
    back is read the short way round the circle: if that leaves less than the overlap, the read crosses the origin;
    if as much, the adjacency is ambiguous; else the overlap is a duplication. What is then left may hold an insertion
    of skipped query bases.
    """
    rows, least, jump = _junctions(parts), F.lit(c.sv_min_length), F.col("jump")
    overlap, around = -jump, length + jump
    back = jump < 0
    kind = F.when(F.col("from_strand") != F.col("strand"), "inversion").when(back & (around < overlap), "circular_origin")
    kind = kind.when(back & (around == overlap) & (overlap >= least), "ambiguous_adjacency").when(back & (overlap >= least), "duplication")
    kind = kind.when(~back & (jump >= least), "deletion").when(F.col("skipped") >= least, "insertion")
    low, high = F.least("out", "in"), F.greatest("out", "in")
    is_ = lambda *names: F.col("type").isin(*names)
    start = F.when(is_("deletion"), low + 1).when(is_("circular_origin"), high).otherwise(low)
    end = F.when(is_("deletion"), high - 1).when(is_("circular_origin", "insertion"), low).otherwise(high)
    size = F.when(is_("inversion"), high - low + 1).when(is_("circular_origin"), around).when(is_("deletion"), jump).when(is_("insertion"), F.col("skipped")).otherwise(overlap)
    told = rows.withColumn("type", kind).where("type is not null")
    out = told.select("id", "type", start.cast("long").alias("start"), end.cast("long").alias("end"), size.cast("long").alias("length"), F.concat_ws("/", "from_strand", "strand").alias("orientation"), "place")
    place = F.when(F.col("type") == "insertion", F.concat_ws("+", "start", "length")).otherwise(F.concat_ws("-", "start", "end"))
    known = (F.col("type") == "deletion") & F.col("start").between(*KNOWN_START) & F.col("end").between(*KNOWN_END)
    return out.withColumn("event_id", F.concat_ws(":", "type", place)).withColumn("known_event", known)


def merged_events(events: DataFrame, key: str = "event_id", molecule: str = "id") -> DataFrame:
    """One row for each event: type, start, end, length, support (molecules), orientations (four at most), whether known. Who
    supports an event stays in rows (`event_members`), as a common event is in every read."""
    return events.groupBy(key).agg(
        F.min("type").alias("type"),
        F.min("start").alias("start"),
        F.min("end").alias("end"),
        F.min("length").alias("length"),
        F.countDistinct(molecule).alias("support"),
        F.array_sort(F.collect_set("orientation")).alias("orientations"),
        F.bool_or("known_event").alias("known_event"),
    )


def event_members(events: DataFrame, key: str = "event_id", molecule: str = "id") -> DataFrame:
    """key, molecule: who supports each event, once each."""
    return events.select(key, molecule).distinct()


def end_position(start: Column, ops: Column) -> Column:
    """The last reference position of an alignment, not folded; an alignment without a span holds its start."""
    return start + F.greatest(F.lit(1), text.reference_span(ops)) - 1


def as_supplementary(contig: Column, start: Column, flags: Column, cigar: Column, mapq: Column) -> Column:
    """An alignment as an entry of another's supplementary list."""
    strand = F.when(flags.bitwiseAND(F.lit(0x10)) != 0, "-").otherwise("+")
    return F.concat(F.concat_ws(",", contig, start.cast("string"), strand, cigar, mapq.cast("string"), F.lit("0")), F.lit(";"))


def span_mismatches(reads: DataFrame, reference: DataFrame, c: Config, length: int = coords.L) -> DataFrame:
    """id, position, ref, alt of reads without a CIGAR (id, reference_start, sequence, qualities): base by base from their start."""
    pairs = F.zip_with(F.split("sequence", ""), F.split("qualities", ""), lambda b, q: F.struct(F.upper(b).alias("alt"), (F.ascii(q) - 33).alias("quality")))
    rows = reads.select("id", "reference_start", F.posexplode(pairs).alias("i", "x")).select("id", coords.fold(F.col("reference_start") + F.col("i"), length).cast("long").alias("position"), "x.*")
    good = rows.where((F.col("quality") >= c.min_base_quality) & F.col("alt").isin(*"ACGT"))
    return good.join(reference, "position").where(F.col("ref").isin(*"ACGT") & (F.col("ref") != F.col("alt"))).select("id", "position", "ref", "alt")


def occurrences(reads: DataFrame, order: str = "record_index") -> DataFrame:
    """Adds occurrence: which of the records of its name a record is, from 1."""
    return reads.withColumn("occurrence", F.row_number().over(Window.partitionBy("id").orderBy(order)).cast("long"))
