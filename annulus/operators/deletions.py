"""Small indels and large deletions: calls of single reads, and deletions of many reads with their level."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annulus.config import Config
from annulus.functions import coords, indels, stats
from annulus.operators import breakpoints, intervals
from annulus.operators.alignments import walked
from annulus.operators.annotation import deletion_impact
from annulus.operators.evidence import band_components
from annulus.operators.shared import written

# Fixed values of the calling method.
SMALL, LARGE, ANCHOR, QUERY_GAP, ORIGIN = 50, 50, 100, 50, 100
PLACEMENT, LENGTH_TOLERANCE = 30, 8
COMMON = (8483, 4977)
FDR = 0.01


def placed_right(reference: str, start: int, bases: str, insertion: bool) -> tuple[int, str]:
    """The rightmost place within the linear reference: the anchor in front of an insertion, or a deletion's first base.
    A deletion over the origin stays where it is."""
    n = len(reference)
    if insertion:
        while start < n and bases[0] == reference[start]:
            start, bases = start + 1, bases[1:] + bases[0]
        return start, bases
    if start == 1 or start + len(bases) - 1 > n:
        return start, bases
    while start + len(bases) <= n and reference[start - 1] == reference[start + len(bases) - 1]:
        start, bases = start + 1, bases[1:] + bases[0]
    return start, bases


def small_indels(reads: DataFrame, reference: str, config: Config) -> DataFrame:
    """event, type, start, end, reference, alternate, molecule, fragment, quality of indels up to 50 bases and shorter than
    the structural minimum; an insertion needs every base known and good. Columns as the evidence graph takes them."""
    most, n = min(SMALL, config.sv_min_length - 1), len(reference)
    ops = F.filter(walked(F.col("cigar_operations")), lambda o: o["code"].isin("I", "D") & (o["length"] <= most))
    cut = lambda c, o: F.when(o["code"] == "I", F.substring(F.col(c), o["query"] + 1, o["length"]))
    found = F.transform(ops, lambda o: F.struct(o["code"].alias("code"), o["length"].alias("length"), coords.fold(F.col("reference_start") + o["reference"], n).cast("long").alias("at"), F.upper(cut("sequence", o)).alias("bases"), cut("qualities", o).alias("q")))
    rows = reads.select("molecule", F.col("record_index").alias("fragment"), F.explode(found).alias("o")).select("molecule", "fragment", "o.*")
    rows = rows.withColumn("quality", F.array_min(F.transform(F.split("q", ""), lambda c: F.ascii(c) - 33)))
    rows = rows.where((F.col("code") == "D") | (F.regexp("bases", F.lit("^[ACGT]+$")) & (F.col("quality") >= config.min_base_quality)))
    kind = T.StructType([T.StructField(c, T.LongType() if c in ("start", "end") else T.StringType()) for c in ("event", "type", "start", "end", "reference", "alternate")])

    @F.pandas_udf(kind)
    def named(code: pd.Series, length: pd.Series, at: pd.Series, bases: pd.Series) -> pd.DataFrame:
        out = []
        for c, k, p, b in zip(code, length, at, bases):
            if c == "I":
                p, b = placed_right(reference, p - 1 if p > 1 else n, b, True)
                out.append((f"indel:insertion:{p}:{b}", "SMALL_INSERTION", p, p, reference[p - 1], reference[p - 1] + b))
            else:
                p, b = placed_right(reference, p, "".join(reference[(p - 1 + i) % n] for i in range(k)), False)
                end, before = (p + k - 2) % n + 1, reference[p - 2]
                out.append((f"indel:deletion:{p}-{end}:{b}", "SMALL_DELETION", p, end, before + b, before))
        return pd.DataFrame(out, columns=kind.names)

    made = rows.select("molecule", "fragment", F.when(F.col("code") == "I", F.col("quality")).alias("quality"), named("code", "length", "at", "bases").alias("e"))
    return made.select("e.*", "molecule", "fragment", "quality").dropDuplicates(["event", "molecule", "fragment"])


def cigar_junctions(reads: DataFrame, length: int = coords.L) -> DataFrame:
    """molecule, left, right, length, strand, record, query, size: gaps of at least 50 with 100 aligned bases on both sides;
    query are the bases of the record's sequence in front of the gap, size all of them."""
    large = lambda o: o["code"].isin("D", "N") & (o["length"] >= LARGE)
    reads = reads.where(F.exists("cigar_operations", large))  # the others need no walk along their operations
    ops = walked(F.col("cigar_operations"))
    aligned = lambda items: F.aggregate(F.filter(items, lambda o: o["code"].isin("M", "=", "X")), F.lit(0), lambda s, o: s + o["length"])
    rows = reads.select("molecule", "record_index", F.length("sequence").alias("size"), "flags", "reference_start", ops.alias("ops"))
    big = F.filter(
        F.transform("ops", lambda o, i: F.struct(o["code"].alias("code"), o["length"].alias("length"), o["reference"].alias("reference"), o["query"].alias("query"), F.when(large(o), aligned(F.slice("ops", F.lit(1), i))).alias("before"))),
        lambda o: o["before"] >= ANCHOR,
    )
    gaps = rows.select("molecule", "record_index", "size", "flags", "reference_start", aligned("ops").alias("all"), F.explode(big).alias("o"))
    gaps = gaps.where((F.col("all") - F.col("o.before") >= ANCHOR) & (F.col("o.length") < length))
    at = F.col("reference_start") + F.col("o.reference")
    strand = F.when(F.col("flags").bitwiseAND(F.lit(0x10)) != 0, "-").otherwise("+")
    return gaps.select("molecule", coords.fold(at - 1, length).cast("long").alias("left"), coords.fold(at + F.col("o.length"), length).cast("long").alias("right"), F.col("o.length").cast("long").alias("length"), strand.alias("strand"), F.col("record_index").cast("long").alias("record"), F.col("o.query").cast("int").alias("query"), F.col("size").cast("int").alias("size"))


def split_junctions(parts: DataFrame, config: Config, length: int = coords.L) -> DataFrame:
    """The same from segments (molecule, strand, query_start, query_end, reference_start, reference_end, mapping_quality) that
    follow each other on the query and strand; bases that both claim count once. There is no record, and query counts on the
    read's own strand."""
    order = Window.partitionBy("molecule").orderBy("query_start", "query_end", "reference_start", "strand")
    names = ("strand", "query_end", "reference_start", "reference_end", "mapping_quality")
    rows = parts.select("*", *(F.lag(c).over(order).alias(f"p_{c}") for c in names)).where("p_strand = strand")
    span = lambda a, b: F.col(b) - F.col(a) + 1 >= ANCHOR
    rows = rows.where(F.least("mapping_quality", "p_mapping_quality") >= config.min_mapping_quality).where(span("reference_start", "reference_end") & span("p_reference_start", "p_reference_end"))
    forward, gap = F.col("strand") == "+", F.col("query_start") - F.col("p_query_end") - 1
    left = F.when(forward, F.col("p_reference_end")).otherwise(F.col("reference_end")) + F.least(gap, F.lit(0))
    right = F.when(forward, F.col("reference_start")).otherwise(F.col("p_reference_start"))
    query = F.col("p_query_end") + F.least(gap, F.lit(0))
    rows = rows.where(gap <= QUERY_GAP).select("molecule", left.alias("l"), right.alias("r"), "strand", query.alias("query"))
    size = F.when(F.col("r") > F.col("l"), F.col("r") - F.col("l") - 1).otherwise(F.col("r") - F.col("l") - 1 + length)
    out = rows.select("molecule", coords.fold("l", length).cast("long").alias("left"), coords.fold("r", length).cast("long").alias("right"), size.cast("long").alias("length"), "strand", F.lit(None).cast("long").alias("record"), F.col("query").cast("int").alias("query"), F.lit(None).cast("int").alias("size"))
    return out.where(F.col("length").between(LARGE, length - LARGE))


def large_deletions(junctions: DataFrame, pieces: DataFrame, consensus: str, molecules_used: int, depths: DataFrame | None = None, reads: DataFrame | None = None) -> DataFrame:
    """Deletions that two molecules or more show: start, end, length, microhomology, support by strand, molecules that span
    the breakpoints, fraction and interval, p, q, filters, pass.

    junctions as above; pieces (molecule, start, end) are aligned stretches without gaps of 50 or more. Equal junctions are
    one node, so clusters are found among distinct placements. A cluster's place is where its reads (molecule, record_index,
    flags, sequence, qualities) are likeliest, see `breakpoints`; without reads it is its commonest.
    """
    n = len(consensus)
    kind = T.StructType([T.StructField(c, T.LongType()) for c in ("left", "right", "shift")])

    @F.pandas_udf(kind)
    def leftmost(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([indels.junction(consensus, int(a), int(b)) for a, b in zip(left, right)], columns=["left", "right", "shift"])

    distinct = junctions.groupBy("left", "right", "length").agg(F.count("*").alias("n"))
    moved = distinct.withColumn("m", leftmost("left", "right")).select(F.col("left").alias("raw_left"), F.col("right").alias("raw_right"), "length", "m.*")
    moved = written(moved, "placements")
    nodes = moved.select("left", "length").distinct().withColumn("node", F.struct("left", "length"))
    clusters = band_components(nodes.select("node", "left", "length"), "node", {"left": PLACEMENT, "length": LENGTH_TOLERANCE})
    rows = junctions.withColumnsRenamed({"left": "raw_left", "right": "raw_right"}).join(moved, ["raw_left", "raw_right", "length"])
    rows = written(rows.withColumn("node", F.struct("left", "length")).join(clusters, "node").withColumn("cluster", F.to_json("component")), "junctions")
    first = rows.groupBy("cluster", "molecule").agg(F.min("strand").alias("strand"))
    support = first.groupBy("cluster").agg(F.count("*").alias("support"), F.count_if(F.col("strand") == "+").alias("forward"), F.count_if(F.col("strand") == "-").alias("reverse"))
    lone = F.broadcast(support.agg(F.count_if(F.col("support") < 2).alias("singletons")))
    counted = rows.groupBy("cluster", "left", "right", "shift").agg(F.count("*").alias("n"))
    variants = counted.withColumn("breakpoint_variants", F.count("*").over(Window.partitionBy("cluster")))
    place = breakpoints.frequent_placements(variants, 1).drop("rank", "n")
    if reads is not None:
        told = written(support.where("support >= 2").select("cluster"), "supported")
        best = breakpoints.refined(rows.join(told, "cluster", "left_semi"), counted.join(told, "cluster", "left_semi"), reads, consensus)
        moved = best.withColumn("m", leftmost("left", "right")).select("cluster", F.col("m").alias("better"))
        own = F.coalesce("better", F.struct("left", "right", "shift"))
        place = place.join(moved, "cluster", "left").withColumn("m", own).select("cluster", "breakpoint_variants", "m.*")
    found = support.where("support >= 2").crossJoin(lone).join(written(place, "places"), "cluster")
    size = F.when(F.col("right") > F.col("left"), F.col("right") - F.col("left") - 1).otherwise(n - F.col("left") + F.col("right") - 1)
    found = found.withColumn("length", size.cast("long")).where(F.col("length") >= LARGE)
    start, end = coords.fold(F.col("left") + 1 + F.col("shift"), n), coords.fold(F.col("right") + F.col("shift") - 1, n)
    found = found.withColumn("start", start.cast("long")).withColumn("end", end.cast("long")).withColumn("left_start", coords.fold(F.col("left") + 1, n).cast("long"))
    twice = F.lit(consensus + consensus)
    found = found.withColumn("microhomology", F.substring(twice, F.col("left_start").cast("int"), F.col("shift").cast("int")))
    points = found.select("cluster", F.explode(F.array("left_start", "end")).alias("point"))
    # carriers of one deletion do span another's point, so counts are taken for each cluster and point
    wild = _spanning_by_cluster(pieces, points, first)
    for name, at in (("wild_left", "left_start"), ("wild_right", "end")):
        found = found.join(wild.select("cluster", F.col("point").alias(at), F.col("n").alias(name)), ["cluster", at], "left").fillna(0, [name])
    half = (F.col("wild_left") + F.col("wild_right")) / 2.0
    total = F.col("support") + half
    low, high = stats.wilson(F.col("support"), total)
    seen = half > 0
    background = F.greatest(F.col("singletons") / max(1, molecules_used) * (4.0 * PLACEMENT * LENGTH_TOLERANCE) / (n * n / 2.0), F.lit(1e-7))
    found = found.withColumn("fraction", F.when(seen, F.col("support") / total)).withColumn("ci_low", F.when(seen, low)).withColumn("ci_high", F.when(seen, high))
    found = found.withColumn("p", stats.beta_binomial_survival(F.col("support").cast("int"), F.round(total).cast("int"), background, F.lit(0.0)))
    tested = stats.benjamini_hochberg(found, "p", ["start", "end"])
    edge = (F.col("left_start") <= ORIGIN) | (F.col("end") <= ORIGIN) | (F.col("left_start") + ORIGIN > n) | (F.col("end") + ORIGIN > n)
    one_way = (F.col("support") >= 8) & ((F.col("forward") == 0) | (F.col("reverse") == 0))
    rules = (("low_support", F.col("support") < 3), ("single_strand_support", one_way), ("linearization_origin", edge), ("not_significant", F.col("q") > FDR))
    filters = F.array_compact(F.array(*(F.when(c, name) for name, c in rules)))
    tested = tested.withColumn("depth_ratio", F.lit(None).cast("double")) if depths is None else _with_depth_ratio(tested, depths)
    discordant = (F.col("fraction") >= 0.2) & (F.col("depth_ratio") > 1 - F.col("fraction") / 2)
    notes = (("breakpoints_not_spanned", ~seen), ("depth_discordant", discordant), ("direct_repeat_flanked", F.length("microhomology") >= 5))
    flags = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in notes)))
    common = (F.col("start") == COMMON[0]) & (F.col("length") == COMMON[1])
    names = ("start", "end", "length", "microhomology", "breakpoint_variants", "support", "forward", "reverse", "wild_left", "wild_right", "fraction", "ci_low", "ci_high", "p", "q", "depth_ratio")
    event = F.concat(F.lit("pdeletion:"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    return tested.select(event.alias("event"), *names, filters.alias("filters"), flags.alias("flags"), common.alias("common"), (F.size(filters) == 0).alias("pass"))


def _with_depth_ratio(deletions: DataFrame, depths: DataFrame, step: int = 20) -> DataFrame:
    """Adds the median depth inside over that outside, at every `step`-th position; depths is as long as the genome."""
    some = depths.where((F.col("position") - 1) % step == 0).agg(F.collect_list(F.struct("position", "depth")).alias("_depths"))
    a, b = F.col("left_start"), F.col("end")
    inside = lambda x: F.when(a <= b, x["position"].between(a, b)).otherwise((x["position"] >= a) | (x["position"] <= b))
    median = lambda values: F.when(F.size(values) > 0, (F.get(values, F.floor((F.size(values) - 1) / 2).cast("int")) + F.get(values, F.floor(F.size(values) / 2).cast("int"))) / 2.0)
    part = lambda test: median(F.array_sort(F.transform(F.filter("_depths", test), lambda x: x["depth"])))
    ratio = part(inside) / F.nullif(part(lambda x: ~inside(x)), F.lit(0.0))
    return deletions.crossJoin(F.broadcast(some)).withColumn("depth_ratio", ratio).drop("_depths")


def with_impact(deletions: DataFrame) -> DataFrame:
    """The calls with what they do to genes."""
    return deletions.join(deletion_impact(deletions.select("event", "start", "end").distinct()), "event")


def _spanning_by_cluster(pieces: DataFrame, points: DataFrame, carriers: DataFrame, flank: int = 25) -> DataFrame:
    """cluster, point, n: molecules that span a point with its flanks and don't carry the cluster's deletion."""
    wide = points.distinct().select("cluster", "point", (F.col("point") - flank).alias("p_start"), (F.col("point") + flank).alias("p_end"))
    over = intervals.overlapping(pieces.select("molecule", "start", "end"), wide, "start", "end", "p_start", "p_end").where("start <= p_start and end >= p_end")
    left = over.select("cluster", "point", "molecule").distinct().join(carriers.select("cluster", "molecule"), ["cluster", "molecule"], "left_anti")
    return left.groupBy("cluster", "point").agg(F.count("*").alias("n"))
