"""Statistical substitution calls from a pileup of molecules.

Reads shrink to a row for each position, base and strand before anything is
fitted; what follows is bounded by the genome, whatever the number of reads.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annulus.config import Config
from annulus.functions import coords, indels, stats
from annulus.operators.alignments import base_places, walked
from annulus.operators.evidence import outliers
from annulus.operators.intervals import merged, split_at_origin
from annulus.operators.shared import written

# Fixed values of the calling method.
QUALITY_BINS = 8
PROXIMITY_BINS = 5
GAP_WINDOW = 5
SMALL_GAP = 49
STRAND_DEPTH = 10
FDR = 0.01
EFFECT_MULTIPLE = 2.0
LOW_SUPPORT = 5
WEAKER_STRAND = 0.01
LOW_LEVEL = 0.25
TRIM, MEAN_FLOOR, RHO_FLOOR, SHRINKAGE = 0.01, 2e-5, 2e-4, 30.0
DIVERGENCE_BASES = 200
REPORTED_FILTERED = 200


def read_bases(reads: DataFrame, config: Config, length: int = coords.L) -> DataFrame:
    """molecule, record_index, query, position, base, strand (0, 1), quality_bin, proximity_bin, near_gap: good aligned bases.

    reads: molecule, record_index, flags, reference_start, cigar_operations, sequence, qualities.
    """
    gap = lambda o: F.coalesce((o["code"] == "I") | ((o["code"] == "D") & (o["length"] <= SMALL_GAP)), F.lit(False))
    ops = walked(F.col("cigar_operations"))
    around = F.transform(
        ops,
        lambda o, i: F.struct(o["code"].alias("code"), o["length"].alias("length"), o["query"].alias("query"), o["reference"].alias("reference"), gap(F.get(ops, i - 1)).alias("before"), gap(F.get(ops, i + 1)).alias("after")),
    )
    beside = lambda o, i: [((o["before"] & (i < GAP_WINDOW)) | (o["after"] & (o["length"] - 1 - i < GAP_WINDOW))).alias("near_gap")]
    strand = F.when(F.col("flags").bitwiseAND(F.lit(0x10)) != 0, 1).otherwise(0)
    rows = reads.select("molecule", "record_index", "reference_start", F.length("sequence").alias("size"), strand.alias("strand"), F.explode(base_places(around, beside)).alias("x"))
    q, quality = F.col("x.query"), F.col("x.quality")
    distance = F.least(q, F.col("size") - 1 - q)
    out = rows.select(
        "molecule",
        "record_index",
        q.alias("query"),
        coords.fold(F.col("reference_start") + F.col("x.reference"), length).cast("long").alias("position"),
        F.col("x.base").alias("base"),
        "strand",
        quality.alias("quality"),
        F.least(F.floor(quality / 5), F.lit(QUALITY_BINS - 1)).cast("int").alias("quality_bin"),
        F.least(F.floor(2 * distance * PROXIMITY_BINS / F.col("size")), F.lit(PROXIMITY_BINS - 1)).cast("int").alias("proximity_bin"),
        F.col("x.near_gap").alias("near_gap"),
    )
    return out.where((F.col("quality") >= config.min_base_quality) & F.col("base").isin(*"ACGT")).drop("quality")


def pileup(bases: DataFrame) -> DataFrame:
    """position, base, forward, reverse, near_gap, quality (histogram), proximity (histogram): a molecule counts once at a
    position, by its first base there."""
    first = F.min(F.struct("record_index", "query", "base", "strand", "quality_bin", "proximity_bin", "near_gap"))
    one = bases.groupBy("molecule", "position").agg(first.alias("b")).select("position", "b.*")
    histogram = lambda c, n: F.array(*(F.count_if(F.col(c) == i) for i in range(n))).alias(c.removesuffix("_bin"))
    return one.groupBy("position", "base").agg(
        F.count_if(F.col("strand") == 0).alias("forward"),
        F.count_if(F.col("strand") == 1).alias("reverse"),
        F.count_if("near_gap").alias("near_gap"),
        histogram("quality_bin", QUALITY_BINS),
        histogram("proximity_bin", PROXIMITY_BINS),
    )


def consensus(cells: DataFrame, reference: DataFrame) -> DataFrame:
    """position, ref, major: the commonest base; the reference's of equals, then the first; the reference's where nothing is seen."""
    counted = cells.join(reference, "position").groupBy("position").agg(
        F.max_by("base", F.struct(F.col("forward") + F.col("reverse"), F.col("base") == F.col("ref"), -F.ascii("base"))).alias("major")
    )
    return reference.join(counted, "position", "left").select("position", "ref", F.coalesce("major", "ref").alias("major"))


def divergent(bases: DataFrame, agreed: DataFrame) -> DataFrame:
    """molecule, divergence, outlier of molecules with at least 200 bases: the share that differs from the consensus."""
    rows = bases.join(F.broadcast(agreed.select("position", "major")), "position")  # a row for each position of the genome
    share = rows.groupBy("molecule").agg(F.avg((F.col("base") != F.col("major")).cast("int")).alias("divergence"), F.count("*").alias("n"))
    return outliers(share.where(F.col("n") >= DIVERGENCE_BASES).drop("n"), "divergence").select("molecule", "divergence", "outlier")


def contexts(agreed: DataFrame) -> DataFrame:
    """position, base, strand, context: the class of an error to `base`: its neighbours as the strand reads them and the
    longest run of equal bases there (up to 3, 4 or 5, more); null where a base is unknown.

    The consensus is as long as the genome, so it is read on the driver.
    """
    spark = agreed.sparkSession
    sequence = "".join(r.major for r in agreed.orderBy("position").select("major").toLocalIterator())
    n, other = len(sequence), dict(zip("ACGT", "TGCA"))
    runs = [indels.homopolymer_run(sequence, p) for p in range(1, n + 1)]
    rows = []
    for i, center in enumerate(sequence):
        before, after = sequence[i - 1], sequence[(i + 1) % n]
        run = max(runs[i - 1], runs[i], runs[(i + 1) % n])
        size = "short" if run <= 3 else "middle" if run <= 5 else "long"
        for base in "ACGT":
            if base == center:
                continue
            known = {before, center, after} <= set("ACGT")
            rows.append((i + 1, base, 0, f"{before}{center}{after}>{base}:{size}" if known else None))
            rows.append((i + 1, base, 1, f"{other[after]}{other[center]}{other[before]}>{other[base]}:{size}" if known else None))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["position", "base", "strand", "context"]), "position long, base string, strand int, context string")


def run_lengths(spark, sequence: str) -> DataFrame:
    """position, run, unit, span: runs of equal bases around the origin, and the tandem repeat over each position."""
    repeats = indels.repeat_context(sequence)
    rows = [(p, indels.homopolymer_run(sequence, p), *repeats[p - 1]) for p in range(1, len(sequence) + 1)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["position", "run", "unit", "span"]), "position long, run long, unit long, span long")


def error_fits(cells: DataFrame, agreed: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(context, mean, rho) of each class, drawn to the genome's the fewer sites it has, and the genome's (mean, rho)."""
    depth = cells.groupBy("position").agg(F.sum("forward").alias("d0"), F.sum("reverse").alias("d1"))
    strands = lambda a, b: F.explode(F.array(*(F.struct(F.lit(s).alias("strand"), F.col(x).alias("k"), F.col(d).alias("n")) for s, (x, d) in enumerate(zip(a, b)))))
    every = classes.select("position", "base").distinct().join(depth, "position").join(cells.select("position", "base", "forward", "reverse"), ["position", "base"], "left").fillna(0)
    sites = every.join(agreed.where(F.col("major").isin(*"ACGT")).select("position"), "position").select("position", "base", strands(("forward", "reverse"), ("d0", "d1")).alias("s"))
    sites = sites.select("position", "base", "s.*").where("n > 0").join(classes, ["position", "base", "strand"]).select(F.coalesce("context", F.lit("")).alias("context"), "k", "n")

    def fit(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["n", "k"])
        mean, rho, count = stats.fit_beta_binomial(x.k, x.n, TRIM, MEAN_FLOOR, RHO_FLOOR)
        return pd.DataFrame([(x.context.iloc[0], mean, rho, count)], columns=["context", "mean", "rho", "sites"])

    schema = "context string, mean double, rho double, sites long"
    whole = sites.withColumn("genome", F.lit(0)).groupBy("genome").applyInPandas(fit, schema).select(F.col("mean").alias("all_mean"), F.col("rho").alias("all_rho"))  # six sites for each position
    share = F.col("sites") / (F.col("sites") + SHRINKAGE)
    drawn = lambda a, b: share * F.col(a) + (1 - share) * F.col(b)
    each = sites.groupBy("context").applyInPandas(fit, schema).crossJoin(F.broadcast(whole))
    return each.select("context", drawn("mean", "all_mean").alias("mean"), F.greatest(drawn("rho", "all_rho"), F.lit(RHO_FLOOR)).alias("rho")), whole


def substitutions(cells: DataFrame, agreed: DataFrame) -> DataFrame:
    """Calls of bases that differ from the reference with two reads or more: depth, fraction and its interval, p, q,
    filters, pass. Every covered position counts as three hypotheses."""
    classes = contexts(agreed)
    fits, whole = error_fits(cells, agreed, classes)
    depth = cells.groupBy("position").agg(F.sum("forward").alias("n0"), F.sum("reverse").alias("n1"))
    covered = depth.agg((F.count("*") * 3).alias("hypotheses"))
    fitted = lambda s: classes.where(F.col("strand") == s).join(fits, F.coalesce(classes.context, F.lit("")) == fits.context).select("position", "base", F.col("mean").alias(f"mean{s}"), F.col("rho").alias(f"rho{s}"))
    major = cells.join(agreed, "position").where("base = major").select("position", F.col("quality").alias("major_quality"), F.col("proximity").alias("major_proximity"), (F.col("near_gap") / (F.col("forward") + F.col("reverse"))).alias("major_gap"))
    rows = cells.join(agreed, "position").where("base <> ref and ref in ('A', 'C', 'G', 'T')").join(depth, "position").join(fitted(0), ["position", "base"], "left").join(fitted(1), ["position", "base"], "left")
    rows = rows.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(covered)).join(major, "position", "left")
    for s in "01":  # the commonest base has no class
        rows = rows.withColumn(f"mean{s}", F.coalesce(f"mean{s}", "all_mean")).withColumn(f"rho{s}", F.coalesce(f"rho{s}", "all_rho"))
    k0, k1, n0, n1 = (F.col(c) for c in ("forward", "reverse", "n0", "n1"))
    rows = rows.withColumn("p0", stats.beta_binomial_survival(k0, n0, F.col("mean0"), F.col("rho0"))).withColumn("p1", stats.beta_binomial_survival(k1, n1, F.col("mean1"), F.col("rho1")))
    rows = rows.withColumn("both", (n0 >= STRAND_DEPTH) & (n1 >= STRAND_DEPTH))
    one = F.when(n0 >= n1, F.col("p0")).otherwise(F.col("p1"))
    rows = rows.withColumn("p", F.when(F.col("both"), stats.fisher_combined(F.col("p0"), F.col("p1"))).otherwise(one))
    rows = rows.withColumn("weaker", F.when(F.col("both"), F.greatest("p0", "p1")).otherwise(0.0))
    tested = stats.benjamini_hochberg(rows, "p", ["position", "base"], F.col("hypotheses")).where("forward + reverse >= 2")
    n, k = n0 + n1, k0 + k1
    tested = tested.withColumn("depth", n).withColumn("alternate_depth", k).withColumn("raw", k / n)
    tested = tested.withColumn("background", (F.col("mean0") * n0 + F.col("mean1") * n1) / n).withColumn("rho", (F.col("rho0") * n0 + F.col("rho1") * n1) / n)
    tested = tested.withColumn("strand_p", stats.fisher_exact_p(k0, n0 - k0, k1, n1 - k1))
    tested = tested.withColumn("by_quality", stats.rank_sum("quality", F.coalesce("major_quality", "quality"))).withColumn("by_end", stats.rank_sum("proximity", F.coalesce("major_proximity", "proximity")))
    return _judged(tested)


def _judged(rows: DataFrame) -> DataFrame:
    raw, background, both = F.col("raw"), F.col("background"), F.col("both")
    corrected = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - background) / F.greatest(F.lit(0.25), 1 - 4 * background)))
    effective = F.col("depth") / (1 + (F.col("depth") - 1) * F.col("rho"))
    low, high = stats.wilson(raw * effective, effective)
    r0, r1 = F.col("forward") / F.nullif("n0", F.lit(0)), F.col("reverse") / F.nullif("n1", F.lit(0))
    minor = (F.col("base") != F.col("major")) & (F.col("alternate_depth") >= LOW_SUPPORT)
    gap = F.col("near_gap") / F.col("alternate_depth")
    by_quality = (F.col("by_quality.p") < F.when(raw < 0.05, 0.02).otherwise(1e-3)) & (F.col("by_quality.shift") <= -0.6)
    by_end = (F.col("by_end.p") < 1e-4) & (F.col("by_end.shift") <= -0.75)
    rules: list[tuple[str, Column]] = [
        ("below_error_floor", raw < EFFECT_MULTIPLE * background),
        ("low_support", (raw < 0.5) & (F.col("alternate_depth") < LOW_SUPPORT)),
        ("strand_bias", both & (F.col("strand_p") < 1e-3) & (F.least(r0, r1) < 0.25 * F.greatest(r0, r1))),
        ("one_strand_support", both & (F.col("weaker") > WEAKER_STRAND) & (raw < 0.2)),
        ("low_alternate_base_quality", minor & by_quality),
        ("read_end_bias", minor & by_end),
        ("gap_adjacent", minor & (raw < LOW_LEVEL) & (gap >= 0.4) & (gap >= 3 * F.coalesce("major_gap", F.lit(0.0)))),
        ("not_significant", F.col("q") > FDR),
    ]
    filters = F.array_compact(F.array(*(F.when(c, name) for name, c in rules)))
    fraction = corrected(raw)
    return rows.select(
        "position",
        "ref",
        F.col("base").alias("alt"),
        "depth",
        "alternate_depth",
        fraction.alias("fraction"),
        F.least(corrected(low), fraction).alias("ci_low"),
        F.greatest(corrected(high), fraction).alias("ci_high"),
        "p",
        "q",
        "background",
        filters.alias("filters"),
        (F.size(filters) == 0).alias("pass"),
    )


def reportable(calls: DataFrame, keep: int = REPORTED_FILTERED) -> DataFrame:
    """All calls that pass, and the filtered ones with the smallest p."""
    return calls.where("pass").unionByName(calls.where("not pass").orderBy("p", "position", "alt").limit(keep))


def call_substitutions(reads: DataFrame, reference: DataFrame, config: Config, length: int = coords.L) -> DataFrame:
    """Calls from usable reads; molecules that differ from the consensus far more than the rest are left out."""
    bases = read_bases(reads, config, length)
    first = consensus(pileup(bases), reference)
    gone = divergent(bases, first).where("outlier").select("molecule")
    cells = written(pileup(bases.join(gone, "molecule", "left_anti")), "cells")
    return substitutions(cells, written(consensus(cells, reference), "consensus"))


def aligned_pieces(reads: DataFrame, length: int = coords.L, gap: int = 50, guard: int = 0) -> DataFrame:
    """molecule, strand, start, end: stretches of alignments without a gap of `gap` or more, `guard` positions shorter on both
    sides, cut at the origin."""
    large = lambda o: o["code"].isin("D", "N") & (o["length"] >= gap)
    # only operations with a gap are walked along
    gaps = F.when(F.exists("cigar_operations", large), F.filter(walked(F.col("cigar_operations")), large))
    whole = F.aggregate(F.filter("cigar_operations", lambda o: o["code"].isin("M", "D", "N", "=", "X")), F.lit(0), lambda s, o: s + o["length"])
    strand = F.when(F.col("flags").bitwiseAND(F.lit(0x10)) != 0, 1).otherwise(0)
    rows = reads.select("molecule", "reference_start", strand.alias("strand"), gaps.alias("gaps"), whole.alias("whole"))
    each = lambda f: F.coalesce(F.transform("gaps", f), F.array().cast("array<int>"))
    starts = F.concat(F.array(F.lit(0)), each(lambda o: o["reference"] + o["length"]))
    ends = F.concat(each(lambda o: o["reference"]), F.array(F.col("whole")))
    parts = rows.select("molecule", "strand", "reference_start", F.explode(F.arrays_zip(starts.alias("a"), ends.alias("b"))).alias("p")).where(F.col("p.b") - F.col("p.a") > 2 * guard)
    at = lambda x: coords.fold(F.col("reference_start") + x, length).cast("long")
    return split_at_origin(parts.select("molecule", "strand", at(F.col("p.a") + guard).alias("start"), at(F.col("p.b") - guard - 1).alias("end")), length=length).drop("piece")


def spanning_depths(pieces: DataFrame, length: int = coords.L) -> DataFrame:
    """position, n0, n1: molecules by strand over each position; a molecule's overlapping pieces count once."""
    once = merged(pieces, ["molecule", "strand"])
    ends = F.array(F.struct(F.col("start").alias("position"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("position"), F.lit(-1).alias("d")))
    side = lambda s: F.sum(F.when(F.col("strand") == s, F.col("x.d")).otherwise(0)).alias(f"n{s}")
    sums = once.select("strand", F.explode(ends).alias("x")).groupBy("x.position").agg(side(0), side(1))
    every = pieces.sparkSession.range(1, length + 1).select(F.col("id").alias("position"))
    running = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)  # one row for each position of the genome
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(running).cast("long").alias(c)
    return every.join(sums, "position", "left").select("position", total("n0"), total("n1"))
