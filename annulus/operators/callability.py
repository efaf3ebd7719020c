"""Where alignments and molecules show the reference's path, found within each row: no base is ever a row of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annulus.config import Config
from annulus.functions import coords
from annulus.operators import intervals
from annulus.operators.alignments import base_places, exclusion_reason, walked


def runs(positions: Column) -> Column:
    """array of (start, end): the runs of an array of positions, in order; repeated positions count once."""
    # a sorted array of distinct values with its neighbours on both sides
    a = F.sort_array(F.array_distinct(positions))
    before = F.concat(F.array(F.lit(None).cast("long")), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))))
    after = F.concat(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.lit(None).cast("long")))
    first = F.filter(F.zip_with(a, before, lambda x, y: F.when(y.isNull() | (y != x - 1), x)), lambda x: x.isNotNull())
    last = F.filter(F.zip_with(a, after, lambda x, y: F.when(y.isNull() | (y != x + 1), x)), lambda x: x.isNotNull())
    return F.zip_with(first, last, lambda x, y: F.struct(x.alias("start"), y.alias("end")))


def alignments(reads: DataFrame, reference: str, config: Config) -> DataFrame:
    """molecule, alignment, status, eligible, ranges, callable_bases, anchors, exclusions, inserted, clipped.

    reads: molecule, record_index and an alignment's columns. status is the first reason to leave the alignment out, else
    ASSESSED; ranges hold good bases over known reference bases; anchors are the positions in front of insertions;
    exclusions counts positions without a good base by reason.
    """
    length, bases = len(reference), F.col("places")
    unknown = F.array(*(F.lit(i + 1).cast("long") for i, c in enumerate(reference) if c not in "ACGT")).cast("array<long>")
    ops = walked(F.col("cigar_operations"))
    at = lambda o: coords.fold(F.col("reference_start") + o["reference"], length).cast("long")
    walked_rows = reads.select("molecule", F.col("record_index").alias("alignment"), exclusion_reason(config).alias("_reason"), "reference_start", ops.alias("ops"), base_places(ops).alias("x"))
    rows = walked_rows.withColumn("places", F.transform("x", lambda b: F.struct(at(b).alias("position"), b["base"].isin(*"ACGT").alias("known"), (b["quality"] >= config.min_base_quality).alias("good"))))
    plain = lambda b: ~F.array_contains(unknown, b["position"])
    some = lambda f: F.size(F.filter(bases, f)).cast("long")
    total = lambda code: F.aggregate(F.filter("ops", lambda o: o["code"] == code), F.lit(0).cast("long"), lambda s, o: s + o["length"])
    tallies = {
        "NON_CANONICAL_REFERENCE_BASE": some(lambda b: ~plain(b)),
        "NON_CANONICAL_OBSERVED_BASE": some(lambda b: plain(b) & ~b["known"]),
        "LOW_OR_INVALID_BASE_QUALITY": some(lambda b: plain(b) & b["known"] & ~b["good"]),
        "DELETION_FROM_REFERENCE_PATH": total("D"),
        "REFERENCE_SKIP": total("N"),
    }
    counts = F.map_filter(F.create_map(*(c for k, v in tallies.items() for c in (F.lit(k), v))), lambda k, v: v > 0)
    good = F.transform(F.filter(bases, lambda b: plain(b) & b["known"] & b["good"]), lambda b: b["position"])
    anchors = F.array_sort(F.array_distinct(F.transform(F.filter("ops", lambda o: o["code"] == "I"), lambda o: coords.fold(F.col("reference_start") + o["reference"] - 1, length).cast("long"))))
    fine = F.col("_reason").isNull()
    out = rows.select("molecule", "alignment", F.coalesce("_reason", F.lit("ASSESSED")).alias("status"), fine.alias("eligible"), F.when(fine, runs(good)).otherwise(F.array().cast("array<struct<start:long,end:long>>")).alias("ranges"),
                      F.when(fine, anchors).otherwise(F.array().cast("array<long>")).alias("anchors"), F.when(fine, counts).alias("exclusions"), F.when(fine, total("I")).alias("inserted"), F.when(fine, total("S")).alias("clipped"))
    return out.withColumn("callable_bases", F.aggregate("ranges", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"] + 1))


def ranges(assessed: DataFrame) -> DataFrame:
    """molecule, alignment, start, end, as the evidence graph's joins take them."""
    return assessed.select("molecule", "alignment", F.explode("ranges").alias("r")).select("molecule", "alignment", "r.start", "r.end")


def disrupted(assessed: DataFrame) -> DataFrame:
    """molecule, alignment, anchor."""
    return assessed.select("molecule", "alignment", F.explode("anchors").alias("anchor"))


def molecules(assessed: DataFrame, nuclear: DataFrame) -> DataFrame:
    """molecule, status, callable_bases: EXCLUDED_NUMT for molecules in `nuclear`, NOT_ASSESSABLE without an eligible
    alignment, ASSESSED_EMPTY without a callable base, else ASSESSED. Positions of several alignments count once."""
    union = intervals.merged(ranges(assessed), ["molecule"]).groupBy("molecule").agg(F.sum(F.col("end") - F.col("start") + 1).alias("bases"))
    known = assessed.groupBy("molecule").agg(F.bool_or("eligible").alias("known"))
    rows = known.join(union, "molecule", "left").join(nuclear.select("molecule").distinct().withColumn("numt", F.lit(True)), "molecule", "left")
    n = F.when(F.col("numt").isNull(), F.coalesce("bases", F.lit(0))).otherwise(0).cast("long")
    status = F.when(F.col("numt"), "EXCLUDED_NUMT").when(~F.col("known"), "NOT_ASSESSABLE").when(n == 0, "ASSESSED_EMPTY").otherwise("ASSESSED")
    return rows.select("molecule", status.alias("status"), n.alias("callable_bases"))
