"""Where the ends of a large deletion are: candidate placements of each cluster of junctions against the reads over it.

Aligners put a gap anywhere near a repeat or a changed base. So each cluster gets candidates, the commonest
placements and those around the first of them, and each is scored by the likelihood of the cluster's
reads under the sequence that the placement spells. Placements that spell the same sequence are one candidate.
The unit of work is a row (cluster, candidate, read); candidates and reads of a cluster are bounded by constants,
so no cluster is larger than another at this point, whatever its support.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annulus.functions import haplotypes, text
from annulus.operators.shared import written

# Fixed values of the calling method: placements by frequency, width of the grid around the first, reads of a cluster,
# bases of a read on each side, spare bases of a candidate, band of the alignment, scores that count as equal.
PLACEMENTS, GRID, READS, FLANK, SPARE, BAND, EQUAL = 6, 9, 40, 40, 10, 16, 1e-9


def frequent_placements(counted: DataFrame, keep: int = PLACEMENTS) -> DataFrame:
    """The commonest placements (cluster, left, right, n) of each cluster with their rank, ties by place."""
    order = Window.partitionBy("cluster").orderBy(F.desc("n"), "left", "right")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def spelled(consensus: str, left: Column, right: Column, flank: int = FLANK + SPARE) -> Column:
    """The sequence around a junction of kept positions left and right on the circle; unknown bases are left out."""
    n, around = len(consensus), F.lit(consensus * 3)
    cut = lambda at: F.substring(around, at.cast("int"), F.lit(flank))
    return F.regexp_replace(F.concat(cut(left + n - flank + 1), cut(right + n)), "N", "")


def candidates(counted: DataFrame, consensus: str) -> DataFrame:
    """cluster, rank, left, right, haplotype: each sequence once, at its first placement: the common ones by
    frequency, then the grid around the first, row by row."""
    n, half = len(consensus), GRID // 2
    common = frequent_placements(counted)
    steps = F.explode(F.array(*(F.struct(F.lit(PLACEMENTS + 1 + i * GRID + j).alias("rank"), F.lit(i - half).alias("a"), F.lit(j - half).alias("b")) for i in range(GRID) for j in range(GRID))))
    grid = common.where("rank = 1").select("cluster", "left", "right", steps.alias("s"))
    grid = grid.select("cluster", F.col("s.rank").alias("rank"), (F.col("left") + F.col("s.a")).alias("left"), (F.col("right") + F.col("s.b")).alias("right"))
    both = common.select("cluster", "rank", "left", "right").unionByName(grid).where(F.col("left").between(1, n) & F.col("right").between(1, n))
    spelt = both.withColumn("haplotype", spelled(consensus, F.col("left"), F.col("right")))
    first = F.min(F.struct("rank", "left", "right")).alias("p")
    return spelt.groupBy("cluster", "haplotype").agg(first).select("cluster", "p.*", "haplotype")


def representatives(reads: DataFrame) -> DataFrame:
    """molecule, r_record, r_size, r_strand: the first primary record of each molecule, with which split alignments are told."""
    own = reads.where(F.col("flags").bitwiseAND(F.lit(0x900)) == 0)
    strand = F.when(F.col("flags").bitwiseAND(F.lit(0x10)) != 0, "-").otherwise("+")
    first = F.min(F.struct(F.col("record_index").alias("r_record"), F.length("sequence").alias("r_size"), strand.alias("r_strand")))
    return own.groupBy("molecule").agg(first.alias("r")).select("molecule", "r.*")


def read_windows(members: DataFrame, reads: DataFrame, length: int, keep: int = READS) -> DataFrame:
    """cluster, molecule, sequence, qualities: what a read holds FLANK bases to both sides of a junction, as the reference runs.

    members (cluster, molecule, left, right, length, raw_left, strand, record, query, size): a junction's place after and
    before it was moved left, and the bases in front of it in its record. Without record, query counts on the
    read's own strand. The first `keep` of a cluster by place, length and molecule are taken that have bases enough.
    """
    split = F.col("record").isNull()
    told = members
    if "r_record" not in members.columns:
        # only split alignments are told by their molecule's record
        asked = written(members.where(split).select("molecule").distinct(), "split-molecules")
        told = members.join(representatives(reads.join(asked, "molecule", "left_semi")), "molecule", "left")
    turned = split & (F.col("r_strand") != F.col("strand"))
    at = F.when(~split, F.col("query")).when(F.col("r_strand") == "-", F.col("r_size") - F.col("query")).otherwise(F.col("query"))
    moved = F.pmod(F.col("raw_left") + length - F.col("left"), F.lit(length))  # the gap moves in the read with its placement
    at = F.when(turned, at + moved).otherwise(at - moved).cast("int")
    placed = told.select(
        "cluster", "molecule", "left", "length", "right", turned.alias("turned"), at.alias("at"), F.coalesce("record", "r_record").alias("record_index"), F.coalesce("size", "r_size").alias("size")
    )
    placed = placed.where((F.col("at") >= FLANK) & (F.col("at") + FLANK <= F.col("size")))
    order = Window.partitionBy("cluster").orderBy("left", "length", "molecule", "right", "record_index", "at")
    few = placed.withColumn("i", F.row_number().over(order)).where(F.col("i") <= keep).select("cluster", "record_index", "at", "turned", "i")
    few = written(few, "chosen-reads")  # a few of each cluster: broadcast by its size, so that reads aren't shuffled with their bases
    reads = reads.join(few.select("record_index").distinct(), "record_index", "left_semi")
    cut = lambda c: F.substring(F.col(c), F.col("at") - FLANK + 1, F.lit(2 * FLANK))
    cutout = few.join(reads.select("record_index", "molecule", "sequence", "qualities"), "record_index").select("cluster", "molecule", "i", "turned", cut("sequence").alias("s"), cut("qualities").alias("q"))
    sequence = F.when(F.col("turned"), text.reverse_complement(F.upper("s"))).otherwise(F.upper("s"))
    return cutout.select("cluster", "molecule", "i", sequence.alias("sequence"), F.when(F.col("turned"), F.reverse("q")).otherwise(F.col("q")).alias("qualities"))


@F.pandas_udf(T.DoubleType())
def _fit(haplotype: pd.Series, sequence: pd.Series, qualities: pd.Series) -> pd.Series:
    """log10 likelihood of each read under its row's haplotype; a haplotype's rows of a batch are computed together."""
    out = np.empty(len(haplotype))
    for own, rows in haplotype.groupby(haplotype).groups.items():
        places = haplotype.index.get_indexer(rows)
        phred = [np.frombuffer(q.encode(), np.uint8).astype(float) - 33 for q in qualities.iloc[places]]
        out[places] = haplotypes.pair_hmm_batch(list(sequence.iloc[places]), phred, own, band=BAND)
    return pd.Series(out)


def scores(found: DataFrame, windows: DataFrame) -> DataFrame:
    """cluster, rank, left, right, score: the likelihood of all windows of the cluster under each candidate."""
    # few rows that each take long: dealt to all tasks, which adaptive execution would merge into one
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = found.join(windows, "cluster").repartition(tasks, "cluster", "rank")
    each = rows.select("cluster", "rank", "left", "right", _fit("haplotype", "sequence", "qualities").alias("score"))
    return each.groupBy("cluster", "rank", "left", "right").agg(F.sum("score").alias("score"))


def likeliest(scored: DataFrame) -> DataFrame:
    """cluster, left, right: the candidate with the best score, the first of equals; clusters that no candidate explains have none."""
    top = F.max("score").over(Window.partitionBy("cluster"))
    best = scored.where(F.col("score") > float("-inf")).withColumn("top", top).where(F.col("score") >= F.col("top") - EQUAL)
    return best.groupBy("cluster").agg(F.min(F.struct("rank", "left", "right")).alias("p")).select("cluster", "p.left", "p.right")


def refined(members: DataFrame, counted: DataFrame, reads: DataFrame, consensus: str) -> DataFrame:
    """cluster, left, right of clusters with windows: where their reads say that the deletion is."""
    windows = written(read_windows(members, reads, len(consensus)), "windows")
    return likeliest(written(scores(candidates(counted, consensus), windows), "placement-scores"))
