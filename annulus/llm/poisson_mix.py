"""Mixing sources to target weights by Poisson replication.

A source's rate is its mean number of repetitions: the budget times its target
weight over its present size. Each document draws its count by inverting the
Poisson distribution of its source's rate at a point given by a hash of seed,
doc_id and text, is exploded by this count, and all copies are shuffled globally
by another hash. Expected sizes are exact; a count depends on no other row, so
retried tasks repeat it.

Nulls: documents without source form a source of their own; a null text counts as
empty, with size 0; rows without doc_id draw by their texts. Rows that share a
doc_id but not the text draw each for itself; rows equal in both draw the same
count. A source whose texts are all empty has no size to scale: rate 1. Sources
without a target weight get weight 0; if no source has one above 0, the rates are null and nothing is drawn; a very long text is one row like any other;
an empty table gives no rows. Columns named as the added ones are replaced, other
names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annulus.llm.workspace import free_name, written

SEED = 11
#: Without target weights a source's weight is its size to this power: small sources repeat, large ones thin out.
TEMPERATURE = 0.7


def _name():
    """What a document's draws are made of: doc_id and a digest of the text."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def _point(*parts):
    """A point in [0, 1) from 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


#: Target weights by source: a mapping, a table (source, weight), or none (see TEMPERATURE).
Weights = dict[str | None, float] | DataFrame | None


def rates(docs: DataFrame, weights: Weights = None, budget: float = 1.0) -> DataFrame:
    """source, size (code points), rate. `budget` is the expected size after mixing over the size before."""
    sizes = docs.groupBy("source").agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).cast("double").alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow("size", F.lit(TEMPERATURE)))
    else:
        if isinstance(weights, dict):
            weights = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        target = weights.select(F.col("source").alias("target"), F.col("weight").cast("double").alias("weight"))
        weighed = sizes.join(target, F.col("source").eqNullSafe(F.col("target")), "left").drop("target").fillna(0.0, ["weight"])
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row for each source
    share = F.col("weight") / F.nullif(F.sum("weight").over(every), F.lit(0.0)) * F.sum("size").over(every) * F.lit(float(budget))
    return weighed.withColumn("rate", F.when(F.col("size") > 0, share / F.col("size")).otherwise(F.lit(1.0))).drop("weight")


def curves(table: DataFrame) -> DataFrame:
    """The rates with curve: cumulative probabilities of 0, 1, ... up to where the rest is below 1e-15.

    Each source's steps are rows that two running sums turn into its curve; sums of logarithms don't underflow.
    """
    rate, k = F.col("rate"), F.col("k")
    last = F.when(rate > 0, F.ceil(rate + 12 * F.sqrt(rate) + 30)).otherwise(0).cast("int")
    steps = table.select("source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as a source's rate asks for
    log = F.sum(F.when(k == 0, -rate).otherwise(F.log(rate / k))).over(upto)
    summed = steps.withColumn("p", F.exp(log)).withColumn("c", F.sum("p").over(upto))
    gathered = summed.groupBy(F.col("source").alias("_of")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("curve"))
    return table.join(gathered, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")


def _above(curve: str, point: Column) -> Column:
    """How many steps of an ascending curve are at most `point`, by halving."""
    size = F.size(curve)
    start = F.struct(F.lit(0).alias("low"), size.alias("high"))

    def halved(s, _):
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        right = (s["low"] < s["high"]) & (F.get(curve, middle) <= point)
        return F.struct(F.when(right, middle + 1).otherwise(s["low"]).alias("low"), F.when(right | (s["low"] >= s["high"]), s["high"]).otherwise(middle).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(size)).cast("int") + 1), start, halved, lambda s: s["low"].cast("long"))


def _drawn(docs: DataFrame, weights: Weights, budget: float, seed: int) -> tuple[DataFrame, str]:
    """The rows of `docs` with rate, n_copies and their names, and the name of that column."""
    table = rates(docs.select("source", "text"), weights, budget)
    # Written first, so that its size is known when the join is planned: a row for each source.
    own = docs.drop("rate", "n_copies")
    source, curve, name = (free_name(own, x) for x in ("_source", "_curve", "_name"))
    table = written(curves(table).select(F.col("source").alias(source), "rate", F.col("curve").alias(curve)), "rates")
    # Texts are hashed once, below the join; a point is found once for each row, not for each step of its source's curve.
    joined = own.withColumn(name, _name()).join(table, F.col("source").eqNullSafe(F.col(source)))
    points = F.array(_point(F.lit(f"{seed}"), F.col(name)))
    count = F.element_at(F.transform(points, lambda p: _above(curve, p)), 1)
    return joined.withColumn("n_copies", count).select(*own.columns, "rate", "n_copies", name), name


def repetitions(docs: DataFrame, weights: Weights = None, budget: float = 1.0, seed: int = SEED) -> DataFrame:
    """The rows of `docs` with rate and n_copies."""
    drawn, name = _drawn(docs, weights, budget, seed)
    return drawn.drop(name)


def mix(docs: DataFrame, weights: Weights = None, budget: float = 1.0, seed: int = SEED) -> DataFrame:
    """Every document as often as it is drawn, in a global random order.

    Adds rate, n_copies, copy (from 0) and shuffle_key, by whose hash rows are dealt to partitions
    and by which they are sorted there.
    """
    drawn, name = _drawn(docs.drop("copy", "shuffle_key"), weights, budget, seed)
    copies = drawn.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1)))
    key = F.md5(F.concat_ws(":", F.lit(f"order {seed}"), F.col(name), F.col("copy").cast("string")).cast("binary"))
    return copies.withColumn("shuffle_key", key).drop(name).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
