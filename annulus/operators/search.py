"""Search of observations by molecule, event and state: an index of postings, and pages of results.

The index is a table (field, value, ids in sorted blocks), written once; a
search reads the postings of its filters, the shortest list first, and meets
the others by block, so that a search never scans the observations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annulus.operators.ordered import page

FIELDS = ("molecule", "event", "state")
#: Ids of one block of a list.
BLOCK = 4096


def postings(observations: DataFrame, index: str, fields=FIELDS) -> DataFrame:
    """field, value, block, ids (sorted), n (of the whole list): who holds each value of each field."""
    entry = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))
    rows = observations.select(F.col(index).alias("_id"), entry.alias("e")).select("_id", "e.*").where("value is not null")
    block = F.floor(F.col("_id") / BLOCK).cast("long")
    lists = rows.groupBy("field", "value", block.alias("block")).agg(F.array_sort(F.collect_list("_id")).alias("ids"))
    sizes = rows.groupBy("field", "value").agg(F.count("*").alias("n"))
    return lists.join(sizes, ["field", "value"])


def dictionary(lists: DataFrame) -> DataFrame:
    """field, value, n: the values of each field and how many observations have them."""
    return lists.select("field", "value", "n").distinct()


def matching(lists: DataFrame, filters: dict[str, str | None], index: str = "id") -> DataFrame:
    """Ids that fit every filter; a blank one filters nothing. None given: all ids of the first field."""
    wanted = {f: v.strip() for f, v in filters.items() if v and v.strip()}
    if unknown := set(wanted) - set(FIELDS):
        raise ValueError(f"no such field: {', '.join(sorted(unknown))}")
    if not wanted:
        return lists.where(F.col("field") == FIELDS[0]).select(F.explode("ids").alias(index))
    sizes = {r.field: r.n for r in dictionary(lists.where(_any_of(wanted))).collect()}  # a row for each filter
    if len(sizes) < len(wanted):
        return lists.where("false").select(F.explode("ids").alias(index))
    out = None
    for f in sorted(wanted, key=lambda f: (sizes[f], f)):
        one = lists.where((F.col("field") == f) & (F.col("value") == wanted[f])).select("block", F.col("ids").alias(f"_{f}"))
        out = one.withColumnRenamed(f"_{f}", "_ids") if out is None else out.join(one, "block").withColumn("_ids", F.array_intersect("_ids", f"_{f}")).drop(f"_{f}")
    return out.select(F.explode("_ids").alias(index))


def _any_of(wanted: dict[str, str]):
    out = F.lit(False)
    for f, v in wanted.items():
        out = out | ((F.col("field") == f) & (F.col("value") == v))
    return out


def search(observations: DataFrame, lists: DataFrame, index: str, filters: dict[str, str | None], offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of the observations that fit, in order of the index, with n, total and next_cursor."""
    found = observations.join(matching(lists, filters, index), index)
    return page(found, index, offset, limit)
