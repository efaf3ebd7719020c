"""Order over whole tables without a task that sees them all.

Rows are dealt to ranges of the order and sorted there; a row's number within
its range is counted while it is written, and a table with one row for each
range says where the range begins. So a global rank, a running minimum or an
order statistic costs one shuffle, whatever the number of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annulus.operators.shared import free_name, written

#: monotonically_increasing_id() counts a partition's rows in this many low bits.
_ROW_BITS = 33


def placed(df: DataFrame, *order: Column | str) -> tuple[DataFrame, str, str]:
    """`df` in ranges of the order, written, with the names of two columns: the range, and the row's place in it from 0.

    The last of `order` should make rows distinct, so that a hot value is dealt to several ranges.
    """
    part, place = free_name(df, "_range"), free_name(df, "_place")
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return written(ranges.select("*", F.spark_partition_id().alias(part), at.alias(place)), "ordered"), part, place


def numbered(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """Adds each row's number in the whole order, from 1, and `_total`, the number of rows."""
    rows, part, place = placed(df, *order)
    return _counted(rows, part, place, name).select(*df.columns, name, "_total")


def _counted(rows: DataFrame, part: str, place: str, name: str) -> DataFrame:
    """Placed rows with their number and the number of all."""
    sizes = rows.groupBy(part).agg(F.count("*").alias("_n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    joined = rows.join(F.broadcast(starts), part)  # as many rows as the shuffle has partitions
    return joined.withColumn(name, F.col(place) + F.col("_start") + 1).drop("_start")


def cumulated(df: DataFrame, amount: str, *order: Column | str, name: str = "before") -> DataFrame:
    """Adds the sum of `amount` over the rows before each row in the whole order."""
    rows, part, place = placed(df, *order)
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = rows.groupBy(part).agg(F.sum(amount).alias("_sum")).select(part, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    here = F.sum(amount).over(Window.partitionBy(part).orderBy(place)) - F.col(amount)
    joined = rows.withColumn("_here", here).join(F.broadcast(starts), part)
    return joined.select(*df.columns, (F.col("_here") + F.col("_start")).alias(name))


def order_statistic(df: DataFrame, value: str, share: float = 0.5) -> DataFrame:
    """One row (value): element floor(share * n) of the sorted values, nulls left out; with 0.5 the upper median."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    rows = cumulated(counts, "_n", value)
    total = counts.agg(F.sum("_n").alias("_total"))
    at = F.floor(F.lit(share) * F.col("_total"))
    return rows.crossJoin(F.broadcast(total)).where((F.col("before") <= at) & (at < F.col("before") + F.col("_n"))).select(value)


def outliers(df: DataFrame, value: str, scale: float = 6 * 1.4826, least: float = 0.02) -> DataFrame:
    """Adds center (upper median), spread (upper median of distances) and outlier, like `evidence.outliers`, over any number of rows."""
    near = df.crossJoin(F.broadcast(order_statistic(df, value).select(F.col(value).alias("center"))))
    away = near.select(F.abs(F.col(value) - F.col("center")).alias("spread"))
    limit = F.col("center") + F.greatest(F.lit(scale) * F.col("spread"), F.lit(least))
    return near.crossJoin(F.broadcast(order_statistic(away, "spread"))).withColumn("outlier", F.col(value) > limit)


def benjamini_hochberg(df: DataFrame, p: str, order: list[str], hypotheses: int = 0) -> DataFrame:
    """Adds rank and q over the whole table: the smallest p * m / rank of this row and all later ones, at most 1; m is the
    number of rows, or of hypotheses if there were more. Ranks and minima come from the same ranges: one sort."""
    placed_rows, part, place = placed(df, p, *order)
    step = F.least(F.lit(1.0), F.col(p) * F.greatest("_total", F.lit(hypotheses)) / F.col("rank"))
    rows = _counted(placed_rows, part, place, "rank").withColumn("_step", step)
    behind = Window.orderBy(F.desc(part)).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    later = rows.groupBy(part).agg(F.min("_step").alias("_least")).select(part, F.min("_least").over(behind).alias("_later"))
    here = F.min("_step").over(Window.partitionBy(part).orderBy(F.desc(place)))
    joined = rows.withColumn("_here", here).join(F.broadcast(later), part)
    return joined.select(*df.columns, "rank", F.least("_here", "_later").alias("q"))


def share_below(df: DataFrame, group: str, value: str) -> DataFrame:
    """Adds the share of the group's rows whose value is strictly below; equal values are counted before they are ordered."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("_n"))
    rows = cumulated(counts, "_n", group, value)
    whole = rows.groupBy(group).agg(F.min("before").alias("_first"), F.sum("_n").alias("_all"))
    shares = rows.join(written(whole, "groups"), group).select(group, value, ((F.col("before") - F.col("_first")) / F.col("_all")).alias("share"))
    return df.join(shares, [group, value])


def islands(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """keys, start, end: runs of consecutive positions, for keys of any size."""
    rows = numbered(df.select(*keys, position), *keys, position)
    run = F.col(position) - F.col("rank")
    return rows.groupBy(*keys, run.alias("_run")).agg(F.min(position).alias("start"), F.max(position).alias("end")).drop("_run")


def systematic_sample(df: DataFrame, group: str, order: str, step: int) -> DataFrame:
    """Every `step`-th row of a group, from its first, with n (its number) and the weight that makes up for the others."""
    rows = numbered(df, group, order, name="_number")
    first = rows.groupBy(group).agg(F.min("_number").alias("_first"), F.count("*").alias("_all"))
    counted = rows.join(first, group).withColumn("n", F.col("_number") - F.col("_first") + 1)
    kept = counted.where((F.col("n") - 1) % step == 0)
    return kept.select(*df.columns, "n", (F.col("_all") / F.ceil(F.col("_all") / step)).alias("weight"))


def page(df: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """Rows offset + 1 .. offset + limit of an order, with n, total (all rows) and next_cursor (null on the last page)."""
    if not 1 <= limit <= 500:
        raise ValueError("a page has 1 to 500 rows")
    some = df.orderBy(order).limit(offset + limit)
    cut = some.withColumn("n", F.row_number().over(Window.orderBy(order)).cast("long")).where(F.col("n") > offset)
    total = df.agg(F.count("*").alias("total"))
    following = F.when(F.lit(offset + limit) < F.col("total"), F.lit(offset + limit).cast("long"))
    return cut.crossJoin(F.broadcast(total)).withColumn("next_cursor", following)


def best_of_the_rest(df: DataFrame, passes: Column, order: list[str], keep: int) -> DataFrame:
    """All rows that pass and the first `keep` of the others."""
    return df.where(passes).unionByName(df.where(~passes).orderBy(*order).limit(keep))


def weighted_slope(x: Column, y: Column, w: Column) -> Column:
    """Aggregate: the slope of the weighted least-squares line."""
    return (F.sum(w) * F.sum(w * x * y) - F.sum(w * x) * F.sum(w * y)) / (F.sum(w) * F.sum(w * x * x) - F.sum(w * x) * F.sum(w * x))


def weighted_intercept(x: Column, y: Column, w: Column) -> Column:
    return (F.sum(w * y) - weighted_slope(x, y, w) * F.sum(w * x)) / F.sum(w)


def monotone(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """`value` made to rise with `order` within each group: the largest so far."""
    sofar = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.max(value).over(sofar))
