"""Complex rearrangements: paths of junctions, their canonical reading, merging over reads; development tokens of headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JUNCTION = "struct<id:string,orientation:string>"


def flip_strand(strand: Column) -> Column:
    return F.translate(strand, "+-", "-+")


def flip_orientation(orientation: Column) -> Column:
    """A junction's orientation (two strands, `+/-`) read from the other side: strands turned round and flipped."""
    return flip_strand(F.reverse(orientation))


def canonical_path(junctions: Column) -> Column:
    """An array of (id, orientation) as read, or turned round with every orientation flipped, whichever sorts first."""
    back = F.transform(F.reverse(junctions), lambda j: F.struct(j["id"].alias("id"), flip_orientation(j["orientation"]).alias("orientation")))
    key = lambda path: F.transform(path, lambda j: F.concat_ws("@", j["id"], j["orientation"]))
    return F.when(key(back) < key(junctions), back).otherwise(junctions)


def path_name(junctions: Column) -> Column:
    """`complex:id@o|id@o` of a canonical path of two junctions or more; null of a shorter one."""
    parts = F.transform(junctions, lambda j: F.concat_ws("@", j["id"], j["orientation"]))
    return F.when(F.size(junctions) >= 2, F.concat(F.lit("complex:"), F.array_join(parts, "|")))


def complex_events(junctions: DataFrame) -> DataFrame:
    """read, event, path: reads with two junctions or more (read, place, id, orientation), each as one event."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "id", "orientation")))
    rows = junctions.groupBy("read").agg(F.transform(ordered, lambda x: F.struct(x["id"].alias("id"), x["orientation"].alias("orientation"))).alias("path"))  # one read's
    named = rows.where(F.size("path") >= 2).withColumn("path", canonical_path(F.col("path")))
    return named.select("read", path_name(F.col("path")).alias("event"), "path")


def merged_paths(events: DataFrame) -> DataFrame:
    """event, path, support, junctions: reads with the same path are one event; who supports it stays in `events`, as rows."""
    return events.groupBy("event").agg(F.min("path").alias("path"), F.countDistinct("read").alias("support")).withColumn("junctions", F.size("path").cast("long"))


def merged_supports(rows: DataFrame, event: str, read: str) -> DataFrame:
    """event, support, known, longest, strands of events seen in several reads (known, length, strand of each); reads are
    counted, not gathered, so that an event every read has stays one row."""
    return rows.groupBy(event).agg(
        F.countDistinct(read).alias("support"),
        F.bool_or("known").alias("known"),
        F.max("length").alias("longest"),
        F.array_join(F.array_sort(F.collect_set("strand")), ",").alias("strands"),  # two at most
    )


def header_tokens(header: Column, name: str) -> Column:
    """The values of `name=value` tokens of a read's header, in order."""
    return F.regexp_extract_all(header, F.lit(rf"(?:^|[ \t;]){name}=([^ \t;]+)"), F.lit(1))


def substitution_token(token: Column) -> Column:
    """(position, ref, alt) of `P:R>A` in any case with two different bases; null of anything else."""
    pattern = "^([0-9]+):([ACGTacgt])[^>]*>([ACGTacgt])"
    position = F.regexp_extract(token, pattern, 1).try_cast("long")
    ref, alt = (F.upper(F.regexp_extract(token, pattern, i)) for i in (2, 3))
    return F.when(F.regexp(token, F.lit(pattern)) & (position > 0) & (ref != alt), F.struct(position.alias("position"), ref.alias("ref"), alt.alias("alt")))


def structural_token(token: Column) -> Column:
    """(kind, start, end) of `kind:S-E` with S <= E, the kind in lower case and `del` and `ins` spelt out; null of anything else."""
    pattern = "^([^:]*):([0-9]+)-([0-9]+)$"
    kind = F.lower(F.regexp_extract(token, pattern, 1))
    kind = F.when(kind == "del", "deletion").when(kind == "ins", "insertion").otherwise(kind)
    start, end = (F.regexp_extract(token, pattern, i).try_cast("long") for i in (2, 3))
    return F.when(F.regexp(token, F.lit(pattern)) & (start > 0) & (start <= end), F.struct(kind.alias("kind"), start.alias("start"), end.alias("end")))


def range_token(token: Column, length: int) -> Column:
    """Array of (start, end) of a comma-separated list of `S-E` or `S` inside the genome; null if an item is anything else."""

    def one(item):
        start = F.regexp_extract(item, "^([0-9]+)(?:-([0-9]+))?$", 1).try_cast("long")
        end = F.coalesce(F.regexp_extract(item, "^([0-9]+)-([0-9]+)$", 2).try_cast("long"), start)
        return F.when((start > 0) & (start <= end) & (end <= length), F.struct(start.alias("start"), end.alias("end")))

    items = F.transform(F.split(token, ","), one)
    return F.when(F.forall(items, lambda x: x.isNotNull()), items)


def feature_tokens(substitutions: Column, indels: Column, structural: Column, complexes: Column, bases: Column) -> Column:
    """Distinct tokens of a read for clustering, from arrays of names; a read without any has its length in hundreds."""
    named = lambda prefix, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(prefix), x))
    every = F.array_distinct(F.concat(named("snp:", substitutions), named("phylo_indel:", indels), named("sv:", structural), named("complex_sv:", complexes)))
    return F.when(F.size(every) > 0, every).otherwise(F.array(F.concat(F.lit("length:"), F.floor(bases / 100).cast("string"))))


def united(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of both, one for each key; the first table's of equals."""
    both = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)))
    rest = [c for c in first.columns if c not in keys]
    return both.groupBy(*keys).agg(*(F.min_by(c, F.struct("_side")).alias(c) for c in rest)) if rest else first.unionByName(second).distinct()
