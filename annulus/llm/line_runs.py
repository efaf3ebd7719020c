"""Line deduplication with a suffix array over line ids, built by distributed prefix doubling.

A document is a sequence of lines; only lines with a word count, blank ones stay
as they are. The documents follow each other in order of doc_id (nulls first,
then by an internal row number). A run of consecutive lines with at least
`min_words` words in all that also stands at an earlier place, in this or another
document, is deleted; the first copy stays. A document that loses all its lines
is a copy and goes.

Suffixes are ranked by their first line, then by 2, 4, 8 ... lines: a rank is the
number of suffixes that sort before, so suffixes that share their first 2^k lines
form one interval of the suffix array, with a longest common prefix of at least
2^k. The interval of those that share n lines, 2^k <= n < 2^(k+1), is named by the
ranks of their first and their last 2^k lines. For each line, the intervals of the
shortest run from it, and of the shortest run up to it, that has min_words words
tell whether the run is repeated and where it stands first. Later copies of such
shortest runs that overlap or touch are merged, as a running maximum of their
ends within the row: that gives the maximal repeated runs, which are deleted.
Nothing else can lie in a repeated run: a line of a longer one also lies in a
shortest one that is repeated. As every line has a word, no shortest run has more
than min_words lines: the doubling ends after log2(min_words) rounds whatever
the length of the copies.

Only lines that occur twice enter the suffix array. Hot lines and runs are counted
before the shuffle. Counts and first places are written before they are joined
back: then a small table is broadcast, and in a join of two large ones AQE can
split a hot key. Ranks come from range-sorted distinct keys, never from one task.

Nulls: a null text has no lines and stays. Repeated rows: the first stays. A very
long text is one row of the input, in between each line is a row. An empty table
gives no rows. Clashing names of other columns don't matter, as documents are
carried in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annulus.llm.workspace import dropped, keyed, written

MIN_WORDS = 50


def _n_words(line: Column) -> Column:
    return F.size(F.split(F.trim(line, F.lit(" \t\n\x0b\f\r")), "[ \t\n\x0b\f\r]+"))


def _ranked(keys: DataFrame, columns: list[str]) -> DataFrame:
    """`keys` (distinct rows of `columns`, n) with rank: the rows, n times each, that sort before."""
    ordered = keys.repartitionByRange(*columns).sortWithinPartitions(*columns)
    placed = written(ordered.select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("place")), "ranks")
    here = Window.partitionBy("p").orderBy("place")
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    sums = placed.groupBy("p").agg(F.sum("n").alias("total"))
    sums = sums.select("p", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    return placed.withColumn("rank", F.sum("n").over(here) - F.col("n")).join(sums, "p").select(*columns, (F.col("rank") + F.col("start")).alias("rank"))


def _lines(rows: DataFrame) -> DataFrame:
    """row, doc_id, line (its place among the text's lines), pos (among those with a word), a, b (ids), words."""
    line = F.col("x.line")
    split = rows.select(
        "row",
        F.col("doc.doc_id").cast("long").alias("doc_id"),
        F.filter(
            F.transform(F.split("doc.text", "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("i"))),
            lambda x: F.regexp(x["line"], F.lit("[^ \t\n\x0b\f\r]")),
        ).alias("lines"),
    )
    return split.select("row", "doc_id", F.posexplode("lines").alias("pos", "x")).select(
        "row",
        "doc_id",
        F.col("x.i").alias("line"),
        "pos",
        F.xxhash64(line).alias("a"),
        F.hash(line).alias("b"),
        _n_words(line).cast("long").alias("words"),
    )


def _repeated(lines: DataFrame) -> DataFrame:
    """The lines that occur twice or more, with r0, the rank of their first line's interval."""
    counts = lines.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")
    ranks = written(_ranked(counts, ["a", "b"]), "ranks")
    return lines.join(ranks, ["a", "b"]).select("row", "doc_id", "line", "pos", "words", F.col("rank").alias("r0"))


def _runs(suffixes: DataFrame, min_words: int) -> DataFrame:
    """Shortest runs with min_words words within stretches of repeated lines: row, doc_id, pos, n (lines)."""
    row = Window.partitionBy("row").orderBy("pos")
    stretched = suffixes.withColumn("stretch", F.col("pos") - F.row_number().over(row))
    stretch = Window.partitionBy("row", "stretch")
    sums = stretched.withColumn("upto", F.sum("words").over(stretch.orderBy("pos"))).withColumn("from", F.col("upto") - F.col("words"))
    ahead = stretch.orderBy("from").rangeBetween(0, min_words - 1)
    back = stretch.orderBy("upto").rangeBetween(-(min_words - 1), 0)
    both = sums.select(
        "row",
        "doc_id",
        "pos",
        F.struct(F.count("*").over(ahead).cast("int").alias("n"), F.sum("words").over(ahead).alias("w")).alias("ahead"),
        F.struct(F.count("*").over(back).cast("int").alias("n"), F.sum("words").over(back).alias("w")).alias("back"),
    )
    forward = both.where(F.col("ahead.w") >= min_words).select("row", "doc_id", "pos", F.col("ahead.n").alias("n"))
    backward = both.where(F.col("back.w") >= min_words).select("row", "doc_id", (F.col("pos") - F.col("back.n") + 1).alias("pos"), F.col("back.n").alias("n"))
    return forward.union(backward.where("n > 1")).distinct()


def _doubled(ranks: DataFrame, k: int) -> DataFrame:
    """row, pos, r: ranks of suffixes by their first 2^(k+1) lines, from those by 2^k; others have no such prefix."""
    second = ranks.select("row", (F.col("pos") - (1 << k)).alias("pos"), F.col("r").alias("s"))
    pairs = written(ranks.join(second, ["row", "pos"]), "pairs")
    keys = written(_ranked(pairs.groupBy("r", "s").agg(F.count("*").alias("n")), ["r", "s"]), "ranks")
    return pairs.join(keys, ["r", "s"]).select("row", "pos", F.col("rank").alias("r"))


def deleted_lines(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """row, line: lines of keyed documents that lie in a run whose first copy is earlier."""
    lines = written(_lines(rows), "lines")
    suffixes = written(_repeated(lines), "suffixes")
    runs = written(_runs(suffixes, min_words).withColumn("k", F.floor(F.log2("n") + 1e-9).cast("int")), "runs")
    ranks = suffixes.select("row", "pos", F.col("r0").alias("r"))
    most = runs.agg(F.max("k")).first()[0]
    copies = None
    for k in range((-1 if most is None else most) + 1):
        # A table for each step: six levels in one plan would fill the driver.
        last = ranks.select("row", F.col("pos").alias("end"), F.col("r").alias("s"))
        named = runs.where(F.col("k") == k).join(ranks, ["row", "pos"])
        if k:
            named = named.withColumn("end", F.col("pos") + F.col("n") - (1 << k)).join(last, ["row", "end"])
        else:
            named = named.withColumn("s", F.col("r"))
        named = written(named.select("row", "doc_id", "pos", "n", "r", "s"), "named")
        key = ["n", "r", "s"]
        place = F.struct(F.col("doc_id"), F.col("row"), F.col("pos"))
        first = written(named.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1"), "intervals")
        later = written(named.join(first, key).where(place > F.col("first")).select("row", "pos", "n"), "copies")
        dropped(named, first)
        copies = later if copies is None else copies.union(later)
        if k < most:
            after = written(_doubled(ranks, k), "suffixes")
            if k:
                dropped(ranks)
            ranks = after
    if copies is None:
        return suffixes.where("false").select("row", "line")
    dropped(lines, runs)
    # Maximal runs: the furthest end of the copies that start at or before a line, as a running maximum within the row.
    ends = copies.groupBy("row", "pos").agg(F.max(F.col("pos") + F.col("n")).alias("end"))
    own = suffixes.select("row", "pos", "line").join(written(ends, "runs"), ["row", "pos"], "left")
    sofar = Window.partitionBy("row").orderBy("pos")
    return own.withColumn("reach", F.max("end").over(sofar)).where("pos < reach").select("row", "line")


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc (the document's columns with the text that is left), n_lines, deleted (array of line numbers from 0),
    gone (whether no line with a word is left of a document that had one), for every document."""
    rows = keyed(docs)
    gone = deleted_lines(rows, min_words).groupBy("row").agg(F.array_sort(F.collect_list("line")).alias("deleted"))
    joined = rows.join(gone, "row", "left").select(
        "doc", "deleted", F.when(F.col("deleted").isNotNull(), F.split("doc.text", "\n")).alias("lines")
    )
    # What lies between two deleted lines, as slices: linear in the text's lines.
    n = F.size("deleted")
    start = lambda j: F.coalesce(F.get("deleted", j - 1) + 1, F.lit(0))
    stop = lambda j: F.coalesce(F.get("deleted", j), F.size("lines"))
    left = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda j: F.slice("lines", start(j) + 1, stop(j) - start(j))))
    text = F.when(F.col("lines").isNull(), F.col("doc.text")).otherwise(F.array_join(left, "\n"))
    gone = F.col("lines").isNotNull() & ~F.regexp(F.col("doc_text"), F.lit("[^ \t\n\x0b\f\r]"))
    return (
        joined.withColumn("doc_text", text)
        .select(
            F.col("doc").withField("text", F.col("doc_text")).alias("doc"),
            F.coalesce(F.size(F.split("doc.text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
            F.coalesce("deleted", F.array().cast("array<int>")).alias("deleted"),
            F.coalesce(gone, F.lit(False)).alias("gone"),
        )
    )


def kept_documents(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with what is left of their texts, without those that are gone."""
    return deduplicated(docs, min_words).where("not gone").select("doc.*")
