"""Lineage calls of clusters: majority markers within callable ranges, typed matching, scores, the best few.

A marker is (position, kind, index, bases, encoded). Clusters with the same
markers and ranges are scored once, and so are definitions with the same markers.
Definitions and ranges are tables bounded by the tree and the genome; what grows
with the reads is joined by cluster alone, and stays dealt by cluster from the
first join to the ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annulus.functions import coords, text
from annulus.operators import intervals
from annulus.operators.shared import dealt, written

#: Candidates reported, and the lead below which two macro groups are a warning.
KEPT, CLEAR_LEAD = 3, 3.0
#: Counts of matches that a task of `ranked_candidates` gets: about 100 MB.
MATCHES = 1_000_000
MARKER = ("position", "kind", "index", "bases", "encoded")


def parse_marker(token: Column) -> Column:
    """(position, kind, index, bases, back): `P[ACGT]` substitution, `Pd` deletion, `P.nSEQ` or `P.XSEQ` insertion, `!` behind for a back mutation."""
    plain = F.regexp_replace(token, "!+$", "")
    pattern = "^([0-9]+)(?:([ACGT])|(d)|[.]([0-9]+|X)([ACGT]+))$"
    part = lambda i: F.nullif(F.regexp_extract(plain, pattern, i), F.lit(""))
    kind = F.when(part(2).isNotNull(), "substitution").when(part(3).isNotNull(), "deletion").when(part(4).isNotNull(), "insertion")
    fields = F.struct(part(1).cast("long").alias("position"), kind.alias("kind"), part(4).alias("index"), F.coalesce(part(2), part(5)).alias("bases"), F.endswith(token, F.lit("!")).alias("back"))
    return F.when(F.regexp(plain, F.lit(pattern)), fields)


def marker_order(m: Column) -> Column:
    """The order of markers: position, kind (substitution, deletion, insertion), index, name."""
    kind = F.when(m["kind"] == "substitution", 0).when(m["kind"] == "deletion", 1).otherwise(2)
    return F.struct(m["position"].alias("position"), kind.alias("kind"), m["index"].alias("index"), m["encoded"].alias("encoded"))


def restores_reference(token: Column) -> Column:
    """Whether a token of a rule is a position alone, which puts the reference back."""
    return F.regexp(token, F.lit("^[0-9]+$"))


def consensus_markers(calls: DataFrame, level: float = 0.5, length: int | None = coords.L) -> DataFrame:
    """Markers of calls (position, ref, alt, fraction, pass) that pass at `level` or more: a base each, `d` for each
    deleted base, `.1` and the bases of an insertion. VCF alleles: of a deletion or insertion the first base is the anchor.
    Deleted bases go on behind the origin of a genome of `length`; without one (None) positions are a line's."""
    sure = calls.where(F.col("pass") & (F.col("fraction") >= level))
    place = lambda p: p if length is None else coords.fold(p, length)
    gone, more = F.length("ref") > F.length("alt"), F.length("alt") > F.length("ref")
    none = F.lit(None).cast("string")
    one = lambda position, kind, index, bases: F.struct(position.cast("long").alias("position"), F.lit(kind).alias("kind"), index.alias("index"), bases.alias("bases"))
    deleted = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("ref") - 1)), lambda i: one(place(F.col("position") + i), "deletion", none, none))
    added = F.array(one(F.col("position"), "insertion", F.lit("1"), F.expr("substring(alt, 2)")))
    changed = F.array(one(F.col("position"), "substitution", none, F.col("alt")))
    rows = sure.select(F.explode(F.when(gone, deleted).when(more, added).otherwise(changed)).alias("m")).select("m.*")
    name = F.when(F.col("kind") == "deletion", F.concat(F.col("position").cast("string"), F.lit("d")))
    name = name.when(F.col("kind") == "insertion", F.concat(F.col("position").cast("string"), F.lit(".1"), F.col("bases")))
    return rows.withColumn("encoded", name.otherwise(F.concat(F.col("position").cast("string"), F.col("bases")))).distinct()


def typed_match(expected: Column, observed: Column) -> Column:
    """Whether an observed marker of the same position and kind is the expected one: the same base; any deletion; an
    insertion that holds the expected bases where their index says, or consists of their repeats (index X)."""
    e, o = expected["bases"], observed["bases"]
    repeats = F.substring(F.repeat(e, F.ceil(F.length(o) / F.length(e)).cast("int")), F.lit(1), F.length(o)) == o
    offset = expected["index"].try_cast("int") - observed["index"].try_cast("int")
    fits = (offset >= 0) & (F.length(e) + offset <= F.length(o)) & (F.substring(o, offset + 1, F.length(e)) == e)
    some = (F.length(e) > 0) & (F.length(o) > 0)
    inserted = some & F.when(expected["index"] == "X", repeats).otherwise(fits)
    found = F.when(expected["kind"] == "substitution", e == o).when(expected["kind"] == "deletion", F.lit(True)).otherwise(inserted)
    return (expected["position"] == observed["position"]) & (expected["kind"] == observed["kind"]) & F.coalesce(found, F.lit(False))


def callable_segments(members: DataFrame, ranges: DataFrame) -> DataFrame:
    """cluster, start, end, active: stretches with the number of members that can be called there.

    members (cluster, molecule), ranges (molecule, start, end; disjoint for a molecule)."""
    counts = intervals.active_counts(ranges.join(members, "molecule").select("cluster", "start", "end"), ["cluster"])
    following = F.lead("position").over(Window.partitionBy("cluster").orderBy("position"))  # a row for each position at most
    return counts.select("cluster", F.col("position").alias("start"), (following - 1).alias("end"), "active").where("active > 0 and end is not null")


def majority_markers(members: DataFrame, markers: DataFrame, ranges: DataFrame) -> DataFrame:
    """cluster, marker columns, carriers, callable: markers of more than half of the members that can be called at their
    position; where none can, of all members. markers: (molecule, MARKER); a molecule's repeated marker counts once."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("members"))
    counted = markers.select("molecule", *MARKER).distinct().join(members, "molecule").groupBy("cluster", *MARKER).agg(F.count("*").alias("carriers"))
    segments = callable_segments(members, ranges)
    at = counted.select("cluster", "position").distinct().join(segments, "cluster").where("position between start and end").select("cluster", "position", "active")
    joined = counted.join(sizes, "cluster").join(at, ["cluster", "position"], "left").withColumn("callable", F.coalesce("active", "members"))
    return joined.where(F.col("carriers") * 2 > F.col("callable")).select("cluster", *MARKER, "carriers", "callable")


def majority_ranges(members: DataFrame, ranges: DataFrame, length: int = coords.L) -> DataFrame:
    """cluster, start, end, known: where enough members can be called, more than min(n div 2, max(2, n div 20)); the whole
    genome, not known, if not more than half of the members have ranges. A single member's ranges are its cluster's."""
    having = members.join(ranges.select("molecule").distinct().withColumn("has", F.lit(1)), "molecule", "left")
    sizes = having.groupBy("cluster").agg(F.count("*").alias("n"), F.count("has").alias("with"))
    known = F.when(F.col("n") == 1, F.col("with") == 1).otherwise(F.col("with") * 2 > F.col("n"))
    least = F.when(F.col("n") == 1, F.lit(0)).otherwise(F.least(F.expr("n div 2"), F.greatest(F.lit(2), F.expr("n div 20"))))
    judged = sizes.select("cluster", known.alias("known"), least.alias("least"))
    deep = callable_segments(members, ranges).join(judged.where("known"), "cluster").where("active > least")
    found = intervals.merged(deep, ["cluster"]).withColumn("known", F.lit(True))
    whole = judged.where("not known").select("cluster", F.lit(1).cast("long").alias("start"), F.lit(length).cast("long").alias("end"), F.lit(False).alias("known"))
    return found.unionByName(whole)


def within_ranges(markers: DataFrame, ranges: DataFrame) -> DataFrame:
    """Markers of clusters at positions inside their ranges (disjoint, few for a cluster)."""
    inside = F.col("position").between(F.col("start"), F.col("end"))
    return markers.join(ranges.select("cluster", "start", "end"), "cluster").where(inside).drop("start", "end")


def _side(alias: str) -> Column:
    """The marker of one side of a join."""
    return F.struct(*(F.col(f"{alias}.{c}").alias(c) for c in MARKER))


def _met(*also: str) -> Column:
    """Whether an expected marker `e` and an observed one `o` meet: equal position, kind and `also`, and a typed match."""
    same = F.lit(True)
    for c in ("position", "kind", *also):
        same = same & (F.col(f"e.{c}") == F.col(f"o.{c}"))
    return same & typed_match(_side("e"), _side("o"))


def definition_sets(definitions: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """Definitions with the same markers are one set: (set, MARKER), and (set, source_order, name, n) of the first `keep`
    definitions of each by source_order and name, which are all that can be among the best `keep` of anything."""
    of = ("source_order", "name")
    # dealt first: a table of names is one small file, whose task would hold the markers of all of them
    rows = dealt(definitions.select(*of, *MARKER), *of)
    listed = rows.groupBy(*of).agg(F.sort_array(F.collect_set(F.struct(*MARKER))).alias("markers"))
    listed = written(listed.withColumn("set", F.sha2(F.to_json("markers"), 256)), "definitions")
    order = Window.partitionBy("set").orderBy(*of)
    members = written(listed.select("set", *of).withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep), "members")
    firsts = listed.join(members.where("n = 1").select("set", *of), ["set", *of], "left_semi")
    return firsts.select("set", F.explode("markers").alias("m")).select("set", "m.*"), members


def lineage_calls(observed: DataFrame, definitions: DataFrame, ranges: DataFrame, weights: DataFrame | None = None, keep: int = KEPT) -> DataFrame:
    """The best definitions of each cluster: cluster, rank, name, score, matched_count, matched, missing, extra (names of
    markers, in order), contamination (the two best are close and of different macro groups).

    observed (cluster, MARKER), definitions (name, source_order, MARKER; a definition's repeated marker counts once), ranges
    (cluster, start, end), weights (encoded, weight; 1 by default). Candidates match an observed marker; a definition's
    markers outside the ranges count neither way. Equal scores go by source_order, then by name.

    Definitions with the same markers are scored as one set. Markers meet by an equi-join on position and kind, so a row is a
    match and not a question. What a set expects within a cluster's ranges is summed over its own list of markers, once for
    each candidate; lists of names are made for the best few alone.
    """
    every = written(observed.select("cluster", *MARKER).distinct(), "observed")
    # One scoring for each set of markers and ranges.
    marks = every.groupBy("cluster").agg(F.sort_array(F.collect_set("encoded")).alias("marks"))
    spans = ranges.groupBy("cluster").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    signed = marks.join(spans, "cluster")
    same = signed.select("cluster", "spans", F.min("cluster").over(Window.partitionBy(F.xxhash64("marks", "spans"), "marks", "spans")).alias("key"))
    same = written(same, "signatures")
    first = same.where("cluster = key").select("key", "spans")
    weigh = lambda df: df.withColumn("weight", F.lit(1.0)) if weights is None else df.join(weights, "encoded", "left").fillna(1.0, ["weight"])
    seen = weigh(every.withColumnRenamed("cluster", "key").join(first.select("key"), "key", "left_semi").select("key", *MARKER))
    sets, members = definition_sets(definitions, keep)
    known = written(weigh(sets).select("set", *MARKER, "weight"), "sets")  # bounded by the tree: broadcast by its size
    profile = known.groupBy("set").agg(F.collect_list(F.struct("position", "weight")).alias("profile"))
    profile = written(profile.join(members.where("n = 1").drop("n"), "set"), "profiles")
    covered = lambda position, held: F.exists(held, lambda s: position.between(s["start"], s["end"]))
    inside = seen.join(first, "key").where(covered(F.col("position"), F.col("spans"))).select("key", *MARKER)
    hits = known.alias("e").join(inside.alias("o"), _met()).groupBy("key", "set", *(F.col(f"e.{c}").alias(c) for c in MARKER)).agg(F.first("weight").alias("weight"))
    matched = hits.groupBy("key", "set").agg(F.sum("weight").alias("matched_weight"), F.count("*").alias("matched_count"))
    total = seen.groupBy("key").agg(F.sum("weight").alias("observed"))
    asked = F.filter("profile", lambda m: covered(m["position"], F.col("spans")))
    expected = F.aggregate(asked, F.lit(0.0), lambda a, m: a + m["weight"])
    scored = matched.join(first.join(total, "key"), "key").join(profile, "set").withColumn("expected", expected)
    score = 50.0 * (F.col("matched_weight") / F.col("expected") + F.col("matched_weight") / F.col("observed"))
    order = Window.partitionBy("key").orderBy(F.desc("score"), "source_order", "name")
    best = scored.where("expected > 0 and observed > 0").withColumn("score", score).where("score > 0")
    # the best sets by their first definitions, then the best of what they hold
    first_sets = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).select("key", "set", "score", "matched_count", "spans")
    ranked = first_sets.join(members.drop("n"), "set").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= keep)
    best = written(ranked.select("key", "set", "name", "score", "rank", "matched_count", "spans"), "candidates")
    chosen = best.select("key", "set", "spans").distinct()

    few = chosen.join(known, "set").where(covered(F.col("position"), F.col("spans"))).select("key", "set", *MARKER).alias("e")
    own = seen.join(chosen.select("key", "set"), "key").select("key", "set", *MARKER).alias("o")
    marker = F.struct(*MARKER)
    names = F.transform(F.array_sort(F.collect_list(F.struct(marker_order(marker).alias("o")))), lambda x: x["o"]["encoded"])
    lists = (
        ("matched", few.join(seen.alias("o"), _met("key"), "left_semi")),
        ("missing", few.join(seen.alias("o"), _met("key"), "left_anti")),
        ("extra", own.join(known.alias("e"), _met("set"), "left_anti")),
    )
    two = best.groupBy("key").agg(F.max_by("score", -F.col("rank")).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"),
                                  F.max(F.when(F.col("rank") == 1, F.col("name"))).alias("n1"), F.max(F.when(F.col("rank") == 2, F.col("name"))).alias("n2"))
    doubt = F.coalesce((F.col("s2") > 0) & (F.col("s1") - F.col("s2") < CLEAR_LEAD) & (text.macro_group(F.col("n1")) != text.macro_group(F.col("n2"))), F.lit(False))
    out = best.drop("spans").join(two.select("key", doubt.alias("contamination")), "key")
    for name, rows in lists:
        out = out.join(rows.groupBy("key", "set").agg(names.alias(name)), ["key", "set"], "left")
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    return out.join(same.select("cluster", "key"), "key").select("cluster", "rank", "name", "score", "matched_count", empty("matched"), empty("missing"), empty("extra"), "contamination")


def cluster_lineages(members: DataFrame, markers: DataFrame, ranges: DataFrame, definitions: DataFrame, weights: DataFrame | None = None, corrected=None) -> DataFrame:
    """`lineage_calls` of clusters (or architectures, under the name cluster) from their members' markers and ranges:
    majority markers inside the majority's ranges, passed through `corrected` (a rule fixpoint over cluster markers) and
    restricted again. Clusters whose ranges aren't known get no call."""
    spans = written(majority_ranges(members, ranges).where("known").select("cluster", "start", "end"), "ranges")
    seen = within_ranges(majority_markers(members, markers, ranges).select("cluster", *MARKER), spans)
    if corrected is not None:
        seen = within_ranges(corrected(seen), spans)
    return lineage_calls(seen, definitions, spans, weights)


def ranked_candidates(observed: DataFrame, defined: DataFrame, keep: int, weights: DataFrame | None = None) -> DataFrame:
    """observed (cluster, marker), defined (definition, marker), weights (marker, weight; 1 by default): the `keep`
    best definitions of each cluster that match a marker: matched, missing, extra, score, rank.

    Definitions with the same markers have the same score everywhere, so each set of markers is counted once, for the first
    `keep` definitions that have it. Matches are counted before they are made: clusters are dealt once, to as many tasks as keep a task's counts
    in memory, and the counts, the scores and the ranking stay in that partitioning.
    """
    weigh = lambda df: df.withColumn("weight", F.lit(1)) if weights is None else df.join(weights, "marker", "left").fillna(1, ["weight"])
    signed = defined.groupBy("definition").agg(F.sort_array(F.collect_list(F.struct("marker"))).alias("markers"))
    of_set = Window.partitionBy("markers").orderBy("definition")
    sets = signed.withColumn("set", F.first("definition").over(of_set)).withColumn("_n", F.row_number().over(of_set))
    sets = written(sets.where(F.col("_n") <= keep).drop("_n"), "sets")
    named = sets.select("set", "definition")
    firsts = sets.where("definition = set").select("definition", F.explode("markers").alias("m")).select("definition", "m.marker")
    wanted = written(weigh(firsts), "definitions")
    expected = wanted.groupBy("definition").agg(F.sum("weight").alias("expected"), F.count("*").alias("_e"))
    of_cluster = Window.partitionBy("cluster")
    spread = observed.groupBy("marker").agg(F.count("*").alias("n")).join(wanted.groupBy("marker").agg(F.count("*").alias("m")), "marker")
    matches = spread.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    tasks = max(int(observed.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(20_000, matches // MATCHES + 1))
    seen = weigh(observed).repartition(tasks, "cluster")
    seen = seen.withColumn("observed", F.sum("weight").over(of_cluster)).withColumn("_o", F.count("*").over(of_cluster))
    met = seen.join(wanted.select("definition", "marker"), "marker").groupBy("cluster", "definition").agg(
        F.sum("weight").alias("_w"), F.count("*").alias("matched"), F.first("observed").alias("observed"), F.first("_o").alias("_o")
    )
    joined = met.join(written(expected, "expected"), "definition")
    score = F.round(F.lit(50.0) * F.col("_w") / F.col("expected") + F.lit(50.0) * F.col("_w") / F.col("observed"), 6)
    joined = joined.withColumnRenamed("definition", "set")
    few = joined.withColumn("_s", score).withColumn("_n", F.rank().over(of_cluster.orderBy(F.desc("_s")))).where(F.col("_n") <= keep)
    joined = few.join(named, "set")
    rows = joined.select("cluster", "definition", "matched", (F.col("_e") - F.col("matched")).alias("missing"), (F.col("_o") - F.col("matched")).alias("extra"), score.alias("score"))
    order = of_cluster.orderBy(F.desc("score"), "definition")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
