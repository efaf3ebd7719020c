"""Similarity of token sets: a Jaccard self-join with prefix filter, and density clusters on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annulus.operators.graph import components
from annulus.operators.ordered import numbered
from annulus.operators.shared import written


def profiles(df: DataFrame, key: str, token: str) -> DataFrame:
    """profile, tokens, n, members: equal token sets are one profile, named by its smallest key; n counts its tokens, and
    `tokens` are those that other profiles have as well, rarest first: the others meet nothing."""
    own = df.select(key, token).where(F.col(token).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(token)).alias("_all"))
    sets = written(own.groupBy("_all").agg(F.min(key).alias("profile"), F.count("*").alias("members")), "sets")
    rows = sets.select("profile", F.explode("_all").alias("t"))
    frequency = written(rows.groupBy("t").agg(F.count("*").alias("_f")).where("_f > 1"), "frequency")
    shared = rows.join(frequency, "t").groupBy("profile").agg(F.array_sort(F.collect_list(F.struct("_f", "t"))).alias("x"))
    named = sets.select("profile", F.size("_all").alias("n"), "members").join(shared.select("profile", F.transform("x", lambda s: s["t"]).alias("tokens")), "profile", "left")
    return written(named.select("profile", F.coalesce("tokens", F.array().cast(sets.schema["_all"].dataType)).alias("tokens"), "n", "members"), "profiles")


def _classes(sets: DataFrame, epsilon: float) -> DataFrame:
    """class, tokens, n, weight, whole: profiles with the same shared tokens and the same n are as near to any other; `whole`
    says whether they are near each other."""
    shared = F.size("tokens")
    whole = 1 - shared / (2 * F.col("n") - shared) <= epsilon + 1e-12
    one = sets.where(shared > 0).groupBy("tokens", "n").agg(F.min("profile").alias("class"), F.sum("members").alias("weight"))
    return written(one.select("class", "tokens", "n", "weight", whole.alias("whole")), "classes")


def _length(n: Column) -> Column:
    """The bin of a set's size: one for each up to 8, then as wide as half their start."""
    return F.when(n <= 8, n).otherwise(8 + F.floor(F.log(n / 8) / F.log(F.lit(1.5)))).cast("int")


def _class_pairs(classes: DataFrame, epsilon: float) -> DataFrame:
    """a < b, distance: classes at a Jaccard distance of at most epsilon.

    Sets of na and nb tokens that near share at least (1 - epsilon) / (2 - epsilon) (na + nb). The first token they share
    has that many at or behind it in both sets. So a token near the end of a set, where the frequent ones are,
    meets only sets that are short enough; they meet by token and bin of sizes.
    """
    share = max(1 - epsilon, 1e-9)
    bound = share / (1 + share)
    heads = classes.select("class", "n", (F.col("n") - F.size("tokens")).alias("lone"), F.posexplode("tokens").alias("i", "token"))
    heads = heads.select("class", "n", "token", (F.col("n") - F.col("lone") - F.col("i")).alias("rest"))
    longest = F.least(F.floor(F.col("n") / share + 1e-6), F.floor(F.col("rest") / bound + 1e-6) - F.col("n"))
    shortest = F.greatest(F.ceil(F.col("n") * share - 1e-6), F.lit(1))
    reach = F.when(longest >= shortest, F.sequence(_length(shortest), _length(longest)))
    a = heads.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("rest").alias("ra"), "token", F.explode(reach).alias("bin"))
    b = heads.where(longest >= shortest).select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("rb"), "token", _length(F.col("n")).alias("bin"))
    needed = F.ceil(F.lit(bound) * (F.col("na") + F.col("nb")) - 1e-9)
    lengths = (F.col("na") >= F.lit(share) * F.col("nb") - 1e-9) & (F.col("nb") >= F.lit(share) * F.col("na") - 1e-9)
    met = a.join(b, ["token", "bin"]).where("a < b").where(lengths & (F.col("ra") >= needed) & (F.col("rb") >= needed)).select("a", "b").distinct()
    side = lambda x: classes.select(F.col("class").alias(x), F.col("tokens").alias(f"t{x}"), F.col("n").alias(f"n{x}"))
    shared = F.size(F.array_intersect("ta", "tb"))
    full = met.join(side("a"), "a").join(side("b"), "b").select("a", "b", (1 - shared / (F.col("na") + F.col("nb") - shared)).alias("distance"))
    return written(full.where(F.col("distance") <= epsilon + 1e-12), "class-pairs")


def similar_pairs(sets: DataFrame, epsilon: float) -> DataFrame:
    """a < b, distance: profiles at a Jaccard distance of at most epsilon. Classes of profiles are compared, then spelt out."""
    classes = _classes(sets, epsilon)
    members = written(sets.join(classes.select("class", "tokens", "n", "whole"), ["tokens", "n"]).select("class", "profile", "whole", F.size("tokens").alias("s"), "n"), "members")
    one = members.select(F.col("class").alias("a"), F.col("profile").alias("p"))
    other = members.select(F.col("class").alias("b"), F.col("profile").alias("q"))
    apart = _class_pairs(classes, epsilon).join(one, "a").join(other, "b").select("p", "q", "distance")
    inner = members.where("whole").select("class", "profile", "s", "n")
    inside = inner.join(inner.select("class", F.col("profile").alias("q")), "class").where("profile < q")
    inside = inside.select(F.col("profile").alias("p"), "q", (1 - F.col("s") / (2 * F.col("n") - F.col("s"))).alias("distance"))
    return apart.unionByName(inside).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "distance")


def density_clusters(sets: DataFrame, epsilon: float, least: int = 1) -> DataFrame:
    """profile, cluster: profiles with at least `least` members within epsilon (themselves included) are cores; cores
    that near are one cluster; others join the first cluster that reaches them, or are noise (-1). Clusters are
    numbered by their smallest core. Classes of profiles are compared, pairs of profiles are never spelt out."""
    classes = _classes(sets, epsilon)
    pairs = _class_pairs(classes, epsilon).select("a", "b")
    both = pairs.union(pairs.select("b", "a"))
    around = both.join(classes.select(F.col("class").alias("b"), "weight"), "b").groupBy(F.col("a").alias("class")).agg(F.sum("weight").alias("_near"))
    told = classes.join(around, "class", "left")
    inside = F.when(F.col("whole"), F.col("weight")).otherwise(F.col("members"))
    near = F.coalesce(inside, "members") + F.coalesce("_near", F.lit(0))
    rows = written(sets.join(told, ["tokens", "n"], "left").select("profile", "class", "whole", (near >= least).alias("core")), "cores")
    inner = written(rows.where("core and class is not null").groupBy("class").agg(F.min("profile").alias("node"), F.first("whole").alias("whole")), "inner")
    one, other = inner.select(F.col("class").alias("a"), F.col("node").alias("x")), inner.select(F.col("class").alias("b"), F.col("node").alias("y"))
    edges = written(pairs.join(one, "a").join(other, "b").select("x", "y"), "edges")
    linked = edges.select(F.col("x").alias("node")).union(edges.select("y")).distinct().withColumn("_linked", F.lit(True))
    # the cores of a class are one cluster if they are near each other or all near another class's core
    found = inner.join(components(inner.select("node"), edges.toDF("a", "b")), "node").join(linked, "node", "left")
    found = written(found.select("class", "component", (F.col("whole") | F.coalesce("_linked", F.lit(False))).alias("joint"), "whole"), "found")
    edge = both.join(found.select(F.col("class").alias("b"), "component"), "b").select(F.col("a").alias("class"), "component")
    edge = edge.unionByName(found.where("whole").select("class", "component")).groupBy("class").agg(F.min("component").alias("reached"))
    placed = rows.drop("whole").join(found.select("class", "component", "joint"), "class", "left").join(edge, "class", "left")
    root = F.when(F.col("core"), F.when(F.col("joint"), F.col("component")).otherwise(F.col("profile"))).otherwise(F.col("reached"))
    placed = written(placed.select("profile", root.alias("root")), "roots")
    names = numbered(placed.where("root is not null").select(F.col("root").alias("_root")).distinct(), "_root")
    return placed.join(names, placed.root == names._root, "left").select("profile", F.coalesce(F.col("rank") - 1, F.lit(-1)).cast("long").alias("cluster"))


def weighted_jaccard(items: DataFrame, left: str, right: str, key: str, item: str, weight: str) -> DataFrame:
    """One row: the weighted Jaccard similarity of two keys' items; 1 for two empty sets."""
    a = items.where(F.col(key) == left).select(F.col(item).alias("i"), F.col(weight).alias("wa"))
    b = items.where(F.col(key) == right).select(F.col(item).alias("i"), F.col(weight).alias("wb"))
    both = a.join(b, "i", "full")
    union = F.sum(F.coalesce("wa", "wb"))
    shared = F.sum(F.when(F.col("wa").isNotNull() & F.col("wb").isNotNull(), F.col("wa")).otherwise(0.0))
    return both.agg(F.when(F.coalesce(union, F.lit(0.0)) > 0, shared / union).otherwise(F.lit(1.0)).alias("similarity"))
