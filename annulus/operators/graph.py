"""Connected components by alternating large and small stars.

Each round moves every edge towards the smallest node it knows. Minima are
plain aggregates, so a hub with a third of all edges is combined before the
shuffle. They are written before they are joined back: a small table of minima
is broadcast, and where it is large both sides of the join come straight from a
shuffle, which lets adaptive execution split a hub's edges over many tasks.
Every round is a table in the shared folder: a lost executor repeats one round,
not the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annulus.operators.shared import dropped, written


def edge_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component) for every node that has an edge; component is its smallest node.

    Self loops and repeated edges are allowed; null ends are dropped; no edges give no rows.
    """
    now = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    while True:
        digest = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if digest == seen or not digest[0]:
            break
        seen = digest
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        least2 = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        joined = large.join(least2, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        after = written(small.where("a <> b").distinct(), "edges")
        dropped(now, least, large, least2)
        now = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (node) and edges (a, b): node, component, the smallest node it reaches, for every node."""
    found = edge_components(edges, "a", "b")
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
