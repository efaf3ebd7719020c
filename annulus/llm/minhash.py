"""Near duplicates by the Jaccard similarity of word shingles: SimHash's index and MinHash bands propose pairs, shingle sets decide.

A text's words (in lower case) give the set of its runs of WIDTH words. Two texts
are linked if their sets have a Jaccard similarity of LEAST or more, computed on
the sets; fingerprints and MinHash only choose which pairs are looked at.

Operator 9's index over positional bytes proposes sets with fingerprints within
2 bits, and sets with equal fingerprints the smallest of them. It can't find all
pairs: at a similarity of 0.8 two fingerprints of 64 bits differ in 10 bits on
average, and 8 bytes with 10 differing bits need not agree in any. So a signature
also has BANDS bands of ROWS minima each, and texts that share a band's minima
meet: a pair with similarity s is missed there with probability
(1 - s^ROWS)^BANDS, 4 in 10,000 at 0.8.

Texts with equal sets are one node, so copies form no pairs. The members of a
band's list are compared with its smallest member first, one row each. Where this
leaves a list's members in different components, all of them are compared with
each other: as pairs in lists of up to LIST, in longer ones within one row for
each node and list (and for each couple of blocks of BLOCK_NODES, where a list has
several), so that no list is cut and no pair of a long one is a row.

Nulls and texts without words have the empty set and are one node; texts of fewer
than WIDTH words have one shingle; a very long text's signature takes bounded
memory besides its set. Repeated rows share a node; an empty table gives no rows.
Rows are told apart by an internal number, so rows without doc_id, and rows that
share one, take part each for itself; a component of rows without doc_id alone
has component_id null. Other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annulus.llm import simhash
from annulus.llm.components import components
from annulus.llm.workspace import keyed, written

WIDTH = 5
#: The least similarity, as a fraction.
LEAST = (4, 5)
BANDS = 20
ROWS = 5
SEED = 42
#: Longest list whose pairs are rows; nodes of longer ones that one task compares.
LIST = 24
BLOCK_NODES = 2048
#: Shingles hashed by all functions at a time.
BLOCK = 1024


def shingle_set(text: str | None, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; none without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z alone, and ASCII white space alone
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    spans = zip(starts[:n].tolist(), ends[width - 1 :].tolist())
    return np.unique(np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in spans), np.uint64, n))


def _factors(seed: int) -> np.ndarray:
    """Odd factors; the products with hashes, modulo 2^64, are the orders whose minima are taken."""
    return np.random.default_rng(seed).integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64, endpoint=False) | np.uint64(1)


def bands(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One value for each band of a set; sets with equal minima in a band have equal values there."""
    from xxhash import xxh64_intdigest

    least = np.full(len(factors), (1 << 64) - 1, np.uint64)
    for i in range(0, len(hashes), BLOCK):
        np.minimum(least, (factors * hashes[i : i + BLOCK]).min(axis=1), out=least)
    raw = least.tobytes()
    return np.array([xxh64_intdigest(raw[i : i + 8 * ROWS], SEED) for i in range(0, len(raw), 8 * ROWS)], np.uint64).view(np.int64)


def _node(hashes: np.ndarray) -> int:
    """A set's name, a signed long."""
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(hashes.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def signatures(keyed_docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """row, doc_id, node (equal for equal sets), size (of the set), fp (its fingerprint), bands, for every keyed row."""

    def rows(batches):
        factors = _factors(seed)
        for batch in batches:
            sets = [shingle_set(t.as_py(), width, seed) for t in batch.column(2)]
            values = pa.array([bands(s, factors) for s in sets], pa.list_(pa.int64()))
            fps = pa.array(np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64))
            columns = [*batch.columns[:2], pa.array(map(_node, sets), pa.int64()), pa.array(map(len, sets), pa.int32()), fps, values]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "node", "size", "fp", "bands"])

    own = keyed_docs.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").alias("text"))
    return own.mapInArrow(rows, "row long, doc_id long, node long, size int, fp long, bands array<bigint>")


def _sets(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """node, hashes, for every row."""

    def rows(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), width, seed) for t in batch.column(0)]
            values = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(map(_node, sets), pa.int64()), values], ["node", "hashes"])

    return docs.select("text").mapInArrow(rows, "node long, hashes array<bigint>")


def _enough(common: Column, a: Column, b: Column) -> Column:
    """Whether sets of sizes a and b with so many common members reach LEAST."""
    return LEAST[1] * common >= LEAST[0] * (a + b - common)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return both.where(_enough(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b")


def proposed(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (node, size, fp) that operator 9's index finds and whose sizes allow LEAST: the smallest nodes of
    fingerprints that it links, and each node with the smallest of its own fingerprint."""
    own = nodes.select("node", "size", "fp")
    firsts = written(own.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("first"), F.count("*").alias("n")), "fingerprints")
    near = written(simhash.linked(firsts.select("fp")), "near")
    end = lambda c: firsts.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}"))
    found = near.join(end("a"), "a").join(end("b"), "b").select(F.col("first_a").alias("x"), F.col("first_b").alias("y"))
    alike = own.join(written(firsts.where("n > 1").select("fp", "first"), "alike"), "fp").where(F.col("node") != F.col("first.node"))
    both = found.union(alike.select(F.struct("node", "size").alias("x"), F.col("first").alias("y")))
    fits = _enough(F.least("x.size", "y.size"), F.col("x.size"), F.col("y.size"))
    return both.where(fits).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _block_edges(names: np.ndarray, parts: np.ndarray, sides: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges between similar nodes that connect all components which any pair of different sides (or of the only side) connects."""
    _, members = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    there, parts, edges = np.zeros(int(members.max()) + 1, np.int64), parts.copy(), []
    first, last = sides.min(), sides.max()
    for x in np.flatnonzero(sides == first):
        open_ = (parts != parts[x]) & (sides == last)
        if not open_.any():
            continue
        own = members[starts[x] : ends[x]]
        there[own] = 1
        common = np.add.reduceat(there[members], starts)
        there[own] = 0
        for y in np.flatnonzero(open_ & _enough(common, sizes, sizes[x])):
            if parts[y] != parts[x]:
                edges.append((int(names[x]), int(names[y])))
                parts[parts == parts[y]] = parts[x]
    return edges


def _compared(left: DataFrame, sets: DataFrame, block_nodes: int) -> DataFrame:
    """Verified edges (a, b) within long lists (k, v, node, component, n: the list's length)."""

    def edges(table):
        column = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "component", "side")}
        values = table.column("hashes").combine_chunks()
        sets = np.split(values.flatten().to_numpy(zero_copy_only=False), values.value_lengths().to_numpy().cumsum()[:-1])
        found = _block_edges(column["node"], column["component"], column["side"], sets)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    blocks = F.ceil(F.col("n") / block_nodes).cast("int")
    dealt = left.withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    coupled = dealt.select("k", "v", "node", "component", "side", other.alias("other"))
    coupled = coupled.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
    named = coupled.join(sets, "node").select("k", "v", "i", "j", "node", "component", "side", "hashes")
    return named.groupBy("k", "v", "i", "j").applyInArrow(edges, "a long, b long")


def linked(
    keyed_docs: DataFrame, rows: DataFrame, width: int = WIDTH, seed: int = SEED, most: int = LIST, block_nodes: int = BLOCK_NODES
) -> DataFrame:
    """Verified edges (a, b) between nodes that the index proposes or that share a band; pairs that others connect may be left out."""
    nodes = rows.groupBy("node").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")).where("size > 0")
    index = written(proposed(nodes), "proposed")
    postings = nodes.select("node", "size", F.posexplode("bands").alias("k", "v"))
    lists = postings.groupBy("k", "v").agg(F.min(F.struct("node", "size")).alias("least"), F.count("*").alias("n")).where("n > 1")
    lists = written(lists, "lists")  # before it is joined back: broadcast if small, else a join that can split a long list
    listed = written(postings.join(lists, ["k", "v"]), "postings")
    can = lambda a, b: _enough(F.least(a, b), a, b)

    ends = index.select(F.explode(F.array("a", "b")).alias("node"))
    met = written(listed.select("node").union(ends).distinct(), "met")
    one = written(rows.join(met, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row")).select("row"), "rows")  # a text of each node
    texts = keyed_docs.join(one, "row", "left_semi").select(F.col("doc.text").alias("text"))
    sets = written(_sets(texts, width, seed), "sets")

    stars = listed.where(F.col("node") != F.col("least.node")).where(can(F.col("size"), F.col("least.size")))
    pairs = index.union(stars.select(F.col("node").alias("a"), F.col("least.node").alias("b")))
    near = written(_verified(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), sets), "links")
    parts = written(components(near, "a", "b"), "components")
    # The least member has been compared with all others.
    named = listed.where(F.col("node") != F.col("least.node")).join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("k", "v").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select("k", "v")
    mixed = written(mixed, "mixed")
    left = written(named.join(mixed, ["k", "v"]).select("k", "v", "node", "size", "component", "n"), "left")
    short = left.where(F.col("n") <= most)
    a, b = (short.select("k", "v", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "size", "component"))) for x in "ab")
    pairs = a.join(b, ["k", "v"]).where("node_a < node_b and component_a <> component_b").where(can(F.col("size_a"), F.col("size_b")))
    paired = _verified(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), sets)
    # Lists of several bands with the same members would give the same edges.
    long = left.where(F.col("n") > most)
    key = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"))
    once = long.groupBy("k", "v").agg(key.alias("members")).groupBy("members").agg(F.min(F.struct("k", "v")).alias("x")).select("x.k", "x.v")
    return near.union(paired).union(_compared(long.join(once, ["k", "v"]), sets, block_nodes))


def grouped(keyed_docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """row, doc_id, node, component (a node) for every keyed row."""
    rows = written(signatures(keyed_docs, width, seed), "signatures")
    found = written(components(linked(keyed_docs, rows, width, seed), "a", "b"), "components")
    own = rows.select("row", "doc_id", "node").join(found, "node", "left")
    return own.select("row", "doc_id", "node", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id, node, component_id (smallest doc_id reachable by links) for every row."""
    rows = written(grouped(keyed(docs), width, seed), "grouped")
    ids = written(rows.groupBy("component").agg(F.min("doc_id").alias("component_id")), "ids")
    return rows.join(ids, "component").select("doc_id", "node", "component_id")


def one_of_each(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """One document of each component, with its columns: the smallest doc_id (rows without one last), then the first row."""
    held = keyed(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    kept = grouped(held, width, seed).groupBy("component").agg(F.min(order).alias("least")).select(F.col("least.row").alias("row"))
    return held.join(kept, "row", "left_semi").select("doc.*")
