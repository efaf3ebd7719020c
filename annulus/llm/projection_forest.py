"""Near-duplicate embeddings by a forest of random-projection trees.

Equal vectors of a label are one node with a weight. Each tree starts from the
labels and splits recursively: a node's unit vectors are projected on a random
direction (one for each tree and depth) and cut at the median of a bounded
sample; vectors within a margin of the cut go to both sides (spill), so that
near vectors seldom part. Splitting goes on while leaves are larger than LEAF
and a split still helps: in a knot of near copies the margins swallow both
sides, and the knot stays one leaf. Vectors of a leaf are compared with each
other in blocks of BLOCK, each pair of blocks a task of its own, exactly and in
double precision. A pair found in several leaves counts in the first leaf that
both share. Blocks report for each vector a number of links and the smallest
vector of its part, never the pairs, so a knot of m copies needs m rows, not
m^2. Components of these reports are the unions.

The margin is 0.75 standard deviations of the projected difference of a pair at
the threshold: such a pair parts at a split with a probability of about 0.01, so
with TREES trees almost none is lost; measured recall is in the README.

Vectors that are null, empty, zero or hold null or non-finite components, and
rows without label or vec_id, link with nothing; nor do vectors of different
lengths. Every row is a vector of its own: repeated rows link with each other,
and rows that share a vec_id but not the vector link only if their vectors do. A
component is named by the smallest vec_id of its rows. A very long vector is one
row of its block. An empty table gives no rows. Only vec_id, embedding and label
are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annulus.llm.components import components
from annulus.llm.workspace import written

THRESHOLD = 0.93
TREES = 5
LEAF = 1024
BLOCK = 1024
#: Splits of one round at most, and rows that decide about a leaf's splits.
ROUND_DEPTH, SAMPLE = 5, 4096
#: A leaf of up to GROWN times LEAF, as a sample's error makes, isn't split again.
GROWN = 2
MAX_ROUNDS = 12
#: Margin in standard deviations, and the share of a node that a side of a useful split may hold.
MARGIN, USEFUL = 0.75, 0.8
SEED = 5


def direction(seed: int, tree: int, depth: int, dims: int) -> np.ndarray:
    v = np.random.default_rng((seed, tree, depth, dims)).standard_normal(dims)
    return v / np.linalg.norm(v)


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(np.float64)


def _unit(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    x = _matrix(vectors)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def margin(dims: int, threshold: float) -> float:
    return MARGIN * np.sqrt(max(0.0, 2 - 2 * threshold) / dims)


def fit_splits(x: np.ndarray, count: int, tree: int, depth: int, threshold: float, seed: int, leaf: int = LEAF) -> list[float]:
    """Cuts of up to ROUND_DEPTH levels in heap order (NaN: a leaf), from a sample x of `count` vectors."""
    cuts = [float("nan")] * ((1 << ROUND_DEPTH) - 1)
    here, gap = {0: np.arange(len(x))}, margin(x.shape[1], threshold)
    for level in range(ROUND_DEPTH):
        projected, after = x @ direction(seed, tree, depth + level, x.shape[1]), {}
        for node, rows in here.items():
            share = len(rows) / max(1, len(x))
            if share * count <= leaf or len(rows) < 8:
                continue
            p = projected[rows]
            cut = float(np.median(p))
            left, right = rows[p <= cut + gap], rows[p > cut - gap]
            if max(len(left), len(right)) > USEFUL * len(rows):
                continue
            cuts[node] = cut
            after[2 * node + 1], after[2 * node + 2] = left, right
        here = after
    return cuts


def _descend(x: np.ndarray, cuts: list[float], tree: int, depth: int, threshold: float, seed: int):
    """(rows, node) for each node of the round's tree where vectors stop."""
    gap, here = margin(x.shape[1], threshold), {0: np.arange(len(x))}
    for level in range(ROUND_DEPTH + 1):
        after: dict[int, np.ndarray] = {}
        projected = None
        for node, rows in here.items():
            if level == ROUND_DEPTH or np.isnan(cuts[node]):
                yield rows, node
                continue
            projected = x @ direction(seed, tree, depth + level, x.shape[1]) if projected is None else projected
            p = projected[rows]
            after[2 * node + 1], after[2 * node + 2] = rows[p <= cuts[node] + gap], rows[p > cuts[node] - gap]
        here = after


def _fitted(sample: DataFrame, threshold: float, seed: int, leaf: int) -> DataFrame:
    def fit(table: pa.Table) -> pa.Table:
        first = table.select(["n", "tree", "depth", "leaf"]).slice(0, 1).to_pylist()[0]
        x = _unit(table.sort_by("id").column("v"))
        cuts = fit_splits(x, first["n"], first["tree"], first["depth"], threshold, seed, leaf)
        kinds = pa.schema([("tree", pa.int32()), ("leaf", pa.int64()), ("cuts", pa.list_(pa.float64()))])
        return pa.Table.from_pydict({"tree": [first["tree"]], "leaf": [first["leaf"]], "cuts": [cuts]}, kinds)

    some = sample.select("id", "tree", "leaf", "n", "depth", "v")
    return some.groupBy("tree", "leaf").applyInArrow(fit, "tree int, leaf long, cuts array<double>")


def forest_leaves(nodes: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> DataFrame:
    """(id, tree, leaf) for nodes (id, label, v): a row for each leaf a vector is in."""
    root = F.xxhash64(F.col("label").cast("string"), F.size("v"))  # leaves have 64-bit names, hashed from the path
    # Vectors stay in `nodes`; the rows that are dealt out anew each round carry them only while a leaf is split.
    rows = nodes.select("id", "v", root.alias("leaf"), F.explode(F.array(*(F.lit(t) for t in range(trees)))).alias("tree"))
    rows, done = written(rows.select("id", "tree", "leaf"), "leaves"), None
    for r in range(MAX_ROUNDS):
        sizes = rows.groupBy("tree", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > GROWN * leaf)
        sizes = written(sizes.withColumn("depth", F.lit(r * ROUND_DEPTH)), "sizes")
        if sizes.isEmpty():
            break
        large = rows.join(sizes, ["tree", "leaf"]).join(nodes.select("id", "v"), "id")
        place = F.pmod(F.xxhash64("id", F.lit(r)), F.lit(1 << 30)).cast("double")
        sample = large.where(place * F.col("n") < float(SAMPLE << 30))
        cuts = written(_fitted(sample, threshold, seed, leaf), "cuts")
        useful = cuts.where(~F.isnan(F.col("cuts")[0]))
        if useful.isEmpty():
            break

        def split(batches):
            for batch in batches:
                ids, trees_, names, depths, vectors, all_cuts = batch.columns
                ids, trees_, names, depths = (c.to_numpy() for c in (ids, trees_, names, depths))
                order = np.lexsort((names, trees_))
                new = np.flatnonzero((np.diff(names[order]) != 0) | (np.diff(trees_[order]) != 0)) + 1
                for part in np.split(order, new):
                    if not len(part):
                        continue
                    k = int(part[0])
                    x, tree = _unit(vectors.take(pa.array(part))), int(trees_[k])
                    found = list(_descend(x, all_cuts[k].as_py(), tree, int(depths[k]), threshold, seed))
                    at = np.concatenate([rows for rows, _ in found])
                    node = np.repeat([n for _, n in found], [len(rows) for rows, _ in found])
                    columns = [ids[part][at], np.full(len(at), tree, np.int32), np.full(len(at), names[k]), node.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "tree", "leaf", "node"])

        moved = large.join(useful, ["tree", "leaf"]).select("id", "tree", "leaf", "depth", "v", "cuts")
        moved = moved.mapInArrow(split, "id long, tree int, leaf long, node int")
        moved = moved.select("id", "tree", F.xxhash64("leaf", "node").alias("leaf"))
        stay = rows.join(useful.select("tree", "leaf"), ["tree", "leaf"], "left_anti").select("id", "tree", "leaf")
        done = stay if done is None else done.union(stay)
        rows = written(moved, "leaves")
    return rows if done is None else done.union(rows)


def _compare(left: pa.Table, same: bool, right: pa.Table, threshold: float) -> pa.Table | None:
    """Links of two blocks of one leaf and the least of each vector's part: (id, n_links, least)."""
    a = _matrix(left.column("v"))
    b = a if same else _matrix(right.column("v"))
    linked = (a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)) >= threshold
    if same:
        np.fill_diagonal(linked, False)
    i, j = np.nonzero(linked)
    if not len(i):
        return None
    # A pair counts where its first common leaf is: elsewhere both are in an earlier one.
    lists = [t.column("earlier").combine_chunks() for t in ((left,) if same else (left, right))]
    names, code = np.unique(np.concatenate([x.flatten().to_numpy() for x in lists]), return_inverse=True)
    members, last = [], 0
    for x in lists:
        counts = x.value_lengths().to_numpy()
        m = np.zeros((len(x), max(1, len(names))), np.float32)
        m[np.repeat(np.arange(len(x)), counts), code[last : last + counts.sum()]] = 1
        last += counts.sum()
        members.append(m)
    counted = linked & ((members[0] @ members[-1].T) == 0)
    ids_a, ids_b = left.column("id").to_numpy(), right.column("id").to_numpy()
    least_a, least_b = _least(ids_a, ids_b, i, j)
    found = [(ids_a, counted @ right.column("weight").to_numpy(), least_a, linked.any(axis=1))]
    if same:
        least_a[:] = np.minimum(least_a, least_b)
    else:
        found.append((ids_b, left.column("weight").to_numpy() @ counted, least_b, linked.any(axis=0)))
    columns = zip(*((ids[some], n[some], least[some]) for ids, n, least, some in found))
    return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["id", "n_links", "least"])


def _least(ids_a: np.ndarray, ids_b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each vector of two blocks reaches by the links (i, j), sorted by i."""
    order = np.argsort(j, kind="stable")
    rows, at_row = np.unique(i, return_index=True)
    columns, at_column = np.unique(j[order], return_index=True)
    a, b = ids_a.copy(), ids_b.copy()
    while True:
        before = a.copy(), b.copy()
        a[rows] = np.minimum(a[rows], np.minimum.reduceat(b[j], at_row))
        b[columns] = np.minimum(b[columns], np.minimum.reduceat(a[i[order]], at_column))
        if (a == before[0]).all() and (b == before[1]).all():
            return a, b


def compared(nodes: DataFrame, leaves: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(id, n_links, least): for each vector and pair of blocks where it has links, their number and the least vector it reaches there."""
    name = F.xxhash64("tree", "leaf")
    named = leaves.select("id", name.alias("leaf"))
    sizes = named.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1")
    of = named.groupBy("id").agg(F.array_sort(F.collect_list("leaf")).alias("all"))  # as many as trees and spills
    rows = named.join(sizes, "leaf").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = rows.withColumn("mine", mine).select("id", "leaf", "mine", F.explode(others).alias("other"))
    dealt = dealt.select("id", "leaf", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    earlier = F.filter("all", lambda x: x < F.col("leaf"))
    full = dealt.join(nodes, "id").join(of, "id").select("id", "leaf", "mine", "lo", "hi", "v", "weight", earlier.alias("earlier"))

    kinds = pa.schema([("id", pa.int64()), ("n_links", pa.int64()), ("least", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        mine, lo, hi = table.column("mine"), table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        left, right = table.filter(pc.equal(mine, lo)), table.filter(pc.equal(mine, hi))
        if len(left) and len(right) and (got := _compare(left, lo == hi, right, threshold)) is not None:
            return got
        return kinds.empty_table()

    return full.groupBy("leaf", "lo", "hi").applyInArrow(compare, "id long, n_links long, least long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    sound = F.coalesce(finite & F.exists(x, lambda e: e != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("v"), sound.alias("sound"))
    nodes = rows.where("sound").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")  # a vec_id may stand for several nodes
    leaves = written(forest_leaves(nodes.select("id", "label", "v"), threshold, trees, leaf, seed), "leaves")
    found = written(compared(nodes.select("id", "v", "weight"), leaves, threshold), "found")
    links = found.groupBy("id").agg(F.sum("n_links").alias("others"))
    parts = components(found.select("id", "least"), "id", "least").withColumnRenamed("node", "id")
    parts = written(nodes.select("id", "least").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id")), "parts")
    names = written(parts.groupBy("component").agg(F.min("least").alias("part")), "names")
    answers = nodes.select("id", "label", "v", "weight").join(links, "id", "left").join(parts.select("id", "component").join(names, "component"), "id").select(
        "label", "v", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("links"), "part"
    )
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    member = rows.where("sound").join(answers, ["label", "v"]).select("vec_id", F.col("links").alias("n_links"), F.col("part").alias("component_id"))
    return member.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
