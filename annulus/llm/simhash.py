"""Near duplicates by SimHash fingerprints and an inverted index over positional bytes.

A fingerprint has 64 bits, that is 8 positional bytes. Two fingerprints with at
most 2 differing bits agree in at least 6 of them. The index lists each distinct
fingerprint under its positional bytes, four positions intersected at a time in
such a way that every pair with 6 shared positions meets: the positions form 4
couples, 2 differing bits spoil at most 2 of them, and each of the 6 unions of
two couples is a posting key of 32 bits. (Lists of single bytes would hold
1/256 of all fingerprints each, and their pairs would grow with the square of
the corpus.) For each pair that meets, the shared positional bytes are tallied;
pairs that reach the guaranteed minimum are verified bit by bit.

Documents with equal fingerprints are one node, so copies form no pairs. A
posting list of more than LIST fingerprints isn't paired: its members are
grouped instead by the fingerprints one bit away from them (in the bits
outside the key), and members of such a group, which differ in at most 2 bits
for sure, are linked to its smallest. Two members within 2 bits always share
such a group, so no link's connection is lost, and rows stay linear in the list.

Nulls and texts without words have fingerprint 0 and are linked like any other.
Repeated rows share a fingerprint; an empty table gives no rows. Rows without
doc_id, or that share one, take part each for itself; a component of rows without
doc_id alone has component_id null. A very long text is hashed in blocks. Only
doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annulus.llm.components import components
from annulus.llm.workspace import written

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Longest posting list whose pairs are formed; longer ones go the linear way.
LIST = 24
HASHES = 1 << 16
#: Couples of byte positions, and the unions of two couples.
COUPLES = ((0, 1), (2, 3), (4, 5), (6, 7))
KEYS = tuple((COUPLES[a] + COUPLES[b]) for a in range(4) for b in range(a + 1, 4))


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text as an unsigned integer; 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z alone, and ASCII white space alone
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    spans = zip(starts[:n].tolist(), ends[width - 1 :].tolist())
    return majority(np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in spans), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), HASHES):
        some = hashes[i : i + HASHES].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), for every row."""

    def rows(batches):
        for batch in batches:
            got = [fingerprint(t.as_py(), width, seed) for t in batch.column(1)]
            fps = pa.array(np.array(got, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, fp long")


def _byte(fp, position: int):
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def linked(distinct: DataFrame, most: int = LIST) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) with at most MAX_BITS differing bits.

    Every pair of a posting list of up to `most` is there; pairs within longer ones are connected
    through others that are there.
    """
    fp = F.col("fp")
    masks = [sum(0xFF << 8 * p for p in key) for key in KEYS]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    postings = distinct.select(
        fp,
        F.explode(F.array(*(F.struct(F.lit(k).alias("k"), fp.bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(signed)))).alias("key"),
    ).select("fp", "key.k", "key.v")
    # Counts and minima are written before they are joined back, so that a small table is broadcast and a long list can be split.
    sizes = written(postings.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    listed = written(postings.join(sizes, ["k", "v"]), "postings")

    short = listed.where(F.col("n") <= most)
    tally = sum((_byte(F.col("a"), p) == _byte(F.col("b"), p)).cast("int") for p in range(8))
    pairs = (
        short.select("k", "v", F.col("fp").alias("a"))
        .join(short.select("k", "v", F.col("fp").alias("b")), ["k", "v"])
        .where("a < b")
        .where(tally >= 8 - MAX_BITS)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
        .select("a", "b")
    )
    flips = [
        F.array(fp, *(fp.bitwiseXOR(F.lit((1 << 8 * p + bit) - (1 << 64 if 8 * p + bit == 63 else 0))) for p in range(8) if p not in key for bit in range(8)))
        for key in KEYS
    ]
    around = F.element_at(F.array(*flips), F.col("k") + 1)
    near = listed.where(F.col("n") > most).select("k", "fp", F.explode(around).alias("center"))
    least = written(near.groupBy("k", "center").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1"), "least")
    stars = near.join(least, ["k", "center"]).where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable by links) for every row."""
    rows = written(fingerprints(docs, width, seed), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(linked(distinct.select("fp")), "a", "b")
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    named = written(named, "named")
    ids = written(named.groupBy("component").agg(F.min("least").alias("component_id")), "ids")
    answers = written(named.join(ids, "component").select("fp", "component_id"), "answers")
    return rows.join(answers, "fp")  # copies of one text are many rows of one side, which a skewed join splits


def one_of_each(docs: DataFrame, width: int = 5) -> DataFrame:
    """One document of each group of near duplicates by shingles of `width` words and a Jaccard similarity of 0.8.

    The index over positional bytes proposes the pairs within MAX_BITS. At that similarity most fingerprints differ in more
    bits, so `minhash` proposes the others and decides all of them on the shingle sets; its docstring has the cases."""
    from annulus.llm import minhash  # which takes its fingerprints and index from here

    return minhash.one_of_each(docs, width)
