"""Operator 12: what each order of five filters would keep and remove, part by part.

Filters (see CONDITIONS) are independent of each other, so every order of them
follows from one mask of failures for each document:

- A to D are found from the text alone, E (an equal text with a smaller doc_id)
  by sorting: documents are dealt by ranges of (fingerprint, doc_id), so that a
  text with very many copies spreads over tasks, and sorted in each task by
  (fingerprint, full text, doc_id). A row is compared with its predecessor, by the
  full text. Keys of the ranges are two numbers, so no text is in the sample that
  Spark takes for them.
- At a task's edges a run of equal texts may go on elsewhere. The texts of a task's
  first and last fingerprint are edge texts: a record has each of them once with its
  smallest doc_id in that task. Only rows with exactly that doc_id can't know
  whether a smaller one exists; they refer to the record, and records are
  resolved by their texts (some records a task, whatever the number of rows).
- Masks are counted by part, mask and labels with partial aggregation, and counts
  become sums over subsets of filters: clean[S] counts documents that fail none of
  S. Each of the 600 rows of a part is a difference of such sums.

Texts are shuffled once; what follows is narrow (a doc_id, a part, a mask).

Defined cases: a null text counts as the empty one; a null lang is part ''.
A document without doc_id is counted, has no labels, and neither is a copy
nor makes another one a copy. Rows that share doc_id and text are counted each,
and are no copies of each other (no doc_id is smaller). Several label rows of a doc_id: it is
good if one says quality 1, toxic if one says toxic 1; null labels say nothing, labels of
unknown documents count nowhere. No documents give no rows. Other columns,
clashing names included, are not looked at.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annulus.llm.workspace import dropped, written

#: The filters: bit k of a mask is letter k's failure.
LETTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT, SYMBOLS = 200, 50, 3, b"#$%&*|"
CONDITIONS = {
    "A": "under 200 words",
    "B": "100 * distinct words < 50 * words",
    "C": "100 * capital letters A-Z > 3 * code points",
    "D": "holds one of # $ % & * |",
    "E": "equal to the text of a smaller doc_id, removed or not",
}
COPY = 1 << LETTERS.index("E")
ORDERS = ["".join(x) for x in permutations(LETTERS)]
_CAPITALS = bytes(range(0x41, 0x5B))
_INNER = bytes(range(0x80, 0xC0))


def mask_of(raw: bytes) -> int:
    """Failures A to D of a text in UTF-8."""
    words = raw.split()  # cuts at space and \t\n\v\f\r alone
    points = len(raw) - (0 if raw.isascii() else len(raw) - len(raw.translate(None, _INNER)))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    fails = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words),
        100 * capitals > MAX_CAPITAL_PERCENT * points,
        len(raw) != len(raw.translate(None, SYMBOLS)),
    )
    return sum(1 << k for k, failed in enumerate(fails) if failed)


#: A row: its mask (E included where `run` is null), and the edge record it refers to. An edge record: the text and its smallest doc_id there.
_FOUND = "doc_id long, part string, mask int, task int, run int, fp long, text binary, first long"


def _compared(batches):
    """Rows in the order of (fp, text, doc_id): compare each with its predecessor."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    last = None  # fp, text, first doc_id, mask of A to D of the run that a row may go on
    opening, edges, run = None, [], 0  # the task's first fingerprint, texts of the current edge fingerprint

    def record(rows):
        columns = list(zip(*rows)) if rows else [[]] * 8
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64())
        names = [x.split()[0] for x in _FOUND.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for batch in batches:
        rows = []
        fps, ids, parts = (batch.column(k).to_pylist() for k in range(3))
        for fp, doc, part, value in zip(fps, ids, parts, batch.column(3)):
            raw = value.as_py()
            if last is None or fp != last[0] or raw != last[1]:
                if opening is None:
                    opening = fp
                if last is not None and fp != last[0]:
                    if last[0] == opening:
                        rows += [(None, None, None, task, k, last[0], t, d) for k, t, d in edges]
                    edges = []
                run += 1
                last = (fp, raw, None, mask_of(raw))
            mask, own = last[3], None
            if doc is not None:
                if last[2] is None:  # documents without id come first in a run and start none
                    last = (fp, raw, doc, mask)
                    edges.append((run, raw, doc))
                if doc > last[2]:
                    mask |= COPY
                elif fp == opening:
                    own = run  # whether another task has a smaller doc_id is settled later
            rows.append((doc, part, mask, task, own, None, None, None))
        yield record(rows)
    if last is not None:
        yield record([(None, None, None, task, k, last[0], t, d) for k, t, d in edges])


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask), a row for each document; a written table."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.xxhash64(text).alias("fp"), F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("part"), text.cast("binary").alias("text"))
    dealt = own.repartitionByRange("fp", "doc_id").sortWithinPartitions("fp", "text", "doc_id")
    found = written(dealt.mapInArrow(_compared, _FOUND), "masks", "zstd")
    edges = found.where("first IS NOT NULL")
    least = edges.groupBy("fp", "text").agg(F.min("first").alias("least"))
    later = edges.join(least, ["fp", "text"]).where("first > least").select("task", "run", F.lit(COPY).alias("copy"))
    later = written(later, "edges")
    rows = found.where("first IS NULL").drop("fp", "text", "first")
    done = written(rows.join(later, ["task", "run"], "left").select("doc_id", "part", F.col("mask").bitwiseOR(F.coalesce("copy", F.lit(0))).alias("mask")), "failures")
    dropped(found, later)
    return done


def counters(failures: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part and mask."""
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = said.agg(*(F.max((F.col(k) == 1).cast("int")).alias(name) for k, name in (("quality", "good"), ("toxic", "toxic"))))
    said = written(said.where("good = 1 OR toxic = 1"), "labels")
    counts = failures.join(said, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), *(F.count(F.when(F.col(k) == 1, 1)).alias(k) for k in ("good", "toxic"))
    )
    counts = written(counts, "counters")
    dropped(said)
    return counts


def _clean(value: str) -> Column:
    """Element S: the sum of `value` over masks that share no bit with S."""
    return F.array(*(F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) == 0, F.col(value))), F.lit(0)) for s in range(1 << len(LETTERS))))


def orders(counts: DataFrame) -> DataFrame:
    """The audit's rows out of counters."""
    parts = counts.groupBy("part").agg(
        *(_clean(k).alias(k) for k in ("n", "good", "toxic")),
        F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == 1 << k, F.col("n"))), F.lit(0)) for k in range(len(LETTERS)))).alias("alone"),
    )
    ordered = parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.array(*(F.lit(k + 1) for k in range(len(LETTERS))))))
    letter = F.instr(F.lit(LETTERS), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    bit = lambda k: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(LETTERS), F.substring("filter_order", k, F.lit(1))) - 1)
    before = F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(len(LETTERS))), lambda k: k < F.col("step")), F.lit(0), lambda s, k: s.bitwiseOR(bit(k)))
    placed = ordered.select("*", letter.alias("f"), before.alias("s")).withColumn("own", F.call_function("shiftleft", F.lit(1), F.col("f"))).withColumn("t", F.col("s").bitwiseOR(F.col("own")))
    left = lambda k, s: F.get(F.col(k), F.col(s) if isinstance(s, str) else s)
    removed = left("n", "s") - left("n", "t")
    return placed.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        left("n", "t").alias("kept"),
        removed.alias("removed"),
        (left("n", F.lit(0)) - left("n", "own") - removed).alias("redundant"),
        F.get("alone", F.col("f")).alias("unique_fails"),
        (left("good", "s") - left("good", "t")).alias("good_lost"),
        (left("toxic", "s") - left("toxic", "t")).alias("toxic_lost"),
        _shapley().alias("shapley"),
    )


def _shapley() -> Column:
    """Removals of filter f over all orders: a set S stands in front of f in |S|! (4 - |S|)! of them."""
    n = len(LETTERS)
    sets = [(s, factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) for s in range(1 << n) if s.bit_count() < n]
    terms = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(w).cast("long").alias("w")) for s, w in sets))
    outside = F.filter(terms, lambda x: x["s"].bitwiseAND(F.col("own")) == 0)
    gain = lambda x: F.get("n", x["s"]) - F.get("n", x["s"].bitwiseOR(F.col("own")))
    return F.aggregate(outside, F.lit(0).cast("long"), lambda a, x: a + x["w"] * gain(x))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    failures = masks(docs)
    counts = counters(failures, labels)
    dropped(failures)
    return orders(counts)
