"""Hierarchical multi-length packing.

Every document, with an end id, is cut into full windows of the longest context
and a rest. Rests are routed to the tier of the smallest context that holds
them. From the longest tier down, each rest opens a window whose gap is filled
with rests of shorter tiers: the longest that fits, again and again, then a
piece cut from the next one. A partition packs its own documents in bounded
batches, so packing needs no shuffle and a lost task repeats alone. What a
partition can't fill at its end is cut into windows of powers of two, which need
no padding. Steps are groups of windows of one length. They are balanced over all
partitions: the windows of a length are numbered through, by a table with a row
for each partition and length that is joined to the pieces, and dealt to as few
steps as hold them, so that the steps of a length differ by one window at most.

Nulls and empty texts consist of the end id; a very long text is encoded whole and
cut into full windows; repeated rows are packed each time; an empty table gives no
rows. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annulus.llm.workspace import written

CONTEXT = 2048
TIERS = (256, 512, 1024, 2048)
#: Tokens of one step.
STEP_TOKENS = 8 * 2048
#: Rests held back before a partition packs them: memory is bounded by tokens, not by rows.
FLUSH_TOKENS = 1 << 20
#: Tokens of closed windows that go out in one batch: 4 MB of ids.
OUT_TOKENS = 1 << 20

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int"
#: Bits of a sequence's number within its partition.
SHARD_BITS = 40


class Packer:
    """Packs one partition; `rows` gathers (doc, start, ids, doc_tokens, sequence, offset, tier, nth window of its tier)."""

    def __init__(self, shard: int, tiers=TIERS):
        self.tiers = tiers
        self.base, self.sequences = shard << SHARD_BITS, 0
        self.windows: dict[int, int] = {}
        # A tier's rests: sorted keys (length, number), and the pieces by number.
        self.waiting: dict[int, list[tuple[int, int]]] = {t: [] for t in tiers}
        self.pieces: dict[int, tuple] = {}
        self.number = self.held = 0
        self.rows: list[tuple] = []
        self.ready = 0  # tokens in rows
        self.rest: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        top, n = self.tiers[-1], len(ids)
        full = n - n % top
        for start in range(0, full, top):
            self._close([(doc, start, ids[start : start + top], n)], top)
        if full < n:
            self._wait((doc, full, ids[full:], n))
        if self.held >= FLUSH_TOKENS:
            self._pack()

    def _wait(self, piece) -> None:
        n = len(piece[2])
        tier = next(t for t in self.tiers if n <= t)
        self.number += 1
        self.pieces[self.number] = piece
        insort(self.waiting[tier], (n, self.number))
        self.held += n

    def _take(self, tier: int, at: int):
        n, number = self.waiting[tier].pop(at)
        self.held -= n
        return self.pieces.pop(number)

    def _fill(self, gap: int, below: int):
        """The next piece for a gap: the longest that fits, from tiers up to index `below`; else a cut one."""
        for t in reversed(self.tiers[: below + 1]):
            if at := bisect_right(self.waiting[t], (gap, 1 << 62)):
                return self._take(t, at - 1)
        for t in self.tiers[: below + 1]:
            if self.waiting[t]:
                doc, start, ids, n = self._take(t, -1)
                self._wait((doc, start + gap, ids[gap:], n))
                return doc, start, ids[:gap], n
        return None

    def _pack(self) -> None:
        for level in reversed(range(len(self.tiers))):
            size = self.tiers[level]
            while self.waiting[size]:
                window, gap = [self._take(size, -1)], size
                gap -= len(window[0][2])
                while gap and (piece := self._fill(gap, level)):
                    window.append(piece)
                    gap -= len(piece[2])
                if not gap:
                    self._close(window, size)
                    continue
                for piece in window:  # too little is left for this tier: it waits for more documents
                    self.rest.append(piece)
        for piece in self.rest:
            self._wait(piece)
        self.rest = []

    def finish(self) -> None:
        self._pack()
        left = [self._take(t, 0) for t in self.tiers for _ in range(len(self.waiting[t]))]
        total, at, skip = sum(len(p[2]) for p in left), 0, 0
        size = self.tiers[-1]
        while total:
            while size > total:
                size //= 2
            window, gap = [], size
            while gap:
                doc, start, ids, n = left[at]
                ids = ids[skip : skip + gap]
                window.append((doc, start + skip, ids, n))
                gap -= len(ids)
                skip += len(ids)
                if skip == len(left[at][2]):
                    at, skip = at + 1, 0
            self._close(window, size)
            total -= size

    def _close(self, window, size: int) -> None:
        nth = self.windows.get(size, 0)
        self.windows[size] = nth + 1
        offset, sequence = 0, self.base | self.sequences
        self.sequences += 1
        self.ready += size
        for doc, start, ids, n in window:
            self.rows.append((doc, start, ids, n, sequence, offset, size, nth))
            offset += len(ids)


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    ids: bool = True,
) -> DataFrame:
    """One row per piece: SCHEMA, step_id, and with `ids` the piece's ids as little-endian unsigned 32-bit integers.

    sequence_id counts within the partition named by its upper bits. A piece is never longer than
    its window; offsets in a window have no gaps; no window is padded, as those that can't be filled
    have the length of a power of two. A step has at most step_tokens tokens.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)) or step_tokens < tiers[-1]:
        raise ValueError("tiers are increasing powers of two, and a step holds the longest")
    schema = SCHEMA + ", nth long" + ", ids binary" * ids
    names = [x.split()[0] for x in schema.split(", ")]

    def packed(batches):
        from pyspark import TaskContext

        from annulus.llm.tokens import encoder

        enc, packer = encoder(tokenizer), Packer(TaskContext.get().partitionId(), tiers)

        def out():
            rows, packer.rows, packer.ready = packer.rows, [], 0
            raw = [x[2].tobytes() for x in rows]
            columns = [
                [x[0] for x in rows],
                [x[1] for x in rows],
                [len(x[2]) for x in rows],
                [zlib.crc32(x) for x in raw],
                *([x[k] for x in rows] for k in (3, 4, 5)),
            ]
            arrays = [pa.array(c, pa.int64()) for c in columns]
            arrays += [pa.array([x[6] for x in rows], pa.int32()), pa.array([x[7] for x in rows], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays + [pa.array(raw, pa.binary())] * ids, names)

        for batch in batches:
            for doc, got in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                whole = np.empty(len(got) + 1, "<u4")
                whole[:-1], whole[-1] = got, end_id
                packer.add(doc, whole)
                if packer.ready >= OUT_TOKENS:
                    yield out()
        packer.finish()
        yield out()

    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(packed, schema)
    return with_steps(written(pieces, "pieces"), step_tokens)


def with_steps(pieces: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """The pieces with step_id in the place of nth: their windows' steps, balanced over all partitions."""
    shard = F.shiftright("sequence_id", SHARD_BITS).alias("shard")
    counts = pieces.where("offset = 0").groupBy("tier", shard).agg(F.count("*").alias("n"))  # a window has one first piece
    before = Window.partitionBy("tier").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    total = F.sum("n").over(Window.partitionBy("tier"))
    steps = F.ceil(total / F.floor(F.lit(step_tokens) / F.col("tier")))
    table = written(counts.select("tier", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), total.alias("total"), steps.alias("steps")), "steps")
    joined = pieces.withColumn("shard", shard).join(table, ["tier", "shard"])
    number = F.expr("(before + nth) * steps div total")
    own = [c for c in pieces.columns if c not in ("nth", "ids")]
    step = (F.shiftleft(number, 6) + F.log2("tier").cast("int")).alias("step_id")  # lengths are powers of two
    return joined.select(*own, step, *(c for c in pieces.columns if c == "ids"))
