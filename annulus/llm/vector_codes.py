"""Operator 11: product codes of vectors, the nearest entry found by VA-file filtering.

A vector's components become integers and the vector is cut into equal parts;
each part position has a codebook of integer entries, fitted by rounds of
assignment and componentwise means. A nearest entry is found as in a VA file:

- an entry's coordinates are quantised to a few bits: along each dimension the
  entries' range is cut into 2**bits cells, and an entry is known by its cells;
- a query (a part of a vector) gets a table with, for each dimension and cell, the
  least and the greatest squared distance to that cell's interval; sums of it over
  an entry's cells are a lower and an upper bound of its distance;
- entries whose lower bound is at most the smallest upper bound are candidates
  (others cannot even tie), and their integer distances are compared; ties go to
  the lower index.

Spark deals out the vectors. A round is one pass: each task assigns its vectors
batch by batch, keeps a sum and a count for each entry and gives only these
(parts x entries rows a task, whatever it read); they are added up by entry and
the driver sees parts x entries rows. Integers are written once, so that passes
read what the rounds need and nothing else. Errors are summed by label over tasks
first, and the sums are joined back by label.

Defined cases: a row whose vector is null, empty or holds null or non-finite
components is dropped, also one whose length is not a multiple of `parts` or
differs from the first seed's. Rows without vec_id are coded and counted but
never seeds; rows that share a vec_id are rows of their own, and among seeds they
stand in the order of their vectors. Fewer rows than entries give fewer entries.
Equal entries: the lower index wins, the other stays as it is. Rows without label
share one label_error. An empty table gives an empty table. Integers are exact
for components within +-32768 at 64 dimensions (more at fewer); a component
beyond, whose squared distances no long could hold, fails the job by name. Other
columns of the input, clashing names included, are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annulus.llm.workspace import dropped, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bits of a cell number in one dimension.
BITS = 3
#: Vectors that are assigned at once.
CHUNK = 4096


class Cells:
    """The entries of one part position, quantised."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        n, dims = entries.shape
        low, high = entries.min(axis=0), entries.max(axis=0)
        width = np.maximum(1, -(-(high - low + 1) // (1 << bits)))
        self.cell = (entries - low) // width  # (entry, dimension)
        steps = np.arange(1 << bits, dtype=np.int64)
        self.starts = low[:, None] + width[:, None] * steps  # (dimension, cell): the first and last integer of each
        self.ends = self.starts + width[:, None] - 1
        self.flat = self.cell + (np.arange(dims) << bits)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances of queries to entries."""
        q = queries[:, :, None]
        below, above = self.starts - q, q - self.ends
        least = np.maximum(np.maximum(below, above), 0)
        most = np.maximum(np.abs(below), np.abs(above))
        tables = ((x * x).reshape(len(queries), -1) for x in (least, most))
        return tuple(sum(t[:, column] for column in self.flat.T) for t in tables)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each query and its squared distance."""
        lower, upper = self.bounds(queries)
        row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
        d = queries[row] - self.entries[entry]
        exact = np.full(lower.shape, np.iinfo(np.int64).max)
        exact[row, entry] = np.einsum("ij,ij->i", d, d)
        best = exact.argmin(axis=1)
        return best, exact[np.arange(len(best)), best]


def assigned(books: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts): entry numbers and squared distances. books: (parts, entries, width), vectors: (rows, parts, width)."""
    found = [Cells(book).nearest(vectors[:, p]) for p, book in enumerate(books)]
    return np.stack([x[0] for x in found], 1), np.stack([x[1] for x in found], 1)


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(len(column), parts, -1)


def integers(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """(vec_id, label, q): the rows whose vectors can be coded, as integers."""
    v = F.col("embedding")
    whole = v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    limit = F.pow(F.lit(2.0), F.floor((F.lit(62) - F.ceil(F.log2(F.size(v)))) / 2) - 1)
    checked = lambda x: F.when(F.abs(x) < limit, F.floor(x).cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("a component is too large for integer distances, vec_id "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))))
    )
    scaled = F.transform(v, lambda x: checked(x.cast("double") * SCALE))
    return vectors.where(whole).where(finite).select("vec_id", "label", scaled.alias("q"))


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) of integer rows; empty if there are none."""
    ordered = rows.where("vec_id IS NOT NULL").select("vec_id", "q").orderBy("vec_id", "q")
    first = ordered.first()
    if first is None:
        return np.zeros((parts, 0, 0), np.int64)
    seeds = ordered.where(F.size("q") == len(first.q)).limit(entries).collect()
    books = np.array([r.q for r in seeds], np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _moved(rows, books)
    return books


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, width = books.shape

    def sums(batches):
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                q = _matrix(batch.column(0).slice(at, CHUNK), parts)
                best, _ = assigned(books, q)
                for p in range(parts):
                    np.add.at(total[p], best[:, p], q[:, p])
                    count[p] += np.bincount(best[:, p], minlength=entries)
        part, entry = np.nonzero(count)
        if len(part):
            columns = [part, entry, count[part, entry], *total[part, entry].T]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    names = ["part", "entry", "n", *(f"s{k}" for k in range(width))]
    told = rows.where(F.size("q") == parts * width).select("q").mapInArrow(sums, ", ".join(f"{n} long" for n in names))
    added = told.groupBy("part", "entry").agg(*(F.sum(n).alias(n) for n in names[2:]))
    moved = books.copy()
    for r in added.collect():  # at most parts x entries rows
        moved[r.part, r.entry] = [s // r.n for s in r[3:]]
    return moved


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of integer rows; rows of another length than the codebooks' are dropped."""
    parts, _, width = books.shape

    def encoded(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                best, error = assigned(books, _matrix(part.column(2), parts))
                codes = [bytes(b).hex() for b in best.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(codes), pa.array(error.sum(axis=1))], ["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    return rows.where(F.size("q") == parts * width).select("vec_id", "label", "q").mapInArrow(encoded, schema)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), a row for each vector that can be coded."""
    rows = written(integers(vectors), "integers", "zstd")
    books = fit(rows)
    if not books.size:  # no row with a vec_id to start from
        dropped(rows)
        return vectors.where(F.lit(False)).select("vec_id", *(F.lit(None).cast(t).alias(n) for n, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))))
    coded = written(encode(rows, books), "codes", "zstd")
    dropped(rows)
    totals = written(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    found = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
