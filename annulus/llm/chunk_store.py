"""Content-addressed store of token ids.

A rolling hash over the last ids of a stream decides where it is cut, so equal
passages give equal chunks wherever they stand. A chunk's address is its
BLAKE2b digest. The store is a folder:

  raw/       each distinct chunk once (recipe=false: key, its address; n, its ids; data), and the recipes as first written
  recipes/   part, place, doc_id, row, n_tokens, start, chunks, root
             in ascending order of doc_id; chunks: 24 bytes for each chunk, its address and how many ids follow it
             (8 bytes, big-endian); root: Merkle root over these entries, with doc_id and n_tokens
  manifest/  part, n_docs, n_tokens, start, root   a Merkle root over the part's document roots

Ids are little-endian unsigned integers of 16 bits if the vocabulary allows, else of 32.

Writing shuffles each chunk's ids once: every task sends a chunk it has met
before only by address. Reading checks each chunk against its address and the
sizes that the recipes state, and each recipe and part against its root; a
document's checksum is put together from its chunks' checksums, so ids aren't
shuffled again.

A null text counts as empty; each document ends with the end id. Documents with
the same doc_id, or none (first), are kept apart by `row`. A very long text is
one row of the input and of the encoding, in the store it is chunks and a recipe
of 24 bytes each. An empty table gives an empty store. Only doc_id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annulus.llm.workspace import new_path

MIN_IDS, MAX_IDS, MASK_BITS, WINDOW = 64, 2048, 8, 8
ADDRESS = 16
#: Bytes of ids hashed at a time.
HASHED_BYTES = 1 << 18
#: Addresses a task remembers so as not to send a chunk twice; beyond it forgets, and the shuffle finds the repeats.
SEEN = 1 << 20
_MIX = np.random.default_rng(20240229).integers(0, 1 << 32, 1 << 16, dtype=np.uint32)


def _candidates(ids: np.ndarray) -> list[int]:
    """Places behind an id where the hash of the last WINDOW ids asks for a cut."""
    rolling, width = _MIX[ids & 0xFFFF], 1
    while width < WINDOW:  # a window is two of half the width
        wider = rolling.copy()
        wider[width:] += rolling[:-width] << np.uint32(3 * width)
        rolling, width = wider, 2 * width
    return (np.flatnonzero(rolling >> np.uint32(32 - MASK_BITS) == 0) + 1).tolist()


def _cuts(lengths: list[int], candidates: list[int]) -> Iterator[list[int]]:
    """For each of several streams that follow each other: the ends of its chunks, from its start.

    A hash over the border of two streams lies within the first WINDOW ids of the later one, where
    MIN_IDS allows no cut: so streams may be hashed together.
    """
    at, base, m = 0, 0, len(candidates)
    for n in lengths:
        out, last = [], 0
        while True:
            e = candidates[at] - base if at < m else n
            at += 1
            if e >= n:
                e = n
            elif e - last < MIN_IDS:
                continue
            while e - last > MAX_IDS:
                last += MAX_IDS
                out.append(last)
            if e > last:
                out.append(e)
                last = e
            if e == n:
                break
        at -= 1
        while at < m and candidates[at] - base <= n:
            at += 1
        base += n
        yield out


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of `ids`; the last is its length. An empty stream has none."""
    return next(_cuts([len(ids)], _candidates(ids)))


def address(raw: bytes) -> bytes:
    return blake2b(raw, digest_size=ADDRESS).digest()


def document_root(doc_id: int | None, n_tokens: int, entries: bytes) -> bytes:
    """Root of a document: over its recipe's entries, named with its doc_id and length."""
    step = ADDRESS + 8
    own = b"\0" if doc_id is None else doc_id.to_bytes(8, "big", signed=True)
    return address(b"\2" + n_tokens.to_bytes(8, "big") + merkle_root([entries[i : i + step] for i in range(0, len(entries), step)]) + own)


def merkle_root(leaves) -> bytes:
    """Root over any number of leaves, from a stack as high as the tree; without leaves, the address of nothing."""
    stack: list[tuple[int, bytes]] = []
    for leaf in leaves:
        level, node = 0, leaf
        while stack and stack[-1][0] == level:
            node, level = address(b"\1" + stack.pop()[1] + node), level + 1
        stack.append((level, node))
    if not stack:
        return address(b"")
    node = stack.pop()[1]
    while stack:
        node = address(b"\1" + stack.pop()[1] + node)
    return node


def _encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Rows of two kinds, recipe (true) and chunk (false), from one encoding."""

    def rows(batches):
        from pyspark import TaskContext

        from annulus.llm.tokens import encoder

        enc, part, row, seen = encoder(tokenizer), TaskContext.get().partitionId(), 0, set()
        names = ["recipe", "key", "doc_id", "n", "data", "root"]

        def out():
            kinds = [pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        columns, size, end = [[] for _ in names], 0, end_id.to_bytes(enc.dtype.itemsize, "little")
        width = enc.dtype.itemsize
        for batch in batches:
            docs_, raws, held, left = [], [], 0, batch.num_rows
            for doc, raw in zip(batch.column(0).to_pylist(), enc.encode_raw(batch.column(1).to_pylist())):
                docs_.append(doc)
                raws.append(raw + end)
                held, left = held + len(raw), left - 1
                if held < HASHED_BYTES and left:
                    continue
                lengths = [len(raw) // width for raw in raws]
                cuts = _cuts(lengths, _candidates(np.frombuffer(b"".join(raws), enc.dtype)))
                for doc_, raw_, n, ends in zip(docs_, raws, lengths, cuts):
                    last, recipe = 0, []
                    for e in ends:
                        chunk = raw_[last * width : e * width]
                        key = address(chunk)
                        recipe.append(key + (n - e).to_bytes(8, "big"))
                        if key not in seen:
                            seen.add(key)
                            for column, x in zip(columns, (False, key, None, e - last, chunk, None)):
                                column.append(x)
                            size += len(chunk)
                        last = e
                    entries = b"".join(recipe)
                    told = (True, b"%d:%d" % (part, row), doc_, n, entries, document_root(doc_, n, entries))
                    for column, x in zip(columns, told):
                        column.append(x)
                    row += 1
                docs_, raws, held = [], [], 0
                if size > 1 << 22 or len(columns[0]) > 20_000:
                    yield out()
                    columns, size = [[] for _ in names], 0
                if len(seen) > SEEN:
                    seen.clear()
        if columns[0]:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        rows, "recipe boolean, key binary, doc_id long, n long, data binary, root binary"
    )


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    spark = docs.sparkSession
    first = Window.partitionBy("recipe", "key").orderBy("n")
    rows = _encoded(docs, tokenizer, end_id).repartition("recipe", "key").withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    raw = f"{path}/raw"
    rows.write.partitionBy("recipe").option("compression", "lz4_raw").parquet(raw)
    both = spark.read.schema("key binary, doc_id long, n long, data binary, root binary, recipe boolean").parquet(raw)
    ordered = (
        both.where("recipe")
        .select("doc_id", F.col("key").cast("string").alias("row"), F.col("n").alias("n_tokens"), F.col("data").alias("chunks"), "root")
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("row"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row")
    )
    # One pass over the sorted rows: each file is a part, with its own places and starts.
    ordered.mapInArrow(_placed, "doc_id long, row string, n_tokens long, chunks binary, root binary, part int, place long, start long").write.option(
        "compression", "zstd"
    ).parquet(f"{path}/recipes")

    parts = part_roots(spark.read.parquet(f"{path}/recipes"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    parts.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{path}/manifest")


def _placed(batches):
    """The rows of one part with part, place (from 0) and start (ids before, in this part)."""
    from pyspark import TaskContext

    part, place, ids = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n, lengths = batch.num_rows, batch.column(2).to_numpy()
        ends = ids + np.cumsum(lengths)
        added = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n)), pa.array(ends - lengths)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "part", "place", "start"])
        place, ids = place + n, int(ends[-1]) if n else ids


def part_roots(recipes: DataFrame) -> DataFrame:
    """part, n_docs, n_tokens, root: recomputed from the recipes, each part's in its order."""

    def roots(batches):
        part, sums, leaves = None, [0, 0], []

        def row():
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "n_docs": [sums[0]], "n_tokens": [sums[1]], "root": [merkle_root(leaves)]}
            )

        for batch in batches:
            for p, n, root in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2))):
                if p != part:
                    if part is not None:
                        yield row()
                    part, sums, leaves = p, [0, 0], []
                sums[0] += 1
                sums[1] += n
                leaves.append(root)
        if part is not None:
            yield row()

    return (
        recipes.select("part", "n_tokens", "root", "place")
        .repartition("part")
        .sortWithinPartitions("part", "place")
        .mapInArrow(roots, "part int, n_docs long, n_tokens long, root binary")
    )


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema("key binary, doc_id long, n long, data binary, root binary, recipe boolean")
        .parquet(f"{path}/raw")
        .where("not recipe")
        .select(F.col("key").alias("address"), F.col("n").alias("n_ids"), F.col("data").alias("ids"))
    )


def _checked_chunks(spark: SparkSession, path: str) -> DataFrame:
    """address, size, crc (of the ids as 32-bit integers), sound."""

    def checked(batches):
        for batch in batches:
            keys, sizes, ids = (batch.column(k) for k in range(3))
            # The ids lie one after the other in the column's buffer, which is read in place.
            kind = np.int64 if pa.types.is_large_binary(ids.type) else np.int32
            ends = np.frombuffer(ids.buffers()[1], kind)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64) if len(ids) else np.zeros(1, np.int64)
            raw = memoryview(ids.buffers()[2] or b"")[ends[0] : ends[-1]]
            ends -= ends[0]
            counts, times, wide = sizes.to_numpy(zero_copy_only=False), 1, raw
            if (np.diff(ends) == 2 * counts).all():
                times, wide = 2, memoryview(np.frombuffer(raw, "<u2").astype("<u4")).cast("B")
            crcs, sound, last = [], [], 0
            for key, n, end in zip(keys.to_pylist(), counts.tolist(), ends[1:].tolist()):
                own = wide[times * last : times * end]
                if times == 1 and end - last == 2 * n:  # beside a chunk of another size, which is damaged
                    own = np.frombuffer(own, "<u2").astype("<u4").tobytes()
                crcs.append(zlib.crc32(own))
                sound.append(address(raw[last:end]) == key)
                last = end
            columns = [keys, batch.column(1), pa.array(crcs, pa.int64()), pa.array(sound, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["address", "size", "crc", "sound"])

    return _chunks(spark, path).mapInArrow(checked, "address binary, size long, crc long, sound boolean")


def _powers() -> np.ndarray:
    """[b][k][x]: byte k of a CRC-32 register with value x after 2**b further ids (of 4 bytes) of zeros."""

    def times(m, x):
        out = 0
        for i in range(32):
            if x >> i & 1:
                out ^= m[i]
        return out

    one = [0xEDB88320, *(1 << i for i in range(31))]  # one bit of zeros
    for _ in range(5):  # 32 bits
        one = [times(one, x) for x in one]
    tables = np.zeros((41, 4, 256), np.uint32)
    for b in range(41):
        for k in range(4):
            for i in range(8):
                tables[b, k, 1 << i : 2 << i] = tables[b, k, : 1 << i] ^ np.uint32(one[8 * k + i])
        one = [times(one, x) for x in one]
    return tables


def shifted_crc(crc: np.ndarray, after: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """What each chunk adds to its document's CRC-32 when `after` ids follow it; the sum is an exclusive or."""
    crc, b = crc.astype(np.uint32), 0
    while (after >> b).any():
        at = np.flatnonzero(after >> b & 1)
        x = crc[at]
        crc[at] = powers[b, 0, x & 255] ^ powers[b, 1, x >> 8 & 255] ^ powers[b, 2, x >> 16 & 255] ^ powers[b, 3, x >> 24]
        b += 1
    return crc


ENTRY = "row string, address binary, after long, n_ids long, whole boolean"


def _entries(recipes: DataFrame) -> DataFrame:
    """ENTRY: one row for each chunk of each recipe; n_ids is its size by the recipe, whole tells whether the recipe fits its root."""
    step = ADDRESS + 8

    def entries(batches):
        for batch in batches:
            lists, lengths = batch.column(3).to_pylist(), batch.column(2).to_numpy()
            whole = [
                document_root(doc, n, data) == root
                for doc, n, data, root in zip(batch.column(1).to_pylist(), lengths.tolist(), lists, batch.column(4).to_pylist())
            ]
            lists = [x if x and len(x) % step == 0 else bytes(step) for x in lists]  # a damaged one names a chunk that isn't there
            counts = np.array([len(x) // step for x in lists], np.int64)
            table = np.frombuffer(b"".join(lists), np.uint8).reshape(-1, step)
            after = table[:, ADDRESS:].copy().view(">i8").reshape(-1).astype(np.int64)
            before = np.empty_like(after)  # ids from a chunk's start on
            before[1:] = after[:-1]
            ends = np.cumsum(counts)
            before[ends - counts] = lengths
            at = np.repeat(np.arange(len(lists)), counts)
            falls = np.logical_and.reduceat((before > after) & (after >= 0), ends - counts) if len(after) else np.zeros(0, bool)
            sound = np.array(whole, bool) & falls & (after[ends - 1] == 0) if len(after) else np.zeros(0, bool)
            places = np.arange(0, ADDRESS * len(after) + 1, ADDRESS, dtype=np.int32)
            keys = pa.Array.from_buffers(
                pa.binary(), len(after), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(table[:, :ADDRESS]))]
            )
            columns = [batch.column(0).take(pa.array(at)), keys, pa.array(after), pa.array(before - after), pa.array(sound[at])]
            yield pa.RecordBatch.from_arrays(columns, ["row", "address", "after", "n_ids", "whole"])

    return recipes.select("row", "doc_id", "n_tokens", "chunks", "root").mapInArrow(entries, ENTRY)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the store, from its files: doc_id, row, start, n_tokens, ids_crc32, verified.

    verified: its chunks are there and fit their addresses, its recipe fits its root, and its
    part's recipes fit the manifest.
    """
    recipes = spark.read.parquet(f"{path}/recipes")
    manifest = spark.read.parquet(f"{path}/manifest")

    def moved(batches):
        powers = _powers()
        for batch in batches:
            crc = batch.column(1).to_numpy(zero_copy_only=False)
            got = shifted_crc(crc, batch.column(2).to_numpy(zero_copy_only=False), powers)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.astype("int64")), batch.column(3)], ["row", "crc", "ok"])

    # An entry fits if its chunk is there, sound, and as long as the recipe says.
    fits = F.coalesce(F.col("sound") & (F.col("n_ids") == F.col("size")), F.lit(False))
    sums = (
        _entries(recipes)
        .join(_checked_chunks(spark, path), "address", "left")
        .select("row", F.coalesce("crc", F.lit(0)).cast("long").alias("crc"), "after", (F.col("whole") & fits).alias("ok"))
        .mapInArrow(moved, "row string, crc long, ok boolean")
        .groupBy("row")
        .agg(F.bit_xor("crc").alias("ids_crc32"), F.bool_and("ok").alias("ok"))
    )
    again = part_roots(recipes).select("part", F.col("root").alias("root_again"), F.col("n_tokens").alias("n_again"))
    parts = manifest.join(again, "part", "left").select(
        "part",
        F.col("start").alias("part_start"),
        (F.col("root").eqNullSafe(F.col("root_again")) & F.col("n_tokens").eqNullSafe(F.col("n_again"))).alias("part_ok"),
    )
    return (
        recipes.select("part", "doc_id", "row", "start", "n_tokens")
        .join(parts, "part")
        .join(sums, "row")
        .select(
            "doc_id",
            "row",
            (F.col("start") + F.col("part_start")).alias("start"),
            "n_tokens",
            "ids_crc32",
            (F.col("ok") & F.col("part_ok")).alias("verified"),
        )
    )


def read_ids(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """The id streams of some documents: rows (row, place, n_ids, ids) of their chunks, place counting from 0.

    `rows` has a column row, as in read_digests. Streams stay in chunks: one that doesn't fit a
    task's memory can still be read in order.
    """
    wanted = spark.read.parquet(f"{path}/recipes").join(rows.select("row").distinct(), "row", "left_semi")
    entries = _entries(wanted).select("row", "address", "after")
    order = Window.partitionBy("row").orderBy(F.desc("after"))
    return (
        entries.withColumn("place", F.row_number().over(order) - 1)
        .join(_chunks(spark, path), "address")
        .select("row", "place", "n_ids", "ids")
    )


def store_path(spark: SparkSession) -> str:
    return new_path(spark, "store")
