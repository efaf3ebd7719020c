"""BAM as a Spark data source: partitions of SPLIT compressed bytes, decoded record by record in bounded memory.

Files are opened by pyarrow's file systems, so they may lie in any store that
executors reach. BGZF is gzip in blocks that state their size, so a partition
starts at the first block in its range. Records cross blocks: a partition finds
the first place from which a chain of CHAIN records (or all up to the end)
parses, and owns the records that start in its blocks; the last of them may end
in a later one. Files of other gzip members, small ones, and those read under
a bound of bases are one partition.
"""

from __future__ import annotations

import gzip
import struct

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from annulus.errors import AnalysisError
from annulus.functions import text

# Fixed values of the format.
MAGIC = b"BAM\x01"
BASES = "=ACMGRSVTWYHKDBN"
OPERATIONS = "MIDNSHP=X"
SCALARS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
FIXED = struct.Struct("<iiBBHHHiiii")
LARGEST_RECORD = 1 << 28
#: Compressed bytes of a partition, and records that must follow each other where one is looked for.
SPLIT, CHAIN = 64 << 20, 8

SCHEMA = "file string, split long, file_index long, id string, flags int, reference_name string, reference_start int, mapping_quality int, cigar string, sequence string, qualities string, aux_tags map<string,string>, cost long"


def _open(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    try:
        return store.open_input_stream(inner)
    except OSError as e:
        raise AnalysisError("E1101", f"{path}: {e}") from e


def _take(stream, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise AnalysisError("E1103", "the BAM ends inside a record")
    return data


def sniff(path: str) -> str:
    """`bam`, or a refusal by what the first bytes are."""
    with _open(path) as raw:
        head = raw.read(4)
    if head[:2] == b"\x1f\x8b":
        with _open(path) as raw, gzip.GzipFile(fileobj=raw) as stream:
            if stream.read(4) == MAGIC:
                return "bam"
    if head == b"CRAM":
        raise AnalysisError("E1401", f"{path}: no decoder for CRAM")
    raise AnalysisError("E1102", f"{path} isn't BAM")


def _number(x) -> str:
    """Integers as they are, floats with all their digits."""
    return f"{x:.17g}" if isinstance(x, float) else str(x)


def aux_tags(data: bytes) -> dict[str, str]:
    """Tags with their values as text; arrays as `t,v,v`. A repeated tag, an unknown type or a value beyond the record fails."""
    out, at = {}, 0

    def need(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise AnalysisError("E1103", "auxiliary data ends inside a value")
        at += n
        return data[at - n : at]

    while at < len(data):
        head = need(3).decode("latin-1")
        tag, kind = head[:2], head[2]
        if tag in out:
            raise AnalysisError("E1103", f"tag {tag} is repeated")
        if tag == "SA" and kind != "Z":
            raise AnalysisError("E1103", "the supplementary alignments aren't text")
        if kind == "A":
            value = need(1).decode("latin-1")
        elif kind in SCALARS:
            value = _number(struct.unpack(SCALARS[kind], need(struct.calcsize(SCALARS[kind])))[0])
        elif kind in "ZH":
            end = data.find(b"\0", at)
            if end < 0:
                raise AnalysisError("E1103", f"tag {tag} has no end")
            value = need(end - at).decode("utf-8", "replace")
            need(1)
        elif kind == "B":
            of, n = chr(need(1)[0]), struct.unpack("<i", need(4))[0]
            if of not in SCALARS or n < 0:
                raise AnalysisError("E1103", f"tag {tag} has an array of unknown type or size")
            form = SCALARS[of]
            value = ",".join([of, *(_number(x) for x in struct.unpack(f"<{n}{form[1]}", need(n * struct.calcsize(form))))])
        else:
            raise AnalysisError("E1103", f"tag {tag} has unknown type {kind}")
        out[tag] = value
    return out


def _cigar(words) -> str:
    if any(w & 15 >= len(OPERATIONS) for w in words):
        raise AnalysisError("E1103", "unknown CIGAR operation")
    return "".join(f"{w >> 4}{OPERATIONS[w & 15]}" for w in words) or "*"


def record(data: bytes, names: list[str]) -> tuple:
    """A record as the columns from `id` on; the last is its cost: its bases, a quarter of its bytes, or its reference span, whichever is most."""
    if len(data) < FIXED.size:
        raise AnalysisError("E1103", "a record is too short")
    ref, pos, l_name, mapq, _, n_ops, flags, l_seq, *_rest = FIXED.unpack_from(data)
    at = FIXED.size
    ends = [at + l_name, at + l_name + 4 * n_ops]
    ends += [ends[1] + (l_seq + 1) // 2, ends[1] + (l_seq + 1) // 2 + l_seq]
    if l_name < 1 or l_seq < 0 or ends[-1] > len(data) or not -1 <= ref < len(names):
        raise AnalysisError("E1103", "a record's lengths don't fit")
    name = data[at : ends[0] - 1].decode("utf-8", "replace")
    ops = struct.unpack_from(f"<{n_ops}I", data, ends[0])
    packed, quals = data[ends[1] : ends[2]], data[ends[2] : ends[3]]
    sequence = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:l_seq]
    tags = aux_tags(data[ends[3] :])
    cigar = _cigar(ops)
    if "CG" in tags and cigar.startswith(f"{l_seq}S") and cigar.endswith("N") and len(ops) == 2 and tags["CG"][0] == "I":
        cigar = _cigar([int(x) for x in tags.pop("CG").split(",")[1:]])  # more operations than the field can count
    missing = not quals or quals[0] == 0xFF
    qualities = "!" * l_seq if missing else "".join(chr(min(q, 93) + 33) for q in quals)
    cost = max(l_seq, -(-len(data) // 4), _reference_span(cigar))
    return name, flags, names[ref] if ref >= 0 else "*", pos + 1, mapq, cigar, sequence.upper(), qualities, tags, cost


def reference_names(path: str) -> list[str]:
    """The names of the references in a file's header."""
    with _open(path) as raw, gzip.GzipFile(fileobj=raw) as stream:
        return _header(stream, path)


def _header(stream, path: str) -> list[str]:
    """The names of the references; the stream then stands at the first record."""
    if _take(stream, 4) != MAGIC:
        raise AnalysisError("E1102", f"{path} isn't BAM")
    left = struct.unpack("<i", _take(stream, 4))[0]
    while left > 0:
        left -= len(_take(stream, min(left, 1 << 20)))
    names = []
    for _ in range(struct.unpack("<i", _take(stream, 4))[0]):
        names.append(_take(stream, struct.unpack("<i", _take(stream, 4))[0])[:-1].decode())
        _take(stream, 4)
    return names


def records(path: str, most_bases: int | None = None):
    """The records of a file. `most_bases` bounds the sum of their costs."""
    spent = 0
    with _open(path) as raw, gzip.GzipFile(fileobj=raw) as stream:
        names = _header(stream, path)
        for index, body in enumerate(_bodies(stream)):
            row = record(body, names)
            if most_bases is not None:
                spent += row[-1]
                if spent > most_bases:
                    raise AnalysisError("E1601", f"{path} holds more than {most_bases} bases")
            yield (path, 0, index, *row)


def _bodies(stream):
    while head := stream.read(4):
        if len(head) < 4:
            raise AnalysisError("E1103", "the BAM ends inside a record")
        size = struct.unpack("<i", head)[0]
        if not 0 < size <= LARGEST_RECORD:
            raise AnalysisError("E1103", f"a record of {size} bytes")
        yield _take(stream, size)


def _block_size(head: bytes) -> int | None:
    """The size that a BGZF block's header states; None of anything else."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 4 <= min(end, len(head)):
        size = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return None


def _file(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store, inner


def splits(path: str, size: int = SPLIT) -> list[tuple[str, int, int]]:
    """(path, start, end) of a file's partitions; one from 0 to -1 if it can't be split."""
    store, inner = _file(path)
    length = store.get_file_info(inner).size
    with store.open_input_stream(inner, compression=None) as raw:
        blocks = _block_size(raw.read(64)) is not None
    if not blocks or length <= size:
        return [(path, 0, -1)]
    return [(path, a, min(a + size, length)) for a in range(0, length, size)]


class _Blocks:
    """The decompressed bytes of BGZF blocks from an offset on, with where each block started."""

    def __init__(self, source, start: int, length: int):
        self.source, self.at, self.length = source, start, length
        self.data, self.base, self.starts = bytearray(), 0, []  # base: decompressed bytes dropped; starts: (decompressed, compressed)

    def more(self) -> bool:
        if self.at >= self.length:
            return False
        self.source.seek(self.at)
        size = _block_size(self.source.read(64))
        if size is None:
            raise AnalysisError("E1103", "a damaged block")
        self.source.seek(self.at)
        self.starts.append((self.base + len(self.data), self.at))
        self.data += gzip.decompress(self.source.read(size))
        self.at += size
        return True

    def get(self, a: int, n: int) -> bytes | None:
        """n bytes from a decompressed place on; None beyond the end."""
        while a + n > self.base + len(self.data):
            if not self.more():
                return None
        return bytes(self.data[a - self.base : a - self.base + n])

    def block_of(self, a: int) -> int:
        """Where the block that holds a decompressed place starts in the file."""
        self.get(a, 1)
        return max((c for d, c in self.starts if d <= a), default=self.length)

    def drop(self, a: int) -> None:
        """Forget what lies before a decompressed place."""
        keep = next((i for i in range(len(self.starts) - 1, -1, -1) if self.starts[i][0] <= a), 0)
        self.starts = self.starts[keep:]
        del self.data[: a - self.base]
        self.base = a


def _first_block(source, start: int, length: int) -> int:
    """The first place from `start` on where two BGZF blocks follow each other, or one up to the end."""
    at = start
    while at < length:
        source.seek(at)
        window = source.read(1 << 17)
        here = window.find(b"\x1f\x8b\x08\x04")
        while here >= 0:
            source.seek(at + here)
            size = _block_size(source.read(64))
            if size is not None:
                source.seek(at + here + size)
                if at + here + size == length or _block_size(source.read(64)) is not None:
                    return at + here
            here = window.find(b"\x1f\x8b\x08\x04", here + 1)
        at += max(1, len(window) - 3)
    return length


def _plausible(head: bytes, size: int, references: int) -> bool:
    """Whether 36 bytes could start a record of a size."""
    ref, pos, name, _, _, ops, _, bases, next_ref, next_pos, _ = FIXED.unpack(head[:32])
    fits = 32 + name + 4 * ops + (bases + 1) // 2 + bases <= size <= LARGEST_RECORD
    return fits and name > 0 and bases >= 0 and -1 <= ref < references and pos >= -1 and -1 <= next_ref < references and next_pos >= -1


def _first_record(blocks: _Blocks, references: int, end: int) -> int | None:
    """The decompressed place of the first record that starts in a block before `end`."""
    a = 0
    while blocks.get(a, 1) is not None and blocks.block_of(a) < end:
        at, good = a, True
        for _ in range(CHAIN):
            head = blocks.get(at, 4 + FIXED.size)
            if head is None:
                good = at != a and blocks.get(at, 1) is None  # all records up to the end of the file
                break
            size = struct.unpack("<i", head[:4])[0]
            if size < FIXED.size or not _plausible(head[4:], size, references) or blocks.get(at + 4 + FIXED.size + head[12] - 1, 1) != b"\0":
                good = False
                break
            at += 4 + size
        if good:
            return a
        a += 1
    return None


def split_records(path: str, start: int, end: int):
    """The records that start in blocks of a range of a file."""
    store, inner = _file(path)
    length = store.get_file_info(inner).size
    with _open(path) as raw, gzip.GzipFile(fileobj=raw) as stream:
        names = _header(stream, path)
        first = stream.tell()
    with store.open_input_file(inner) as source:
        blocks = _Blocks(source, 0 if start == 0 else _first_block(source, start, length), length)
        at = first if start == 0 else _first_record(blocks, len(names), end)
        index = 0
        while at is not None and blocks.block_of(at) < end and (head := blocks.get(at, 4)) is not None:
            size = struct.unpack("<i", head)[0]
            body = blocks.get(at + 4, size) if 0 < size <= LARGEST_RECORD else None
            if body is None:
                raise AnalysisError("E1103", f"{path}: a record of {size} bytes")
            yield (path, start, index, *record(body, names))
            at, index = at + 4 + size, index + 1
            blocks.drop(at)


def _reference_span(cigar: str) -> int:
    total, n = 0, 0
    for c in cigar:
        if c.isdigit():
            n = n * 10 + int(c)
        else:
            total, n = total + (n if c in "MDN=X" else 0), 0
    return total


class BamSource(DataSource):
    """`spark.read.format("bam").load(paths)`; several paths are separated by commas. Option `maxBases` bounds each file."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BamReader(self.options)


class BamFile(InputPartition):
    pass


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options["path"].split(",") if p]
        self.most = int(options["maxBases"]) if "maxBases" in options else None
        self.size = int(options.get("splitBytes", SPLIT))

    def partitions(self):
        whole = [[(p, 0, -1)] if self.most is not None else splits(p, self.size) for p in self.paths]
        return [BamFile(x) for parts in whole for x in parts]

    def read(self, partition):
        path, start, end = partition.value
        yield from records(path, self.most) if end < 0 else split_records(path, start, end)


def read_bam(spark: SparkSession, paths: str | list[str], most_bases: int | None = None, split_bytes: int = SPLIT) -> DataFrame:
    """reads, as from SAM; records are numbered in the order of files and of records in them."""
    from annulus.sources.alignments import supplementary

    files = [paths] if isinstance(paths, str) else list(paths)
    for path in files:
        sniff(path)
    spark.dataSource.register(BamSource)
    source = spark.read.format("bam").option("splitBytes", split_bytes)
    rows = (source.option("maxBases", most_bases) if most_bases is not None else source).load(",".join(files))
    if len(files) == 1 and (most_bases is not None or len(splits(files[0], split_bytes)) == 1):
        numbered = rows.withColumn("record_index", F.col("file_index"))
    else:
        order = F.array_position(F.array(*map(F.lit, files)), F.col("file"))
        sizes = rows.groupBy("file", "split").agg(F.count("*").alias("n")).withColumn("o", order)
        before = F.coalesce(F.sum("n").over(Window.orderBy("o", "split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
        numbered = rows.join(sizes.select("file", "split", before.alias("_start")), ["file", "split"]).withColumn("record_index", F.col("_start") + F.col("file_index"))
    ops = text.cigar_operations(F.col("cigar"))
    fits = (F.col("sequence") == "") | (F.col("cigar") == "*") | (text.query_span(ops) == F.length("sequence"))
    id_ = F.when(~fits, F.raise_error(F.concat(F.lit("E1103: malformed alignment record: "), F.col("id")))).otherwise(F.col("id"))
    out = numbered.select("record_index", id_.alias("id"), "flags", "reference_name", "reference_start", "mapping_quality", "cigar", ops.alias("cigar_operations"), "sequence", "qualities", "aux_tags", "cost")
    return out.withColumn("supplementary_alignments", supplementary(F.try_element_at("aux_tags", F.lit("SA"))))
