"""BAM files made here, against the same records as SAM text."""

import gzip
import struct

import pytest

from annulus.errors import AnalysisError
from annulus.sources import alignments, bam

NAMES = ["MT", "chr1"]
RECORDS = [
    ("r1", 0, "MT", 10, 60, "2S5M1D3M", "ACGTACGTNA", "IIIIIIIIII", [("NM", "i", 1), ("SA", "Z", "MT,200,-,5S5M,50,0;"), ("XA", "A", "q"), ("XF", "f", 0.5), ("XB", "B", ("s", [1, -2, 3]))]),
    ("r2", 16, "chr1", 1, 0, "3M", "ACG", "*", []),
    ("r3", 4, "*", 0, 0, "*", "*", "*", [("RX", "Z", "ACGT")]),
]


def aux(tag, kind, value):
    head = tag.encode() + kind.encode()
    if kind == "B":
        of, xs = value
        return head + of.encode() + struct.pack(f"<i{len(xs)}{bam.SCALARS[of][1]}", len(xs), *xs)
    return head + (value.encode() + (b"\0" if kind == "Z" else b"") if kind in "AZ" else struct.pack(bam.SCALARS[kind], value))


def packed(name, flags, ref, pos, mapq, cigar, sequence, qualities, tags):
    import re

    ops = [int(n) << 4 | bam.OPERATIONS.index(o) for n, o in re.findall("([0-9]+)(.)", cigar)]
    bases = "" if sequence == "*" else sequence
    codes = [bam.BASES.index(b) for b in bases] + [0] * (len(bases) % 2)
    body = bam.FIXED.pack(NAMES.index(ref) if ref != "*" else -1, pos - 1, len(name) + 1, mapq, 0, len(ops), flags, len(bases), -1, -1, 0)
    body += name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    body += b"\xff" * len(bases) if qualities == "*" else bytes(ord(q) - 33 for q in qualities)
    body += b"".join(aux(*t) for t in tags)
    return struct.pack("<i", len(body)) + body


def written(path, rows, cut=50):
    data = bam.MAGIC + struct.pack("<i", 3) + b"@CO" + struct.pack("<i", len(NAMES)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 16569) for n in NAMES)
    data += b"".join(rows)
    path.write_bytes(b"".join(gzip.compress(data[i : i + cut]) for i in range(0, len(data), cut)) + gzip.compress(b""))
    return str(path)


def test_same_as_sam(spark, tmp_path):
    def field(tag, kind, value):
        return f"{tag}:{'i' if kind in 'cCsSiI' else kind}:" + (",".join([value[0], *map(str, value[1])]) if kind == "B" else str(value))

    sam = tmp_path / "a.sam"
    sam.write_text("@HD\tVN:1.6\n" + "".join("\t".join([n, str(f), r, str(p), str(m), c, "*", "0", "0", s, q, *(field(*t) for t in tags)]) + "\n" for n, f, r, p, m, c, s, q, tags in RECORDS))
    made = written(tmp_path / "a.bam", [packed(*r) for r in RECORDS])
    want, got = alignments.read(spark, str(sam)), alignments.read(spark, made)
    assert got.columns == want.columns
    assert [r.asDict(True) for r in got.drop("cost").orderBy("record_index").collect()] == [r.asDict(True) for r in want.drop("cost").orderBy("record_index").collect()]  # a record's size is its format's


def test_files_are_numbered_in_order(spark, tmp_path):
    paths = [written(tmp_path / f"{k}.bam", [packed(f"{k}{i}", 0, "MT", 1, 9, "1M", "A", "I", []) for i in range(3)]) for k in "ba"]
    rows = bam.read_bam(spark, [*paths, written(tmp_path / "none.bam", [])]).orderBy("record_index").collect()
    assert [(r.record_index, r.id) for r in rows] == list(enumerate(["b0", "b1", "b2", "a0", "a1", "a2"]))


def test_refusals(spark, tmp_path):
    for name, content, code in (("c.cram", b"CRAM\3\0", "E1401"), ("t.bam", b"@HD\tVN", "E1102"), ("g.bam", gzip.compress(b"text"), "E1102")):
        (tmp_path / name).write_bytes(content)
        with pytest.raises(AnalysisError) as e:
            alignments.read(spark, str(tmp_path / name))
        assert e.value.code == code
    whole = packed("x", 0, "MT", 1, 9, "1M", "A", "I", [])
    for rows in ([whole[:-1]], [packed("x", 0, "MT", 1, 9, "2M", "A", "I", [])], [packed("x", 0, "MT", 1, 9, "1M", "A", "I", [("NM", "i", 1), ("NM", "i", 2)])]):
        with pytest.raises(Exception, match="E1103"):
            bam.read_bam(spark, written(tmp_path / "bad.bam", rows)).collect()
    with pytest.raises(Exception, match="E1601"):
        bam.read_bam(spark, written(tmp_path / "big.bam", [whole]), most_bases=1).collect()


def test_long_cigar_comes_from_its_tag():
    row = bam.record(packed("x", 0, "MT", 1, 9, "4S9N", "ACGT", "IIII", [("CG", "B", ("I", [2 << 4, 1 << 4 | 1, 1 << 4]))])[4:], NAMES)
    assert row[5] == "2M1I1M" and "CG" not in row[8]


def blocked(path, rows, cut):
    """A BAM in true BGZF blocks of up to `cut` bytes each, which records cross."""
    import zlib

    def block(data):
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(data) + deflate.flush()
        return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))

    data = bam.MAGIC + struct.pack("<i", 3) + b"@CO" + struct.pack("<i", len(NAMES)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 16569) for n in NAMES) + b"".join(rows)
    path.write_bytes(b"".join(block(data[i : i + cut]) for i in range(0, len(data), cut)) + block(b""))
    return str(path)


@pytest.mark.parametrize("cut,size", [(100, 300), (700, 900), (5000, 2000), (65000, 4000), (40, 1 << 20)])
def test_splits_hold_every_record_once(spark, tmp_path, cut, size):
    import random

    rng = random.Random(cut)
    rows = []
    for i in range(400):
        n = rng.choice([1, 5, 40, 300, 3000 if i % 50 == 0 else 20])
        bases = "".join(rng.choice("ACGT") for _ in range(n))
        rows.append((f"read{i}", rng.choice([0, 16]), "MT", 1 + rng.randrange(9000), 60, f"{n}M", bases, "I" * n, [("NM", "i", i), ("XF", "f", 0.1)]))
    path = blocked(tmp_path / "x.bam", [packed(*r) for r in rows], cut)
    whole = list(bam.records(path))
    parts = bam.splits(path, size)
    assert len(parts) > 1 or size >= 1 << 20
    got = [r for p, a, b in parts for r in (bam.records(p) if b < 0 else bam.split_records(p, a, b))]
    assert [r[3:] for r in got] == [r[3:] for r in whole] and len(got) == 400
    table = bam.read_bam(spark, path, split_bytes=size).orderBy("record_index").collect()
    assert [(r.record_index, r.id) for r in table] == [(i, f"read{i}") for i in range(400)]
    assert table[0].aux_tags["XF"] == "0.10000000149011612"


def test_the_supplementary_tag_is_text(spark, tmp_path):
    with pytest.raises(AnalysisError, match="E1103"):
        bam.record(packed("x", 0, "MT", 1, 9, "1M", "A", "I", [("SA", "i", 1)])[4:], NAMES)
