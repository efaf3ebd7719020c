"""Chunks of the quality rules: all bytes are judged, and junk in a part of a text is found."""

import random

import zstandard

from annulus.llm import compression_bands


def test_every_byte_is_in_a_chunk():
    for n in (0, 1, 300, 1023, 1024, 1025, 2048, 5000):
        raw = bytes(random.Random(n).randrange(256) for _ in range(n))
        chunks = compression_bands._chunks(raw)
        assert len(chunks) == -(-n // 1024) and all(len(x) == min(n, 1024) for x in chunks)
        assert b"".join(chunks[:-1]) == raw[: 1024 * (len(chunks) - 1)] and (not n or raw.endswith(chunks[-1]))


def test_junk_in_a_short_texts_tail_is_rejected():
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    prose = " ".join(rng.choice(words) for _ in range(330))
    table = "\n".join(f"{i} | {rng.randrange(90)} | {rng.randrange(90)} | yes | no | # {i}" for i in range(30))
    compressor = zstandard.ZstdCompressor(level=compression_bands.LEVEL)
    good, bad = compression_bands.measure(prose, compressor), compression_bands.measure(prose + "\n" + table, compressor)
    low, high = next((a, b) for most, a, b in compression_bands.BANDS if len(prose + table) + 1 <= most)
    assert good[-1] and not bad[-2] and low <= bad[5] <= high  # neither the base rules nor the whole text tell
    assert not bad[-1] and bad[7] > 0


def test_whole_texts_between_noise_and_prose_are_rejected(monkeypatch):
    """Prose with a part of noise, at a ratio above the old lower limit for its length (1.45)."""
    monkeypatch.setattr(compression_bands, "MAX_BAD_CHUNKS", 1.0)  # the whole-text limits alone
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    noise = " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(9)) for _ in range(90))
    got = compression_bands.measure(" ".join(rng.choice(words) for _ in range(400)) + " " + noise, zstandard.ZstdCompressor(level=3))
    assert 1.45 < got[5] < 1.82 and not got[-2] and not got[-1]


def test_verdicts_are_those_of_the_limits_spelt_out(spark):
    """Every verdict against a version of its own: ratios of whole texts and of 1 KB chunks, the last one ending with the text."""
    import random
    import re

    import zstandard

    rng = random.Random(31)
    words = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randrange(1, 10))) for _ in range(600)]
    texts = [None, "", "a b"]
    for n in (49, 50, 60, 120, 300, 800, 2500):
        texts += [" ".join(rng.choice(words) for _ in range(n)) for _ in range(6)]
        texts += [" ".join(rng.choice(words[:40]) for _ in range(n)), "\n".join(["one two three four five"] * (n // 5 + 1))]
        texts += [" ".join("".join(chr(rng.randrange(33, 127)) for _ in range(7)) for _ in range(n)), "é " * n]
    prose, noise = (" ".join(x) for x in ([rng.choice(words) for _ in range(2000)], ["".join(chr(rng.randrange(33, 127)) for _ in range(9)) for _ in range(300)]))
    texts += [prose + noise, noise + prose, prose[:5000] + noise + prose[5000:]]
    pack = lambda raw: len(raw) / len(zstandard.ZstdCompressor(level=compression_bands.LEVEL).compress(raw))
    band = lambda table, size: next((a, b) for most, a, b in table if size <= most)

    def verdict(text):
        raw = (text or "").encode()
        tokens = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(tokens[i : i + 3]) for i in range(len(tokens) - 2)]
        repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(set(windows)) < len(windows) else set()
        if len(tokens) < 50 or 2 * len(repeated) > len(tokens):
            return False
        low, high = band(compression_bands.BANDS, len(raw))
        size = min(len(raw), 1024)
        ends = sorted({*range(size, len(raw) + 1, size), len(raw)})
        least, most = band(compression_bands.CHUNK_BANDS, size)
        bad = sum(not least <= pack(raw[e - size : e]) <= most for e in ends)
        return low <= pack(raw) <= high and bad <= compression_bands.MAX_BAD_CHUNKS * len(ends)

    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.kept for r in compression_bands.with_quality(frame).collect()}
    assert got == {i: verdict(t) for i, t in enumerate(texts)} and set(got.values()) == {True, False}
