"""The whole pipeline against a plain one: every stage spelt out over lists, and the packed ids of every copy."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import zstandard

from annulus.llm import compression_bands, poisson_mix, queries
from tests.llm.test_minhash import brute_groups
from tests.llm.test_operators import brute_quality, brute_runs

SPACES = re.compile("[\x20\x09-\x0d]*")


def kept(text):
    """The quality stage's verdict, from the limits alone."""
    raw, size = (text or "").encode(), min(len((text or "").encode()), compression_bands.CHUNK_BYTES)
    if brute_quality(text)[-1]:
        return False
    ratio = lambda x: len(x) / len(zstandard.ZstdCompressor(level=compression_bands.LEVEL).compress(x))
    band = lambda table, n: next((a, b) for most, a, b in table if n <= most)
    ends = sorted({*range(size, len(raw) + 1, size), len(raw)})
    low, high = band(compression_bands.BANDS, len(raw))
    least, most = band(compression_bands.CHUNK_BANDS, size)
    bad = sum(not least <= ratio(raw[e - size : e]) <= most for e in ends)
    return low <= ratio(raw) <= high and bad <= compression_bands.MAX_BAD_CHUNKS * len(ends)


def without_repeats(rows):
    """Rows (doc_id, text, source) without the lines of runs of 50 words that an earlier place has; what is left empty goes."""
    rows = sorted(rows, key=lambda r: r[0])
    gone = brute_runs([(d, i, t) for i, (d, t, _) in enumerate(rows)], 50)
    out = []
    for i, (d, t, source) in enumerate(rows):
        lines = t.split("\n")
        left = [x for k, x in enumerate(lines) if (i, k) not in gone]
        if len(left) == len(lines) or any(not SPACES.fullmatch(x) for x in left):
            out.append((d, "\n".join(left), source))
    return out


def one_of_each(rows):
    groups, out = brute_groups([(d, t) for d, t, _ in rows]), {}
    for row, g in zip(rows, groups):
        out[g] = min(out.get(g, row), row)
    return list(out.values())


def drawn(rows):
    """How often each row is drawn."""
    sizes = Counter()
    for _, t, source in rows:
        sizes[source] += len(t)
    total, weights = sum(sizes.values()), {s: n**poisson_mix.TEMPERATURE for s, n in sizes.items()}
    out = {}
    for d, t, source in rows:
        rate = weights[source] / sum(weights.values()) * total / sizes[source]
        name = f"{d}:{hashlib.md5(t.encode()).hexdigest()}"
        u = int(hashlib.md5(f"{poisson_mix.SEED}:{name}".encode()).hexdigest()[:13], 16) / 2**52
        k, p, c = 0, math.exp(-rate), math.exp(-rate)
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        out[d] = k
    return out


def test_the_whole_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    rng = random.Random(77)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(4000)]
    line = lambda n=30: " ".join(rng.choice(words) for _ in range(n))
    passage = "\n".join(line() for _ in range(3))
    rows = [(i, "\n".join(line() for _ in range(rng.randrange(4, 9))), rng.choice("aab")) for i in range(60)]
    rows += [(100 + i, "\n".join([line(), line(), passage, line(), line()]), "b") for i in range(8)]  # a passage in many
    rows += [(200 + i, rows[i][1], "a") for i in range(6)]  # exact copies
    for i in range(10):  # near copies, on one line so that no line repeats
        base = line(150).split()
        rows.append((300 + 2 * i, " ".join(base), "a"))
        base[rng.randrange(150)] = "edited"
        rows.append((301 + 2 * i, " ".join(base), "b"))
    rows += [(400, "spam and eggs " * 200, "a"), (401, None, "b"), (402, "", "a"), (403, "too short", None), (404, " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(9)) for _ in range(200)), "a")]
    frame = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")

    good = [r for r in rows if kept(r[1])]
    assert {r[0] for r in rows if r[0] < 400} == {r[0] for r in good}  # clean documents stay
    left = one_of_each(without_repeats(good))
    assert {301 + 2 * i for i in range(10)} & {r[0] for r in left} == set()
    copies = drawn(left)
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = {d: Counter({(k, x): copies[d] for k, x in enumerate([*tokenizer.encode(t, add_special_tokens=False).ids, 1])}) for d, t, _ in left if copies[d]}
    got = defaultdict(Counter)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id].update(enumerate(np.frombuffer(bytes(r.ids), "<u4").tolist(), r.start))
    assert got == want
