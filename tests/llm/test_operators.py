"""Each operator against a brute-force version, over awkward rows."""

import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from annulus.llm import (
    chunk_store,
    compression_bands,
    components,
    langid,
    length_histogram,
    license_rules,
    line_runs,
    packing,
    poisson_mix,
    projection_forest,
    queries,
    simhash,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, copy string"
LONG = " ".join(f"w{i % 977} x{i % 13}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
ODD = [
    (1, "The quick brown fox.\nA second line here\n\nThe quick brown fox.", "en", "a", 1, 7, "x"),
    (1, "The quick brown fox.\nA second line here\n\nThe quick brown fox.", "en", "a", 1, 7, "x"),  # a repeated row
    (2, None, "en", "a", None, None, None),
    (3, "", None, None, 0, 0, ""),
    (None, "no id  here \t tabs\r\nand lines ", "en", "b", 1, 1, "y"),
    (4, LONG, "en", "b", 1, 1, None),
    (5, LONG + " tail", "de", "b", 1, 1, None),
    (6, " \n\t \x0b\x0c", "en", "a", 1, 1, None),
    (7, "ÉCOLE Straße 日本 語 \U0001f600 <|endoftext|> a 's don't 12 34", "fr", None, 1, 1, None),
    (8, f"intro\n{PASSAGE}\noutro", "en", "a", 1, 1, None),
    (9, f"other\n{PASSAGE}\nmore {PASSAGE}", "en", "c", 1, 1, None),
    (10, f"{PASSAGE}", "en", "c", 1, 1, None),
    (11, "x" * 200_000, "en", "c", 1, 1, None),
    (12, "GNU General Public License v2. the Apache License, Version 2.0; CC-BY-SA 4.0 MIT license mit LICENSE", "en", "a", 1, 1, None),
    (-5, "12 34 ... 56", "en", "a", 1, 1, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_gives_the_librarys_ids(encode):
    from annulus.llm.tokens import Encoder

    rng = random.Random(1)
    pieces = ["a", "the", "don't", "'s", " ", "  ", "\n", "\t", "é", "日本", "12", "...", "　", "\x85", "\x1c", "<|endoftext|>", ",\nB"]
    pieces += ["<|endoftext", "|>", "X###", "=", "a1b2", "§", "ß!?", "'", "1.5", "\n\n", "--", "½", "²", "ª"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randrange(12))) for _ in range(6000)]
    texts += ["a <|endoftext|> b", "<|endoftext|>", " <|endoftext|><|endoftext|> ", "<|endoftext|>\n", "x" * 100_000 + "<|endoftext|>y z", "<|endoftext<|endoftext|>|>"]
    assert encode("a <|endoftext|> b") == [64, 220, 50256, 275]
    for text, ids in zip(texts, Encoder(queries.tokenizer_path()).encode(texts)):
        assert ids.tolist() == encode(text), repr(text)


def test_length_histogram(docs, none, encode):
    lengths = [len(encode(r[1])) for r in ODD]
    got = length_histogram.length_histogram(docs, queries.tokenizer_path())
    rows = {r.n_tokens: r for r in got.collect()}
    assert {k: r.n_docs for k, r in rows.items()} == Counter(lengths)
    for n, r in rows.items():
        assert r.docs_ge == sum(x >= n for x in lengths) and r.docs_le == sum(x <= n for x in lengths)
        assert r.tokens_ge == sum(x for x in lengths if x >= n) and r.total_tokens == sum(lengths)
        assert r.truncated_tokens == sum(min(x, n) for x in lengths) and r.total_docs == len(lengths)
    assert length_histogram.truncated_total(got, 10) == sum(min(x, 10) for x in lengths)
    assert length_histogram.length_quantile(got, 0.5) == sorted(lengths)[math.ceil(len(lengths) / 2) - 1]
    empty = length_histogram.length_histogram(none, queries.tokenizer_path())
    assert empty.count() == 0 and length_histogram.truncated_total(empty, 5) == 0 and length_histogram.length_quantile(empty, 0.5) is None


def test_chunk_store_round_trip(spark, docs, none, encode):
    path = chunk_store.store_path(spark)
    chunk_store.write_store(docs, path, queries.tokenizer_path())
    got = chunk_store.read_digests(spark, path)
    rows = sorted(got.collect(), key=lambda r: r.start)
    assert [r.doc_id is None for r in rows][0] and [r.doc_id for r in rows[1:]] == sorted(r.doc_id for r in rows[1:])
    want = Counter((r[0], len(encode(r[1])) + 1, crc([*encode(r[1]), 0])) for r in ODD)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    start = 0
    for r in rows:
        assert r.start == start and r.verified
        start += r.n_tokens
    # streams from chunks
    streams = defaultdict(list)
    for r in chunk_store.read_ids(spark, path, got).orderBy("row", "place").collect():
        streams[r.row] += np.frombuffer(bytes(r.ids), "<u2").tolist()
    assert {r.row: crc(streams[r.row]) for r in rows} == {r.row: r.ids_crc32 for r in rows}
    # the two long texts share most of their chunks
    chunks = chunk_store._chunks(spark, path)
    assert chunks.select("address").distinct().count() == chunks.count()
    assert chunks.agg(F.sum("n_ids")).first()[0] < 0.75 * sum(r.n_tokens for r in rows)
    empty = chunk_store.store_path(spark)
    chunk_store.write_store(none, empty, queries.tokenizer_path())
    assert chunk_store.read_digests(spark, empty).count() == 0


@pytest.mark.parametrize("damage", ["chunk", "size", "recipe", "length", "order", "lost chunk"])
def test_chunk_store_notices_damage(spark, docs, damage):
    path = chunk_store.store_path(spark)
    chunk_store.write_store(docs, path, queries.tokenizer_path())
    where = f"{path}/raw/recipe=false" if "chunk" in damage or damage == "size" else f"{path}/recipes"
    table = spark.read.parquet(where)
    rows = [r.asDict() for r in table.collect()]
    hit = max(range(len(rows)), key=lambda i: rows[i].get("n") or rows[i].get("n_tokens"))
    if damage == "chunk":
        rows[hit]["data"] = bytes(rows[hit]["data"][:-2]) + b"zz"
    elif damage == "size":
        rows[hit]["n"] -= 1
    elif damage == "lost chunk":
        del rows[hit]
    elif damage == "recipe":
        rows[hit]["chunks"] = bytes(rows[hit]["chunks"][24:])
    elif damage == "length":
        rows[hit]["n_tokens"] += 1
    elif damage == "order":
        rows = [r | {"place": -r["place"]} for r in rows]
    spark.createDataFrame(rows, table.schema).coalesce(1).write.mode("overwrite").parquet(where)
    got = chunk_store.read_digests(spark, path).collect()
    assert len(got) == len(ODD) and not all(r.verified for r in got)


def test_cut_points_follow_content():
    ids = np.random.default_rng(3).integers(0, 50_000, 20_000).astype("<u2")
    a, b = chunk_store.cut_points(ids), chunk_store.cut_points(np.concatenate([ids[:100], ids]))
    assert a[-1] == len(ids) and max(np.diff([0, *a])) <= chunk_store.MAX_IDS
    assert len({x + 100 for x in a} & set(b)) > 0.9 * len(a)
    assert chunk_store.cut_points(ids[:0]) == [] and chunk_store.cut_points(ids[:5]) == [5]


def brute_links(rows, threshold):
    sound = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ok = [r for r in rows if sound(r[1]) and r[2] is not None and r[0] is not None]
    links, parent = Counter(), {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[2] != b[2] or len(a[1]) != len(b[1]):
                continue
            x, y = np.array(a[1], np.float64), np.array(b[1], np.float64)
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[a[0]] += 1
                links[b[0]] += 1
                p, q = find(a[0]), find(b[0])
                parent[max(p, q)] = min(p, q)
    return {r[0]: (links[r[0]], find(r[0])) for r in rows}


@pytest.mark.parametrize("leaf,block", [(1024, 1024), (64, 50)])
def test_projection_forest(spark, leaf, block, monkeypatch):
    rng = np.random.default_rng(4)
    rows, base = [], rng.standard_normal((60, 64))
    for i in range(500):
        v = base[rng.integers(60)] + 0.25 * rng.standard_normal(64) if i % 2 else rng.standard_normal(64)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3)))
    knot = rng.standard_normal(64)
    rows += [(1000 + i, [float(np.float32(x)) for x in knot + 0.02 * rng.standard_normal(64)], 0) for i in range(150)]
    rows += [(2000 + i, rows[7][1], rows[7][2]) for i in range(20)]  # copies
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 64, 1), (3003, [float("nan")] + [1.0] * 63, 1), (3004, [None] + [1.0] * 63, 1)]
    rows += [(3005, rows[7][1], None), (3006, [1.0, 2.0], 1), (3007, [2.0, 4.0], 1), (3008, [float("inf")] * 64, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("clash")).withColumn("v", F.lit(1))
    monkeypatch.setattr(projection_forest.compared, "__defaults__", (projection_forest.THRESHOLD, block))
    got = {r.vec_id: (r.n_links, r.component_id) for r in projection_forest.near_duplicates(frame, leaf=leaf).collect()}
    want = brute_links(rows, 0.93)
    assert got.keys() == want.keys()
    total = sum(n for n, _ in want.values())
    assert sum(min(got[k][0], want[k][0]) for k in want) >= 0.99 * total
    assert all(got[k][0] <= want[k][0] for k in want)
    if leaf == 1024:
        assert got == want
    assert projection_forest.near_duplicates(frame.limit(0)).count() == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def test_compression_bands(docs, none):
    got = compression_bands.with_quality(docs.withColumnRenamed("copy", "kept")).collect()
    want = defaultdict(list)
    for r in ODD:
        want[r[0]].append(brute_quality(r[1]))
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) in want[r.doc_id], r.doc_id
        assert not (r.base_failed and r.kept)
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    prose = " ".join(rng.choice(words) for _ in range(300))
    noise = " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(9)) for _ in range(300))
    rows = docs.sparkSession.createDataFrame([(1, prose), (2, noise), (3, "spam and eggs " * 300), (4, "short one")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in compression_bands.with_quality(rows).collect()} == {1: True, 2: False, 3: False, 4: False}
    assert compression_bands.kept_documents(docs).columns == docs.columns
    assert compression_bands.with_quality(none).count() == 0


def test_langid(spark, none):
    words = {
        "en": "the of and to in is that for it with as was on be at by this".split(),
        "de": "der die und den von zu das mit sich des auf nicht ein ist im dem".split(),
        "fr": "le la les des et une est que dans qui pour pas sur plus par avec".split(),
        "es": "el los las y en que del se por con una para como más pero sus".split(),
    }
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(40)), lang) for i, lang in enumerate(sorted(words) * 60)]
    rows += [(1000, None, "en"), (1001, "12 34 !!", "en"), (1002, "the of and", None), (None, "der die und", "de"), (1003, "", "de")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in langid.identify(frame, per_lang=30).collect()}
    assert len(got) == len(rows)
    for doc, text, lang in rows:
        r = got[doc]
        assert r.held_out == (doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0) and 0 <= r.score <= 1
        if doc is not None and doc < 1000:
            assert r.lang_pred == lang
    assert {got[k].lang_pred for k in (1000, 1001, 1003)} == {"und"} and got[1002].lang_pred == "en" and got[None].lang_pred == "de"
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.identify(frame.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_families():
    a, b = np.eye(4)[:2], np.eye(4)[2:]
    centroids = np.array([a[0], a[0] + 0.2 * a[1], b[0], b[0] + 0.2 * b[1]])
    assert langid.families(centroids / np.linalg.norm(centroids, axis=1, keepdims=True)) == [[0, 1], [2, 3]]


def brute_license(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    base = []
    for phrase, label in license_rules.BASE:
        p = phrase.split()
        base += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    found = []
    line = " " + " ".join(words) + " "
    for k, r in enumerate(license_rules.RULES):
        for m in re.finditer(rf"(?<= )(?:{r.pattern})(?= )", line):
            first = line[: m.start()].count(" ") - 1
            found.append((first, -(first + m.group().count(" ") + 1), -r.priority, k))
    found.sort()
    left = [d for i, d in enumerate(found) if not any(e[1] <= d[1] and e[2] <= d[2] for e in found[:i])]
    labels = sorted({x[1] for x in base} | {license_rules.RULES[d[3]].label for d in left})
    starts = [x[0] for x in base]
    score = max((license_rules.RULES[d[3]].score for d in left), default=0.0)
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x[1] for x in base})), ",".join(labels), score)


def test_license_rules(spark, docs, none):
    assert len(license_rules.RULES) > 200
    rng = random.Random(6)
    parts = [p for p, _ in license_rules.BASE] + ["version 2.0", "v3", "or later", "CC BY-NC-SA 4.0", "licensed under the", "SPDX-License-Identifier: MIT", "SPDX-License-Identifier: Apache-2.0", "foo", "é", "public domain", "into the public domain", "GPL 3", "BSD 3-Clause License", "Mozilla Public License 2.0"]
    rows = [(i, rng.choice([" ", "-", ", ", "\n"]).join(rng.choice(parts) for _ in range(rng.randrange(15)))) for i in range(300)]
    rows += [(r[0], r[1]) for r in ODD] + [(900, "mit license " * 3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit(1))
    got = license_rules.digest(license_rules.scan(frame))
    key = lambda x: json.dumps(x, default=str)
    have = Counter(key([r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score]) for r in got.collect())
    assert have == Counter(key([a, *brute_license(t)]) for a, t in rows)
    assert license_rules.digest(license_rules.scan(none)).count() == 0


def brute_runs(rows, least):
    """Deleted (row, line) of rows (doc_id, row, text) by comparing all pairs of places."""
    places = []
    for doc, row, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        lines = [(i, x) for i, x in enumerate((text or "").split("\n")) if WORD.search(x)]
        places += [(row, lines, k) for k in range(len(lines))]
    by, deleted = defaultdict(list), set()
    for n, (row, lines, k) in enumerate(places):
        for m in by[lines[k][1]]:
            other, j = places[m][1], places[m][2]
            size = 0
            while k + size < len(lines) and j + size < len(other) and lines[k + size][1] == other[j + size][1]:
                size += 1
            if sum(len(WORD.findall(x)) for _, x in lines[k : k + size]) >= least:
                deleted |= {(row, i) for i, _ in lines[k : k + size]}
        by[lines[k][1]].append(n)
    return deleted


@pytest.mark.parametrize("least", [1, 5, 12])
def test_line_runs(spark, least):
    rng = random.Random(least)
    vocabulary = ["a b", "c", "d e f", "g h i j k l", "", "  ", "m\tn", "o p q r s t u v w x y z", "é ß"]
    texts = ["\n".join(rng.choice(vocabulary) for _ in range(rng.randrange(9))) for _ in range(60)] + [None, ""]
    rows = [(i // 2 if i % 7 else None, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("doc", F.lit(2))
    held = line_runs.keyed(frame)
    told = [(r.doc.doc_id, r.row, r.doc.text) for r in held.collect()]
    got = {(r.row, r.line) for r in line_runs.deleted_lines(held, least).collect()}
    assert got == brute_runs(told, least)
    done = line_runs.deduplicated(frame, least).collect()
    assert len(done) == len(rows) and line_runs.kept_documents(frame, least).columns == frame.columns
    assert sum(len(r.deleted) for r in done) == len(got)
    for r in done:
        assert not r.gone or not WORD.search(r.doc.text)
    assert line_runs.kept_documents(frame.limit(0), least).count() == 0


def test_line_runs_of_long_texts(spark):
    lines = [f"line {i} has some words" for i in range(5000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["first", *lines, "last"])), (3, "\n".join(lines[100:4000]))]
    got = {r.doc.doc_id: r for r in line_runs.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].doc.text == rows[0][1] and got[2].doc.text == "first\nlast" and got[3].gone


def test_poisson_mix(spark, docs, none):
    rows = [(i, "x" * 10, f"s{i % 10 // 5}{i % 10 % 2 if i % 10 < 5 else ''}") for i in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"s00": 0.5, "s01": 0.3, "s1": 0.2}
    got = poisson_mix.mix(frame, weights)
    shares = {r.source: r.n / len(rows) for r in got.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert all(abs(shares[k] - w) < 0.06 for k, w in weights.items())
    counts = poisson_mix.repetitions(frame, {"s00": 0.6, "s01": 0.4, "s1": 0})
    assert {r.n_copies for r in counts.where("source = 's1'").collect()} == {0}
    spread = Counter(r.n_copies for r in counts.where("source = 's00'").collect())
    rate, n = counts.where("source = 's00'").first().rate, sum(spread.values())
    for k in range(4):
        assert abs(spread[k] / n - math.exp(-rate) * rate**k / math.factorial(k)) < 0.05
    assert abs(poisson_mix.repetitions(frame, {"s1": 1.0}, budget=900).where("source = 's1'").agg(F.avg("n_copies")).first()[0] / 1800 - 1) < 0.02
    odd = poisson_mix.mix(docs)
    assert {r.n_copies for r in odd.where("doc_id = 1").collect()} <= {odd.where("doc_id = 1").count() // 2}
    assert poisson_mix.mix(none).count() == 0


def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64)) for r in got) == Counter((r[0], brute_fingerprint(r[1])) for r in ODD)
    zero = [r for r in got if r.fp == 0]
    assert {r.doc_id for r in zero} == {2, 3, 6} and {r.component_id for r in zero} == {2}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 1").count() == 1 and kept.where("doc_id is null").count() == 1


@pytest.mark.parametrize("most", [0, 4, 10_000])
def test_fingerprint_links(spark, most):
    rng = random.Random(9)
    seeds, found = [rng.getrandbits(64) for _ in range(30)], set()
    for s in seeds:
        for _ in range(rng.choice([1, 2, 40])):
            x = s
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            found.add(x)
    found = sorted(found)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(x),) for x in found], "fp long")
    got = {r.node: r.component for r in components.components(simhash.linked(frame, most), "a", "b").collect()}
    parent = {x: x for x in found}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(found):
        for b in found[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    groups, have = defaultdict(set), defaultdict(set)
    for x in found:
        groups[find(x)].add(signed(x))
        have[got.get(signed(x), signed(x))].add(signed(x))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, have.values()))
    for edge in simhash.linked(frame, most).collect():
        assert ((edge.a ^ edge.b) & (1 << 64) - 1).bit_count() <= 2


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(100)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    assert got == {x: find(x) for x in list(parent)}
    assert components.components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_packing(docs, none, encode):
    rows = packing.pack(docs, queries.tokenizer_path()).collect()
    streams = Counter((r[0], tuple([*encode(r[1]), 1])) for r in ODD)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length and crc(ids) == r.ids_crc32
        pieces[r.doc_id].append((r.start, r.doc_tokens, ids))
        sequences[r.sequence_id].append(r)
    for doc, parts in pieces.items():
        want = [s for (d, s), n in streams.items() if d == doc for _ in range(n)]
        assert sum(len(p[2]) for p in parts) == sum(map(len, want))
        if len(want) > 1:  # rows that share a doc_id: their pieces make up their streams
            left = Counter(want)
            found = Counter()
            for start, n, ids in parts:
                found[n, start, start + len(ids)] += 1
                assert any(tuple(ids) == s[start : start + len(ids)] and n == len(s) for s in left)
            for s, n in left.items():
                spans = sorted((a, b) for (size, a, b), k in found.items() if size == len(s) for _ in range(k))
                assert sum(b - a for a, b in spans) == len(s) * sum(k for t, k in left.items() if len(t) == len(s))
        if len(want) == 1:
            parts.sort(key=lambda p: p[0])
            assert tuple(x for p in parts for x in p[2]) == want[0] and {p[1] for p in parts} == {len(want[0])}
            assert [p[0] for p in parts] == [sum(len(q[2]) for q in parts[:k]) for k in range(len(parts))]
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
        total = sum(r.length for r in parts)
        assert total == parts[0].tier <= 2048 and total & (total - 1) == 0
    steps = defaultdict(set)
    for r in rows:
        steps[r.step_id].add((r.sequence_id, r.tier))
    assert all(len({t for _, t in s}) == 1 and sum(t for _, t in s) <= packing.STEP_TOKENS for s in steps.values())
    sizes = defaultdict(list)
    for s in steps.values():
        sizes[next(iter(s))[1]].append(len(s))
    for tier, held in sizes.items():  # as few steps as hold the windows of all partitions, as even as can be
        assert len(held) == -(-sum(held) // (packing.STEP_TOKENS // tier)) and max(held) - min(held) <= 1
    assert packing.pack(none, queries.tokenizer_path()).count() == 0


def test_pipeline(spark, tmp_path, docs, none):
    import corpus_pipeline

    rng = random.Random(12)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    prose = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(30)) for _ in range(n))
    good = [(100 + i, prose(6), "en", "a" if i % 3 else "b", 1) for i in range(40)]
    copies = [(500 + i, good[i][1], "en", "a", 1) for i in range(5)]
    junk = [(600, "spam and eggs " * 200, "en", "a", 1), (601, None, "en", "b", 1), (602, "", None, None, None)]
    frame = spark.createDataFrame(good + copies + junk, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    kept = frame
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == frame.columns
        seen.append({r.doc_id for r in kept.select("doc_id").collect()})
    assert seen[0] == {r[0] for r in good + copies} and seen[1] == seen[2] == {r[0] for r in good}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == seen[3] and seen[3] <= seen[2]
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        con.sql(f"create view {table} as select * from '{sf}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b) and all((a[c] == b[c]).all() for c in columns)


def test_poisson_curves_and_their_search(spark):
    rates = spark.createDataFrame([("a", 0.3), ("b", 7.5), (None, 40.0), ("z", 0.0), ("big", 2500.0)], "source string, rate double")
    for r in poisson_mix.curves(rates).collect():
        p, c, want = -r.rate, 0.0, []
        for k in range(len(r.curve)):
            p += math.log(r.rate / k) if k else 0.0
            c += math.exp(p)
            want.append(c)
        assert r.curve == pytest.approx(want, abs=1e-9) and r.curve[-1] > 1 - 1e-9
    points = spark.createDataFrame([(x, [0.1, 0.4, 0.4, 0.9]) for x in (0.0, 0.1, 0.3, 0.4, 0.5, 0.95)] + [(0.5, [1.0]), (1.0, [1.0])], "x double, curve array<double>")
    for r in points.select("x", "curve", poisson_mix._above("curve", F.col("x")).alias("n")).collect():
        assert r.n == sum(c <= r.x for c in r.curve)
    frame = spark.createDataFrame([(i, "x" * 10, f"s{i % 2}") for i in range(2000)], "doc_id long, text string, source string")
    table = spark.createDataFrame([("s0", 3), ("s1", 1)], "source string, weight int")
    as_table, as_dict = (sorted((r.doc_id, r.n_copies) for r in poisson_mix.repetitions(frame, w).collect()) for w in (table, {"s0": 3, "s1": 1}))
    assert as_table == as_dict and abs(sum(n for i, n in as_table if i % 2 == 0) / 1500 - 1) < 0.1
