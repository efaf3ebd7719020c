"""Operator 13 against the sentencepiece library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from annulus.llm import queries, sentencepiece_bpe

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, ids string, Decoded int"
BITS = ["a", "the", " ", "  ", "   ", "\n", "\t", "é", "日本", "12", "...", "▁", "<s>", "</s>", "<unk>", "<0x0A>", "①", "\x00", "😀", "́", "Straße", "ing", "tion", "\r\n", "    x", "⁇", "�"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def ids_of(raw):
    return np.frombuffer(raw, sentencepiece_bpe.DTYPE).tolist()


def test_agenda_gives_the_librarys_ids_and_texts(library):
    bpe = sentencepiece_bpe.Codec(PATH)
    for t in [*texts(1, 6000), "x" * 5000, " " * 999, "ab " * 3000, "", " ", "▁", "\n"]:
        (raw,) = bpe.encode([t])
        ids, (decoded,) = ids_of(raw), bpe.decode_own([raw]).to_pylist()
        assert ids == library.encode(t), t
        assert decoded == library.decode(ids) == bpe.decode(ids), t


def test_decode_of_any_ids(library):
    bpe, rng = sentencepiece_bpe.Codec(PATH), random.Random(2)
    for _ in range(4000):
        ids = [rng.choice((rng.randrange(3), rng.randrange(3, 259), 28705, 264, rng.randrange(32000))) for _ in range(rng.randrange(0, 12))]
        assert bpe.decode(ids) == library.decode(ids), ids


def test_rows(spark, library):
    odd = [(1, None), (1, None), (2, ""), (None, "a  b"), (3, "x" * 200_000), (3, "word " * 50_000), (4, " lead\n\n trail ")]
    docs = spark.createDataFrame([(i, t, "own", 7) for i, t in odd] + [(k + 10, t, None, None) for k, t in enumerate(texts(3, 300))], SCHEMA)
    rows = sentencepiece_bpe.encode(docs.repartition(3), PATH, verify=True).collect()
    assert len(rows) == 307 and all(r.verified for r in rows)
    assert sorted(rows[0].asDict()) == ["decoded", "doc_id", "ids", "text", "verified"]
    for r in rows:
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)
    back = sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs, PATH).select("doc_id", "ids", F.col("decoded").alias("was")), PATH)
    assert back.where("decoded <> was").count() == 0
    assert sentencepiece_bpe.encode(docs.limit(0), PATH).count() == 0


def test_query_digests(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {}
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), True)
    got = queries.op13_sentencepiece_agenda(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.verified) for r in got} == want


def test_a_difference_is_seen(library):
    bpe = sentencepiece_bpe.Codec(PATH)
    raws = bpe.encode(["a b", "d", "x y", ""])
    assert bpe.decode_own(raws).to_pylist() == ["a b", "d", "x y", ""] and bpe.decode_own([]).to_pylist() == []
    assert bpe.agrees(["a b", "c", "x y", ""], raws, ["a b", "d", "x y!", ""]) == [True, False, False, True]


def test_pieces_decide_where_texts_are_cut():
    assert sentencepiece_bpe._segments(["▁a", "ab", "..", "▁▁"]) != sentencepiece_bpe._segments(["▁a", "a.", "▁▁"])
    assert sentencepiece_bpe._segments(["a▁b"]) == sentencepiece_bpe._segments(["a\n"]) == "(?s:.+)"


def test_small_tables_of_segments_change_nothing(library, monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "CACHE_SEGMENTS", 5)
    bpe = sentencepiece_bpe.Codec(PATH)
    for t in texts(4, 300):
        assert ids_of(bpe.encode([t])[0]) == library.encode(t)
        assert len(bpe.segments) < 100 and len(bpe.old) < 100


def test_agendas_together_are_agendas_one_by_one():
    bpe, rng = sentencepiece_bpe.Codec(PATH), random.Random(6)
    rows = ["".join(rng.choice("▁▁aetinrslo.,é日①\x00ß") for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    assert [ids_of(x) for x in bpe.merged_together(rows)] == [bpe.merged(x) for x in rows]
