"""Rows that share an id, or have none: none is lost, and each is judged by what it holds."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from annulus.llm import langid, license_rules, minhash, poisson_mix, projection_forest, simhash


def _unit(seed, near=None):
    x = np.random.default_rng(seed).standard_normal(32)
    return [float(v) for v in (x if near is None else np.array(near) + 0.05 * x)]


@pytest.mark.parametrize("labels", [(0, 0, 0, 0, 0), (0, 1, 1, 0, 0)])
def test_vectors_that_share_a_vec_id(spark, labels):
    v, w = _unit(1), _unit(2)
    rows = list(zip((5, 5, 6, 7, 8), (v, w, _unit(3, v), _unit(4, w), _unit(5)), labels))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in projection_forest.near_duplicates(frame).collect())
    # v is near 6's vector and w near 7's, if their labels are equal
    six, seven = labels[0] == labels[2], labels[1] == labels[3]
    want = [(5, int(six), 5, True), (5, int(seven), 5, True), (6, int(six), 5 if six else 6, not six), (7, int(seven), 5 if seven else 7, not seven), (8, 0, 8, True)]
    assert got == Counter(want)


def test_languages_of_rows_that_share_a_doc_id(spark):
    words = {"en": "the of and to in is that", "de": "der die und den von zu das"}
    rows = [(7 if lang == "en" else i, f"{w} {w} {i}x{w}", lang) for lang, w in words.items() for i in range(1, 300)]
    rows += [(1, words["en"], "en")] * 300  # copies of one row
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for doc in (3, 4, 7, 12, 21):
        moved = frame.withColumn("doc_id", F.when(F.col("lang") == "en", F.lit(doc)).otherwise(F.col("doc_id")))
        model = langid.fit(moved, per_lang=50)
        held = moved.select(langid.held_out().alias("h")).where(moved.lang == "en").first().h
        assert model.names == (["de"] if held else ["de", "en"])


def test_draws_of_rows_without_a_doc_id(spark):
    rows = [(None if i < 1000 else 5, f"text {i}", "a" if i < 1000 else "b", 0) for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, _source int").withColumn("_cdf", F.lit(1)).withColumn("_point", F.lit(2))
    got = {r.source: r.n for r in poisson_mix.mix(frame, {"a": 0.5, "b": 0.5}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert all(850 < got[s] < 1150 for s in "ab")


def test_names_that_clash(spark):
    frame = spark.createDataFrame([(1, "MIT License")], "doc_id long, text string").withColumn("_line", F.lit(1)).withColumn("_raw", F.lit(2)).withColumn("_RAW2", F.lit(2))
    found = license_rules.scan(frame).first()
    assert found._line == 1 and found._raw == 2 and found.base[0].label == "mit"
    kept = simhash.one_of_each(frame.withColumn("_least", F.lit(3)).withColumn("row", F.lit(4)))
    assert kept.count() == 1 and kept.first().row == 4


def test_documents_that_share_a_doc_id_stay(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    frame = spark.createDataFrame([(1, a), (1, b), (2, a), (None, c), (None, c), (None, b)], "doc_id long, text string")
    assert Counter((r.doc_id, r.text) for r in minhash.one_of_each(frame).collect()) == Counter([(1, a), (1, b), (None, c)])
