"""Operator 12 against plain loops: every order applied to every document."""

import random
import re
from itertools import permutations

import pytest

from annulus.llm import filter_audit

DOCS = "doc_id long, text string, lang string, n int, Mask string"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, *_ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    parts, out = {}, {}
    for d, t, lang, *_ in docs:
        t = t or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": d is not None and least[t] < d,
        }
        parts.setdefault(lang or "", []).append((fails, d in good, d in toxic))
    for part, rows in parts.items():
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            alive = list(rows)
            for step, f in enumerate(order, 1):
                gone = [r for r in alive if r[0][f]]
                alive = [r for r in alive if not r[0][f]]
                failing = [r for r in rows if r[0][f]]
                total[f] += len(gone)
                out[part, order, step] = [len(alive), len(gone), len(failing) - len(gone), sum(sum(r[0].values()) == 1 for r in failing), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def run(spark, docs, labels, n=4):
    a = spark.createDataFrame([(d, t, x, 1, "own") for d, t, x in docs], DOCS).repartition(n)
    rows = filter_audit.audit(a, spark.createDataFrame(labels, LABELS)).collect()
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in rows}
    assert len(got) == len(rows)
    return got


def corpus(n, seed):
    rng = random.Random(seed)
    bases = [" ".join(rng.choice(("Word", "x", "y", f"w{k}", f"v{k}")) for k in range(rng.choice((5, 199, 200, 260)))) + rng.choice(("", "", " #", " É|")) for _ in range(12)]
    docs = [(rng.randrange(-n, n), rng.choice(bases + [bases[0]] * 8 + ["", None, " \t\n", "A\x0bB\x0c"]), rng.choice(("en", "de", None, ""))) for _ in range(n)]
    docs += [(None, bases[0], "en"), (None, bases[0], "en"), docs[0], docs[0]]
    labels = [(d, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for d, *_ in docs if rng.random() < 0.7] + [(10**9, 1, 1), (None, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    docs, labels = corpus(300, seed)
    assert run(spark, docs, labels) == brute(docs, labels)


def test_runs_over_many_tasks(spark):
    """One text in most rows, so that its run goes over all tasks' edges; and a task of one row each."""
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        docs = [(k // 2, "the same text", "en") for k in range(60)] + [(k, f"text {k}", "fr") for k in range(10)]
        assert run(spark, docs, []) == brute(docs, [])
        docs = [(7, "the same text", "en") for k in range(60)] + [(3, "the same text", "fr"), (None, "the same text", "fr")]
        assert run(spark, docs, [(7, 1, 1)]) == brute(docs, [(7, 1, 1)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_texts_that_share_a_fingerprint(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "xxhash64", lambda text: F.length(text).cast("long") % 3)
    docs, labels = corpus(200, 9)
    assert run(spark, docs, labels) == brute(docs, labels)


def test_long_text_and_empty_table(spark):
    docs = [(1, "Long Words " * 60_000, "en"), (2, "Long Words " * 60_000, "en"), (3, "x" * 400_000, None)]
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], []) == {}
