"""Operator 11 against plain loops over Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from annulus.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, Entry int"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, v, x) for i, v, x in rows if v and all(c is not None and math.isfinite(c) for c in v) and len(v) % parts == 0]
    seeds = sorted(((i, [math.floor(4096 * float(np.float32(c))) for c in v]) for i, v, _ in kept if i is not None))
    seeds = [x for x in seeds if len(x[1]) == len(seeds[0][1])][:entries]
    kept = [(i, [math.floor(4096 * float(np.float32(c))) for c in v], x) for i, v, x in kept if len(v) == len(seeds[0][1])]
    w = len(seeds[0][1]) // parts
    cut = lambda q: [q[p * w : (p + 1) * w] for p in range(parts)]
    books = [[cut(q)[p] for _, q in seeds] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        groups = {}
        for _, q, _ in kept:
            for p, x in enumerate(cut(q)):
                groups.setdefault((p, near(p, x)[1]), []).append(x)
        for (p, k), xs in groups.items():
            books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    out, by_label = [], {}
    for i, q, label in kept:
        found = [near(p, x) for p, x in enumerate(cut(q))]
        error = sum(d for d, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[x], sha) for i, c, e, x in out), key=str)


def vectors(n, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(5)]
    return [(rng.randrange(10 * n), [round(c + rng.gauss(0, 0.2), 3) for c in rng.choice(centres)], rng.choice((None, 1, 1, 2))) for _ in range(n)]


def run(spark, rows):
    df = spark.createDataFrame([(i, v, x, "own", 3) for i, v, x in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in vector_codes.compress(df).collect()), key=str)


def test_against_brute_force(spark):
    rows = vectors(150)
    rows += [rows[0], rows[0], (rows[0][0], rows[1][1], 2)]  # repeated rows and a shared vec_id
    rows += [(None, [0.5] * 16, None), (-3, None, 1), (-2, [1.0, None] * 8, 1), (-1, [math.nan] * 16, 1), (-4, [math.inf] * 16, 1), (-5, [], 1), (-6, [1.0] * 7, 1), (1 << 40, [1.0] * 24, 1)]
    rows += [(5000 + k, [100.0 * k, *[-0.0001] * 15], 7) for k in range(4)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", (1, 5, 16))
def test_few_rows_and_ties(spark, n):
    rows = [(k, [float(k % 3)] * 16, 1) for k in range(n)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(None, [1.0] * 8, 1)]) == [] and run(spark, [(1, None, 1)]) == []


def test_a_component_too_large_is_named(spark):
    with pytest.raises(Exception, match="too large.*vec_id 77"):
        run(spark, [(77, [1e30] * 16, 1)])


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(1)
    entries, queries = rng.integers(-4000, 4000, (16, 8)), rng.integers(-6000, 6000, (500, 8))
    cells = vector_codes.Cells(entries)
    lower, upper = cells.bounds(queries)
    exact = ((queries[:, None] - entries) ** 2).sum(axis=2)
    assert (lower <= exact).all() and (exact <= upper).all()
    best, error = cells.nearest(queries)
    assert (best == exact.argmin(axis=1)).all() and (error == exact.min(axis=1)).all()
    assert (lower <= upper.min(axis=1)[:, None]).mean() < 0.6  # most entries need no distance
