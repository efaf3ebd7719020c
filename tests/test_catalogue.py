"""Every registered query against its SQL, and the same query on one core."""

import duckdb
import pytest

from annulus.operators import similarity
from annulus.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, con, name):
    want, got = con.sql(catalogue.oracle_sql()[name]).df(), catalogue.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_flagship(spark):
    assert catalogue.flagship(spark, SF).count() > 0


@pytest.mark.parametrize("least", [1, 3])
@pytest.mark.parametrize("epsilon", [0.2, 0.5, 0.72])
def test_density_clusters_against_brute_force(spark, epsilon, least):
    import random

    rng = random.Random(round(epsilon * 100) + least)
    sets = {i: frozenset(rng.sample(range(12), rng.randrange(1, 6))) for i in range(40)}
    rows = [(k, t) for k, s in sets.items() for t in s]
    found = similarity.profiles(spark.createDataFrame(rows, "k long, t long"), "k", "t")
    names = {}
    for k, s in sorted(sets.items()):
        names.setdefault(s, []).append(k)
    nodes = {v[0]: (s, len(v)) for s, v in names.items()}
    near = {a: [b for b in nodes if 1 - len(nodes[a][0] & nodes[b][0]) / len(nodes[a][0] | nodes[b][0]) <= epsilon + 1e-12] for a in nodes}
    pairs = {(r.a, r.b) for r in similarity.similar_pairs(found, epsilon).collect()}
    assert pairs == {(a, b) for a in nodes for b in near[a] if a < b}
    core = {a for a in nodes if sum(nodes[b][1] for b in near[a]) >= least}
    label = {}
    for a in sorted(core):
        if a not in label:
            number, todo = len(set(label.values())), [a]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = number
                    todo += [b for b in near[x] if b in core]
    want = {a: label.get(a, min((label[b] for b in near[a] if b in core), default=-1)) for a in nodes}
    assert {r.profile: r.cluster for r in similarity.density_clusters(found, epsilon, least).collect()} == want
