"""The near dedup by shingle sets against all pairs."""

import random
import re
from collections import Counter, defaultdict

import pytest

from annulus.llm import components, minhash, workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_groups(rows):
    """A number for each row: equal for rows that pairs of a Jaccard similarity of 0.8 connect."""
    sets, parent = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def brute_components(rows):
    """The smallest doc_id reachable, for each row."""
    groups, least = brute_groups(rows), {}
    for (doc, _), g in zip(rows, groups):
        if doc is not None:
            least[g] = min(doc, least.get(g, doc))
    return [least.get(g) for g in groups]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(1 << 30)}"
    return words


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    prose = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    texts = [" ".join(prose(120)) for _ in range(40)]
    for n in range(13):  # pairs from equal to far apart
        base = prose(200)
        texts += [" ".join(base), "\n".join(edited(rng, base, n)).upper()]
    chain = prose(300)  # each step is near, the ends are not
    for _ in range(6):
        texts.append(" ".join(chain))
        chain = edited(rng, chain, 5)
    hub = prose(250)  # a large group of near copies
    texts += [" ".join(edited(rng, hub, rng.randrange(4))) for _ in range(150)]
    texts += ["a b c", "A  b\tc", "a b c d e f", "", None, " \n "]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(None if i % 31 == 7 else order[i], t) for i, t in enumerate(texts)] + [(order[0], texts[0]), (order[1], texts[2])]


def test_groups_are_those_of_all_pairs(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r.doc_id, r.component_id) for r in minhash.near_duplicates(frame).collect())
    assert got == Counter((doc, c) for (doc, _), c in zip(rows, brute_components(rows)))
    kept = minhash.one_of_each(frame)
    assert kept.columns == frame.columns
    groups = defaultdict(list)
    for (doc, _), g in zip(rows, brute_groups(rows)):
        groups[g].append(doc)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(min((d for d in docs if d is not None), default=None) for docs in groups.values())
    assert minhash.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("most,block_nodes", [(0, 7), (24, 2048)])
def test_members_of_a_long_list_are_compared_with_each_other(spark, most, block_nodes):
    """Families around a common text: members of one are near, those of different ones and the common text are not."""
    rng = random.Random(23)
    common, rows = [f"w{rng.randrange(4000)}" for _ in range(300)], []
    for _ in range(8):
        family = edited(rng, common, 9)
        rows += [(len(rows) + i, " ".join(edited(rng, family, 3))) for i in range(9)]
    frame = workspace.keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    table = workspace.written(minhash.signatures(frame), "signatures")
    edges = minhash.linked(frame, table, most=most, block_nodes=block_nodes)
    found = {r.node: r.component for r in components.components(edges, "a", "b").collect()}
    node = {r.doc_id: r.node for r in table.collect()}
    got, want = {}, {}
    for (doc, _), c in zip(rows, brute_components(rows)):
        got.setdefault(found.get(node[doc], node[doc]), set()).add(doc)
        want.setdefault(c, set()).add(doc)
    assert len(want) > 1 and sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_the_pipelines_stage_removes_edited_copies(spark):
    import corpus_pipeline

    rng = random.Random(22)
    base = [[f"w{rng.randrange(4000)}" for _ in range(200)] for _ in range(10)]
    near = [edited(rng, x, 3) for x in base]
    far = [edited(rng, x, 60) for x in base]
    rows = [(k * 100 + i, " ".join(x)) for k, part in enumerate((base, near, far)) for i, x in enumerate(part)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()}
    assert got == {i for i, _ in rows if not 100 <= i < 200}
