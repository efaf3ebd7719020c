"""the index over positional bytes proposes pairs in the near dedup, and the shingle sets decide."""

from pyspark.sql import functions as F

from annulus.llm import minhash, simhash, workspace

LONG = " ".join(f"w{i * i % 97}x{i}" for i in range(2000))


def test_the_index_proposes_what_no_band_does(spark):
    """Rows without a common band value: only the index is left."""
    docs = [(0, LONG), (1, LONG + " more"), (2, " ".join(f"other{i}" for i in range(900))), (3, None), (4, LONG)]
    keyed = workspace.keyed(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = minhash.signatures(keyed).withColumn("bands", F.array(F.col("node")))
    sets = {r.doc_id: r for r in rows.collect()}
    assert bin((sets[0].fp ^ sets[1].fp) & (1 << 64) - 1).count("1") <= simhash.MAX_BITS and sets[0].node != sets[1].node
    edges = minhash.linked(keyed, workspace.written(rows, "signatures")).collect()
    assert {frozenset((e.a, e.b)) for e in edges} == {frozenset((sets[0].node, sets[1].node))}


def test_sets_decide_on_what_the_index_proposes(spark):
    """Equal fingerprints of unlike sets are proposed, if the sizes allow it, and not linked."""
    nodes = spark.createDataFrame([(1, 10, 7), (2, 10, 7), (3, 10, 6), (4, 2, 7), (5, 10, -1)], "node long, size int, fp long")
    assert {frozenset((p.a, p.b)) for p in minhash.proposed(nodes).collect()} == {frozenset(x) for x in ((1, 2), (1, 3))}
    docs = spark.createDataFrame([(0, "a b c d e f g h i j"), (1, "q r s t u v w x y z")], "doc_id long, text string")
    keyed = workspace.keyed(docs)
    rows = minhash.signatures(keyed).withColumn("bands", F.array(F.col("node"))).withColumn("fp", F.lit(5).cast("long"))
    assert minhash.linked(keyed, workspace.written(rows, "signatures")).count() == 0
