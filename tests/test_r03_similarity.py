"""Sets that share one frequent token form one cluster without a row for each pair of them."""

from annulus.operators import similarity


def test_many_sets_with_one_frequent_token_are_one_class(spark):
    rows = spark.range(30_000).selectExpr("id as k", "explode(array('same', 'own ' || id)) as t")  # 450 million pairs at 2/3
    found = similarity.density_clusters(similarity.profiles(rows, "k", "t"), 0.72, 2)
    assert [(r.cluster, r["count"]) for r in found.groupBy("cluster").count().collect()] == [(0, 30_000)]


def test_sets_without_a_shared_token_stay(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, None)], "k long, t string")
    sets = similarity.profiles(rows, "k", "t")
    assert {(r.profile, r.cluster) for r in similarity.density_clusters(sets, 0.72).collect()} == {(1, 0), (2, 1)}
    assert similarity.similar_pairs(sets, 1.0).count() == 0
