"""Supported signatures are all there, whatever the limit of candidates is."""

from __future__ import annotations

from annulus.config import Config
from annulus.operators import architectures


def test_signatures_beyond_the_limit_of_candidates(spark):
    rows = spark.createDataFrame([(2 * i + k, [f"e{i}"]) for i in range(5) for k in (0, 1)] + [(99, ["x"])], "molecule long, signature array<string>")
    got = {(tuple(r.signature), r.n) for r in architectures.supported(rows, Config(max_candidate_architectures=1)).collect()}
    assert got == {((f"e{i}",), 2) for i in range(5)}
