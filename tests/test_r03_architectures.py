"""Molecules with equal observations are scored once, with every molecule's result."""

from __future__ import annotations

from annulus.config import Config
from annulus.operators import architectures


def test_equal_patterns_are_scored_once(spark, monkeypatch):
    seen = [(m, e, "ALTERNATE" if e == "AB"[m % 2] else "REFERENCE") for m in range(12) for e in "AB"]
    obs = spark.createDataFrame(seen, "molecule long, event string, state string")
    weights = spark.createDataFrame([("A", 2.0), ("B", 1.0)], "event string, weight double")
    signed = architectures.signatures(obs.select("molecule").distinct(), obs)
    members = architectures.seeds(signed, Config())
    inputs = (signed, obs, members.select("architecture", "signature").distinct(), architectures.member_profiles(members, obs, Config()), weights)
    plain, scored = architectures.scores, []
    want = {tuple(r) for r in plain(*inputs).select("molecule", "architecture", "distance", "overlap", "score").collect()}

    def spy(few, *others):
        scored.append(few.count())
        return plain(few, *others)

    monkeypatch.setattr(architectures, "scores", spy)
    got = {tuple(r) for r in architectures.pattern_scores(*inputs).select("molecule", "architecture", "distance", "overlap", "score").collect()}
    assert got == want and len(want) == 24 and scored == [2]
