"""rounds see classes of molecules with equal observations, with their number."""

import random

from annulus.config import Config
from annulus.operators import architectures

STATES = ("ALTERNATE", "REFERENCE", "EVENT_ABSENT", "LOW_QUALITY")


def _observed(spark, rows):
    return spark.createDataFrame(rows, "molecule long, event string, state string")


def test_rounds_see_classes_alone(spark, monkeypatch):
    obs = _observed(spark, [(m, e, "ALTERNATE" if e == "AB"[m % 2] else "REFERENCE") for m in range(40) for e in "AB"])
    weights = spark.createDataFrame([("A", 1.0), ("B", 1.0)], "event string, weight double")
    plain, sizes = architectures.member_profiles, []
    monkeypatch.setattr(architectures, "member_profiles", lambda members, seen, config: sizes.append((members.count(), seen.count())) or plain(members, seen, config))
    molecules = spark.createDataFrame([(m,) for m in range(41)], "molecule long")  # one has no observations
    got = architectures.infer(molecules, obs, weights, Config())
    rows = {r.molecule: (r.status, r.architecture) for r in got.assignments.collect()}
    assert rows == {m: ("ASSIGNED", f"architecture:v1:1#{'AB'[m % 2]}") for m in range(40)} | {40: ("UNASSIGNED", None)}
    assert got.status == "CANDIDATES_INFERRED" and sizes and set(sizes) == {(2, 4)}
    found = {r.architecture: (r.members, r.fraction, r.defining) for r in got.architectures.collect()}
    assert found == {f"architecture:v1:1#{e}": (20, 20 / 41, [e]) for e in "AB"}


def test_profiles_of_classes_are_those_of_molecules(spark):
    rng = random.Random(17)
    obs = _observed(spark, [(m, e, rng.choice(STATES)) for m in range(120) for e in "AB" if rng.random() < 0.8])
    molecules = spark.createDataFrame([(m,) for m in range(120)], "molecule long")
    alike, few, seen = architectures.classes(molecules, obs)
    signed = architectures.signatures(molecules, obs)
    signed_few = architectures.signatures(few, seen).join(few, "molecule")
    profiles = lambda s, o: {tuple(r) for r in architectures.member_profiles(architectures.seeds(s, Config()), o, Config()).collect()}
    assert profiles(signed, obs) == profiles(signed_few, seen)
    assert alike.count() == 120 and few.count() < 30 and few.groupBy().sum("n").first()[0] == 120
