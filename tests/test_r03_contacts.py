"""Residues with the same atoms are compared once."""

from __future__ import annotations

from annulus.operators import reports


def test_equal_residues_are_one_shape(spark, monkeypatch):
    kept, plain = {}, reports.written
    monkeypatch.setattr(reports, "written", lambda df, name, **k: kept.setdefault(name, plain(df, name, **k)))
    atoms = spark.createDataFrame([(i, float(i % 2) * 3, 0.0, 0.0) for i in range(6)] + [(9, 50.0, 0.0, 0.0)], "residue long, x double, y double, z double")
    got = {tuple(r) for r in reports.contacts(atoms, atoms, 10.0).collect()}
    assert got == {(i, j, abs(i % 2 - j % 2) * 3.0) for i in range(6) for j in range(6) if i != j}
    assert kept["near"].count() == 5
