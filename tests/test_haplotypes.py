"""Haplotype deconvolution against a plain version, and on made mixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from annulus.operators import haplotypes


def patterns_of(spark, x):
    rows = [(m, [(s, bool(v)) for s, v in enumerate(r) if not np.isnan(v)]) for m, r in enumerate(x)]
    seen = spark.createDataFrame(rows, "molecule long, seen array<struct<site:int,alternate:boolean>>")
    return seen, seen.where(F.size("seen") > 0).groupBy("seen").agg(F.count("*").alias("n"))


def plain_em(x, weights, rates, error, rounds):
    """The same rounds over a matrix of molecules and sites."""
    seen, ones, likelihood = ~np.isnan(x), np.nan_to_num(x), 0.0
    for _ in range(rounds):
        logs = np.log(np.maximum(weights, 1e-12)) + ones @ np.log(rates).T + (seen & (ones == 0)) @ np.log1p(-rates).T
        top = logs.max(axis=1, keepdims=True)
        p = np.exp(logs - top)
        total = p.sum(axis=1, keepdims=True)
        p, now = p / total, float((top + np.log(total)).sum())
        weights, covered = p.mean(axis=0), p.T @ seen
        rates = np.where(covered > 0, np.clip((p.T @ ones) / np.where(covered > 0, covered, 1), error, 1 - error), rates)
        done, likelihood = abs(now - likelihood) < 1e-4 * len(x), now
        if done:
            break
    return weights, rates, likelihood


def mixture(n=300, share=0.25, sites=12, missing=0.2, seed=2):
    rng = np.random.default_rng(seed)
    truth = np.array([[1] * (sites // 2) + [0] * (sites // 2), [0] * (sites // 2) + [1] * (sites // 2)])
    which = (rng.random(n) < share).astype(int)
    x = np.where(rng.random((n, sites)) < 0.01, 1 - truth[which], truth[which]).astype(float)
    x[rng.random(x.shape) < missing] = np.nan
    return x[~np.isnan(x).all(axis=1)], which[~np.isnan(x).all(axis=1)]


def test_rounds_are_those_of_a_plain_version(spark):
    x, _ = mixture(120)
    _, patterns = patterns_of(spark, x)
    rng = np.random.default_rng(5)
    weights, rates = np.array([0.5, 0.3, 0.2]), rng.uniform(0.1, 0.9, (3, 12))
    fit = haplotypes.maximised(patterns.cache(), haplotypes.Mixture(weights, rates), rounds=5)
    w, r, ll = plain_em(x, weights, rates, haplotypes.ERROR, 5)
    assert np.allclose(fit.weights, w) and np.allclose(fit.rates, r) and fit.likelihood == pytest.approx(ll)


def test_two_haplotypes_and_one(spark):
    x, which = mixture()
    seen, patterns = patterns_of(spark, x)
    fit = haplotypes.deconvolved(patterns.cache(), np.nanmean(x, axis=0).tolist())
    assert len(fit.weights) == 2 and fit.weights[0] == pytest.approx(0.75, abs=0.06)
    judged = haplotypes._with_posterior(seen, fit).select("molecule", F.get("posterior", F.lit(1)).alias("p")).collect()
    assert np.mean([(r.p > 0.5) == (which[r.molecule] == 1) for r in judged]) > 0.98
    _, alone = patterns_of(spark, x[which == 0])
    assert len(haplotypes.deconvolved(alone.cache(), np.nanmean(x[which == 0], axis=0).tolist()).weights) == 1


def test_a_recurring_error_is_no_haplotype(spark):
    rng = np.random.default_rng(1)
    x = np.zeros((400, 12))
    x[rng.random(400) < 0.4, 3] = 1  # one site alone
    _, patterns = patterns_of(spark, x)
    assert len(haplotypes.deconvolved(patterns.cache(), x.mean(axis=0).tolist()).weights) == 1


def sample(spark, x, positions):
    bases = [(m, 0, s, positions[s], "G" if v else "A", 0) for m, r in enumerate(x) for s, v in enumerate(r) if not np.isnan(v)]
    bases += [(0, 1, 0, positions[0], "T", 0)]  # a later base of the same molecule counts nothing
    held = spark.createDataFrame(bases, "molecule long, record_index long, query int, position long, base string, strand int")
    levels = np.nanmean(x, axis=0)
    calls = [(p, "A", "G", float(v), True) for p, v in zip(positions, levels)]
    calls += [(9000, "C", "T", 0.999, True), (9001, "C", "T", 0.5, False), (9100, "A", "C", 0.5, True)]
    repeats = spark.createDataFrame([(9100, 9)], "position long, span long")
    return held, spark.createDataFrame(calls, "position long, ref string, alt string, fraction double, pass boolean"), repeats


def test_haplotypes_of_a_sample(spark):
    x, which = mixture(240)
    positions = [100 * (s + 1) for s in range(12)]
    held, calls, repeats = sample(spark, x, positions)
    found = haplotypes.haplotypes(held, calls, repeats)
    rows = {r.haplotype: r for r in found.summary.collect()}
    assert set(rows) == {0, 1} and rows[0].defining == [] and rows[1].defining == [f"snv:{p}:A:G" for p in positions]
    assert sum(r.molecules for r in rows.values()) == found.members.count() > 225 and sum(r.fraction for r in rows.values()) == pytest.approx(1)
    marks = {k: {r.encoded for r in found.markers.where(F.col("cluster") == k).collect()} for k in (0, 1)}
    both = {"9000T", "9100C"}  # the one is fixed, the other lies in a repeat and is half of the sample
    assert marks == {0: both | {f"{p}G" for p in positions[:6]}, 1: both | {f"{p}G" for p in positions[6:]}}
    got = {r.molecule: r.haplotype for r in found.members.collect()}
    assert np.mean([got[m] == which[m] for m in got]) > 0.98
    clusters = haplotypes.as_clusters(spark.range(300).withColumnRenamed("id", "molecule"), found.members)
    assert clusters.where("outlier").count() == 300 - len(got) and clusters.where("outlier and cluster <> -1").count() == 0


def test_a_sample_without_sites_or_molecules(spark):
    held, calls, repeats = sample(spark, np.zeros((5, 3)), [1, 2, 3])
    found = haplotypes.haplotypes(held, calls.where("position >= 9000"), repeats)
    assert [(r.haplotype, r.fraction, r.molecules) for r in found.summary.collect()] == [(0, 1.0, 5)]
    none = haplotypes.haplotypes(held.limit(0), calls.limit(0), repeats)
    assert [(r.haplotype, r.molecules) for r in none.summary.collect()] == [(0, 0)] and none.members.count() == 0
    assert math.isfinite(none.mixture.likelihood)
