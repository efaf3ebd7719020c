"""Stability of architectures: inferred again from shares of the molecules, matched to the first ones.

Architectures are at most the configured limit, so they and their defining
events are matched on the driver; molecules and observations stay tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annulus.config import Config
from annulus.functions import stats
from annulus.operators import architectures

#: Percent of the molecules of a replicate, and the similarity below which nothing is matched.
SHARE, LEAST_SIMILARITY = 80, 0.5


def similarity(first: set[str], second: set[str], weight: dict[str, float]) -> float:
    """Weighted Jaccard similarity of two sets of events; 1 for two empty ones."""
    union = sum(weight.get(e, 1.0) for e in first | second)
    return sum(weight.get(e, 1.0) for e in first & second) / union if union > 0 else 1.0


def matched(first: dict[str, set[str]], second: dict[str, set[str]], weight: dict[str, float]) -> dict[str, tuple[str, float]]:
    """Pairs of names, each in one pair at most: the most similar first, ties by the names."""
    pairs = sorted((-similarity(a, b, weight), x, y) for x, a in first.items() for y, b in second.items())
    out, used = {}, set()
    for s, x, y in pairs:
        if -s >= LEAST_SIMILARITY and x not in out and y not in used:
            out[x] = y, -s
            used.add(y)
    return out


def _read(found: architectures.Inference) -> tuple[dict[str, set[str]], dict[str, float]]:
    if found.architectures is None:
        return {}, {}
    rows = found.architectures.select("architecture", "defining", "fraction").collect()  # as many as the limit allows
    return {r.architecture: set(r.defining) for r in rows}, {r.architecture: r.fraction for r in rows}


def stability(molecules: DataFrame, observations: DataFrame, weights: DataFrame, config: Config) -> DataFrame:
    """architecture, signature_stability (mean similarity, 0 where lost), recovery_rate, abundance_sd (sample deviation of its
    share, 0 where lost), over the configured number of replicates."""
    spark = molecules.sparkSession
    names, _ = _read(architectures.infer(molecules, observations, weights, config))
    weight = {r.event: r.weight for r in weights.join(spark.createDataFrame([(e,) for e in sorted(set().union(*names.values()))] or [("",)], "event string"), "event", "left_semi").collect()}
    similar, shares = {x: [] for x in names}, {x: [] for x in names}
    for replicate in range(config.architecture_stability_replicates if names else 0):
        some = molecules.where(stats.in_sample(F.col("molecule").cast("string"), replicate, config.architecture_seed, SHARE))
        again, fraction = _read(architectures.infer(some, observations, weights, config))
        weight |= {e: weight.get(e, 1.0) for events in again.values() for e in events}
        found = matched(names, again, weight)
        for x in names:
            y, s = found.get(x, (None, 0.0))
            similar[x].append(s)
            shares[x].append(fraction[y] if y is not None else 0.0)
    rows = []
    for x in sorted(names):
        n = len(similar[x])
        mean = sum(shares[x]) / n if n else 0.0
        sd = (sum((v - mean) ** 2 for v in shares[x]) / (n - 1)) ** 0.5 if n > 1 else 0.0
        rows.append((x, sum(similar[x]) / n if n else None, sum(s > 0 for s in similar[x]) / n if n else None, sd))
    return spark.createDataFrame(rows, "architecture string, signature_stability double, recovery_rate double, abundance_sd double")
