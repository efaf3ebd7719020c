"""Lineages mixed in a sample: a mixture of Bernoulli components over substitution sites, fitted to molecules.

A molecule is its list of (site, alternate) with sites it doesn't cover left out: a missing site is no evidence. Molecules
with equal lists are one pattern with a count, and a round of expectation-maximisation is one aggregation over
patterns: posteriors are a column, and their sums by site and allele come to the driver, which holds weights and allele
rates (components x sites at most, four times 400) and nothing of the molecules. Molecules get
their component by the same column once the fit is done.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annulus.functions.haplotypes import distinguishing_sites
from annulus.operators.lineage import MARKER
from annulus.operators.shared import dropped, written

# Fixed values of the method: levels and repeats of usable sites, sites, components, rate of errors, rounds, change of the
# likelihood for each molecule that ends them, least gain in BIC, molecules and sites of a component of its own, posterior.
LEVELS, REPEAT, SITES, COMPONENTS, ERROR = (0.02, 0.98), 8, 400, 4, 0.02
ROUNDS, SETTLED, GAIN, MEMBERS, DISTINCT, APART, SURE = 40, 1e-4, 10.0, 5.0, 3, 0.6, 0.9


@dataclass
class Mixture:
    """Weights, rates of the alternate allele (component, site) and the log likelihood of what they were fitted to."""

    weights: np.ndarray
    rates: np.ndarray
    likelihood: float = 0.0

    def ordered(self) -> Mixture:
        """The heaviest component first."""
        order = np.argsort(-self.weights, kind="stable")
        return Mixture(self.weights[order], self.rates[order], self.likelihood)


def usable_sites(calls: DataFrame, repeats: DataFrame) -> DataFrame:
    """site, position, alt, fraction: calls that pass at a mixed level outside repeats (position, span), one for each position,
    numbered from 0 by position. At most SITES: the driver holds their rates."""
    mixed = calls.where(F.col("pass") & F.col("fraction").between(*LEVELS)).select("position", "alt", "fraction")
    clear = mixed.join(repeats.where(F.col("span") >= REPEAT).select("position"), "position", "left_anti")
    one = clear.groupBy("position").agg(F.min(F.struct("alt", "fraction")).alias("c"))
    rows = one.select("position", "c.*").orderBy("position").limit(SITES).collect()
    schema = "site int, position long, alt string, fraction double"
    return calls.sparkSession.createDataFrame([(i, r.position, r.alt, r.fraction) for i, r in enumerate(rows)], schema)


def observations(bases: DataFrame, sites: DataFrame) -> DataFrame:
    """molecule, seen: the (site, alternate) of each molecule that covers a site, by its first base there."""
    first = F.min(F.struct("record_index", "query", "base")).alias("b")
    at = bases.join(F.broadcast(sites.select("site", "position", "alt")), "position")  # SITES rows at most
    one = at.groupBy("molecule", "site", "alt").agg(first).select("molecule", F.struct("site", (F.col("b.base") == F.col("alt")).alias("alternate")).alias("o"))
    return one.groupBy("molecule").agg(F.sort_array(F.collect_list("o")).alias("seen"))


def _with_posterior(rows: DataFrame, fit: Mixture) -> DataFrame:
    """Adds evidence (the log likelihood of a list) and posterior (an array over components)."""
    logs = [np.log(fit.rates).tolist(), np.log1p(-fit.rates).tolist(), np.log(np.maximum(fit.weights, 1e-12)).tolist()]
    given = rows.sparkSession.createDataFrame([tuple(logs)], "_yes array<array<double>>, _no array<array<double>>, _w array<double>")
    # a row, so that the expression is the same in each round
    term = lambda k: lambda a, o: a + F.when(o["alternate"], F.get(F.get("_yes", k), o["site"])).otherwise(F.get(F.get("_no", k), o["site"]))
    joint = F.array(*(F.aggregate("seen", F.get("_w", F.lit(k)), term(F.lit(k))) for k in range(len(fit.weights))))
    held = rows.crossJoin(F.broadcast(given)).withColumn("_joint", joint).withColumn("_top", F.array_max("_joint"))
    total = F.aggregate("_joint", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))
    held = held.withColumn("_total", total).withColumn("evidence", F.col("_top") + F.ln("_total"))
    return held.withColumn("posterior", F.transform("_joint", lambda x: F.exp(x - F.col("_top")) / F.col("_total"))).select(*rows.columns, "evidence", "posterior")


def maximised(patterns: DataFrame, start: Mixture, rounds: int = ROUNDS, error: float = ERROR) -> Mixture:
    """The mixture that expectation-maximisation finds from `start`; patterns (seen, n)."""
    fit, (parts, sites) = start, start.rates.shape
    for _ in range(rounds):
        judged = _with_posterior(patterns, fit)
        whole = F.array(F.struct(F.lit(-1).alias("site"), F.lit(False).alias("alternate")))  # stands for the molecule
        rows = judged.select("n", "evidence", "posterior", F.explode(F.concat(whole, "seen")).alias("o"))
        sums = [F.sum(F.col("n") * F.get("posterior", F.lit(k))).alias(f"p{k}") for k in range(parts)]
        added = rows.groupBy("o.site", "o.alternate").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("evidence")).alias("evidence"), *sums)
        covered, changed, weights, likelihood, molecules = np.zeros((parts, sites)), np.zeros((parts, sites)), fit.weights, 0.0, 0
        for r in added.collect():  # two rows for a site at most
            p = np.array(r[4:])
            if r.site < 0:
                weights, likelihood, molecules = p / r.n, r.evidence, r.n
                continue
            covered[:, r.site] += p
            if r.alternate:
                changed[:, r.site] += p
        if not molecules:
            return fit
        # a site that a component never covers keeps its rate
        rates = np.where(covered > 0, np.clip(changed / np.where(covered > 0, covered, 1), error, 1 - error), fit.rates)
        settled = abs(likelihood - fit.likelihood) < SETTLED * molecules
        fit = Mixture(weights, rates, likelihood)
        if settled:
            break
    return fit


def deconvolved(patterns: DataFrame, levels: list[float], most: int = COMPONENTS, error: float = ERROR) -> Mixture:
    """The mixture of as many components as the data pay for, from one at the sites' levels on.

    The most mixed site of the most mixed component splits it; the new one must gain in BIC, hold molecules, and differ from
    each other one at several sites, so that one recurring error is no lineage.
    """
    best = Mixture(np.ones(1), np.clip(np.array([levels], float).reshape(1, -1), error, 1 - error))
    molecules = patterns.agg(F.sum("n")).first()[0] or 0
    if not molecules or not levels:
        return best
    best = maximised(patterns, best, error=error)
    bic = lambda fit: -2 * fit.likelihood + (fit.rates.size + len(fit.weights) - 1) * math.log(molecules)
    while len(best.weights) < most:
        mixed = best.weights[:, None] * best.rates * (1 - best.rates)
        part, site = np.unravel_index(int(mixed.argmax()), mixed.shape)
        weights, rates = np.append(best.weights, best.weights[part] / 2), np.vstack([best.rates, best.rates[part]])
        weights[part] /= 2
        rates[part, site], rates[-1, site] = error, 1 - error
        fit = maximised(patterns, Mixture(weights, rates, best.likelihood), error=error)
        apart = min(distinguishing_sites(r, fit.rates[-1], APART) for r in fit.rates[:-1])
        if fit.weights[-1] * molecules < MEMBERS or apart < DISTINCT or bic(fit) >= bic(best) - GAIN:
            break
        best = fit
    return best.ordered()


@dataclass
class Haplotypes:
    """What a deconvolution gives: molecules with their haplotype, haplotypes, and their markers as those of clusters."""

    members: DataFrame  # molecule, haplotype; molecules that fit none surely are not there
    summary: DataFrame  # haplotype, fraction, molecules, defining
    markers: DataFrame  # cluster (the haplotype), MARKER
    mixture: Mixture


def _marker(position: Column, alt: Column) -> list[Column]:
    none = F.lit(None).cast("string")
    parts = (position.cast("long"), F.lit("substitution"), none, alt, F.concat(position.cast("string"), alt))
    return [x.alias(c) for x, c in zip(parts, MARKER)]


def haplotypes(bases: DataFrame, calls: DataFrame, repeats: DataFrame) -> Haplotypes:
    """The haplotypes of a sample. bases as `calls.read_bases` gives them, of the molecules that calls were made from; calls
    (position, ref, alt, fraction, pass); repeats (position, span).

    With one component every molecule belongs to it, informative or not. A passing call that is no usable site is a marker of all
    haplotypes if half of the sample has it.
    """
    spark = calls.sparkSession
    sites = usable_sites(calls, repeats)
    levels = [r.fraction for r in sites.orderBy("site").collect()]
    seen = written(observations(bases, sites), "observations")
    patterns = written(seen.groupBy("seen").agg(F.count("*").alias("n")), "patterns")
    fit = deconvolved(patterns, levels)
    parts = len(fit.weights)
    if parts == 1:
        members = bases.select("molecule").distinct().withColumn("haplotype", F.lit(0))
    else:
        judged = _with_posterior(seen, fit).withColumn("_sure", F.array_max("posterior"))
        members = judged.where(F.col("_sure") >= SURE).select("molecule", (F.array_position("posterior", F.col("_sure")) - 1).cast("int").alias("haplotype"))
    members = written(members, "haplotypes")
    dropped(patterns, seen)

    rates = spark.createDataFrame([(i, fit.rates[:, i].tolist()) for i in range(len(levels))], "site int, rates array<double>")
    at = sites.join(rates, "site").select("position", "alt", "rates")
    passing = calls.where("pass").select("position", "ref", "alt", "fraction").join(at, ["position", "alt"], "left")
    each = passing.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("cluster")).withColumn("rate", F.get("rates", F.col("cluster")))
    carried = F.coalesce(F.col("rate"), F.col("fraction")) >= 0.5
    markers = each.where(carried).select("cluster", *_marker(F.col("position"), F.col("alt")))
    differs = (F.col("cluster") > 0) & (F.abs(F.col("rate") - F.get("rates", F.lit(0))) >= APART)
    named = F.concat_ws(":", F.lit("snv"), F.col("position").cast("string"), "ref", "alt")
    defining = each.where(differs).groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", named.alias("name")))), lambda x: x["name"]).alias("defining"))
    sizes = members.groupBy(F.col("haplotype").alias("cluster")).agg(F.count("*").alias("molecules"))
    weights = spark.createDataFrame([(k, float(w)) for k, w in enumerate(fit.weights)], "cluster int, fraction double")
    told = weights.join(sizes, "cluster", "left").join(defining, "cluster", "left")
    summary = told.select(F.col("cluster").alias("haplotype"), "fraction", F.coalesce("molecules", F.lit(0)).alias("molecules"), F.coalesce("defining", F.array().cast("array<string>")).alias("defining"))
    return Haplotypes(members, written(summary, "haplotype-summary"), written(markers, "haplotype-markers"), fit)


def as_clusters(molecules: DataFrame, members: DataFrame) -> DataFrame:
    """molecule, cluster, outlier: haplotypes in the place of clusters; a molecule without one is an outlier of cluster -1."""
    return molecules.select("molecule").join(members, "molecule", "left").select("molecule", F.coalesce("haplotype", F.lit(-1)).alias("cluster"), F.col("haplotype").isNull().alias("outlier"))
