"""Simulated reads of known mixtures, for tests and benchmarks: the same seed gives the same reads, whatever the partitioning.

Components (a sequence and a share) are built from the reference by edits. Each
read is drawn by itself from a generator seeded with its number: a component, a
place on the circle, a length from a lognormal distribution, a strand, then
substitutions by the bases around, slips in runs of equal bases and other small
errors. So any executor can make any read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annulus.functions import indels

Edit = tuple[int, str, str]  # position, deleted, inserted


@dataclass(frozen=True)
class Platform:
    mean_length: float = 8000.0
    spread: float = 0.4
    substitutions: float = 0.004
    insertions: float = 0.002
    deletions: float = 0.002
    slips: float = 0.02  # for each base of a run beyond the third
    quality: int = 20


def edited(reference: str, edits: list[Edit]) -> str:
    return indels.applied(reference, edits)


def spiked(background: list[Edit], spike: Edit) -> list[Edit]:
    """The background with a further edit; those of the background that it overlaps give way."""
    a, b = spike[0], spike[0] + max(1, len(spike[1]))
    return sorted([e for e in background if not (e[0] < b and a < e[0] + max(1, len(e[1])))] + [spike])


def diverged(reference: str, rate: float, seed: int, start: int = 1, end: int | None = None) -> list[Edit]:
    """Substitutions at a share of the positions, as an old copy elsewhere in the genome has them."""
    rng, end = np.random.default_rng(seed), end or len(reference)
    places = np.flatnonzero(rng.random(end - start + 1) < rate) + start
    other = {b: [x for x in "ACGT" if x != b] for b in "ACGT"}
    return [(int(p), reference[p - 1], other[reference[p - 1]][int(rng.integers(3))]) for p in places if reference[p - 1] in other]


def truth(reference: str, components: list[tuple[list[Edit], float]]) -> list[tuple[int, str, str, float]]:
    """position, deleted, inserted, level of the changes of a mixture: shares summed over the components that have them, at their leftmost place."""
    total = sum(w for _, w in components) or 1.0
    found: dict[Edit, float] = {}
    for edits, share in components:
        for position, deleted, inserted in edits:
            if len(deleted) != len(inserted):
                insertion = not deleted
                place = indels.placements(reference, position - 1 if insertion else position, inserted or deleted, insertion)
                key = (place.left + 1, "", place.left_bases) if insertion else (place.left, place.left_bases, "")
            else:
                key = (position, deleted, inserted)
            found[key] = found.get(key, 0.0) + share / total
    return sorted((*k, v) for k, v in found.items())


def _noisy(template: str, platform: Platform, rng: np.random.Generator) -> tuple[str, str]:
    """One read with errors, and its qualities: lower where something was changed."""
    out, quality, i = [], [], 0
    n = len(template)
    draws = rng.random((n, 2))
    while i < n:
        base = template[i]
        j = i
        while j < n and template[j] == base:
            j += 1
        run = j - i
        if run > 3 and rng.random() < min(0.5, platform.slips * (run - 3)):
            run = max(1, run + (1 if rng.random() < 0.3 else -1))
            out.append(base * run)
            quality += [platform.quality // 2] * run
            i = j
            continue
        for k in range(i, j):
            # errors gather where strong bases meet, as on nanopores
            around = template[max(0, k - 2) : k + 3]
            strong = 1.5 if sum(b in "GC" for b in around) >= 4 else 0.9
            x = draws[k, 0]
            if x < platform.deletions:
                continue
            if x < platform.deletions + platform.substitutions * strong:
                out.append("ACGT"[("ACGT".index(base) + 1 + int(draws[k, 1] * 3)) % 4] if base in "ACGT" else base)
                quality.append(platform.quality // 2)
                continue
            out.append(base)
            quality.append(platform.quality)
            if x > 1 - platform.insertions:
                out.append("ACGT"[int(draws[k, 1] * 4)])
                quality.append(platform.quality // 2)
        i = j
    return "".join(out), "".join(chr(33 + q) for q in quality)


def simulated_reads(spark: SparkSession, components: list[tuple[str, float]], count: int, platform: Platform = Platform(), seed: int = 1) -> DataFrame:
    """read, component, start, length, strand, sequence, qualities: `count` reads of a mixture of circular sequences."""
    sequences = [s for s, _ in components]
    shares = np.cumsum([w for _, w in components]) / sum(w for _, w in components)
    mu = math.log(platform.mean_length) - platform.spread**2 / 2

    def made(batches):
        for ids in batches:
            rows = []
            for read in ids["id"]:
                rng = np.random.default_rng((seed, int(read)))
                which = min(int(np.searchsorted(shares, rng.random(), side="right")), len(sequences) - 1)
                circle = sequences[which]
                length = int(min(len(circle), max(200, rng.lognormal(mu, platform.spread))))
                start, reverse = int(rng.integers(len(circle))), bool(rng.random() < 0.5)
                template = (circle + circle)[start : start + length]
                if reverse:
                    template = template[::-1].translate(str.maketrans("ACGTN", "TGCAN"))
                sequence, qualities = _noisy(template, platform, rng)
                rows.append((f"sim{int(read)}", which, start + 1, length, "-" if reverse else "+", sequence, qualities))
            yield pd.DataFrame(rows, columns=["read", "component", "start", "length", "strand", "sequence", "qualities"])

    schema = "read string, component int, start long, length long, strand string, sequence string, qualities string"
    return spark.range(count).mapInPandas(made, schema)


def fastq_lines(reads: DataFrame) -> DataFrame:
    """read, record: four lines each, as a FASTQ file has them."""
    return reads.select("read", F.concat_ws("\n", F.concat(F.lit("@"), "read"), "sequence", F.lit("+"), "qualities").alias("record"))


def prefix(reads: DataFrame, order: str, records: int, bases: int) -> DataFrame:
    """The first reads of an order, as many as both bounds allow."""
    from pyspark.sql import Window

    some = reads.orderBy(order).limit(records)
    upto = F.sum(F.length("sequence")).over(Window.orderBy(order))  # `records` rows at most
    return some.withColumn("_upto", upto).where(F.col("_upto") <= bases).drop("_upto")
