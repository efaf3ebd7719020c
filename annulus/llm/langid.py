"""Language identification by hierarchical discrimination.

Languages are first put into families: the centroids of their training texts
are merged, nearest first, until about the square root of their number is left.
One linear support vector machine for each family (against the others) predicts
the family; one-versus-one machines separate the languages within it. Features
are byte 1-, 2- and 3-grams of the lower-cased letters, hashed, as square roots
of their shares.

The machines are fitted on at most TRAIN_PER_LANG documents of each language,
those with the smallest hash of doc_id and text; prediction reads every text
whole and nothing else. Repeated rows count once in the sample, and it is cut to
TRAIN_PER_LANG before anything goes to the driver, which then holds a row of DIMS
numbers for each training document.

Null texts and texts without a letter are `und` with score 0, and so is every
text if nothing can be learned (no labelled rows, an empty table). Rows without
lang or doc_id are predicted but not learned from. Rows that share a doc_id are
drawn for the sample each by its own text; repeated rows get equal predictions. A
very long text is one vector like any other. Only doc_id, text and lang are read,
so other columns may have any name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annulus.llm.workspace import written

DIMS = 1 << 13
TRAIN_PER_LANG = 400
HELD_OUT_OF = 5
UNKNOWN = "und"
STEPS, PENALTY = 150, 1e-4
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def features(text: str) -> np.ndarray | None:
    """A vector of length 1; None for a text without a letter."""
    letters = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, letters[:64])) and not any(map(str.isalpha, letters)):
        return None
    x = np.frombuffer(f" {letters} ".encode(), np.uint8).astype(np.uint32)
    two = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(31) + x[2:] * np.uint32(0xC2B2AE3D)
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    counts = np.bincount(x * np.uint32(0x27D4EB2F) >> shift, minlength=DIMS)
    counts += np.bincount((two ^ two >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> shift, minlength=DIMS)
    counts += np.bincount((three ^ three >> np.uint32(15)) * np.uint32(0x297A2D39) >> shift, minlength=DIMS)
    v = np.sqrt(counts.astype(np.float32))
    return v / np.linalg.norm(v)


def held_out():
    """Whether a row is held out: crc32 of doc_id as text modulo 5 is 0; without doc_id it isn't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT_OF == 0, F.lit(False))


def _svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the last for the constant) of a linear machine with squared hinge loss, by Nesterov's method.

    y is 1 or -1; either side weighs the same in all.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    ahead, t, rate = w, 1.0, 1 / (4 + PENALTY)
    for _ in range(STEPS):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        gradient = PENALTY * ahead - 2 * x.T @ (cost * y * slack)
        after = ahead - rate * gradient
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = after + (t - 1) / t2 * (after - w), after, t2
    return w


def families(centroids: np.ndarray) -> list[list[int]]:
    """Average-link clusters of the languages; about the square root of their number."""
    groups = [[i] for i in range(len(centroids))]
    near = centroids @ centroids.T
    while len(groups) > max(1, round(len(centroids) ** 0.5)):
        best = max(
            ((float(near[np.ix_(a, b)].mean()), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups[:i])),
            key=lambda x: x,
        )
        i, j = -best[1], -best[2]
        groups[j] = sorted(groups[j] + groups[i])
        del groups[i]
    return sorted(groups)


class Model:
    """Family machines, machines for pairs within families, and the language names."""

    def __init__(self, names: list[str], x: np.ndarray, y: np.ndarray):
        self.names = names
        centroids = np.array([x[y == i].mean(axis=0) for i in range(len(names))]) if names else np.zeros((0, DIMS))
        mean = centroids.mean(axis=0) if len(names) else 0
        away = centroids - mean
        away = away / np.maximum(1e-9, np.linalg.norm(away, axis=1, keepdims=True)) if len(names) else away
        self.families = families(away)
        of = {i: f for f, group in enumerate(self.families) for i in group}
        family = np.array([of[i] for i in y], int)
        one = np.float32(1)
        weights = [_svm(x, np.where(family == f, one, -one)) for f in range(len(self.families))] if len(self.families) > 1 else []
        self.pairs = []
        for group in self.families:
            for k, a in enumerate(group):
                for b in group[:k]:
                    some = (y == a) | (y == b)
                    weights.append(_svm(x[some], np.where(y[some] == a, one, -one)))
                    self.pairs.append((a, b))
        self.weights = np.array(weights, np.float32).reshape(-1, DIMS + 1)

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        sure = 1 / (1 + np.exp(-3 * np.clip(margins, -20, 20)))
        n, out = len(self.families) if len(self.families) > 1 else 0, []
        for row in sure:
            share = row[:n] / max(1e-9, row[:n].sum()) if n else np.ones(1)
            f = int(share.argmax())
            group = self.families[f]
            votes = {i: [] for i in group}
            for (a, b), p in zip(self.pairs, row[n:]):
                if a in votes and b in votes:
                    votes[a].append(p)
                    votes[b].append(1 - p)
            means = {i: float(np.mean(v)) if v else 1.0 for i, v in votes.items()}
            # Most pairs won, then the larger mean, then the first name.
            best = max(group, key=lambda i: (sum(p > 0.5 for p in votes[i]), means[i], -i))
            out.append((self.names[best], min(1.0, max(0.0, float(share[f]) * means[best]))))
        return out


def fit(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> Model:
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out())
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1 << 30)).alias("place")
    placed = known.select("lang", "text", place)
    # Distinct places, so that copies of one row neither fill the sample nor decide on the share that is drawn.
    counts = written(placed.groupBy("lang").agg(F.approx_count_distinct("place", 0.02).alias("n")), "languages")
    # A share that holds per_lang documents with near certainty; the excess goes below.
    share = F.least(F.lit(1.0), (1.15 * per_lang + 40) / F.col("n"))
    drawn = placed.join(counts, "lang").where(F.col("place") < share * (1 << 30))
    once = drawn.groupBy("lang", "place").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("place")  # about 1.2 * per_lang rows of each language
    sample = once.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_lang).select("lang", "text", "place")

    def vectors(batches):
        for batch in batches:
            lang, text, place = (batch.column(k).to_pylist() for k in range(3))
            got = [(a, p, features(t)) for a, t, p in zip(lang, text, place)]
            got = [(a, p, v, np.flatnonzero(v)) for a, p, v in got if v is not None]
            columns = [
                pa.array([x[0] for x in got], pa.string()),
                pa.array([x[1] for x in got], pa.int64()),
                pa.array([x[3].astype("<u2").tobytes() for x in got], pa.binary()),
                pa.array([x[2][x[3]].astype("<f4").tobytes() for x in got], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "place", "at", "value"])

    rows = sample.mapInArrow(vectors, "lang string, place long, at binary, value binary").collect()
    taken = sorted(rows, key=lambda r: (r["lang"], r["place"]))
    names = sorted({r["lang"] for r in taken})
    x = np.zeros((len(taken), DIMS), np.float32)
    for i, r in enumerate(taken):
        x[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["value"], "<f4")
    return Model(names, x, np.array([names.index(r["lang"]) for r in taken], int))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: one row of DIMS weights for each machine

    def rows(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            out = [(UNKNOWN, 0.0)] * len(texts)
            for i in range(0, len(texts), 256) if shared.value.names else ():
                got = [(i + k, features(t)) for k, t in enumerate(texts[i : i + 256]) if t]
                got = [(k, v) for k, v in got if v is not None]
                if got:
                    for (k, _), answer in zip(got, shared.value.predict(np.array([v for _, v in got]))):
                        out[k] = answer
            columns = [batch.column(0), batch.column(1), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(
        rows, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def identify(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> DataFrame:
    """Learn from the rows that aren't held out, then predict every row."""
    return predict(docs, fit(docs, per_lang))
