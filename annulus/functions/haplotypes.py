"""Likelihood of reads under haplotypes, and how far two haplotypes are apart."""

from __future__ import annotations

import math

import numpy as np


def pair_hmm_batch(reads: list[str], qualities, haplotype: str, gap_open: float = 1e-3, gap_extend: float = 0.3, band: int | None = None) -> np.ndarray:
    """log10 likelihood of each read anywhere on a haplotype: match, insertion and deletion states, free ends on the
    haplotype. `band` bounds the distance from the main diagonal, which is that of equal ends.

    All reads advance together, a base at a time; what a deletion gathers along the haplotype is a product with a
    triangle of its powers, so no column is looped over.
    """
    sizes, m = np.array([len(r) for r in reads]), len(haplotype)
    out = np.full(len(reads), -math.inf)
    if not len(reads) or not m or not sizes.max():
        return out
    n = int(sizes.max())
    bases, error = np.zeros((len(reads), n), np.uint8), np.ones((len(reads), n))
    for i, (read, q) in enumerate(zip(reads, qualities)):
        bases[i, : len(read)] = np.frombuffer(read.encode(), np.uint8)
        error[i, : len(read)] = 10 ** (-np.asarray(q, float)[: len(read)] / 10)
    own = np.frombuffer(haplotype.encode(), np.uint8)
    stay = 1 - 2 * gap_open
    step = np.arange(m + 1)[None, :] - np.arange(m + 1)[:, None]  # columns from a match to the end of its deletion
    reach = np.where(step >= 1, gap_open * np.power(gap_extend, np.maximum(step - 1, 0), dtype=float), 0.0)
    match, insert, delete = np.zeros((len(reads), m + 1)), np.zeros((len(reads), m + 1)), np.full((len(reads), m + 1), 1.0 / m)
    log = np.zeros(len(reads))
    for i in range(n):
        going = sizes > i
        fits = np.where(own[None, :] == bases[:, i, None], 1 - error[:, i, None], error[:, i, None] / 3)
        new = np.zeros_like(match)
        new[:, 1:] = fits * (stay * match[:, :-1] + (1 - gap_extend) * (insert[:, :-1] + delete[:, :-1]))
        ins = 0.25 * (gap_open * match + gap_extend * insert)
        gone = new @ reach
        if band is not None:
            slack = np.abs(m - sizes)
            off = np.abs(np.arange(m + 1)[None, :] - (i + 1) - np.maximum(0, m - sizes)[:, None] / 2) > band + slack[:, None] / 2
            new[off] = ins[off] = gone[off] = 0
        total = new.sum(axis=1) + ins.sum(axis=1) + gone.sum(axis=1)
        alive = going & (total > 0)
        scale = np.where(alive, total, 1.0)[:, None]
        for state, after in ((match, new), (insert, ins), (delete, gone)):
            state[going] = (after / scale)[going]
        log[alive] += np.log10(total[alive])
        log[going & (total <= 0)] = -math.inf
    end = match.sum(axis=1) + insert.sum(axis=1)
    sound = (sizes > 0) & (end > 0) & np.isfinite(log)
    out[sound] = log[sound] + np.log10(end[sound])
    return out


def pair_hmm(read: str, qualities, haplotype: str, gap_open: float = 1e-3, gap_extend: float = 0.3, band: int | None = None) -> float:
    """`pair_hmm_batch` of one read."""
    return float(pair_hmm_batch([read], [qualities], haplotype, gap_open, gap_extend, band)[0])


def distinguishing_sites(first: np.ndarray, second: np.ndarray, least: float = 0.6) -> int:
    """Sites at which two components' rates differ by `least` or more."""
    return int((np.abs(np.asarray(first) - np.asarray(second)) >= least).sum())
