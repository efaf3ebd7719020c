"""Insertions and deletions on a circular reference: placements, repeats, names, windows."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Placement(NamedTuple):
    """The same change at its leftmost and rightmost position, with the bases it has there."""

    left: int
    right: int
    left_bases: str
    right_bases: str
    shift: int


def _at(reference: str, p: int) -> str:
    return reference[(p - 1) % len(reference)]


def placements(reference: str, position: int, bases: str, insertion: bool) -> Placement:
    """All positions that give the same sequence, as extremes.

    A deletion is the run of `bases` from `position`; an insertion stands behind `position`. Moving
    one step left is possible when the base in front equals the last of the change, which then turns
    to the front; at most one round of the genome.
    """
    n, change = len(reference), bases

    def moved(step: int) -> tuple[int, str]:
        p, x, count = position, change, 0
        while count < n:
            if step < 0:
                near = _at(reference, p if insertion else p - 1)
                if near != x[-1]:
                    break
                x = near + x[:-1]
            else:
                near = _at(reference, p + 1 if insertion else p + len(x))
                if near != x[0]:
                    break
                x = x[1:] + near
            p, count = p + step, count + 1
        return (p, x) if count < n else (position, change)

    (a, x), (b, y) = moved(-1), moved(1)
    return Placement((a - 1) % n + 1, (b - 1) % n + 1, x, y, b - a)


def junction(reference: str, left: int, right: int) -> tuple[int, int, int]:
    """A deletion between kept positions left and right, moved as far left as it goes: (left, right, shift to the right end). It passes no unknown base."""
    n = len(reference)
    a = b = 0
    while a < n and _at(reference, left - a) == _at(reference, right - 1 - a) != "N":
        a += 1
    while b < n and _at(reference, left + 1 + b) == _at(reference, right + b) != "N":
        b += 1
    return (left - a - 1) % n + 1, (right - a - 1) % n + 1, a + b


def junction_haplotype(reference: str, left: int, right: int, flank: int) -> str:
    twice = reference * 3
    n = len(reference)
    return twice[n + left - flank : n + left] + twice[n + right - 1 : n + right - 1 + flank]


def homopolymer_run(reference: str, position: int) -> int:
    """Length of the run of equal bases over a position, around the origin."""
    n, base = len(reference), _at(reference, position)
    left = next((k for k in range(1, n) if _at(reference, position - k) != base), n)
    right = next((k for k in range(1, n) if _at(reference, position + k) != base), n)
    return min(n, left + right - 1)


def repeat_context(sequence: str, longest: int = 6) -> list[tuple[int, int]]:
    """(unit, span) for each base: the longest stretch with a period of 1 to 6 it lies in, at least 6 and twice the unit long; the shortest unit of equals."""
    found = [(0, 0)] * len(sequence)
    for unit in range(1, longest + 1):
        start = 0
        for i in range(unit, len(sequence) + 1):
            if i < len(sequence) and sequence[i] == sequence[i - unit]:
                continue
            span = i - start
            if span >= max(6, 2 * unit):
                for k in range(start, i):
                    if span > found[k][1]:
                        found[k] = (unit, span)
            start = i - unit + 1
    return found


def hgvs(position: int, bases: str, insertion: bool, reference: str, prefix: str = "m.") -> str:
    """The change's name at its rightmost place; an insertion that repeats the bases in front is a duplication."""
    place, n = placements(reference, position, bases, insertion), len(reference)
    span = lambda a, b: f"{a}" if a == b else f"{a}_{b}"
    end = place.right
    if not insertion:
        return f"{prefix}{span(end, (end + len(bases) - 2) % n + 1)}del"
    before = "".join(_at(reference, end - len(bases) + 1 + i) for i in range(len(bases)))
    if before == place.right_bases:
        return f"{prefix}{span((end - len(bases)) % n + 1, end)}dup"
    return f"{prefix}{end}_{end % n + 1}ins{place.right_bases}"


def applied(reference: str, edits) -> str:
    """The reference with edits (position, deleted, inserted): deleted bases from position are replaced, so an
    insertion stands before its position. Edits must not overlap and must fit the reference."""
    out, at = [], 0
    for position, deleted, inserted in sorted(edits):
        if position - 1 < at or reference[position - 1 : position - 1 + len(deleted)] != deleted:
            raise ValueError(f"edit at {position} doesn't fit")
        out += [reference[at : position - 1], inserted]
        at = position - 1 + len(deleted)
    return "".join([*out, reference[at:]])


def leftmost(reference: str):
    """A vectorised function of (position, bases, insertion): the leftmost place as (position, bases)."""

    @F.pandas_udf(T.StructType([T.StructField("position", T.LongType()), T.StructField("bases", T.StringType())]))
    def normalized(position: pd.Series, bases: pd.Series, insertion: pd.Series) -> pd.DataFrame:
        rows = [placements(reference, int(p), b, bool(i)) for p, b, i in zip(position, bases, insertion)]
        return pd.DataFrame({"position": [r.left for r in rows], "bases": [r.left_bases for r in rows]})

    return normalized
