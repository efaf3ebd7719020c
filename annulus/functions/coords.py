"""Circular coordinates: 1-based, inclusive, on a genome of L positions; end < start wraps the origin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

L = 16569


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if isinstance(x, int) else F.col(x)


def fold(p, length: int = L) -> Column:
    return F.pmod(_c(p) - 1, F.lit(length)) + 1


def previous_position(p, length: int = L) -> Column:
    return F.when(_c(p) == 1, F.lit(length)).otherwise(_c(p) - 1)


def next_position(p, length: int = L) -> Column:
    return F.when(_c(p) == length, F.lit(1)).otherwise(_c(p) + 1)


def spans(start, end, length: int = L) -> Column:
    """One or two (start, end) pieces that don't wrap."""
    s, e = _c(start), _c(end)
    piece = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    return F.when(s <= e, F.array(piece(s, e))).otherwise(F.array(piece(s, F.lit(length).cast("long")), piece(F.lit(1).cast("long"), e)))


def zero_based_spans(start, end, length: int = L) -> Column:
    return F.transform(spans(start, end, length), lambda x: F.struct((x["start"] - 1).alias("start"), x["end"].alias("end")))


def interval_length(start, end, length: int = L) -> Column:
    s, e = _c(start), _c(end)
    return F.when(s <= e, e - s + 1).otherwise(F.lit(length) - s + 1 + e)


def midpoint(start, end, length: int = L) -> Column:
    return fold(_c(start) + F.floor((interval_length(start, end, length) - 1) / 2), length)


def angle(p, length: int = L) -> Column:
    """Degrees clockwise from the top."""
    return (_c(p) - 1) * 360.0 / length


def overlap(start, end, other_start, other_end, length: int = L) -> Column:
    """Shared positions of two circular intervals."""
    pieces = F.flatten(
        F.transform(
            spans(start, end, length),
            lambda a: F.transform(
                spans(other_start, other_end, length),
                lambda b: F.greatest(F.lit(0).cast("long"), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]) + 1),
            ),
        )
    )
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda s, x: s + x)
