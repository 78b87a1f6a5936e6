"""Rectangle algebra as Column expressions: page points, origin top-left, y down.

A rectangle is four flat double columns, so range predicates stay inside whole-stage code generation.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rect(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column


def rect(prefix: str = "") -> Rect:
    """The rectangle held in columns `<prefix>x0 .. <prefix>y1`."""
    return Rect(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))


def aliased(r: Rect, prefix: str = "") -> list[Column]:
    return [c.alias(f"{prefix}{n}") for c, n in zip(r, ("x0", "y0", "x1", "y1"), strict=True)]


def normalise(r: Rect) -> Rect:
    return Rect(F.least(r.x0, r.x1), F.least(r.y0, r.y1), F.greatest(r.x0, r.x1), F.greatest(r.y0, r.y1))


def pad(r: Rect, points: float) -> Rect:
    n = normalise(r)
    return Rect(n.x0 - points, n.y0 - points, n.x1 + points, n.y1 + points)


def area(r: Rect) -> Column:
    n = normalise(r)
    return (n.x1 - n.x0) * (n.y1 - n.y0)


def union(a: Rect, b: Rect) -> Rect:
    a, b = normalise(a), normalise(b)
    return Rect(F.least(a.x0, b.x0), F.least(a.y0, b.y0), F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1))


def overlaps(a: Rect, b: Rect) -> Column:
    """Open-interval overlap: touching edges do not count."""
    return (a.x0 < b.x1) & (b.x0 < a.x1) & (a.y0 < b.y1) & (b.y0 < a.y1)


def intersection(a: Rect, b: Rect) -> Rect:
    """The shared part; every column is null when the two do not overlap."""
    a, b = normalise(a), normalise(b)
    inner = Rect(F.greatest(a.x0, b.x0), F.greatest(a.y0, b.y0), F.least(a.x1, b.x1), F.least(a.y1, b.y1))
    there = (inner.x0 < inner.x1) & (inner.y0 < inner.y1)
    return Rect(*(F.when(there, c) for c in inner))


def midpoint(r: Rect) -> tuple[Column, Column]:
    n = normalise(r)
    return (n.x0 + n.x1) / 2, (n.y0 + n.y1) / 2


def contains_point(r: Rect, x: Column, y: Column) -> Column:
    n = normalise(r)
    return x.between(n.x0, n.x1) & y.between(n.y0, n.y1)


def overlap_ratio(inner: Rect, outer: Rect) -> Column:
    """Share of `inner` lying within `outer`; 0 when `inner` has no area."""
    shared = F.coalesce(area(intersection(inner, outer)), F.lit(0.0))
    whole = area(inner)
    return F.when(whole <= 0, F.lit(0.0)).otherwise(shared / whole)


def interval_share(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Share of the interval a inside b; 0 when a is empty."""
    inside = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    return F.when(a1 <= a0, F.lit(0.0)).otherwise(inside / (a1 - a0))
