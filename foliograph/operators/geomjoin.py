"""Geometry joins on (paper, page). Pages are cut into horizontal bands, so a join key is (paper, page, band) and the
rectangle test is only a residual: no page-wide pairing, and one crowded page still spreads over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions.rects import Rect, overlaps

BAND = 64.0
EDGE = 1e-6


def _bands(y0: Column, y1: Column) -> Column:
    return F.explode(F.sequence(F.floor((y0 - EDGE) / BAND), F.floor((y1 + EDGE) / BAND)))


def points_in_rects(points: DataFrame, rects: DataFrame, px: str, py: str, prefix: str,
                    keys: Sequence[str] = ("paper_id", "page"), residual: Column | None = None) -> DataFrame:
    """Inner join of points to the rectangles `<prefix>x0..` holding them (edges count). Each pair appears once:
    a point lies in one band."""
    left = points.withColumn("_band", F.floor(F.col(py) / BAND))
    right = rects.withColumn("_band", _bands(F.col(f"{prefix}y0"), F.col(f"{prefix}y1")))
    joined = left.join(right, [*keys, "_band"]).drop("_band")
    if residual is not None:
        return joined.where(residual)
    return joined.where(F.col(px).between(F.col(f"{prefix}x0"), F.col(f"{prefix}x1"))
                        & F.col(py).between(F.col(f"{prefix}y0"), F.col(f"{prefix}y1")))


def overlapping_rects(a: DataFrame, b: DataFrame, a_prefix: str, b_prefix: str,
                      keys: Sequence[str] = ("paper_id", "page")) -> DataFrame:
    """Inner join of rectangles that share area. A pair meets in several bands; only the band where the shared part
    starts keeps it."""
    ra = Rect(*(F.col(f"{a_prefix}{c}") for c in ("x0", "y0", "x1", "y1")))
    rb = Rect(*(F.col(f"{b_prefix}{c}") for c in ("x0", "y0", "x1", "y1")))
    left = a.withColumn("_band", _bands(ra.y0, ra.y1))
    right = b.withColumn("_band", _bands(rb.y0, rb.y1))
    return (left.join(right, [*keys, "_band"])
            .where(overlaps(ra, rb) & (F.col("_band") == F.floor(F.greatest(ra.y0, rb.y0) / BAND)))
            .drop("_band"))
