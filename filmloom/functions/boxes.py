"""Column functions over boxes: x1 and y1 are exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def bounds(poly: Column) -> Box:
    """Whole-pixel bounds of a polygon, an array of structs x, y."""
    x, y = F.transform(poly, lambda p: p["x"]), F.transform(poly, lambda p: p["y"])
    return tuple(c.cast("long") for c in (F.floor(F.array_min(x)), F.floor(F.array_min(y)), F.ceil(F.array_max(x)), F.ceil(F.array_max(y))))


def corners(b: Box) -> Column:
    """The polygon of a box, clockwise from the upper left."""
    x0, y0, x1, y1 = b
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])


def clipped(b: Box, width: int, height: int) -> Box:
    x0, y0, x1, y1 = b
    zero = F.lit(0)
    return (
        F.least(F.greatest(x0, zero), F.lit(width)),
        F.least(F.greatest(y0, zero), F.lit(height)),
        F.least(F.greatest(x1, zero), F.lit(width)),
        F.least(F.greatest(y1, zero), F.lit(height)),
    )


def width(b: Box) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0))


def height(b: Box) -> Column:
    return F.greatest(b[3] - b[1], F.lit(0))


def area(b: Box) -> Column:
    return width(b) * height(b)


def overlap(a: Box, b: Box) -> Column:
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0))
    return w * h


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, 0 for boxes apart."""
    inter = overlap(a, b)
    return F.when(inter > 0, inter / (area(a) + area(b) - inter)).otherwise(0.0)


def iou_at_least(a: Box, b: Box, percent: int) -> Column:
    """The same compared in whole numbers, so that no rounding can turn it."""
    inter = overlap(a, b)
    return (inter > 0) & (100 * inter >= percent * (area(a) + area(b) - inter))


def scrolled(a: Box, b: Box) -> Column:
    """The same run of glyphs moved up or down: like size, columns shared, rows near."""
    aw, ah, bw, bh = width(a), height(a), width(b), height(b)
    shared = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0))
    return (
        (F.least(aw, ah, bw, bh) > 0)
        & (100 * F.abs(aw - bw) <= 15 * F.greatest(aw, bw))
        & (100 * F.abs(ah - bh) <= 20 * F.greatest(ah, bh))
        & (10 * shared >= 7 * F.least(aw, bw))
        & (10 * F.abs(a[1] - b[1]) <= 25 * F.greatest(ah, bh))
    )
