"""Column functions on boxes (y0, x0, y1, x1) and points. Frames: 0-1000 per axis unless the name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box:
    """The four columns of a box; prefix as in `l.y0` or `l_y0`."""

    def __init__(self, prefix: str = "", sep: str = "_"):
        at = lambda n: F.col(f"{prefix}{sep}{n}" if prefix else n)
        self.y0, self.x0, self.y1, self.x1 = at("y0"), at("x0"), at("y1"), at("x1")

    @property
    def all(self) -> tuple[Column, ...]:
        return self.y0, self.x0, self.y1, self.x1


def valid(b: Box, limit: float = 1000.0) -> Column:
    """Finite, of positive area, and inside the frame; null is not valid."""
    finite = F.lit(True)
    for c in b.all:
        finite = finite & ~F.isnan(c)
    ok = finite & (b.y0 >= 0.0) & (b.x0 >= 0.0) & (b.y1 <= limit) & (b.x1 <= limit) & (b.y0 < b.y1) & (b.x0 < b.x1)
    return F.coalesce(ok, F.lit(False))


def area(b: Box) -> Column:
    return (b.y1 - b.y0) * (b.x1 - b.x0)


def center(b: Box) -> tuple[Column, Column]:
    return (b.y0 + b.y1) / 2.0, (b.x0 + b.x1) / 2.0


def overlap(a: Box, b: Box) -> Column:
    high = F.greatest(F.lit(0.0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))
    return high * F.greatest(F.lit(0.0), F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, 0 where the union has no area."""
    both = area(a) + area(b) - overlap(a, b)
    return F.when(both > 0.0, overlap(a, b) / both).otherwise(0.0)


def overlap_of_smaller(a: Box, b: Box) -> Column:
    small = F.least(area(a), area(b))
    return F.when(small > 0.0, overlap(a, b) / small).otherwise(0.0)


def gap(a: Box, b: Box) -> Column:
    """The larger of the two axis gaps; at most 0 where the boxes meet."""
    return F.greatest(a.y0 - b.y1, b.y0 - a.y1, a.x0 - b.x1, b.x0 - a.x1)


def holds_center(outer: Box, inner: Box, tol: float = 0.0) -> Column:
    cy, cx = center(inner)
    return (cy >= outer.y0 - tol) & (cy <= outer.y1 + tol) & (cx >= outer.x0 - tol) & (cx <= outer.x1 + tol)


def contains(outer: Box, inner: Box, tol: float = 0.0) -> Column:
    return (inner.y0 >= outer.y0 - tol) & (inner.x0 >= outer.x0 - tol) & (inner.y1 <= outer.y1 + tol) & (inner.x1 <= outer.x1 + tol)


def point_segment_squared(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance of a point from a segment; a segment under 1e-12 is its first point."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size <= 1e-12, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / size)))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return ex * ex + ey * ey


def px_to_page(v: Column, size: Column | float) -> Column:
    """Pixels to the 0-1000 frame, one decimal, halves to even."""
    return F.bround(v / size * 1000.0, 1)


def crop_to_page(v: Column, lo: Column, hi: Column) -> Column:
    return lo + v / 1000.0 * (hi - lo)


def page_to_crop(v: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.lit(1000.0), F.greatest(F.lit(0.0), (v - lo) / (hi - lo) * 1000.0))


def bezier(a: Column, b: Column, c: Column, d: Column, t: Column) -> Column:
    """A coordinate of the cubic curve with these control values at t from 0 to 1."""
    s = 1 - t
    return s * s * s * a + 3 * s * s * t * b + 3 * s * t * t * c + t * t * t * d


def compose(first: tuple[float, ...], then: tuple[float, ...]) -> tuple[float, ...]:
    """The matrix (a, b, c, d, e, f), for x' = a x + c y + e and y' = b x + d y + f, that does one and then the other."""
    a, b, c, d, e, f = first
    p, q, r, s, u, v = then
    return a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + u, e * q + f * s + v


def apply_matrix(m: tuple[float, ...], x: Column, y: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = m
    return a * x + c * y + e, b * x + d * y + f
