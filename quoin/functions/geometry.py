"""Boxes as four DOUBLE columns: measures, transforms and predicates as Column expressions.

Coordinates are points with y downwards. All functions stay inside whole-stage code
generation: no array is built and no UDF is called.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tolerances of the layout rules, in points or shares.
SEAM_AXIS, SEAM_COVERAGE, LEAST_COLLISION = 0.75, 0.01, 0.5
TABLE_SEAM = 1.5
CORNER_TOLERANCE = 12.0


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column


def box(prefix: str = "") -> Box:
    """The box of columns ``{prefix}x0`` to ``{prefix}y1``."""
    return Box(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))


def _zero(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.greatest(as_col(low), F.least(as_col(high), x))


# --- measures


def width(b: Box) -> Column:
    return _zero(b.x1 - b.x0)


def height(b: Box) -> Column:
    return _zero(b.y1 - b.y0)


def area(b: Box) -> Column:
    return width(b) * height(b)


def center_x(b: Box) -> Column:
    return (b.x0 + b.x1) / 2


def center_y(b: Box) -> Column:
    return (b.y0 + b.y1) / 2


def is_valid(b: Box) -> Column:
    return (b.x1 > b.x0) & (b.y1 > b.y0)


def axis_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return _zero(F.least(a1, b1) - F.greatest(a0, b0))


def axis_gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.when(a1 < b0, b0 - a1).when(b1 < a0, a0 - b1).otherwise(F.lit(0.0))


def overlap_width(a: Box, b: Box) -> Column:
    return axis_overlap(a.x0, a.x1, b.x0, b.x1)


def overlap_height(a: Box, b: Box) -> Column:
    return axis_overlap(a.y0, a.y1, b.y0, b.y1)


def intersection_area(a: Box, b: Box) -> Column:
    return overlap_width(a, b) * overlap_height(a, b)


def overlap_share(inner: Box, outer: Box) -> Column:
    """Intersection over the inner box's area; 0 for an empty one."""
    return F.when(area(inner) > 0, intersection_area(inner, outer) / area(inner)).otherwise(F.lit(0.0))


def horizontal_gap(a: Box, b: Box) -> Column:
    return axis_gap(a.x0, a.x1, b.x0, b.x1)


def vertical_gap(a: Box, b: Box) -> Column:
    return axis_gap(a.y0, a.y1, b.y0, b.y1)


def same_baseline(a: Box, b: Box, tolerance: float = 2.0) -> Column:
    return (F.abs(a.y0 - b.y0) <= tolerance) & (F.abs(a.y1 - b.y1) <= tolerance)


def iou(a: Box, b: Box, floor: float = 0.0) -> Column:
    """Intersection over union; areas below ``floor`` count as it."""
    common = intersection_area(a, b)
    union = F.greatest(area(a), F.lit(floor)) + F.greatest(area(b), F.lit(floor)) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def overlap_on_smaller(a: Box, b: Box) -> Column:
    return intersection_area(a, b) / F.greatest(F.lit(1.0), F.least(area(a), area(b)))


def _share_of_smaller(common: Column, a: Column, b: Column) -> Column:
    least = F.least(a, b)
    return F.when(least > 0, common / least).otherwise(F.lit(0.0))


def vertical_overlap_share(a: Box, b: Box) -> Column:
    return _share_of_smaller(overlap_height(a, b), height(a), height(b))


def horizontal_overlap_share(a: Box, b: Box) -> Column:
    return _share_of_smaller(overlap_width(a, b), width(a), width(b))


def overlap_box(a: Box, b: Box) -> Box:
    """Box of the overlap; null unless one of its sides has extent, so edges that touch count."""
    w, h = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    some = (w >= 0) & (h >= 0) & ((w > 0) | (h > 0))
    return Box(*(F.when(some, v) for v in (F.greatest(a.x0, b.x0), F.greatest(a.y0, b.y0), F.least(a.x1, b.x1), F.least(a.y1, b.y1))))


def union(a: Box, b: Box) -> Box:
    return Box(F.least(a.x0, b.x0), F.least(a.y0, b.y0), F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1))


def union_over(prefix: str = "") -> list[Column]:
    """Aggregates that give the union box of a group."""
    return [F.min(f"{prefix}x0").alias("x0"), F.min(f"{prefix}y0").alias("y0"), F.max(f"{prefix}x1").alias("x1"), F.max(f"{prefix}y1").alias("y1")]


def from_quad(points: list[Column]) -> Box:
    """Bounding box of a quad given as x, y of four corners."""
    xs, ys = points[0::2], points[1::2]
    return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


# --- transforms


def mirror(b: Box, page_width: Column, clamped: bool = True) -> Box:
    """Reflection in the page's width; a clamped one that degenerates gives the box itself."""
    x0, x1 = page_width - b.x1, page_width - b.x0
    if not clamped:
        return Box(x0, b.y0, x1, b.y1)
    c0, c1 = clamp(x0, 0.0, page_width), clamp(x1, 0.0, page_width)
    return Box(F.when(c1 > c0, c0).otherwise(b.x0), b.y0, F.when(c1 > c0, c1).otherwise(b.x1), b.y1)


def mirror_within(b: Box, page: Box) -> Box:
    return Box(page.x0 + page.x1 - b.x1, b.y0, page.x0 + page.x1 - b.x0, b.y1)


def mirror_if(flag: Column, b: Box, page_width: Column) -> Box:
    m = mirror(b, page_width)
    return Box(*(F.when(flag, x).otherwise(y) for x, y in zip(m, b, strict=True)))


def inflate(b: Box, pad_x: float, pad_y: float, page_width: Column, page_height: Column) -> Box:
    """Padded, then clamped to the page."""
    return Box(_zero(b.x0 - pad_x), _zero(b.y0 - pad_y), F.least(page_width, b.x1 + pad_x), F.least(page_height, b.y1 + pad_y))


def inset(b: Box, by: float) -> Box:
    """Shrunk on all sides; a box that would vanish stays."""
    ok = (b.x1 - b.x0 > 2 * by) & (b.y1 - b.y0 > 2 * by)
    return Box(F.when(ok, b.x0 + by).otherwise(b.x0), F.when(ok, b.y0 + by).otherwise(b.y0), F.when(ok, b.x1 - by).otherwise(b.x1), F.when(ok, b.y1 - by).otherwise(b.y1))


def rescale(b: Box, scale_x: Column, scale_y: Column, digits: int = 3) -> Box:
    """Pixels to points, rounded."""
    return Box(F.round(b.x0 * scale_x, digits), F.round(b.y0 * scale_y, digits), F.round(b.x1 * scale_x, digits), F.round(b.y1 * scale_y, digits))


def text_frame(b: Box, vertical: Column, padding: float = 1.0) -> tuple[Column, Column]:
    """Content width and height along the text; vertical text swaps them."""
    w = F.when(vertical, height(b)).otherwise(width(b))
    h = F.when(vertical, width(b)).otherwise(height(b))
    return F.greatest(F.lit(1.0), w - 2 * padding), F.greatest(F.lit(1.0), h - 2 * padding)


def moved(b: Box, dx: Column, dy: Column, page_width: Column, page_height: Column) -> Box:
    """Translated, kept on the page."""
    x, y = clamp(b.x0 + dx, 0.0, _zero(page_width - width(b))), clamp(b.y0 + dy, 0.0, _zero(page_height - height(b)))
    return Box(x, y, x + width(b), y + height(b))


def widened(b: Box, ratio: float, page_width: Column, margin: float = 4.0) -> Box:
    return Box(b.x0, b.y0, F.greatest(b.x1, F.least(page_width - margin, b.x1 + width(b) * ratio)), b.y1)


def deepened(b: Box, ratio: float, page_height: Column, margin: float = 4.0) -> Box:
    return Box(b.x0, b.y0, b.x1, F.greatest(b.y1, F.least(page_height - margin, b.y1 + height(b) * ratio)))


def snapped(value: Column, references: Column, tolerance: float) -> Column:
    """The nearest element of an array within a tolerance (first of equals), else the value itself."""
    near = F.filter(F.transform(references, lambda r, i: F.struct(F.abs(r - value).alias("d"), i.alias("i"), r.alias("r"))), lambda s: s["d"] <= tolerance)
    return F.coalesce(F.array_min(near)["r"], value)


# --- predicates


def collides(a: Box, b: Box) -> Column:
    """An overlap that matters: over half a square point and no thin seam."""
    w, h, common = overlap_width(a, b), overlap_height(a, b), intersection_area(a, b)
    coverage = common / F.greatest(F.lit(1e-9), F.least(area(a), area(b)))
    return (common > LEAST_COLLISION) & ~((F.least(w, h) < SEAM_AXIS) & (coverage < SEAM_COVERAGE))


def table_seam(a: Box, b: Box) -> Column:
    return (intersection_area(a, b) > 0) & (F.least(overlap_width(a, b), overlap_height(a, b)) <= TABLE_SEAM)


def inside(inner: Box, outer: Box, tolerance: float = 0.0) -> Column:
    return (inner.x0 >= outer.x0 - tolerance) & (inner.y0 >= outer.y0 - tolerance) & (inner.x1 <= outer.x1 + tolerance) & (inner.y1 <= outer.y1 + tolerance)


def intersects(a: Box, b: Box) -> Column:
    return (a.x0 < b.x1) & (b.x0 < a.x1) & (a.y0 < b.y1) & (b.y0 < a.y1)


def neighbours(a: Box, b: Box, tolerance_x: float, tolerance_y: float) -> Column:
    return (horizontal_gap(a, b) <= tolerance_x) & (vertical_gap(a, b) <= tolerance_y)


def contains_point(b: Box, x: Column, y: Column, padding: float = 0.0) -> Column:
    return (x >= b.x0 - padding) & (x <= b.x1 + padding) & (y >= b.y0 - padding) & (y <= b.y1 + padding)


def holds_center(outer: Box, b: Box) -> Column:
    return contains_point(outer, center_x(b), center_y(b))


def same_row(a: Box, b: Box, share: float = 0.5) -> Column:
    return vertical_overlap_share(a, b) >= share


def same_visual_row(a: Box, b: Box) -> Column:
    least, most = F.least(height(a), height(b)), F.greatest(height(a), height(b))
    return (vertical_overlap_share(a, b) >= 0.82) & (F.abs(center_y(a) - center_y(b)) <= 0.18 * least) & (least > 0) & (F.greatest(least, F.lit(1.0)) >= 0.8 * F.greatest(most, F.lit(1.0)))


def same_lane(a: Box, b: Box, tolerance: float = 6.0) -> Column:
    return (horizontal_overlap_share(a, b) >= 0.45) | (F.abs(a.x0 - b.x0) <= tolerance) | (F.abs(a.x1 - b.x1) <= tolerance) | (F.abs(center_x(a) - center_x(b)) <= tolerance)


def heights_fit(a: Box, b: Box) -> Column:
    return F.least(height(a), height(b)) >= 0.78 * F.greatest(height(a), height(b))


def proximate(a: Box, b: Box) -> Column:
    """Near enough for one sentence: 15 points along a row, or two heights below with a fifth of overlap."""
    below = (vertical_gap(a, b) <= 2 * F.greatest(height(a), height(b))) & (horizontal_overlap_share(a, b) >= 0.2)
    return F.when(same_row(a, b), horizontal_gap(a, b) <= 15).otherwise(below)


def corners_near(a: Box, b: Box) -> Column:
    return (F.abs(a.x0 - b.x0) <= CORNER_TOLERANCE) & (F.abs(a.y0 - b.y0) <= CORNER_TOLERANCE) & (F.abs(a.x1 - b.x1) <= CORNER_TOLERANCE) & (F.abs(a.y1 - b.y1) <= CORNER_TOLERANCE)


def same_horizontal_span(a: Box, b: Box) -> Column:
    return (F.abs(a.x0 - b.x0) <= CORNER_TOLERANCE) & (F.abs(a.x1 - b.x1) <= CORNER_TOLERANCE)


def same_vertical_span(a: Box, b: Box) -> Column:
    return (F.abs(a.y0 - b.y0) <= CORNER_TOLERANCE) & (F.abs(a.y1 - b.y1) <= CORNER_TOLERANCE)
