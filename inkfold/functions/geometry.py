"""Rectangles and offsets as struct columns.

A rectangle is struct(left, top, width, height int); right and bottom are exclusive. An offset is struct(x, y int).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECT = "struct<left:int,top:int,width:int,height:int>"
OFFSET = "struct<x:int,y:int>"


def _half(v: Column) -> Column:
    """Halves towards zero."""
    return (v / 2).cast("int")


def offset(x: Column, y: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))


def rect(left: Column, top: Column, width: Column, height: Column) -> Column:
    return F.struct(*[v.cast("int").alias(k) for k, v in (("left", left), ("top", top), ("width", width), ("height", height))])


def rect_ltrb(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return rect(left, top, right - left, bottom - top)


def rect_center(center: Column, width: Column, height: Column) -> Column:
    return rect(center["x"] - _half(width), center["y"] - _half(height), width, height)


def zero_rect() -> Column:
    return rect(*[F.lit(0)] * 4)


def right(r: Column) -> Column:
    return r["left"] + r["width"]


def bottom(r: Column) -> Column:
    return r["top"] + r["height"]


def point(r: Column, horizontal: str, vertical: str) -> Column:
    """horizontal: left, center or right; vertical: top, center or bottom."""
    x = {"left": r["left"], "center": r["left"] + _half(r["width"]), "right": right(r)}[horizontal]
    y = {"top": r["top"], "center": r["top"] + _half(r["height"]), "bottom": bottom(r)}[vertical]
    return offset(x, y)


def is_empty(r: Column) -> Column:
    """Neither wide nor high; a line isn't empty (T18)."""
    return (r["width"] == 0) & (r["height"] == 0)


def contains_xy(r: Column, x: Column, y: Column) -> Column:
    return (x >= r["left"]) & (x < right(r)) & (y >= r["top"]) & (y < bottom(r))


def contains_offset(r: Column, o: Column) -> Column:
    return contains_xy(r, o["x"], o["y"])


def contains_rect(a: Column, b: Column) -> Column:
    return (b["left"] >= a["left"]) & (right(b) <= right(a)) & (b["top"] >= a["top"]) & (bottom(b) <= bottom(a))


def intersects_vertically(a: Column, b: Column) -> Column:
    """Touching edges count (T18)."""
    return (a["top"] <= bottom(b)) & (bottom(a) >= b["top"])


def intersects_horizontally(a: Column, b: Column) -> Column:
    """Touching edges don't count (T18)."""
    return (a["left"] < right(b)) & (right(a) > b["left"])


def intersects(a: Column, b: Column) -> Column:
    return intersects_horizontally(a, b) & (a["top"] < bottom(b)) & (bottom(a) > b["top"])


def translate(r: Column, dx: Column, dy: Column) -> Column:
    return rect(r["left"] + dx, r["top"] + dy, r["width"], r["height"])


def shift(r: Column, o: Column) -> Column:
    return translate(r, o["x"], o["y"])


def union_box(a: Column, b: Column) -> Column:
    return rect_ltrb(
        F.least(a["left"], b["left"]), F.least(a["top"], b["top"]), F.greatest(right(a), right(b)), F.greatest(bottom(a), bottom(b))
    )


def intersection(a: Column, b: Column) -> Column:
    """The zero rectangle where they have no area in common."""
    left, top = F.greatest(a["left"], b["left"]), F.greatest(a["top"], b["top"])
    r, low = F.least(right(a), right(b)), F.least(bottom(a), bottom(b))
    return F.when((left < r) & (top < low), rect_ltrb(left, top, r, low)).otherwise(zero_rect())


def rect_distance(a: Column, b: Column) -> Column:
    """The larger of the gaps in x and y."""
    zero = F.lit(0)
    dx = F.greatest(zero, b["left"] - right(a), a["left"] - right(b))
    dy = F.greatest(zero, b["top"] - bottom(a), a["top"] - bottom(b))
    return F.greatest(dx, dy)


def within_expanded(inner: Column, outer: Column, padding: Column) -> Column:
    return (
        (inner["left"] >= outer["left"] - padding) & (right(inner) <= right(outer) + padding)
        & (inner["top"] >= outer["top"] - padding) & (bottom(inner) <= bottom(outer) + padding)
    )


def bounding_box(r: Column) -> Column:
    """Aggregate: the box around all rectangles of a group."""
    left, top = F.min(r["left"]), F.min(r["top"])
    return rect_ltrb(left, top, F.max(right(r)), F.max(bottom(r)))


def add(a: Column, b: Column) -> Column:
    return offset(a["x"] + b["x"], a["y"] + b["y"])


def subtract(a: Column, b: Column) -> Column:
    return offset(a["x"] - b["x"], a["y"] - b["y"])


def multiply(a: Column, k: Column) -> Column:
    return offset(a["x"] * k, a["y"] * k)


def divide(a: Column, k: Column) -> Column:
    """Towards zero; null for 0."""
    k = F.nullif(k, F.lit(0))
    return offset((a["x"] / k).cast("int"), (a["y"] / k).cast("int"))


def offset_string(o: Column) -> Column:
    return F.format_string("(%d, %d)", o["x"], o["y"])


def should_merge(a: Column, b: Column, overlap: float = 0.8) -> Column:
    """Whether the common area is at least a share of the smaller one's; of two equal ones either."""
    area_a, area_b = a["width"] * a["height"], b["width"] * b["height"]
    common = intersection(a, b)
    return ~is_empty(common) & (common["width"] * common["height"] >= F.least(area_a, area_b) * overlap)


def same_row(a: Column, b: Column, ratio: float = 0.4) -> Column:
    """Whether two lines' boxes touch vertically and their centres are near for their height."""
    gap = F.abs(point(a, "center", "center")["y"] - point(b, "center", "center")["y"])
    return intersects_vertically(a, b) & (gap < _half(a["height"] + b["height"]) * ratio)


def should_join_lines(west: Column, east: Column, ratio: float = 1.2) -> Column:
    gap = east["left"] - right(west)
    return (gap > 0) & (gap <= _half(east["height"] + west["height"]) * ratio)
