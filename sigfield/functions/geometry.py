"""Plan geometry as column expressions; polygons are arrays of (x, y)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def plan_to_world(px: Column, origin: Column | float, px_per_m: Column | float) -> Column:
    """Metres from the origin along one axis."""
    return (px - origin) / px_per_m


def world_to_plan(m: Column, origin: Column | float, px_per_m: Column | float) -> Column:
    return m * px_per_m + origin


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.hypot(x1 - x0, y1 - y0)


def _edges(polygon: Column) -> Column:
    """Array of (a, b) of consecutive corners, closed."""
    n = F.size(polygon)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(polygon, i).alias("a"), F.get(polygon, (i + 1) % n).alias("b")))


def _cross(e: Column) -> Column:
    return e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]


def polygon_area(polygon: Column) -> Column:
    """Shoelace area; 0 with fewer than three corners."""
    total = F.aggregate(_edges(polygon), F.lit(0.0), lambda s, e: s + _cross(e))
    return F.when(F.size(polygon) >= 3, F.abs(total) / 2).otherwise(F.lit(0.0))


def polygon_centroid(polygon: Column) -> Column:
    """Area centroid as (x, y); of a degenerate polygon the mean of its corners."""
    twice = F.aggregate(_edges(polygon), F.lit(0.0), lambda s, e: s + _cross(e))
    along = lambda c: F.aggregate(_edges(polygon), F.lit(0.0), lambda s, e: s + (e["a"][c] + e["b"][c]) * _cross(e))
    mean = lambda c: F.aggregate(polygon, F.lit(0.0), lambda s, p: s + p[c]) / F.size(polygon)
    pick = lambda c: F.when(F.abs(twice) > EPS, along(c) / (twice * 3)).otherwise(mean(c))
    return F.struct(pick("x").alias("x"), pick("y").alias("y"))


def point_in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Even-odd rule."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < at)

    return F.size(F.filter(_edges(polygon), crosses)) % 2 == 1


def orientation(ax, ay, bx, by, cx, cy) -> Column:
    """1 or -1 by the turn from ab to c, 0 if collinear."""
    v = (by - ay) * (cx - bx) - (bx - ax) * (cy - by)
    return F.when(F.abs(v) < EPS, 0).when(v > 0, 1).otherwise(-1)


def _within(ax, ay, bx, by, cx, cy) -> Column:
    return cx.between(F.least(ax, bx) - EPS, F.greatest(ax, bx) + EPS) & cy.between(F.least(ay, by) - EPS, F.greatest(ay, by) + EPS)


def segments_intersect(p: tuple, q: tuple) -> Column:
    """Whether segments (x0, y0, x1, y1) share a point, touching and collinear ones included."""
    a, b, c, d = p[:2], p[2:], q[:2], q[2:]
    o1, o2, o3, o4 = orientation(*a, *b, *c), orientation(*a, *b, *d), orientation(*c, *d, *a), orientation(*c, *d, *b)
    proper = (o1 != o2) & (o3 != o4)
    touch = ((o1 == 0) & _within(*a, *b, *c)) | ((o2 == 0) & _within(*a, *b, *d)) | ((o3 == 0) & _within(*c, *d, *a)) | ((o4 == 0) & _within(*c, *d, *b))
    return proper | touch


def transform_pixel(x: Column, y: Column, width: float, height: float, kind: str) -> tuple[Column, Column]:
    """A point of a plan that is rotated or flipped: rotate_right, rotate_left, rotate_180, flip_x, flip_y."""
    return {
        "rotate_right": (F.lit(height) - y, x),
        "rotate_left": (y, F.lit(width) - x),
        "rotate_180": (F.lit(width) - x, F.lit(height) - y),
        "flip_x": (F.lit(width) - x, y),
        "flip_y": (x, F.lit(height) - y),
    }[kind]
