"""Containment and crossing tests against polygons and lines stored as ``array<struct<x,y>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boxes import col, cols


def _next(p, i):
    return F.element_at(p, (i + 1) % F.size(p) + 1)


def on_edge(points, x, y) -> Column:
    """Point lies exactly on the outline of a closed polygon."""
    p, (x, y) = col(points), cols(x, y)

    def hit(q, i):
        r = _next(p, i)
        line = (r["x"] - q["x"]) * (y - q["y"]) - (r["y"] - q["y"]) * (x - q["x"]) == 0
        return (
            line
            & (x >= F.least(q["x"], r["x"])) & (x <= F.greatest(q["x"], r["x"]))
            & (y >= F.least(q["y"], r["y"])) & (y <= F.greatest(q["y"], r["y"]))
        )

    return F.exists(F.transform(p, hit), lambda b: b)


def in_polygon(points, x, y, inclusive=False) -> Column:
    """Even-odd containment; the outline counts only when ``inclusive``."""
    p, (x, y) = col(points), cols(x, y)

    def cross(q, i):
        r = _next(p, i)
        spans = (q["y"] > y) != (r["y"] > y)
        at = (r["x"] - q["x"]) * (y - q["y"]) / (r["y"] - q["y"]) + q["x"]
        return F.when(spans, x < at).otherwise(F.lit(False))

    odd = F.size(F.filter(F.transform(p, cross), lambda b: b)) % 2 == 1
    edge = on_edge(p, x, y)
    return (odd | edge) if inclusive else (odd & ~edge)


def _side(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def _within(ax, ay, bx, by, cx, cy) -> Column:
    return (
        (cx >= F.least(ax, bx)) & (cx <= F.greatest(ax, bx)) & (cy >= F.least(ay, by)) & (cy <= F.greatest(ay, by))
    )


def segments_meet(a, b, c, d) -> Column:
    """Segments a-b and c-d share a point. Each argument is an ``(x, y)`` pair."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = a, b, c, d
    s1, s2 = _side(ax, ay, bx, by, cx, cy), _side(ax, ay, bx, by, dx, dy)
    s3, s4 = _side(cx, cy, dx, dy, ax, ay), _side(cx, cy, dx, dy, bx, by)
    return (
        ((s1 != s2) & (s3 != s4))
        | ((s1 == 0) & _within(ax, ay, bx, by, cx, cy))
        | ((s2 == 0) & _within(ax, ay, bx, by, dx, dy))
        | ((s3 == 0) & _within(cx, cy, dx, dy, ax, ay))
        | ((s4 == 0) & _within(cx, cy, dx, dy, bx, by))
    )


def step_meets_line(points, px, py, x, y) -> Column:
    """The step from (px, py) to (x, y) meets the two-point line."""
    p, (px, py, x, y) = col(points), cols(px, py, x, y)
    a, b = F.element_at(p, 1), F.element_at(p, 2)
    return segments_meet((px, py), (x, y), (a["x"], a["y"]), (b["x"], b["y"]))


def step_meets_region(points, px, py, x, y) -> Column:
    """The step touches a two-point line, or touches or lies in a closed polygon."""
    p, (px, py, x, y) = col(points), cols(px, py, x, y)

    def hit(q, i):
        r = _next(p, i)
        return segments_meet((px, py), (x, y), (q["x"], q["y"]), (r["x"], r["y"]))

    edges = F.exists(F.transform(p, hit), lambda b: b)
    return edges | F.when(F.size(p) > 2, in_polygon(p, x, y, inclusive=True)).otherwise(F.lit(False))
