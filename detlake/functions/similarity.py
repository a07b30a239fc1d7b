"""Similarity of candidate pairs. Boxes are four Columns ``(x1, y1, x2, y2)``."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boxes import area, col, cols
from .points import area_in_window, clip_to_window, shoelace
from .rotated import envelope, gaussian_overlap

EPS = 1e-7

# Spread of the 17 body keypoints.
KEYPOINT_SIGMAS = [
    0.026, 0.025, 0.025, 0.035, 0.035, 0.079, 0.079, 0.072, 0.072, 0.062, 0.062, 0.107, 0.107, 0.087, 0.087, 0.089,
    0.089,
]


def intersection(a, b) -> Column:
    a, b = cols(*a), cols(*b)
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    return w * h


def iou(a, b, eps=EPS) -> Column:
    i = intersection(a, b)
    return i / (area(*a) + area(*b) - i + eps)


def ioa(a, b, eps=EPS) -> Column:
    """Intersection over the area of ``b``."""
    return intersection(a, b) / (area(*b) + eps)


def box_similarity(a, b, kind="iou", eps=EPS) -> Column:
    """``iou``, ``giou`` (enclosing box), ``diou`` (centre distance) or ``ciou`` (distance and aspect)."""
    a, b = cols(*a), cols(*b)
    wa, ha = a[2] - a[0], a[3] - a[1] + eps
    wb, hb = b[2] - b[0], b[3] - b[1] + eps
    i = intersection(a, b)
    union = wa * ha + wb * hb - i + eps
    s = i / union
    if kind == "iou":
        return s
    ow = F.greatest(a[2], b[2]) - F.least(a[0], b[0])
    oh = F.greatest(a[3], b[3]) - F.least(a[1], b[1])
    if kind == "giou":
        outer = ow * oh + eps
        return s - (outer - union) / outer
    dx, dy = b[0] + b[2] - a[0] - a[2], b[1] + b[3] - a[1] - a[3]
    gap = (dx * dx + dy * dy) / 4 / (ow * ow + oh * oh + eps)
    if kind == "diou":
        return s - gap
    if kind == "ciou":
        v = (4 / math.pi**2) * F.pow(F.atan(wb / hb) - F.atan(wa / ha), 2.0)
        return s - (gap + v * (v / (v - s + (1 + eps))))
    raise ValueError(kind)


def keypoint_similarity(truth, pred, truth_area, sigmas: list[float], eps=EPS) -> Column:
    """Mean closeness of the truth's visible keypoints, relative to object size."""
    t, p, size = col(truth), col(pred), col(truth_area)
    k = F.array(*[F.lit(float((2 * s) ** 2)) for s in sigmas])
    pairs = F.zip_with(
        t, p, lambda a, b: F.struct(a["v"].alias("v"), (F.pow(a["x"] - b["x"], 2.0) + F.pow(a["y"] - b["y"], 2.0)).alias("d"))
    )
    near = F.transform(
        pairs,
        lambda q, i: F.when(q["v"] != 0, F.exp(-(q["d"] / (F.element_at(k, i + 1) * (size + eps) * 2)))).otherwise(F.lit(0.0)),
    )
    seen = F.size(F.filter(t, lambda q: q["v"] != 0))
    return F.aggregate(near, F.lit(0.0), lambda acc, v: acc + v) / (seen + eps)


def window_share(points, x1, y1, x2, y2, eps=1e-6, shape=None) -> Column:
    """Part of a convex polygon's area that lies in the window. ``shape`` is the polygon's envelope and area, where they are known.

    A polygon inside the window is not cut, and one with finite corners has its area integrated along the edges.
    """
    ex1, ey1, ex2, ey2, own = cols(*(shape or (*envelope(points).values(), shoelace(points))))
    x1, y1, x2, y2 = cols(x1, y1, x2, y2)
    meets = intersection((ex1, ey1, ex2, ey2), (x1, y1, x2, y2)) > 0
    finite = own < float("inf")
    inside = finite & (ex1 >= x1) & (ey1 >= y1) & (ex2 <= x2) & (ey2 <= y2)
    cut = F.when(inside, own).when(finite, area_in_window(points, x1, y1, x2, y2)).otherwise(shoelace(clip_to_window(points, x1, y1, x2, y2)))
    return F.when(meets, cut / F.greatest(own, F.lit(eps))).otherwise(F.lit(0.0))


def fused_cost(sim, score) -> Column:
    """Cost that is low only for overlapping pairs with a confident detection."""
    return 1 - col(sim) * col(score)


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def norm(a) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine_distance(a, b) -> Column:
    return F.greatest(F.lit(0.0), 1 - dot(a, b) / (norm(a) * norm(b)))


__all__ = [
    "EPS", "KEYPOINT_SIGMAS", "box_similarity", "cosine_distance", "dot", "fused_cost", "gaussian_overlap", "intersection",
    "ioa", "iou", "keypoint_similarity", "norm", "window_share",
]
