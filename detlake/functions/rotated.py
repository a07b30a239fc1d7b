"""Rotated boxes ``(cx, cy, w, h, r)`` with r in radians."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boxes import col, cols, let


def point(x, y) -> Column:
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def corners(cx, cy, w, h, r) -> Column:
    """The four corners as ``array<struct<x,y>>``, going round the box."""
    cx, cy, w, h, r = cols(cx, cy, w, h, r)
    ax, ay = w / 2 * F.cos(r), w / 2 * F.sin(r)
    bx, by = -h / 2 * F.sin(r), h / 2 * F.cos(r)
    return F.array(
        point(cx + ax + bx, cy + ay + by),
        point(cx + ax - bx, cy + ay - by),
        point(cx - ax - bx, cy - ay - by),
        point(cx - ax + bx, cy - ay + by),
    )


def envelope(points) -> dict[str, Column]:
    """Smallest axis-aligned box around a point array."""
    p = col(points)
    return {
        "x1": F.array_min(p["x"]),
        "y1": F.array_min(p["y"]),
        "x2": F.array_max(p["x"]),
        "y2": F.array_max(p["y"]),
    }


def regularize(cx, cy, w, h, r) -> dict[str, Column]:
    """Same box with w >= h and the angle in [0, pi)."""
    cx, cy, w, h, r = cols(cx, cy, w, h, r)
    wide = w > h
    return {
        "cx": cx,
        "cy": cy,
        "w": F.greatest(w, h),
        "h": F.least(w, h),
        "r": F.pmod(F.when(wide, r).otherwise(r + math.pi / 2), F.lit(math.pi)),
    }


def min_area_box(points) -> dict[str, Column]:
    """Smallest rotated box around a convex point array.

    A minimal rectangle shares a direction with one edge, so each edge direction is tried: all points are projected on
    it and on its normal, and the direction with the smallest area wins. The angle is folded to [0, pi/2).
    """
    turn = math.pi / 2

    def angles(p):
        def angle(a, i):
            b = F.element_at(p, (i + 1) % F.size(p) + 1)
            t = F.pmod(F.atan2(b["y"] - a["y"], b["x"] - a["x"]), F.lit(turn))
            # an angle within rounding of a right angle is the axis-aligned box
            return F.when(F.lit(turn) - t < 1e-12, F.lit(0.0)).otherwise(t)

        return F.transform(p, angle)

    def extent(p, t):
        c, d = F.cos(t), F.sin(t)
        u = F.transform(p, lambda q: q["x"] * c + q["y"] * d)
        v = F.transform(p, lambda q: q["y"] * c - q["x"] * d)
        return let(
            F.struct(
                t.alias("r"), F.array_min(u).alias("u0"), F.array_max(u).alias("u1"), F.array_min(v).alias("v0"),
                F.array_max(v).alias("v1"),
            ),
            lambda e: F.struct(F.round((e["u1"] - e["u0"]) * (e["v1"] - e["v0"]), 9).alias("area"), e.alias("e")),
        )

    def best(p):
        return F.array_min(F.transform(angles(p), lambda t: extent(p, t)))["e"]

    e = let(col(points), best)
    c, d = F.cos(e["r"]), F.sin(e["r"])
    mu, mv = (e["u0"] + e["u1"]) / 2, (e["v0"] + e["v1"]) / 2
    return {
        "cx": mu * c - mv * d,
        "cy": mu * d + mv * c,
        "w": e["u1"] - e["u0"],
        "h": e["v1"] - e["v0"],
        "r": e["r"],
    }


def covariance(w, h, r) -> tuple[Column, Column, Column]:
    """Gaussian of a rotated box: the two variances and the covariance."""
    w, h, r = cols(w, h, r)
    a, b, c, s = w * w / 12, h * h / 12, F.cos(r), F.sin(r)
    return a * c * c + b * s * s, a * s * s + b * c * c, (a - b) * c * s


def gaussian(cx, cy, w, h, r) -> Column:
    """What the similarity needs of a box, for computing it once per box instead of once per pair."""
    p, q, c = covariance(w, h, r)
    parts = {"x": col(cx), "y": col(cy), "p": p, "q": q, "c": c, "own": F.greatest(p * q - c * c, F.lit(0.0))}
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def gaussian_similarity(a: Column, b: Column, eps=1e-7) -> Column:
    """Similarity of two ``gaussian`` structs through their Hellinger distance."""
    p, q, c = a["p"] + b["p"], a["q"] + b["q"], a["c"] + b["c"]
    det = p * q - c * c
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    spread = (p * dy * dy + q * dx * dx) / (det + eps) * 0.25
    cross = (c * (-dx) * dy) / (det + eps) * 0.5
    shape = F.log(det / (4 * F.sqrt(a["own"] * b["own"]) + eps) + eps) * 0.5
    dist = F.least(F.greatest(spread + cross + shape, F.lit(eps)), F.lit(100.0))
    return 1 - F.sqrt(1.0 - F.exp(-dist) + eps)


def gaussian_overlap(a, b, eps=1e-7, aspect=False) -> Column:
    """Similarity of two rotated boxes, five Columns each. ``aspect`` subtracts a penalty for different aspect ratios."""
    sim = gaussian_similarity(gaussian(*a), gaussian(*b), eps)
    return aspect_penalty(sim, a, b, eps) if aspect else sim


def aspect_penalty(sim: Column, a, b, eps=1e-7) -> Column:
    (wa, ha), (wb, hb) = cols(*a[2:4]), cols(*b[2:4])
    v = (4 / math.pi**2) * F.pow(F.atan(wb / hb) - F.atan(wa / ha), 2.0)
    return sim - v * (v / (v - sim + (1 + eps)))


def reach(w, h, thr: float) -> Column:
    """Half side of a square around a rotated box outside of which nothing can be ``thr`` similar.

    The distance of two Gaussians is at least ``d^2 / (4 * (s1 + s2))`` with ``s = max(w, h)^2 / 12``, which bounds the
    centre distance of every pair that reaches the threshold. So squares of such pairs always meet.
    """
    limit = min(-math.log(max(1.0 - (1.0 - thr) ** 2, 1e-44)), 100.0) if thr > 0 else 100.0
    return F.greatest(*cols(w, h)) * math.sqrt(limit / 3) * 1.001 + 1e-3
