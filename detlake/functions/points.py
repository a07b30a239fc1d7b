"""Point lists: polygons ``array<struct<x,y>>`` and keypoints ``array<struct<x,y,v>>``."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boxes import clamp, col, cols, fit_gain, let, project
from .rotated import envelope, point


def _pt(x, y) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def map_xy(points, fn) -> Column:
    """Apply ``fn(x, y) -> (x, y)`` to every point."""
    return F.transform(col(points), lambda q: _pt(*fn(q["x"], q["y"])))


def map_keypoints(points, fn) -> Column:
    """Apply ``fn(x, y, v) -> (x, y, v)`` to every keypoint."""

    def one(q):
        x, y, v = fn(q["x"], q["y"], q["v"])
        return F.struct(x.alias("x"), y.alias("y"), v.alias("v"))

    return F.transform(col(points), one)


def scale_points(points, from_w, from_h, to_w, to_h, normalize=False, padding=True) -> Column:
    """Points from a padded canvas back to the image; unlike boxes the padding is not rounded."""
    g = fit_gain(from_w, from_h, to_w, to_h)
    fw, fh, tw, th = cols(from_w, from_h, to_w, to_h)
    px, py = ((fw - tw * g) / 2, (fh - th * g) / 2) if padding else (F.lit(0.0), F.lit(0.0))

    def fn(x, y):
        x, y = clamp((x - px) / g, 0.0, tw), clamp((y - py) / g, 0.0, th)
        return (x / tw, y / th) if normalize else (x, y)

    return map_xy(points, fn)


def clip_points(points, width, height) -> Column:
    return map_xy(points, lambda x, y: (clamp(x, 0.0, width), clamp(y, 0.0, height)))


def polygon_box(points, width=640, height=640) -> dict[str, Column]:
    """Box of the part of a polygon inside the image.

    When the polygon leaves the image on three or four sides its points are clipped first, otherwise points outside are
    left out. All zeros when no point with a non-zero x remains.
    """
    b = _inner_box(col(points), col(width).cast("double"), col(height).cast("double"))
    return {k: b[k] for k in ("x1", "y1", "x2", "y2")}


def _inner_box(points: Column, w: Column, h: Column) -> Column:
    def clipped(p):
        e = envelope(p)
        sides = (e["x1"] < 0, e["y1"] < 0, e["x2"] > w, e["y2"] > h)
        over = sum((s.cast("int") for s in sides[1:]), sides[0].cast("int"))
        return F.when(over >= 3, clip_points(p, w, h)).otherwise(p)

    def box(inside):
        ok = F.exists(inside, lambda q: q["x"] != 0)
        return F.struct(*[F.when(ok, c).otherwise(F.lit(0.0)).alias(k) for k, c in envelope(inside).items()])

    def keep(p):
        return F.filter(p, lambda q: (q["x"] >= 0) & (q["y"] >= 0) & (q["x"] <= w) & (q["y"] <= h))

    return let(let(let(points, clipped), keep), box)


def polygon_xywh(points) -> dict[str, Column]:
    from .boxes import xyxy2xywh

    return xyxy2xywh(*envelope(points).values())


def resample(points, n: int = 1000) -> Column:
    """Closed polygon resampled to ``n`` points, linear in the vertex index.

    Polygons with fewer vertices keep all of them and get evenly spaced points in between; ``n`` vertices stay as is.
    """
    def positions(k):
        def spread(count):
            # evenly spaced positions over 0..k, both ends included
            step = k / (count - 1)
            last = count - 1
            return F.transform(
                F.sequence(F.lit(0), last), lambda i: F.when(i == last, k.cast("double")).otherwise(i * step)
            )

        vertices = F.transform(F.sequence(F.lit(0), k), lambda i: i.cast("double"))
        extra = F.lit(n) - (k + 1)
        none = F.array().cast("array<double>")
        fill = F.when(extra >= 2, spread(extra)).when(extra == 1, F.array(F.lit(0.0))).otherwise(none)
        return F.when(k + 1 < n, F.array_sort(F.concat(fill, vertices))).otherwise(spread(F.lit(n)))

    def walk(ring):  # k + 1 vertices, the first one repeated at the end
        k = F.size(ring) - 1

        def at(t):
            i = F.least(F.floor(t).cast("int"), k - 1)
            a, b = F.element_at(ring, i + 1), F.element_at(ring, i + 2)
            return _pt(a["x"] + (b["x"] - a["x"]) * (t - i), a["y"] + (b["y"] - a["y"]) * (t - i))

        return F.transform(let(k, positions), at)

    p = col(points)
    return F.when(F.size(p) == n, p).otherwise(let(F.concat(p, F.slice(p, 1, 1)), walk))


def shoelace(points) -> Column:
    """Unsigned polygon area."""
    return F.abs(signed_area(points))


def signed_area(points) -> Column:
    def area2(p):
        def term(q, i):
            r = F.element_at(p, (i + 1) % F.size(p) + 1)
            return q["x"] * r["y"] - r["x"] * q["y"]

        return F.aggregate(F.transform(p, term), F.lit(0.0), lambda a, t: a + t)

    return let(col(points), area2) / 2


def clip_to_window(points, x1, y1, x2, y2) -> Column:
    """Polygon cut by an axis-aligned window, one half-plane after the other (exact for convex polygons' area)."""
    p = col(points)
    x1, y1, x2, y2 = cols(x1, y1, x2, y2)
    for side in (("x", x1, 1), ("x", x2, -1), ("y", y1, 1), ("y", y2, -1)):
        p = let(p, _cutter(*side))
    return p


def area_in_window(points, x1, y1, x2, y2) -> Column:
    """Area of a polygon inside an axis-aligned window, as :func:`clip_to_window` would leave it: the height inside the window is
    integrated along each edge, so no points are made. For polygons whose coordinates are finite numbers."""
    p = col(points)
    x1, y1, x2, y2 = (c.cast("double") for c in cols(x1, y1, x2, y2))

    def edge(q, i):
        r = F.element_at(p, (i + 1) % F.size(p) + 1)
        # the part of the edge between the window's left and right side
        span = F.struct(clamp(q["x"], x1, x2).alias("a"), clamp(r["x"], x1, x2).alias("b"))
        return let(span, lambda s: F.when(s["a"] == s["b"], F.lit(0.0)).otherwise((s["b"] - s["a"]) * let(heights(q, r, s), mean)))

    def heights(q, r, s):
        def at(x):
            along = q["y"] + (r["y"] - q["y"]) * ((x - q["x"]) / (r["x"] - q["x"]))
            return F.when(x == q["x"], q["y"]).when(x == r["x"], r["y"]).otherwise(along)

        return F.struct(at(s["a"]).alias("a"), at(s["b"]).alias("b"))

    def mean(h):
        a, b = clamp(h["a"], y1, y2), clamp(h["b"], y1, y2)
        above = F.abs(F.greatest(h["b"], y2) - F.greatest(h["a"], y2))
        part = F.abs(b - a) * ((a - y1) + (b - y1)) / 2 + above * (y2 - y1)
        return F.when(h["a"] == h["b"], a - y1).otherwise(part / F.abs(h["b"] - h["a"]))

    return F.abs(F.aggregate(F.transform(p, edge), F.lit(0.0), lambda a, t: a + t))


def _cutter(axis: str, bound: Column, sign: int):
    return lambda p: _cut(p, axis, bound, sign)


def _cut(p: Column, axis: str, bound: Column, sign: int) -> Column:
    other = "y" if axis == "x" else "x"

    def edge(q, i):
        r = F.element_at(p, (i + 1) % F.size(p) + 1)
        dq, dr = (q[axis] - bound) * sign, (r[axis] - bound) * sign
        t = dq / (dq - dr)
        free = q[other] + (r[other] - q[other]) * t
        cross = point(bound, free) if axis == "x" else point(free, bound)
        keep, hit = F.array(q), F.array(cross)
        none = F.filter(F.array(q), lambda _: F.lit(False))
        return (
            F.when((dq >= 0) & (dr >= 0), keep)
            .when((dq >= 0) & (dr < 0), F.when(dq == 0, keep).otherwise(F.concat(keep, hit)))
            .when((dq < 0) & (dr > 0), hit)
            .otherwise(none)
        )

    return F.flatten(F.transform(p, edge))


def flip_points(points, width=None, height=None) -> Column:
    def fn(x, y):
        return (x if width is None else col(width) - x, y if height is None else col(height) - y)

    return map_xy(points, fn)


def flip_keypoints(points, width, order: list[int] | None = None) -> Column:
    """Mirror keypoints left-right and swap left/right joints by the index permutation ``order``."""
    p = map_keypoints(points, lambda x, y, v: (col(width) - x, y, v))
    if order is None:
        return p
    return F.transform(F.array(*[F.lit(i) for i in order]), lambda i: F.element_at(p, i + 1))


def transform_polygon(points, m, width, height) -> tuple[dict[str, Column], Column]:
    """Projected polygon limited to its in-image box; returns the box and the polygon."""
    w, h = col(width).cast("double"), col(height).cast("double")

    def limit(moved):
        return let(
            _inner_box(moved, w, h),
            lambda b: F.struct(
                b.alias("box"),
                map_xy(moved, lambda x, y: (clamp(x, b["x1"], b["x2"]), clamp(y, b["y1"], b["y2"]))).alias("polygon"),
            ),
        )

    out = let(map_xy(points, lambda x, y: project(x, y, m, perspective=True)), limit)
    return {k: out["box"][k] for k in ("x1", "y1", "x2", "y2")}, out["polygon"]


def transform_keypoints(points, m, width, height) -> Column:
    """Projected keypoints; those that leave the image get visibility 0."""

    def fn(x, y, v):
        x, y = project(x, y, m, perspective=True)
        out = (x < 0) | (y < 0) | (x > col(width)) | (y > col(height))
        return x, y, F.when(out, v * 0).otherwise(v)

    return map_keypoints(points, fn)


def hide_uncertain(points, thr=0.5) -> Column:
    """Keypoints whose score is below ``thr`` move to the origin."""
    return map_keypoints(
        points,
        lambda x, y, v: (F.when(v < thr, F.lit(0.0)).otherwise(x), F.when(v < thr, F.lit(0.0)).otherwise(y), v),
    )


def normalize_keypoints(points, width, height) -> Column:
    return map_keypoints(points, lambda x, y, v: (x / col(width), y / col(height), v))


def joint_angle(ax, ay, bx, by, cx, cy) -> Column:
    """Angle at b between the rays to a and c, in degrees, at most 180."""
    ax, ay, bx, by, cx, cy = cols(ax, ay, bx, by, cx, cy)
    deg = F.abs((F.atan2(cy - by, cx - bx) - F.atan2(ay - by, ax - bx)) * 180.0 / math.pi)
    return F.when(deg > 180.0, 360 - deg).otherwise(deg)


def add_visibility(points) -> Column:
    """``array<struct<x,y>>`` to keypoints with visibility 0 where a coordinate is negative."""
    return F.transform(
        col(points),
        lambda q: F.struct(
            q["x"].alias("x"),
            q["y"].alias("y"),
            F.when((q["x"] < 0) | (q["y"] < 0), F.lit(0.0)).otherwise(F.lit(1.0)).alias("v"),
        ),
    )
