"""Queries over box, rotated-box, polygon and keypoint geometry."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import points as P
from ..functions import rotated as R
from .registry import query, r6, rounded, sql6, sql9

XYXY = ("x1", "y1", "x2", "y2")
XYWH_SQL = "(SELECT image_id, det_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h FROM det) b"
LTWH_SQL = "(SELECT image_id, det_id, x1, y1, x2 - x1 AS w, y2 - y1 AS h FROM det) b"
KEY = ("image_id", "det_id")


def _xywh(t):
    return t.det.select(*KEY, *XYXY).transform(B.convert_boxes("xyxy", "xywh"))


def _ltwh(t):
    return t.det.select(*KEY, *XYXY).transform(B.convert_boxes("xyxy", "ltwh"))


def _sized(t, cols=XYXY):
    return t.det.select(*KEY, "cls", *cols).join(t.images, "image_id")


SIZED = "det d JOIN images i USING (image_id)"


@query("g01_xyxy2xywh", "det", f"SELECT image_id, det_id, {sql6(cx='(x1 + x2) / 2', cy='(y1 + y2) / 2', w='x2 - x1', h='y2 - y1')} FROM det")
def g01(t):
    return t.det.select(*KEY, *rounded(B.xyxy2xywh(*XYXY)))


@query("g02_xywh2xyxy", "det", f"SELECT image_id, det_id, {sql6(x1='cx - w / 2', y1='cy - h / 2', x2='cx + w / 2', y2='cy + h / 2')} FROM {XYWH_SQL}")
def g02(t):
    return _xywh(t).select(*KEY, *rounded(B.xywh2xyxy("cx", "cy", "w", "h")))


XYWHN = "SELECT image_id, det_id, width, height, ((x1 + x2) / 2) / width AS cx, ((y1 + y2) / 2) / height AS cy, (x2 - x1) / width AS w, (y2 - y1) / height AS h FROM " + SIZED


@query(
    "g03_xywhn2xyxy", "det images",
    f"SELECT image_id, det_id, {sql6(x1='width * (cx - w / 2) + 3', y1='height * (cy - h / 2) + 5', x2='width * (cx + w / 2) + 3', y2='height * (cy + h / 2) + 5')} FROM ({XYWHN}) b",
)
def g03(t):
    n = _sized(t).select(*KEY, "width", "height", *B.named(B.xyxy2xywhn(*XYXY, "width", "height")))
    return n.select(*KEY, *rounded(B.xywhn2xyxy("cx", "cy", "w", "h", "width", "height", 3.0, 5.0)))


@query(
    "g04_xyxy2xywhn", "det images",
    "WITH c AS (SELECT image_id, det_id, width, height, greatest(least(x1, 480 - 0.001::DOUBLE), 0.0::DOUBLE) AS x1,"
    " greatest(least(y1, 320 - 0.001::DOUBLE), 0.0::DOUBLE) AS y1, greatest(least(x2, 480 - 0.001::DOUBLE), 0.0::DOUBLE) AS x2,"
    f" greatest(least(y2, 320 - 0.001::DOUBLE), 0.0::DOUBLE) AS y2 FROM {SIZED})"
    f" SELECT image_id, det_id, {sql9(cx='((x1 + x2) / 2) / 480', cy='((y1 + y2) / 2) / 320', w='(x2 - x1) / 480', h='(y2 - y1) / 320')} FROM c",
)
def g04(t):
    return _sized(t).select(*KEY, *rounded(B.xyxy2xywhn(*XYXY, 480, 320, clip=True, eps=1e-3), 9))


@query("g05_xywh2ltwh", "det", f"SELECT image_id, det_id, {sql6(x1='cx - w / 2', y1='cy - h / 2', w='w', h='h')} FROM {XYWH_SQL}")
def g05(t):
    return _xywh(t).select(*KEY, *rounded(B.xywh2ltwh("cx", "cy", "w", "h")))


@query("g06_xyxy2ltwh", "det", f"SELECT image_id, det_id, {sql6(x1='x1', y1='y1', w='x2 - x1', h='y2 - y1')} FROM det")
def g06(t):
    return t.det.select(*KEY, *rounded(B.xyxy2ltwh(*XYXY)))


@query("g07_ltwh2xywh", "det", f"SELECT image_id, det_id, {sql6(cx='x1 + w / 2', cy='y1 + h / 2', w='w', h='h')} FROM {LTWH_SQL}")
def g07(t):
    return _ltwh(t).select(*KEY, *rounded(B.ltwh2xywh("x1", "y1", "w", "h")))


@query("g08_ltwh2xyxy", "det", f"SELECT image_id, det_id, {sql6(x1='x1', y1='y1', x2='x1 + w', y2='y1 + h')} FROM {LTWH_SQL}")
def g08(t):
    return _ltwh(t).select(*KEY, *rounded(B.ltwh2xyxy("x1", "y1", "w", "h")))


@query("g09_convert_boxes", "det", f"SELECT image_id, det_id, {sql6(x1='x1', y1='y1', w='x2 - x1', h='y2 - y1')} FROM det")
def g09(t):
    df = t.det.select(*KEY, *XYXY)
    for a, b in (("xyxy", "xywh"), ("xywh", "xyxy"), ("xyxy", "ltwh")):
        df = df.transform(B.convert_boxes(a, b))
    return df.select(*KEY, *r6(x1=F.col("x1"), y1=F.col("y1"), w=F.col("w"), h=F.col("h")))


CORNERS = """
SELECT image_id, det_id, CAST(k AS BIGINT) AS pt, sx, sy,
       cx + sx * (w / 2 * cos(r)) + sy * (-h / 2 * sin(r)) AS x, cy + sx * (w / 2 * sin(r)) + sy * (h / 2 * cos(r)) AS y
FROM obb, (VALUES (0, 1, 1), (1, 1, -1), (2, -1, -1), (3, -1, 1)) v(k, sx, sy)"""


def _corners(t):
    return t.obb.withColumn("points", R.corners("cx", "cy", "w", "h", "r"))


def _points(df, c="points", digits=6):
    return df.select(*KEY, F.posexplode(c).alias("pt", "p")).select(
        *KEY, F.col("pt").cast("bigint").alias("pt"), *rounded({"x": F.col("p.x"), "y": F.col("p.y")}, digits)
    )


@query("g10_rotated_corners", "obb", f"SELECT image_id, det_id, pt, {sql6(x='x', y='y')} FROM ({CORNERS}) c")
def g10(t):
    return _points(_corners(t))


@query("g11_rotated_envelope", "obb", f"SELECT image_id, det_id, {sql6(x1='min(x)', y1='min(y)', x2='max(x)', y2='max(y)')} FROM ({CORNERS}) c GROUP BY image_id, det_id")
def g11(t):
    return _corners(t).select(*KEY, *rounded(R.envelope("points")))


@query(
    "g12_min_area_box", "obb",
    "SELECT image_id, det_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(w * h, 4) AS area, round(least(w, h), 6) AS short,"
    " round(greatest(w, h), 6) AS long FROM obb",
)
def g12(t):
    f = _corners(t).select(*KEY, F.struct(*B.named(R.min_area_box("points"))).alias("b"))
    w, h = F.col("b.w"), F.col("b.h")
    return f.select(
        *KEY, F.round("b.cx", 6).alias("cx"), F.round("b.cy", 6).alias("cy"), F.round(w * h, 4).alias("area"),
        F.round(F.least(w, h), 6).alias("short"), F.round(F.greatest(w, h), 6).alias("long"),
    )


@query(
    "g13_regularize", "obb",
    "SELECT image_id, det_id, round(greatest(w, h), 6) AS w, round(least(w, h), 6) AS h,"
    " round((CASE WHEN w > h THEN r ELSE r + pi() / 2 END) % pi(), 6) AS r FROM obb",
)
def g13(t):
    b = R.regularize("cx", "cy", "w", "h", "r")
    return t.obb.select(*KEY, *r6(w=b["w"], h=b["h"], r=b["r"]))


def _scale_sql(var, pad, gain, hi):
    return f"round(greatest(least(({var} - {pad}) / {gain}, CAST({hi} AS DOUBLE)), 0.0::DOUBLE), 6)"


GAIN = "SELECT *, least(640.0::DOUBLE / height, 640.0::DOUBLE / width) AS g FROM " + SIZED


@query(
    "g14_scale_boxes", "det images",
    f"WITH a AS ({GAIN}), b AS (SELECT *, round_even((640 - width * g) / 2 - 0.1::DOUBLE, 0) AS px,"
    " round_even((640 - height * g) / 2 - 0.1::DOUBLE, 0) AS py FROM a)"
    f" SELECT image_id, det_id, {_scale_sql('x1', 'px', 'g', 'width')} AS x1, {_scale_sql('y1', 'py', 'g', 'height')} AS y1,"
    f" {_scale_sql('x2', 'px', 'g', 'width')} AS x2, {_scale_sql('y2', 'py', 'g', 'height')} AS y2 FROM b",
)
def g14(t):
    return _sized(t).select(*KEY, *rounded(B.scale_boxes(*XYXY, 640, 640, "width", "height")))


# polygons of the boxes, one row per vertex
POLYS = """
SELECT image_id, det_id, cls, conf, CAST(pt AS BIGINT) AS pt, CASE WHEN k IN (0, 4) THEN x1 ELSE x2 END AS x,
       CASE WHEN k IN (0, 1) THEN y1 WHEN k = 2 THEN (y1 + y2) / 2 ELSE y2 END AS y
FROM (SELECT d.*, k, ROW_NUMBER() OVER (PARTITION BY image_id, det_id ORDER BY k) - 1 AS pt
      FROM det d, (VALUES (0), (1), (2), (3), (4)) v(k) WHERE det_id % 2 = 0 OR k <> 2) p"""


@query(
    "g15_scale_points", "det images",
    f"WITH p AS ({POLYS}), a AS (SELECT *, least(640.0::DOUBLE / height, 640.0::DOUBLE / width) AS g FROM p JOIN images USING (image_id)),"
    " b AS (SELECT *, (640 - width * g) / 2 AS px, (640 - height * g) / 2 AS py FROM a)"
    " SELECT image_id, det_id, pt, round(greatest(least((x - px) / g, CAST(width AS DOUBLE)), 0.0::DOUBLE) / width, 9) AS x,"
    " round(greatest(least((y - py) / g, CAST(height AS DOUBLE)), 0.0::DOUBLE) / height, 9) AS y FROM b",
)
def g15(t):
    df = t.polys.select(*KEY, "polygon").join(t.images, "image_id")
    return _points(df.withColumn("points", P.scale_points("polygon", 640, 640, "width", "height", normalize=True)), digits=9)


def _clip_sql(v, hi):
    return f"greatest(least({v}, {hi}::DOUBLE), 0.0::DOUBLE)"


@query(
    "g16_clip_boxes", "det",
    f"SELECT image_id, det_id, {sql6(x1=_clip_sql('x1', 320), y1=_clip_sql('y1', 240), x2=_clip_sql('x2', 320), y2=_clip_sql('y2', 240))} FROM det",
)
def g16(t):
    return t.det.select(*KEY, *rounded(B.clip_box(*XYXY, 320.0, 240.0)))


@query("g17_clip_points", "det", f"SELECT image_id, det_id, pt, {sql6(x=_clip_sql('x', 320), y=_clip_sql('y', 240))} FROM ({POLYS}) p")
def g17(t):
    return _points(t.polys.withColumn("points", P.clip_points("polygon", 320.0, 240.0)))


@query(
    "g18_polygon_box", "det",
    f"WITH p AS (SELECT image_id, det_id, x - 150 AS x, y - 100 AS y FROM ({POLYS}) q), e AS (SELECT image_id, det_id,"
    " (min(x) < 0)::INT + (min(y) < 0)::INT + (max(x) > 160)::INT + (max(y) > 120)::INT AS o FROM p GROUP BY 1, 2),"
    " c AS (SELECT p.image_id, p.det_id, CASE WHEN o >= 3 THEN greatest(least(x, 160), 0) ELSE x END AS x,"
    " CASE WHEN o >= 3 THEN greatest(least(y, 120), 0) ELSE y END AS y FROM p JOIN e USING (image_id, det_id)),"
    " i AS (SELECT image_id, det_id, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, bool_or(x <> 0) AS ok FROM c"
    " WHERE x >= 0 AND y >= 0 AND x <= 160 AND y <= 120 GROUP BY 1, 2)"
    " SELECT image_id, det_id, CASE WHEN ok THEN x1 ELSE 0 END AS x1, CASE WHEN ok THEN y1 ELSE 0 END AS y1,"
    " CASE WHEN ok THEN x2 ELSE 0 END AS x2, CASE WHEN ok THEN y2 ELSE 0 END AS y2 FROM e LEFT JOIN i USING (image_id, det_id)",
)
def g18(t):
    moved = t.polys.withColumn("polygon", P.map_xy("polygon", lambda x, y: (x - 150, y - 100)))
    return moved.select(*KEY, *rounded(P.polygon_box("polygon", 160, 120)))


@query("g19_polygon_xywh", "det", f"SELECT image_id, det_id, {sql6(cx='(min(x) + max(x)) / 2', cy='(min(y) + max(y)) / 2', w='max(x) - min(x)', h='max(y) - min(y)')} FROM ({POLYS}) p GROUP BY 1, 2")
def g19(t):
    return t.polys.select(*KEY, *rounded(P.polygon_xywh("polygon")))


RESAMPLE = """
WITH p AS ({polys}), k AS (SELECT image_id, det_id, count(*) AS k FROM p GROUP BY 1, 2),
g AS (SELECT image_id, det_id, k, CASE WHEN i = 11 - k - 1 THEN k::DOUBLE ELSE i * (k / (11 - k - 1)::DOUBLE) END AS t
      FROM k, (SELECT unnest(range(0, 12)) AS i) s WHERE i <= 11 - k - 1
      UNION ALL SELECT image_id, det_id, k, i::DOUBLE FROM k, (SELECT unnest(range(0, 12)) AS i) s WHERE i <= k),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id, det_id ORDER BY t) - 1 AS pt, least(floor(t), k - 1)::BIGINT AS i FROM g)
SELECT n.image_id, n.det_id, n.pt, round(a.x + (b.x - a.x) * (t - i), 6) AS x, round(a.y + (b.y - a.y) * (t - i), 6) AS y
FROM n JOIN p a ON a.image_id = n.image_id AND a.det_id = n.det_id AND a.pt = i
JOIN p b ON b.image_id = n.image_id AND b.det_id = n.det_id AND b.pt = (i + 1) % k"""


@query("g20_resample", "det", RESAMPLE.format(polys=POLYS))
def g20(t):
    return _points(t.polys.withColumn("points", P.resample("polygon", 12)))


@query(
    "g22_letterbox", "images",
    "WITH a AS (SELECT *, least(640.0::DOUBLE / height, 800.0::DOUBLE / width) AS g FROM images),"
    " b AS (SELECT *, round_even(width * g, 0)::DOUBLE AS uw, round_even(height * g, 0)::DOUBLE AS uh FROM a),"
    " c AS (SELECT *, ((800 - uw) % 32) / 2 AS dw, ((640 - uh) % 32) / 2 AS dh FROM b)"
    " SELECT image_id, round(g, 6) AS ratio_w, round(g, 6) AS ratio_h, uw AS resized_w, uh AS resized_h,"
    " round_even(dw - 0.1::DOUBLE, 0)::DOUBLE AS \"left\", round_even(dh - 0.1::DOUBLE, 0)::DOUBLE AS top, round_even(dw + 0.1::DOUBLE, 0)::DOUBLE AS \"right\","
    " round_even(dh + 0.1::DOUBLE, 0)::DOUBLE AS bottom FROM c",
)
def g22(t):
    return t.images.select("image_id", *rounded(B.letterbox("width", "height", 800.0, 640.0, auto=True)))


@query(
    "g22_letterbox_labels", "det images",
    "WITH a AS (SELECT *, least(512.0::DOUBLE / height, 512.0::DOUBLE / width) AS g FROM images),"
    " b AS (SELECT *, round_even((512 - round_even(width * g, 0)::DOUBLE) / 2 - 0.1::DOUBLE, 0) AS px,"
    " round_even((512 - round_even(height * g, 0)::DOUBLE) / 2 - 0.1::DOUBLE, 0) AS py FROM a)"
    f" SELECT image_id, det_id, {sql6(x1='x1 * g + px', y1='y1 * g + py', x2='x2 * g + px', y2='y2 * g + py')} FROM det JOIN b USING (image_id)",
)
def g22b(t):
    lb = B.letterbox("width", "height", 512.0, 512.0)
    frames = t.images.select("image_id", *[lb[k].alias(k) for k in ("ratio_w", "ratio_h", "left", "top")])
    df = t.det.select(*KEY, *XYXY).join(frames, "image_id")
    s = B.scale_box(*XYXY, "ratio_w", "ratio_h")
    return df.select(*KEY, *rounded(B.shift_box(*s.values(), "left", "top")))


@query(
    "g23_normalize_scale_pad", "det images",
    f"SELECT image_id, det_id, {sql6(x1='x1 / width * 320 + 4', y1='y1 / height * 240 + 6', x2='x2 / width * 320 + 4', y2='y2 / height * 240 + 6')} FROM {SIZED}",
)
def g23(t):
    n = B.normalize_box(*XYXY, "width", "height")
    s = B.scale_box(*n.values(), 320, 240)
    return _sized(t).select(*KEY, *rounded(B.shift_box(*s.values(), 4, 6)))


@query(
    "g24_flip_boxes", "det images",
    f"SELECT image_id, det_id, {sql6(x1='width - x2', y1='height - y2', x2='width - x1', y2='height - y1')} FROM {SIZED}",
)
def g24(t):
    return _sized(t).select(*KEY, *rounded(B.flip_box(*XYXY, "width", "height")))


KPTS = """
SELECT image_id, det_id, cls, conf, CAST(k AS BIGINT) AS k, CASE WHEN k IN (0, 3) THEN x1 WHEN k IN (1, 2) THEN x2 ELSE (x1 + x2) / 2 END AS x,
       CASE WHEN k IN (0, 1) THEN y1 WHEN k IN (2, 3) THEN y2 ELSE (y1 + y2) / 2 END AS y,
       CASE WHEN (det_id + k) % 7 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS v
FROM det d, (VALUES (0), (1), (2), (3), (4)) s(k)"""


def _kpts(df, c, digits=6):
    return df.select(*KEY, F.posexplode(c).alias("k", "p")).select(
        *KEY, F.col("k").cast("bigint").alias("k"), *rounded({n: F.col(f"p.{n}") for n in ("x", "y", "v")}, digits)
    )


@query(
    "g24_flip_keypoints", "det images",
    f"SELECT image_id, det_id, CASE k WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE k END::BIGINT AS k,"
    f" round(width - x, 6) AS x, round(y, 6) AS y, v FROM ({KPTS}) q JOIN images USING (image_id)",
)
def g24k(t):
    df = t.kpts.select(*KEY, "keypoints").join(t.images, "image_id")
    return _kpts(df.withColumn("k2", P.flip_keypoints("keypoints", "width", [1, 0, 3, 2, 4])), "k2")


# A rotation by 10 degrees with scale 0.9 and a shift
AFFINE = [0.9 * math.cos(0.1745), -0.9 * math.sin(0.1745), 30.0, 0.9 * math.sin(0.1745), 0.9 * math.cos(0.1745), -20.0, 0.0, 0.0, 1.0]
A = [f"{v!r}::DOUBLE" for v in AFFINE]


def _proj(x, y, r):
    return f"({x} * {A[3 * r]} + {y} * {A[3 * r + 1]} + {A[3 * r + 2]})"


def _four(r):
    return ", ".join(_proj(x, y, r) for x, y in (("x1", "y1"), ("x2", "y2"), ("x1", "y2"), ("x2", "y1")))


@query(
    "g25_transform_boxes", "det",
    f"SELECT image_id, det_id, {sql6(x1=f'least({_four(0)})', y1=f'least({_four(1)})', x2=f'greatest({_four(0)})', y2=f'greatest({_four(1)})')} FROM det",
)
def g25(t):
    return t.det.select(*KEY, *rounded(B.transform_box(*XYXY, AFFINE)))


@query(
    "g26_transform_polygons", "det",
    f"WITH q AS ({POLYS}), p AS (SELECT image_id, det_id, pt, {_proj('x', 'y', 0)} AS x, {_proj('x', 'y', 1)} AS y FROM q), e AS (SELECT image_id, det_id,"
    " (min(x) < 0)::INT + (min(y) < 0)::INT + (max(x) > 320)::INT + (max(y) > 320)::INT AS o FROM p GROUP BY 1, 2),"
    " c AS (SELECT p.image_id, p.det_id, CASE WHEN o >= 3 THEN greatest(least(x, 320), 0) ELSE x END AS x,"
    " CASE WHEN o >= 3 THEN greatest(least(y, 320), 0) ELSE y END AS y FROM p JOIN e USING (image_id, det_id)),"
    " i AS (SELECT image_id, det_id, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM c"
    " WHERE x >= 0 AND y >= 0 AND x <= 320 AND y <= 320 GROUP BY 1, 2 HAVING bool_or(x <> 0))"
    " SELECT image_id, det_id, pt, round(greatest(least(x, coalesce(x2, 0)), coalesce(x1, 0)), 6) AS x,"
    " round(greatest(least(y, coalesce(y2, 0)), coalesce(y1, 0)), 6) AS y FROM p LEFT JOIN i USING (image_id, det_id)",
)
def g26(t):
    _, poly = P.transform_polygon("polygon", AFFINE, 320, 320)
    return _points(t.polys.withColumn("points", poly))


@query(
    "g27_transform_keypoints", "det",
    f"WITH m AS (SELECT image_id, det_id, k, {_proj('x', 'y', 0)} AS x, {_proj('x', 'y', 1)} AS y, v FROM ({KPTS}) q)"
    " SELECT image_id, det_id, k, round(x, 6) AS x, round(y, 6) AS y, CASE WHEN x < 0 OR y < 0 OR x > 320 OR y > 320 THEN 0 ELSE v END AS v FROM m",
)
def g27(t):
    return _kpts(t.kpts.withColumn("k2", P.transform_keypoints("keypoints", AFFINE, 320, 320)), "k2")


def _trunc(e):
    return f"trunc({e})::BIGINT"


@query(
    "g30_crop_window", "det images",
    "WITH b AS (SELECT image_id, det_id, width, height, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, greatest(x2 - x1, y2 - y1) * 1.02::DOUBLE + 10 AS s"
    f" FROM {SIZED}) SELECT image_id, det_id, greatest(least({_trunc('cx - s / 2')}, width), 0)::BIGINT AS x1, greatest(least({_trunc('cy - s / 2')}, height), 0)::BIGINT AS y1,"
    f" greatest(least({_trunc('cx + s / 2')}, width), 0)::BIGINT AS x2, greatest(least({_trunc('cy + s / 2')}, height), 0)::BIGINT AS y2 FROM b",
)
def g30(t):
    return _sized(t).select(*KEY, *B.named(B.crop_window(*XYXY, "width", "height", square=True)))


@query(
    "g31_square_crop", "det images",
    f"WITH a AS (SELECT image_id, det_id, width, height, {_trunc('x1')} AS x1, {_trunc('y1')} AS y1, {_trunc('x2')} AS x2, {_trunc('y2')} AS y2 FROM {SIZED}),"
    f" b AS (SELECT *, {_trunc('(x2 - x1) * 10 / 100.0::DOUBLE')} AS mx, {_trunc('(y2 - y1) * 10 / 100.0::DOUBLE')} AS my FROM a),"
    " c AS (SELECT image_id, det_id, width, height, greatest(0, x1 - mx) AS l, greatest(0, y1 - my) AS t, least(width, x2 + mx) AS r, least(height, y2 + my) AS b FROM b),"
    " d AS (SELECT *, (t + b) // 2 AS cy, (l + r) // 2 AS cx, greatest(b - t, r - l) // 2 AS hs FROM c)"
    " SELECT image_id, det_id, greatest(0, cx - hs)::BIGINT AS x1, greatest(0, cy - hs)::BIGINT AS y1, least(width, cx + hs)::BIGINT AS x2, least(height, cy + hs)::BIGINT AS y2 FROM d",
)
def g31(t):
    return _sized(t).select(*KEY, *B.named(B.square_crop(*XYXY, "width", "height")))


@query("g32_uncrop", "det", f"SELECT image_id, det_id, {sql6(x1='x1 + jit', y1='y1 + 2 * jit', x2='x2 + jit', y2='y2 + 2 * jit')} FROM det")
def g32(t):
    return t.det.select(*KEY, *rounded(B.uncrop_box(*XYXY, "jit", F.col("jit") * 2)))


@query(
    "g33_snap_to_border", "det images",
    "SELECT image_id, det_id, CASE WHEN x1 < 20 THEN 0 ELSE x1 END AS x1, CASE WHEN y1 < 20 THEN 0 ELSE y1 END AS y1,"
    f" CASE WHEN x2 > width - 400 THEN width::DOUBLE ELSE x2 END AS x2, CASE WHEN y2 > height - 400 THEN height::DOUBLE ELSE y2 END AS y2 FROM {SIZED}".replace("400", "20"),
)
def g33(t):
    df = _sized(t).withColumns({"width": F.col("width").cast("double"), "height": F.col("height").cast("double")})
    return df.select(*KEY, *rounded(B.snap_to_border(*XYXY, "width", "height")))


@query(
    "g34_undo_view", "det images",
    "WITH b AS (SELECT image_id, det_id, width, height, (x1 + x2) / 2 / 0.83::DOUBLE AS cx, (y1 + y2) / 2 / 0.83::DOUBLE AS cy, (x2 - x1) / 0.83::DOUBLE AS w, (y2 - y1) / 0.83::DOUBLE AS h,"
    f" det_id % 4 AS f FROM {SIZED}) SELECT image_id, det_id, {sql6(cx='CASE WHEN f = 3 THEN width - cx ELSE cx END', cy='CASE WHEN f = 2 THEN height - cy ELSE cy END', w='w', h='h')} FROM b",
)
def g34(t):
    b = B.xyxy2xywh(*XYXY)
    return _sized(t).select(*KEY, *rounded(B.undo_view(*b.values(), 0.83, F.col("det_id") % 4, "width", "height")))


@query("g35_area", "det", "SELECT image_id, det_id, round((x2 - x1) * (y2 - y1), 6) AS area FROM det")
def g35(t):
    return t.det.select(*KEY, *r6(area=B.area(*XYXY)))


@query("g36_center", "det", "SELECT image_id, det_id, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy, round(sqrt(pow((x1 + x2) / 2 - 320, 2) + pow((y1 + y2) / 2 - 240, 2)), 6) AS from_center FROM det")
def g36(t):
    b = B.xyxy2xywh(*XYXY)
    return t.det.select(*KEY, *r6(cx=b["cx"], cy=b["cy"], from_center=B.distance(b["cx"], b["cy"], 320.0, 240.0)))


@query(
    "g37_joint_angle", "det",
    "WITH a AS (SELECT image_id, det_id, abs((atan2((y1 + y2) / 2 - y2, (x1 + x2) / 2 - x2) - atan2(y1 - y2, x1 - x2 + conf)) * 180.0::DOUBLE / pi()) AS d FROM det)"
    " SELECT image_id, det_id, round(CASE WHEN d > 180 THEN 360 - d ELSE d END, 6) AS angle FROM a",
)
def g37(t):
    b = B.xyxy2xywh(*XYXY)
    return t.det.select(*KEY, *r6(angle=P.joint_angle(F.col("x1") + F.col("conf"), "y1", "x2", "y2", b["cx"], b["cy"])))


@query(
    "g38_hide_uncertain", "det",
    f"SELECT image_id, det_id, k, round(CASE WHEN v < 0.5 THEN 0 ELSE x END / 640, 9) AS x, round(CASE WHEN v < 0.5 THEN 0 ELSE y END / 480, 9) AS y, round(v, 9) AS v FROM (SELECT image_id, det_id, k, x, y, v * conf AS v FROM ({KPTS}) q) s",
)
def g38(t):
    c = F.col("conf")
    scored = t.kpts.withColumn("s", P.map_keypoints("keypoints", lambda x, y, v: (x, y, v * c)))
    return _kpts(scored.withColumn("k2", P.normalize_keypoints(P.hide_uncertain("s"), 640, 480)), "k2", 9)


@query(
    "g39_normalized_views", "det images",
    f"SELECT image_id, det_id, {sql9(x1='x1 / width', y1='y1 / height', x2='x2 / width', y2='y2 / height', cx='(x1 + x2) / 2 / width', cy='(y1 + y2) / 2 / height', w='(x2 - x1) / width', h='(y2 - y1) / height')} FROM {SIZED}",
)
def g39(t):
    return _sized(t).select(
        *KEY, *rounded(B.normalize_box(*XYXY, "width", "height"), 9), *rounded(B.xyxy2xywhn(*XYXY, "width", "height"), 9)
    )


@query("g39_normalized_corners", "obb images", f"SELECT image_id, det_id, pt, round(x / width, 9) AS x, round(y / height, 9) AS y FROM ({CORNERS}) c JOIN images USING (image_id)")
def g39c(t):
    df = _corners(t).join(t.images, "image_id")
    w, h = F.col("width"), F.col("height")
    return _points(df.withColumn("points", P.map_xy("points", lambda x, y: (x / w, y / h))), digits=9)
