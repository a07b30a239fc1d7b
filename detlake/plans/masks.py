"""Queries over masks, tiles, polygon windows and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rotated import corners, point
from ..operators import joins as J
from ..operators import masks as K
from ..operators import tiles as TL
from .evaluation import COUNTS, MATCH, THR, _counts
from .registry import query, r6

BOX = ("x1", "y1", "x2", "y2")
# pixel boxes of the filled sample polygons at a quarter of the size: centres inside
PX = "ceil(x1 / 4 - 0.5)::BIGINT AS a, ceil(x2 / 4 - 0.5)::BIGINT AS c, ceil(y1 / 4 - 0.5)::BIGINT AS b, ceil(y2 / 4 - 0.5)::BIGINT AS d"
MP = f"mp AS (SELECT image_id, det_id, cls, conf, {PX} FROM det)"
MG = f"mg AS (SELECT image_id, ann_id, cls, {PX} FROM gt)"


def _runs(t, *more):
    return K.polygon_runs(t.polys, ("image_id", "det_id", *more), ratio=4.0)


def _gt_runs(t):
    poly = F.array(point("x1", "y1"), point("x2", "y1"), point("x2", "y2"), point("x1", "y2"))
    return K.polygon_runs(t.gt.withColumn("polygon", poly), ("image_id", "ann_id", "cls"), ratio=4.0)


@query("g43_polygon_runs", "det", f"WITH {MP} SELECT image_id, det_id, d - b AS rows, (d - b) * (c - a) AS area, b AS top FROM mp")
def g43(t):
    r = _runs(t)
    return r.groupBy("image_id", "det_id").agg(
        F.count("*").alias("rows"), F.sum(F.col("x1") - F.col("x0")).alias("area"), F.min("y").alias("top")
    )


# every scanline through a pixel centre cuts the outline of a rotated box twice or not at all
ROTATED = """WITH v AS (SELECT image_id, det_id, cx / 4 AS cx, cy / 4 AS cy, cos(r) * w / 8 AS ax, sin(r) * w / 8 AS ay, -sin(r) * h / 8 AS ex, cos(r) * h / 8 AS ey FROM obb),
co AS (SELECT image_id, det_id, list_value({'x': cx + ax + ex, 'y': cy + ay + ey}, {'x': cx + ax - ex, 'y': cy + ay - ey}, {'x': cx - ax - ex, 'y': cy - ay - ey}, {'x': cx - ax + ex, 'y': cy - ay + ey}) AS p FROM v),
eg AS (SELECT image_id, det_id, p[k] AS a, p[k % 4 + 1] AS b FROM co, (VALUES (1), (2), (3), (4)) e(k)),
sl AS (SELECT *, unnest(range(CAST(ceil(least(a.y, b.y) - 0.5) AS BIGINT), CAST(ceil(greatest(a.y, b.y) - 0.5) AS BIGINT))) AS y FROM eg),
cu AS (SELECT image_id, det_id, y, a.x + (b.x - a.x) * (y + 0.5 - a.y) / (b.y - a.y) AS x FROM sl),
ro AS (SELECT image_id, det_id, y, greatest(ceil(max(x) - 0.5) - ceil(min(x) - 0.5), 0) AS n FROM cu GROUP BY 1, 2, 3)
SELECT image_id, det_id, CAST(sum(n) AS BIGINT) AS area FROM ro GROUP BY 1, 2 HAVING sum(n) > 0"""


@query("g43_rotated_runs", "obb", ROTATED)
def g43r(t):
    """Area of filled rotated boxes."""
    o = t.obb.withColumn("polygon", corners("cx", "cy", "w", "h", "r"))
    return K.run_area(K.polygon_runs(o, ("image_id", "det_id"), ratio=4.0), ("image_id", "det_id"))


@query(
    "g44_overlap_index", "det",
    f"WITH {MP}, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY (c - a) * (d - b) DESC, det_id) AS rank FROM mp),"
    " xs AS (SELECT DISTINCT image_id, a AS x FROM k UNION SELECT image_id, c FROM k), ys AS (SELECT DISTINCT image_id, b AS y FROM k UNION SELECT image_id, d FROM k),"
    " xi AS (SELECT image_id, x, lead(x) OVER (PARTITION BY image_id ORDER BY x) AS x2 FROM xs), yi AS (SELECT image_id, y, lead(y) OVER (PARTITION BY image_id ORDER BY y) AS y2 FROM ys),"
    " ce AS (SELECT xi.image_id, x, x2, y, y2, max(rank) AS rank FROM xi JOIN yi ON xi.image_id = yi.image_id JOIN k ON k.image_id = xi.image_id AND a <= x AND x2 <= c AND b <= y AND y2 <= d GROUP BY ALL)"
    " SELECT image_id, CAST(rank AS INT) AS rank, CAST(sum((x2 - x) * (y2 - y)) AS BIGINT) AS pixels FROM ce GROUP BY 1, 2",
)
def g44(t):
    out = K.overlap_index(_runs(t), "det_id")
    return out.groupBy("image_id", "rank").agg(F.sum(F.col("x1") - F.col("x0")).alias("pixels"))


CROPPED = "greatest(a, 20) AS a, least(c, 60) AS c, greatest(b, 15) AS b, least(d, 45) AS d"


def _cropped(t):
    box = {"bx1": 19.5, "by1": 15.0, "bx2": 59.25, "by2": 45.0}
    return K.crop_runs(_runs(t).withColumns({n: F.lit(v) for n, v in box.items()}))


@query("g45_crop_mask", "det", f"WITH {MP}, q AS (SELECT image_id, det_id, {CROPPED} FROM mp) SELECT image_id, det_id, (c - a) * (d - b) AS area FROM q WHERE a < c AND b < d")
def g45(t):
    return K.run_area(_cropped(t), ("image_id", "det_id"))


@query("g46_mask_box", "det", f"WITH {MP}, q AS (SELECT image_id, det_id, {CROPPED} FROM mp), z AS (SELECT *, a < c AND b < d AS ok FROM q) SELECT image_id, det_id, CASE WHEN ok THEN a ELSE 0 END AS x1, CASE WHEN ok THEN b ELSE 0 END AS y1, CASE WHEN ok THEN c - 1 ELSE 0 END AS x2, CASE WHEN ok THEN d - 1 ELSE 0 END AS y2 FROM z")
def g46(t):
    return K.mask_box(t.det, _cropped(t), ("image_id", "det_id"))


SHARED = "(greatest(least(p.c, g.c) - greatest(p.a, g.a), 0) * greatest(least(p.d, g.d) - greatest(p.b, g.b), 0))"
MIOU = f"({SHARED} / ((p.c - p.a) * (p.d - p.b) + (g.c - g.a) * (g.d - g.b) - {SHARED} + 0.0000001::DOUBLE))"


@query("m04_mask_iou", "det gt", f"WITH {MP}, {MG} SELECT p.image_id, det_id, ann_id, {SHARED} AS shared, round({MIOU}, 6) AS iou FROM mp p JOIN mg g ON p.image_id = g.image_id AND p.cls = g.cls WHERE {SHARED} > 0")
def m04(t):
    t = t.stored()
    out = K.mask_overlap(_runs(t, "cls"), _gt_runs(t), "det_id", "ann_id", keys=("cls",))
    return out.select("image_id", "det_id", "ann_id", "shared", *r6(iou=F.col("iou")))


MASK_PAIRS = f"SELECT p.image_id, det_id, ann_id, conf, {MIOU} AS sim FROM mp p JOIN mg g ON p.image_id = g.image_id AND p.cls = g.cls WHERE {MIOU} >= 0.5"


@query("x02_match_masks", "det gt", f"WITH {MP}, {MG}, {MATCH.format(pairs=MASK_PAIRS, thr=THR, det='det')} {COUNTS}")
def x02m(t):
    t = t.stored()
    return _counts(K.match_masks(t.det.select("image_id", "det_id", "cls", "conf"), _runs(t, "cls"), _gt_runs(t)))


WIN = """WITH RECURSIVE wn AS (SELECT image_id, width, height, unnest(range(0, CASE WHEN width <= 400 THEN 1 ELSE ceil((width - 400) / 320.0::DOUBLE + 1)::INT END)) AS i FROM images),
wx AS (SELECT image_id, width, height, CASE WHEN i * 320 + 400 > width AND width > 400 THEN width - 400 ELSE i * 320 END AS x FROM wn),
wm AS (SELECT *, unnest(range(0, CASE WHEN height <= 400 THEN 1 ELSE ceil((height - 400) / 320.0::DOUBLE + 1)::INT END)) AS j FROM wx),
wy AS (SELECT image_id, width, height, x, CASE WHEN j * 320 + 400 > height AND height > 400 THEN height - 400 ELSE j * 320 END AS y FROM wm),
ws AS (SELECT *, (least(x + 400, width) - x) * (least(y + 400, height) - y) / 160000.0::DOUBLE AS s FROM wy),
wt AS (SELECT *, max(s) OVER (PARTITION BY image_id) AS m FROM ws),
win AS (SELECT image_id, CAST(ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY x, y) - 1 AS INT) AS window_id, x AS x1, y AS y1, x + 400 AS x2, y + 400 AS y2 FROM wt WHERE CASE WHEN m > 0.6 THEN s > 0.6 ELSE abs(s - m) < 0.01 END)"""


def _windows(t):
    return TL.windows(t.images, (400,), (80,))


@query("g42_windows", "images", WIN + " SELECT image_id, window_id, x1::BIGINT AS x1, y1::BIGINT AS y1, x2::BIGINT AS x2, y2::BIGINT AS y2 FROM win")
def g42(t):
    w = _windows(t)
    return w.select("image_id", "window_id", *[F.col(c).cast("bigint").alias(c) for c in BOX])


@query("g41_point_grid", "images", "SELECT image_id, CAST(i.range AS INT) AS i, CAST(j.range AS INT) AS j, round((j.range * 0.25::DOUBLE + 0.125) * width, 6) AS x, round((i.range * 0.25::DOUBLE + 0.125) * height, 6) AS y FROM images, range(4) i, range(4) j")
def g41(t):
    return TL.point_grid(t.images, 4).select("image_id", "i", "j", *r6(x=F.col("x"), y=F.col("y")))


@query(
    "g41_crop_boxes", "images",
    "WITH l AS (SELECT image_id, width AS w, height AS h, l.range + 1 AS layer, (2 ** (l.range + 1))::INT AS n FROM images, range(2) l), o AS (SELECT *, floor(least(w, h) * (0.34::DOUBLE * 2 / n))::BIGINT AS o FROM l),"
    " s AS (SELECT *, ceil((o * (n - 1) + w) / n)::BIGINT AS cw, ceil((o * (n - 1) + h) / n)::BIGINT AS ch, unnest(range(n)) AS i FROM o), g AS (SELECT *, unnest(range(n)) AS j FROM s)"
    " SELECT image_id, 0 AS layer, 0 AS x1, 0 AS y1, width AS x2, height AS y2 FROM images UNION ALL SELECT image_id, layer, (cw - o) * i, (ch - o) * j, least((cw - o) * i + cw, w), least((ch - o) * j + ch, h) FROM g",
)
def g41c(t):
    return TL.crop_boxes(t.images, 2, 0.34)


# rotated quads against windows: clipped by each side in turn, written as a recursion over the four sides
IOF = """, qd AS (SELECT image_id, det_id, [{x: cx + w / 2 * cos(r) - h / 2 * sin(r), y: cy + w / 2 * sin(r) + h / 2 * cos(r)}, {x: cx + w / 2 * cos(r) + h / 2 * sin(r), y: cy + w / 2 * sin(r) - h / 2 * cos(r)},
 {x: cx - w / 2 * cos(r) + h / 2 * sin(r), y: cy - w / 2 * sin(r) - h / 2 * cos(r)}, {x: cx - w / 2 * cos(r) - h / 2 * sin(r), y: cy - w / 2 * sin(r) + h / 2 * cos(r)}] AS p, w * h AS area FROM obb),
pr AS (SELECT image_id, det_id, window_id, area, p, [{k: 1, b: x1::DOUBLE, s: 1}, {k: 1, b: x2::DOUBLE, s: -1}, {k: 2, b: y1::DOUBLE, s: 1}, {k: 2, b: y2::DOUBLE, s: -1}] AS sides FROM qd JOIN win USING (image_id)
 WHERE greatest(p[1].x, p[2].x, p[3].x, p[4].x) > x1 AND least(p[1].x, p[2].x, p[3].x, p[4].x) < x2 AND greatest(p[1].y, p[2].y, p[3].y, p[4].y) > y1 AND least(p[1].y, p[2].y, p[3].y, p[4].y) < y2),
cl AS (SELECT image_id, det_id, window_id, area, sides, 1 AS step, p FROM pr UNION ALL SELECT image_id, det_id, window_id, area, sides, step + 1,
 flatten(list_transform(range(1, len(p) + 1), lambda i: CASE
  WHEN ((CASE WHEN sides[step].k = 1 THEN p[i].x ELSE p[i].y END) - sides[step].b) * sides[step].s >= 0 THEN [p[i]] ELSE [] END ||
  CASE WHEN (((CASE WHEN sides[step].k = 1 THEN p[i].x ELSE p[i].y END) - sides[step].b) * sides[step].s > 0 AND ((CASE WHEN sides[step].k = 1 THEN p[i % len(p) + 1].x ELSE p[i % len(p) + 1].y END) - sides[step].b) * sides[step].s < 0)
   OR (((CASE WHEN sides[step].k = 1 THEN p[i].x ELSE p[i].y END) - sides[step].b) * sides[step].s < 0 AND ((CASE WHEN sides[step].k = 1 THEN p[i % len(p) + 1].x ELSE p[i % len(p) + 1].y END) - sides[step].b) * sides[step].s > 0)
  THEN [CASE WHEN sides[step].k = 1 THEN {x: sides[step].b, y: p[i].y + (p[i % len(p) + 1].y - p[i].y) * (sides[step].b - p[i].x) / (p[i % len(p) + 1].x - p[i].x)}
   ELSE {x: p[i].x + (p[i % len(p) + 1].x - p[i].x) * (sides[step].b - p[i].y) / (p[i % len(p) + 1].y - p[i].y), y: sides[step].b} END] ELSE [] END)) FROM cl WHERE step <= 4),
io AS (SELECT image_id, det_id, window_id, coalesce(abs(list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i].x * p[i % len(p) + 1].y - p[i % len(p) + 1].x * p[i].y))) / 2, 0) / area AS iof FROM cl WHERE step = 5)"""


def _quads(t):
    return t.obb.select("image_id", "det_id", corners("cx", "cy", "w", "h", "r").alias("polygon"))


@query("m07_window_share", "obb images", WIN + IOF + " SELECT image_id, det_id, window_id, round(iof, 6) AS iof FROM io WHERE iof > 0.000001")
def m07(t):
    out = J.window_join(_quads(t), _windows(t), 1e-6)
    return out.select("image_id", "det_id", F.col("b_window_id").alias("window_id"), *r6(iof=F.col("iof")))


@query("j03_window_join", "obb images", WIN + IOF + " SELECT image_id, window_id, count(*) AS objects FROM io WHERE iof >= 0.7 GROUP BY 1, 2")
def j03(t):
    out = J.window_join(_quads(t), _windows(t), 0.7)
    return out.groupBy("image_id", F.col("b_window_id").alias("window_id")).agg(F.count("*").alias("objects"))


@query(
    "j03_window_labels", "obb images", WIN + IOF
    + " SELECT image_id, window_id, det_id" + "".join(f", round((qd.p[{k}].x - x1) / (least(x2, width) - x1)::DOUBLE, 6) AS px{k}, round((qd.p[{k}].y - y1) / (least(y2, height) - y1)::DOUBLE, 6) AS py{k}" for k in (1, 2, 3, 4))
    + " FROM io JOIN qd USING (image_id, det_id) JOIN win USING (image_id, window_id) JOIN images USING (image_id) WHERE iof >= 0.7",
)
def j03_labels(t):
    out = J.window_labels(_quads(t), _windows(t), t.images, 0.7)
    at = {f"p{c}{k + 1}": F.col("polygon")[k][c] for k in range(4) for c in "xy"}
    return out.select("image_id", F.col("b_window_id").alias("window_id"), "det_id", *r6(**at))


@query("m11_stability", "", "SELECT user_id AS mask_id, count(*) FILTER (WHERE value > 60) AS high, count(*) FILTER (WHERE value > 40) AS low, round(count(*) FILTER (WHERE value > 60) / nullif(count(*) FILTER (WHERE value > 40), 0), 6) AS stability FROM events GROUP BY 1")
def m11(t):
    e = t.table("events").select(F.col("user_id").alias("mask_id"), F.col("value").alias("score"))
    return K.stability_score(e, threshold=50, offset=10).withColumn("stability", F.round("stability", 6))


@query(
    "x15_select_by_prompt", "det gt",
    f"WITH {MP}, bx AS (SELECT image_id, ann_id AS prompt_id, trunc(x1 / 4)::INT AS a, trunc(y1 / 4)::INT AS b, trunc(x2 / 4)::INT AS c, trunc(y2 / 4)::INT AS d FROM gt WHERE ann_id % 3 = 0),"
    " sc AS (SELECT g.image_id, prompt_id, det_id, greatest(least(p.c, g.c) - greatest(p.a, g.a), 0) * greatest(least(p.d, g.d) - greatest(p.b, g.b), 0) AS n, (g.c - g.a) * (g.d - g.b) + (p.c - p.a) * (p.d - p.b) AS u FROM mp p JOIN bx g ON p.image_id = g.image_id),"
    " rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id, prompt_id ORDER BY n / (u - n)::DOUBLE DESC, det_id) AS k FROM sc),"
    " pt AS (SELECT image_id, ann_id AS prompt_id, floor((x1 + 20) / 4) AS x, floor((y1 + 20) / 4) AS y, ann_id % 2 AS label FROM gt), al AS (SELECT image_id, max(label) = 0 AS neg FROM pt GROUP BY 1),"
    " ls AS (SELECT p.image_id, det_id, arg_max(label, prompt_id) AS last FROM mp p JOIN pt ON p.image_id = pt.image_id AND x >= a AND x < c AND y >= b AND y < d GROUP BY 1, 2),"
    " pp AS (SELECT p.image_id, p.det_id FROM mp p JOIN al USING (image_id) LEFT JOIN ls ON ls.image_id = p.image_id AND ls.det_id = p.det_id WHERE CASE WHEN last IS NULL THEN neg ELSE last <> 0 END)"
    " SELECT image_id, det_id FROM rk WHERE k = 1 UNION SELECT image_id, det_id FROM pp",
)
def x15(t):
    t = t.stored()
    g = t.gt
    boxes = g.filter(F.col("ann_id") % 3 == 0).select("image_id", F.col("ann_id").alias("prompt_id"), *[(F.col(c) / 4).alias(c) for c in BOX])
    points = g.select("image_id", F.col("ann_id").alias("prompt_id"), ((F.col("x1") + 20) / 4).alias("x"), ((F.col("y1") + 20) / 4).alias("y"), (F.col("ann_id") % 2).alias("label"))
    return K.select_by_prompt(t.det.select("image_id", "det_id"), _runs(t), boxes, points, "det_id")


@query("g21_merge_parts", "det", "SELECT image_id, det_id, CASE det_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 10 ELSE 16 END AS points FROM det")
def g21(t):
    """Boxes as one, two or three parts side by side; the vertex order is checked in the tests."""
    def ring(dx):
        x1, x2 = F.col("x1") + dx, F.col("x2") + dx
        return F.array(point(x1, "y1"), point(x2, "y1"), point(x2, "y2"), point(x1, "y2"))

    rings = [ring(0), ring(300), ring(650)]
    k = F.col("det_id") % 3
    parts = F.when(k == 0, F.array(rings[0])).when(k == 1, F.array(*rings[:2])).otherwise(F.array(*rings))
    out = K.merge_parts(t.det.select("image_id", "det_id", parts.alias("parts")), ("image_id", "det_id"))
    return out.select("image_id", "det_id", F.size("polygon").alias("points"))


