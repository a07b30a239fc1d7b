"""Queries over filters, suppression, merging and assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..operators import assign as AS
from ..operators import joins as J
from ..operators import suppress as X
from .evaluation import IOU
from .pairs import inter, prob_sql, sq
from .registry import query, r6, sql6

BOX = ("x1", "y1", "x2", "y2")


def _det(t):
    return t.det.select("image_id", "det_id", "cls", "conf", *BOX)


@query("f01_keep", "det", "SELECT image_id, det_id, cls FROM det WHERE conf > 0.5")
def f01(t):
    return X.keep(_det(t), 0.5).select("image_id", "det_id", "cls")


@query("f02_keep_classes", "det", "SELECT image_id, det_id, cls FROM det WHERE conf > 0.25 AND cls IN (1, 3)")
def f02(t):
    return X.keep(_det(t), 0.25, [1, 3]).select("image_id", "det_id", "cls")


@query("f03_single_class", "det", "SELECT image_id, det_id, 0 AS cls FROM det WHERE conf > 0.25")
def f03(t):
    return X.keep(_det(t), 0.25, single_cls=True).select("image_id", "det_id", "cls")


CLIP = "least(greatest(x1 - 60, 0), 400) AS x1, least(greatest(y1 - 40, 0), 300) AS y1, least(greatest(x2 - 60, 0), 400) AS x2, least(greatest(y2 - 40, 0), 300) AS y2"


@query(
    "f04_box_candidates", "det",
    f"WITH c AS (SELECT image_id, det_id, (x2 - x1) * (y2 - y1) AS a, {CLIP} FROM det), s AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h FROM c)"
    " SELECT image_id, det_id FROM s WHERE w > 2 AND h > 2 AND w * h / (a + 1e-16) > 0.1 AND greatest(w / (h + 1e-16), h / (w + 1e-16)) < 100",
)
def f04(t):
    d = _det(t).withColumnsRenamed({c: f"o_{c}" for c in BOX})
    moved = B.clip_box(F.col("o_x1") - 60, F.col("o_y1") - 40, F.col("o_x2") - 60, F.col("o_y2") - 40, 400.0, 300.0)
    return X.box_candidates(d.withColumns(moved), [f"o_{c}" for c in BOX]).select("image_id", "det_id")


@query(
    "f07_near_crop_edge", "det images",
    "WITH b AS (SELECT image_id, det_id, width, height, x1 + 100 AS x1, y1 + 80 AS y1, x2 + 100 AS x2, y2 + 80 AS y2 FROM det JOIN images USING (image_id))"
    " SELECT image_id, det_id FROM b WHERE (abs(x1 - 100) <= 20 AND NOT abs(x1) <= 20) OR (abs(y1 - 80) <= 20 AND NOT abs(y1) <= 20)"
    " OR (abs(x2 - 500) <= 20 AND NOT abs(x2 - width) <= 20) OR (abs(y2 - 440) <= 20 AND NOT abs(y2 - height) <= 20)",
)
def f07(t):
    d = _det(t).join(t.images, "image_id")
    return d.filter(B.near_crop_edge(*BOX, 100.0, 80.0, 500.0, 440.0, "width", "height")).select("image_id", "det_id")


@query("f08_drop_empty", "det", f"WITH c AS (SELECT image_id, det_id, {CLIP.replace('400', '200').replace('300', '150')} FROM det) SELECT image_id, det_id FROM c WHERE (x2 - x1) * (y2 - y1) > 0")
def f08(t):
    b = B.clip_box(F.col("x1") - 60, F.col("y1") - 40, F.col("x2") - 60, F.col("y2") - 40, 200.0, 150.0)
    return X.drop_empty(_det(t).select("image_id", "det_id", *B.named(b))).select("image_id", "det_id")


@query(
    "f09_snap_full_image", "det images",
    "WITH b AS (SELECT image_id, det_id, width, height, 0.5::DOUBLE AS x1, 1.0::DOUBLE AS y1, least(x2 * 3, width) AS x2, least(y2 * 3, height) AS y2 FROM det JOIN images USING (image_id)),"
    " s AS (SELECT *, (least(x2, width) - x1) * (least(y2, height) - y1) AS i, (x2 - x1) * (y2 - y1) AS a FROM b), n AS (SELECT *, i / (width * height + a - i + 0.0000001::DOUBLE) > 0.9 AS f FROM s)"
    " SELECT image_id, det_id, CASE WHEN f THEN 0 ELSE x1 END AS x1, CASE WHEN f THEN 0 ELSE y1 END AS y1, CASE WHEN f THEN width ELSE x2 END AS x2, CASE WHEN f THEN height ELSE y2 END AS y2 FROM n",
)
def f09(t):
    d = _det(t).join(t.images, "image_id")
    d = d.withColumns(
        {"x1": F.lit(0.5), "y1": F.lit(1.0), "x2": F.least(F.col("x2") * 3, F.col("width").cast("double")), "y2": F.least(F.col("y2") * 3, F.col("height").cast("double"))}
    )
    return X.snap_full_image(d).select("image_id", "det_id", *BOX)


def NMS_SQL(group, iou, src="SELECT image_id, det_id, cls, conf, x1, y1, x2, y2 FROM det WHERE conf > 0.25", max_det=300):
    """Greedy suppression as a recursion over the rank inside a group."""
    on = " AND ".join(f"a.{g} = b.{g}" for g in group)
    gs = ", ".join(group)
    gg = ", ".join(f"g.{c}" for c in group)
    ong = " AND ".join(f"g.{c} = k.{c}" for c in group)
    plain = f"({inter()} / ({sq('a')} + {sq('b')} - {inter()}))"
    return f"""WITH RECURSIVE src AS ({src}),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {gs} ORDER BY conf DESC, det_id) AS rn FROM src),
sp AS (SELECT {', '.join('b.' + c for c in group)}, b.rn, list(a.rn) AS sup FROM rk a JOIN rk b ON {on} AND a.rn < b.rn WHERE {plain} > {iou} GROUP BY ALL),
k AS (SELECT rk.*, coalesce(sp.sup, []) AS sup FROM rk LEFT JOIN sp USING ({gs}, rn)),
g AS (SELECT {gs}, 1::BIGINT AS rn, [1::BIGINT] AS kept, image_id AS i0, det_id, cls AS c0, conf, true AS ok FROM k WHERE rn = 1
 UNION ALL SELECT {gg}, k.rn, CASE WHEN list_has_any(g.kept, k.sup) THEN g.kept ELSE list_append(g.kept, k.rn) END, k.image_id, k.det_id, k.cls, k.conf, NOT list_has_any(g.kept, k.sup)
 FROM g JOIN k ON {ong} AND k.rn = g.rn + 1),
res AS (SELECT i0 AS image_id, det_id, c0 AS cls, conf, ROW_NUMBER() OVER (PARTITION BY i0 ORDER BY conf DESC, det_id) AS q FROM g WHERE ok)
SELECT image_id, det_id, cls, round(conf, 6) AS conf FROM res WHERE q <= {max_det}"""


def _out(df):
    return df.select("image_id", "det_id", "cls", *r6(conf=F.col("conf")))


@query("x04_nms", "det", NMS_SQL(("image_id", "cls"), 0.45))
def x04(t):
    return _out(X.nms(_det(t), iou=0.45))


def _scored(t):
    c = F.col
    scores = F.array(*[F.when(c("cls") == k, c("conf")).otherwise(c("conf") * ((c("det_id") + k) % 5) / 10) for k in range(5)])
    return t.det.select("image_id", "det_id", *BOX, scores.alias("scores"))


SCORED = """SELECT image_id, det_id, x1, y1, x2, y2, k AS cls, CASE WHEN cls = k THEN conf ELSE conf * ((det_id + k) % 5) / 10 END AS conf
FROM det, (VALUES (0), (1), (2), (3), (4)) v(k)"""


@query("x04_nms_multi_label", "det", NMS_SQL(("image_id", "cls"), 0.6, f"SELECT image_id, det_id::BIGINT * 5 + cls AS det_id, cls, conf, x1, y1, x2, y2 FROM ({SCORED}) s WHERE conf > 0.25"))
def x04m(t):
    return _out(X.nms(X.decode_scores(_scored(t), conf=0.25, multi_label=True), iou=0.6))


@query("x05_nms_agnostic", "det", NMS_SQL(("image_id",), 0.45, max_det=3))
def x05(t):
    return _out(X.nms(_det(t), iou=0.45, agnostic=True, max_det=3))


ROT = f"""SELECT image_id, det_id, cls, round(conf, 6) AS conf FROM obb b WHERE NOT EXISTS (SELECT 1 FROM obb a WHERE a.image_id = b.image_id AND a.cls = b.cls
 AND (a.conf > b.conf OR (a.conf = b.conf AND a.det_id < b.det_id)) AND {prob_sql()} >= 0.45)"""


@query("x06_rotated_nms", "obb", ROT)
def x06(t):
    return _out(X.rotated_nms(t.obb))


@query("x07_pass_through", "det", "SELECT image_id, det_id, cls, round(conf, 6) AS conf FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) AS q FROM det WHERE conf > 0.25) z WHERE q <= 2")
def x07(t):
    return _out(X.pass_through(_det(t), max_det=2))


@query(
    "x08_decode_scores", "det images",
    f"WITH s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id, det_id ORDER BY conf DESC, cls) AS q FROM ({SCORED}) z)"
    f" SELECT image_id, det_id, cls, round(conf, 6) AS conf, {sql6(x1='width * (0.5::DOUBLE - (x2 - x1) / 1280)', x2='width * (0.5::DOUBLE + (x2 - x1) / 1280)')}, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id)::INT AS place"
    " FROM s JOIN images USING (image_id) WHERE q = 1",
)
def x08(t):
    from pyspark.sql import Window

    d = _scored(t).join(t.images, "image_id")
    d = d.withColumns({"cx": F.lit(0.5), "cy": F.lit(0.5), "w": (F.col("x2") - F.col("x1")) / 640, "h": F.lit(0.1)}).drop(*BOX)
    out = X.scale_decoded(X.decode_scores(d))
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(F.col("conf").desc(), "det_id"))
    return out.select("image_id", "det_id", "cls", *r6(conf=F.col("conf"), x1=F.col("x1"), x2=F.col("x2")), place.alias("place"))


TILED = "SELECT 'P' || (image_id // 4)::VARCHAR AS image_id, image_id * 32 + det_id AS det_id, cls, conf, cx + (image_id % 4) * 60 AS cx, cy + (image_id % 2) * 40 AS cy, w, h, r FROM obb"


@query("x09_merge_rotated_tiles", "obb", f"WITH q AS ({TILED}) " + ROT.replace("FROM obb b", "FROM q b").replace("FROM obb a", "FROM q a").replace(">= 0.45", ">= 0.3"))
def x09(t):
    i = F.col("image_id")
    tile = F.concat(
        F.lit("P"), F.floor(i / 4).cast("string"), F.lit("__1024__"), (i % 4 * 60).cast("string"), F.lit("___"), (i % 2 * 40).cast("string")
    )
    d = t.stored().obb.withColumn("det_id", i * 32 + F.col("det_id")).withColumn("image_id", tile)
    return _out(X.merge_rotated_tiles(d))


@query(
    "x10_merge_tiles", "det",
    NMS_SQL(
        ("image_id", "cls"), 0.5,
        "SELECT image_id // 3 AS image_id, image_id * 32 + det_id AS det_id, cls, conf, x1 + (image_id % 3) * 50 AS x1, y1 + (image_id % 3) * 30 AS y1, x2 + (image_id % 3) * 50 AS x2, y2 + (image_id % 3) * 30 AS y2 FROM det WHERE conf > 0.0",
    ),
)
def x10(t):
    i = F.col("image_id")
    d = _det(t).withColumns({"det_id": i * 32 + F.col("det_id"), "window_id": i % 3, "image_id": F.floor(i / 3)})
    w = t.images.select(F.floor(i / 3).alias("image_id"), (i % 3).alias("window_id"))
    w = w.withColumns({"x1": F.col("window_id") * 50, "y1": F.col("window_id") * 30})
    return _out(X.merge_tiles(d, w, 0.5))


VIEWS = """
SELECT image_id, det_id::BIGINT * 2 AS det_id, cls, conf, x1, y1, x2, y2 FROM det WHERE conf > 0.25 UNION ALL
SELECT image_id, det_id::BIGINT * 2 + 1, cls, conf, (640 - (x1 + x2) / 2 * 0.5::DOUBLE / 0.83::DOUBLE) - (x2 - x1) / 0.83::DOUBLE / 2, (y1 + y2) / 2 / 0.83::DOUBLE - (y2 - y1) / 0.83::DOUBLE / 2,
 (640 - (x1 + x2) / 2 * 0.5::DOUBLE / 0.83::DOUBLE) + (x2 - x1) / 0.83::DOUBLE / 2, (y1 + y2) / 2 / 0.83::DOUBLE + (y2 - y1) / 0.83::DOUBLE / 2 FROM det WHERE conf > 0.25"""


@query("x11_merge_views", "det", NMS_SQL(("image_id", "cls"), 0.3, VIEWS))
def x11(t):
    c = _det(t).transform(B.convert_boxes("xyxy", "xywh")).withColumns({"width": F.lit(640.0), "height": F.lit(640.0)})
    second = c.withColumn("cx", F.col("cx") * 0.5)
    return _out(X.merge_views((c, 1.0, 0), (second, 0.83, 3), iou=0.3))


def _assigned(t):
    """Detections to truths per image, costs 1 - IoU, limit 0.8."""
    pairs = J.overlap_join(_det(t), t.gt.select("image_id", "ann_id", *BOX), threshold=0.2)
    pairs = pairs.select("image_id", "det_id", F.col("b_ann_id").alias("ann_id"), (1 - F.col("sim")).alias("cost"))
    return AS.assign(pairs, ["image_id"], "det_id", "ann_id", "cost", 0.8)


@query("x12_assign")
def x12(t):
    return _assigned(t).select("image_id", "det_id", "ann_id", *r6(cost=F.col("cost")))


# the best matching by its definition: detections in turn take one of their free truths or none, for every set of taken truths
TOTALS = f"""WITH RECURSIVE pr AS (SELECT a.image_id, a.det_id, b.ann_id, {IOU} - 0.2 AS w FROM det a JOIN gt b ON a.image_id = b.image_id WHERE {IOU} > 0.2),
di AS (SELECT image_id, det_id, row_number() OVER (PARTITION BY image_id ORDER BY det_id) AS i FROM (SELECT DISTINCT image_id, det_id FROM pr)),
tj AS (SELECT image_id, ann_id, CAST(1 AS BIGINT) << CAST(row_number() OVER (PARTITION BY image_id ORDER BY ann_id) - 1 AS INT) AS bit FROM (SELECT DISTINCT image_id, ann_id FROM pr)),
op AS (SELECT image_id, i, CAST(0 AS BIGINT) AS bit, 0.0::DOUBLE AS w FROM di UNION ALL SELECT pr.image_id, di.i, tj.bit, pr.w FROM pr JOIN di USING (image_id, det_id) JOIN tj USING (image_id, ann_id)),
st AS (SELECT DISTINCT image_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS mask, 0.0::DOUBLE AS gain FROM di
  UNION ALL SELECT s.image_id, o.i, s.mask | o.bit, max(s.gain + o.w) FROM st s JOIN op o ON s.image_id = o.image_id AND o.i = s.i + 1 AND s.mask & o.bit = 0 GROUP BY 1, 2, 3)
SELECT image_id, round(max(gain), 6) AS gain FROM st GROUP BY 1"""


@query("x12_assign_totals", "det gt", TOTALS)
def x12t(t):
    """What the assignment gains per image over leaving all pairs open (the limit of 0.8 less the cost of each pair)."""
    return _assigned(t).groupBy("image_id").agg(F.round(F.sum(0.8 - F.col("cost")), 6).alias("gain"))


@query("l01_top_per_image", "det", "SELECT image_id, det_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) AS q FROM det) z WHERE q <= 3")
def l01(t):
    return X.top_per_group(_det(t), 3).select("image_id", "det_id")


@query("l02_cap_candidates", "det", "SELECT image_id, cls, det_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id, cls ORDER BY conf DESC, det_id) AS q FROM det) z WHERE q <= 1")
def l02(t):
    return X.top_per_group(_det(t), 1, ("image_id", "cls")).select("image_id", "cls", "det_id")


