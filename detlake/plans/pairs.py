"""Queries over similarity measures and pair joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rotated as R
from ..functions import similarity as S
from ..operators import joins as J
from ..operators import vectors as VX
from .registry import query, r6, sql6

BOX = ("x1", "y1", "x2", "y2")


def inter(a="a", b="b"):
    return (
        f"(greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * "
        f"greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0))"
    )


def sq(a):
    return f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1))"


EPS = "CAST(0.0000001 AS DOUBLE)"
IOU = f"({inter()} / ({sq('a')} + {sq('b')} - {inter()} + {EPS}))"
IOA = f"({inter()} / ({sq('b')} + {EPS}))"
PAIR = "det a JOIN gt b ON a.image_id = b.image_id"


def _boxes(t):
    return t.det.select("image_id", "det_id", "cls", "conf", *BOX)


def _truth(t):
    return t.gt.select("image_id", "ann_id", "cls", *BOX)


def _b(prefix=""):
    return [F.col(prefix + c) for c in BOX]


@query("m01_iou", "det gt", f"SELECT a.image_id, det_id, ann_id, round({IOU}, 6) AS iou FROM {PAIR} WHERE {IOU} >= 0.5")
def m01(t):
    p = J.overlap_join(_boxes(t), _truth(t), threshold=0.5)
    return p.select("image_id", "det_id", F.col("b_ann_id").alias("ann_id"), *r6(iou=F.col("sim")))


@query("m02_ioa", "det gt", f"SELECT a.image_id, det_id, ann_id, round({IOA}, 6) AS ioa, round({IOU}, 6) AS iou FROM {PAIR} WHERE {IOA} >= 0.7")
def m02(t):
    p = J.overlap_join(_boxes(t), _truth(t), threshold=0.7, measure=S.ioa)
    return p.select("image_id", "det_id", F.col("b_ann_id").alias("ann_id"), *r6(ioa=F.col("sim"), iou=S.iou(_b(), _b("b_"))))


GIOU = f"""
WITH p AS (SELECT a.image_id, det_id, ann_id, a.x2 - a.x1 AS wa, a.y2 - a.y1 + {EPS} AS ha, b.x2 - b.x1 AS wb, b.y2 - b.y1 + {EPS} AS hb,
  {inter()} AS i, greatest(a.x2, b.x2) - least(a.x1, b.x1) AS cw, greatest(a.y2, b.y2) - least(a.y1, b.y1) AS ch,
  (pow(b.x1 + b.x2 - a.x1 - a.x2, 2) + pow(b.y1 + b.y2 - a.y1 - a.y2, 2)) / 4 AS rho FROM {PAIR} WHERE {IOU} >= 0.3),
q AS (SELECT *, wa * ha + wb * hb - i + {EPS} AS u, cw * ch + {EPS} AS ca, 4 / (pi() * pi()) * pow(atan(wb / hb) - atan(wa / ha), 2) AS v FROM p),
s AS (SELECT *, i / u AS iou FROM q)
SELECT image_id, det_id, ann_id, round(iou, 6) AS iou, round(iou - (ca - u) / ca, 6) AS giou, round(iou - rho / (cw * cw + ch * ch + {EPS}), 6) AS diou,
  round(iou - (rho / (cw * cw + ch * ch + {EPS}) + v * (v / (v - iou + (1 + {EPS})))), 6) AS ciou FROM s"""


@query("m03_box_similarity", "det gt", GIOU)
def m03(t):
    p = J.overlap_join(_boxes(t), _truth(t), threshold=0.3)
    kinds = {k: S.box_similarity(_b(), _b("b_"), k) for k in ("iou", "giou", "diou", "ciou")}
    return p.select("image_id", "det_id", F.col("b_ann_id").alias("ann_id"), *r6(**kinds))


# keypoints of detections and truths share the box layout; visibility follows the row's own id
OKS = f"""
WITH s(k, g) AS (VALUES (0, pow(2 * 0.2::DOUBLE, 2)), (1, pow(2 * 0.2::DOUBLE, 2)), (2, pow(2 * 0.2::DOUBLE, 2)), (3, pow(2 * 0.2::DOUBLE, 2)), (4, pow(2 * 0.2::DOUBLE, 2))),
p AS (SELECT a.image_id, det_id, ann_id, k, g, 0.53::DOUBLE * {sq('b')} AS area, (ann_id + k) % 7 <> 0 AS vis,
  CASE WHEN k IN (0, 3) THEN pow(a.x1 - b.x1, 2) WHEN k IN (1, 2) THEN pow(a.x2 - b.x2, 2) ELSE pow((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, 2) END
  + CASE WHEN k IN (0, 1) THEN pow(a.y1 - b.y1, 2) WHEN k IN (2, 3) THEN pow(a.y2 - b.y2, 2) ELSE pow((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2) END AS d
  FROM {PAIR}, s WHERE {IOU} >= 0.5),
o AS (SELECT image_id, det_id, ann_id, sum(CASE WHEN vis THEN exp(-(d / (g * (area + {EPS}) * 2))) ELSE 0 END) / (count(*) FILTER (WHERE vis) + {EPS}) AS oks FROM p GROUP BY 1, 2, 3)
SELECT image_id, det_id, ann_id, round(oks, 6) AS oks FROM o"""


def gt_keypoints(t):
    from .registry import keypoints_of

    return t.gt.withColumn("keypoints", keypoints_of("ann_id"))


@query("m05_keypoint_similarity", "det gt", OKS)
def m05(t):
    det = t.kpts.select("image_id", "det_id", *BOX, "keypoints")
    ann = gt_keypoints(t).select("image_id", "ann_id", *BOX, "keypoints")
    p = J.overlap_join(det, ann, threshold=0.5)
    size = F.lit(0.53) * (F.col("b_x2") - F.col("b_x1")) * (F.col("b_y2") - F.col("b_y1"))
    oks = S.keypoint_similarity("b_keypoints", "keypoints", size, [0.2] * 5)
    return p.select("image_id", "det_id", F.col("b_ann_id").alias("ann_id"), *r6(oks=oks))


def prob_sql(a="a", b="b", aspect=False):
    """Gaussian similarity of two rows of the rotated-box view."""

    def var(t):
        c, s = f"cos({t}.r)", f"sin({t}.r)"
        p, q = f"({t}.w * {t}.w / 12)", f"({t}.h * {t}.h / 12)"
        return f"({p} * {c} * {c} + {q} * {s} * {s})", f"({p} * {s} * {s} + {q} * {c} * {c})", f"(({p} - {q}) * {c} * {s})"

    (p1, q1, c1), (p2, q2, c2) = var(a), var(b)
    p, q, c = f"({p1} + {p2})", f"({q1} + {q2})", f"({c1} + {c2})"
    det = f"({p} * {q} - {c} * {c})"
    dx, dy = f"({a}.cx - {b}.cx)", f"({a}.cy - {b}.cy)"
    t1 = f"(({p} * {dy} * {dy} + {q} * {dx} * {dx}) / ({det} + {EPS}) * 0.25::DOUBLE)"
    t2 = f"({c} * (-{dx}) * {dy} / ({det} + {EPS}) * 0.5::DOUBLE)"
    own = f"(greatest({p1} * {q1} - {c1} * {c1}, 0) * greatest({p2} * {q2} - {c2} * {c2}, 0))"
    t3 = f"(ln({det} / (4 * sqrt({own}) + {EPS}) + {EPS}) * 0.5::DOUBLE)"
    bd = f"least(greatest({t1} + {t2} + {t3}, {EPS}), 100.0::DOUBLE)"
    return f"(1 - sqrt(1 - exp(-{bd}) + {EPS}))"


@query(
    "m06_gaussian_overlap", "obb",
    f"WITH p AS (SELECT a.image_id, a.det_id AS det_a, b.det_id AS det_b, {prob_sql()} AS sim, 4 / (pi() * pi()) * pow(atan(b.w / b.h) - atan(a.w / a.h), 2) AS v"
    " FROM obb a JOIN obb b ON a.image_id = b.image_id AND a.det_id < b.det_id)"
    f" SELECT image_id, det_a, det_b, round(sim, 6) AS sim, round(sim - v * (v / (v - sim + (1 + {EPS}))), 6) AS with_aspect FROM p WHERE sim >= 0.2",
)
def m06(t):
    from ..operators.match import rotated_pairs

    o = t.obb.select("image_id", "det_id", "cx", "cy", "w", "h", "r")
    p = rotated_pairs(o, o, ["image_id"], 0.2, lambda L, Rr: L("det_id") < Rr("det_id"))
    rb = ("cx", "cy", "w", "h", "r")
    asp = R.aspect_penalty(F.col("sim"), rb, [f"b_{c}" for c in rb])
    return p.select(
        "image_id", F.col("det_id").alias("det_a"), F.col("b_det_id").alias("det_b"), *r6(sim=F.col("sim"), with_aspect=asp)
    )


@query(
    "m08_fused_cost", "det gt",
    f"SELECT a.image_id, det_id, ann_id, round(1 - {IOU}, 6) AS cost, round(1 - {IOU} * conf, 6) AS fused FROM {PAIR} WHERE {IOU} >= 0.2",
)
def m08(t):
    p = J.overlap_join(_boxes(t), _truth(t), threshold=0.2)
    return p.select(
        "image_id", "det_id", F.col("b_ann_id").alias("ann_id"), *r6(cost=1 - F.col("sim"), fused=S.fused_cost("sim", "conf"))
    )


@query(
    "m09_cosine_distance", "",
    "WITH e AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),"
    " p AS (SELECT a.vec_id, b.vec_id AS other, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))"
    " / (sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x * x)))) AS s"
    " FROM e a JOIN e b ON b.vec_id = a.vec_id + 1) SELECT vec_id, other, round(greatest(0, 1 - s), 6) AS dist FROM p",
)
def m09(t):
    e = t.table("embeddings").select("vec_id", "embedding")
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("e2"))
    return e.join(o, "vec_id").select("vec_id", "other", *r6(dist=S.cosine_distance("embedding", "e2")))


@query(
    "m09_frame_pairs", "",
    "WITH e AS (SELECT vec_id, vec_id // 250 AS frame_no, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),"
    " u AS (SELECT vec_id, frame_no, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda z: z * z)))) AS v FROM e)"
    " SELECT a.frame_no, a.vec_id, b.vec_id AS other, round(greatest(0, 1 - list_inner_product(a.v, b.v)), 6) AS dist FROM u a JOIN u b"
    " ON a.frame_no = b.frame_no AND a.vec_id < b.vec_id WHERE greatest(0, 1 - list_inner_product(a.v, b.v)) <= 0.8",
)
def m09_frames(t):
    """All pairs of a frame of 250 vectors within a cosine distance of 0.8."""
    e = t.table("embeddings").withColumn("frame_no", F.floor(F.col("vec_id") / 250))
    return VX.similar_pairs(e, ["frame_no"], "vec_id", "embedding", 0.8).withColumn("dist", F.round("dist", 6))


@query("j01_overlap_join", "det gt", f"SELECT a.image_id, a.cls, count(*) AS pairs, {sql6(mean_iou=f'avg({IOU})')} FROM {PAIR} AND a.cls = b.cls WHERE {IOU} >= 0.5 GROUP BY 1, 2")
def j01(t):
    p = J.overlap_join(_boxes(t), _truth(t).drop("x"), ("image_id", "cls"), threshold=0.5)
    return p.groupBy("image_id", "cls").agg(F.count("*").alias("pairs"), F.round(F.avg("sim"), 6).alias("mean_iou"))


@query(
    "j02_self_overlap", "det",
    f"SELECT a.image_id, a.det_id AS det_a, b.det_id AS det_b, round({IOU}, 6) AS iou FROM det a JOIN det b ON a.image_id = b.image_id AND a.cls = b.cls"
    f" WHERE (a.conf > b.conf OR (a.conf = b.conf AND a.det_id < b.det_id)) AND {IOU} >= 0.45",
)
def j02(t):
    p = J.self_overlap(_boxes(t), ("image_id", "cls"), 0.45)
    return p.select("image_id", F.col("det_id").alias("det_a"), F.col("b_det_id").alias("det_b"), *r6(iou=F.col("sim")))


@query("j07_missing_labels", "images gt", "SELECT image_id, split FROM images WHERE image_id NOT IN (SELECT image_id FROM gt)")
def j07(t):
    return J.missing_labels(t.images, t.gt).select("image_id", "split")


@query(
    "j07_images_with_labels", "images gt",
    "SELECT i.image_id, split, count(ann_id) AS labels FROM images i LEFT JOIN gt USING (image_id) GROUP BY 1, 2",
)
def j07b(t):
    ann = t.gt.select("image_id", "ann_id")
    return J.with_labels(t.images, ann).groupBy("image_id", "split").agg(F.count("ann_id").alias("labels"))


@query(
    "j08_map_classes", "gt",
    "SELECT image_id, ann_id, CASE cls WHEN 0 THEN 10 WHEN 1 THEN 11 WHEN 2 THEN NULL WHEN 3 THEN 13 END AS cls FROM gt",
)
def j08(t):
    return J.map_classes(t.gt.select("image_id", "ann_id", "cls"), {0: 10, 1: 11, 2: None, 3: 13})


TS = "(SELECT video_id, frame_no, track_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM tracks)"


@query(
    "j10_track_sets", "tracks",
    "WITH a AS (SELECT DISTINCT track_id FROM tracks WHERE frame_no % 3 = 0), b AS (SELECT DISTINCT track_id FROM tracks WHERE frame_no % 5 = 1)"
    " SELECT 'union' AS kind, track_id FROM (SELECT * FROM a UNION SELECT * FROM b) u UNION ALL SELECT 'minus' AS kind, track_id FROM a WHERE track_id NOT IN (SELECT track_id FROM b)",
)
def j10(t):
    a = t.tracks.filter("frame_no % 3 = 0").select("track_id").distinct()
    b = t.tracks.filter("frame_no % 5 = 1").select("track_id").distinct()
    u = J.merge_tracks(a, b).select(F.lit("union").alias("kind"), "track_id")
    return u.unionByName(J.subtract_tracks(a, b).select(F.lit("minus").alias("kind"), "track_id"))


DUP = f"""
WITH d AS (SELECT image_id AS video_id, det_id AS track_id, det_id % 3 AS start_frame, 9 AS frame_no, x1, y1, x2, y2 FROM det),
g AS (SELECT image_id AS video_id, ann_id AS track_id, ann_id % 4 AS start_frame, 9 AS frame_no, x1, y1, x2, y2 FROM gt),
p AS (SELECT a.video_id, a.track_id AS ta, b.track_id AS tb, (a.frame_no - a.start_frame) > (b.frame_no - b.start_frame) AS older
  FROM d a JOIN g b ON a.video_id = b.video_id WHERE 1 - {IOU} < 0.15)
SELECT 'a' AS side, video_id, track_id FROM d WHERE (video_id, track_id) NOT IN (SELECT (video_id, ta) FROM p WHERE NOT older)
UNION ALL SELECT 'b', video_id, track_id FROM g WHERE (video_id, track_id) NOT IN (SELECT (video_id, tb) FROM p WHERE older)"""


@query("j11_duplicate_tracks", "det gt", DUP)
def j11(t):
    def side(df, uid, m):
        return df.select(
            F.col("image_id").alias("video_id"), F.col(uid).alias("track_id"), (F.col(uid) % m).alias("start_frame"),
            F.lit(9).alias("frame_no"), *BOX,
        )

    a, b = J.drop_duplicate_tracks(side(t.det, "det_id", 3), side(t.gt, "ann_id", 4))
    out = a.select(F.lit("a").alias("side"), "video_id", "track_id")
    return out.unionByName(b.select(F.lit("b").alias("side"), "video_id", "track_id"))


@query(
    "j13_prior_labels", "det gt",
    "SELECT image_id, count(*) AS n, round(max(conf), 6) AS best, count(*) FILTER (WHERE det_id < 0) AS added FROM"
    " (SELECT image_id, det_id, conf FROM det UNION ALL SELECT image_id, -ann_id - 1, 1.0 FROM gt) u GROUP BY 1",
)
def j13(t):
    u = J.with_prior_labels(_boxes(t), _truth(t))
    return u.groupBy("image_id").agg(
        F.count("*").alias("n"), F.round(F.max("conf"), 6).alias("best"), F.count_if(F.col("det_id") < 0).alias("added")
    )


# boxes of 4 to 32,768 px on rasters of 200,000 px; one in 500 is endless for all practical purposes
SLIDE = """
SELECT image_id % 61 AS slide_id, image_id * 8 + det_id AS box_id, conf, x1, y1, x1 + w AS x2, y1 + h AS y2 FROM (
  SELECT image_id, det_id, conf, CAST((image_id * 7919 + det_id * 104729) % 200000 AS DOUBLE) AS x1,
    CAST((image_id * 15485863 + det_id * 32452843) % 200000 AS DOUBLE) AS y1,
    CASE WHEN (image_id + det_id) % 500 = 0 THEN 1e9 ELSE pow(2, 2 + (image_id + 3 * det_id) % 14) END AS w,
    pow(2, 2 + (image_id * 5 + det_id) % 14) AS h FROM det)"""


@query(
    "j01_overlap_join_slides", "det",
    f"WITH slide AS ({SLIDE}) SELECT a.slide_id, a.box_id, b.box_id AS other_id, round({IOA}, 9) AS share FROM slide a JOIN slide b"
    f" ON a.slide_id = b.slide_id AND a.box_id <> b.box_id AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2 WHERE {IOA} >= 0.5",
)
def j01_slides(t):
    """Every box with the others of which it covers half or more, on rasters whose boxes differ in size by four orders."""
    s = t.spark.sql(SLIDE.replace("FROM det)", "FROM {det})"), det=t.det)
    p = J.overlap_join(s, s.drop("conf"), ("slide_id",), 0.5, S.ioa).filter("box_id <> b_box_id")
    return p.select("slide_id", "box_id", F.col("b_box_id").alias("other_id"), F.round("sim", 9).alias("share"))
