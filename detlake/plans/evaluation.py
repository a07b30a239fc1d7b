"""Queries over matching and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import softmax
from ..operators import match as M
from ..operators import metrics as A
from .pairs import EPS, IOU, PAIR, gt_keypoints, prob_sql, sq
from .registry import query, r6

BOX = ("x1", "y1", "x2", "y2")
THR = "(VALUES " + ", ".join(f"({t}::DOUBLE)" for t in M.THRESHOLDS) + ") t(thr)"


def _det(t):
    return t.det.select("image_id", "det_id", "cls", "conf", *BOX)


def _gt(t):
    return t.gt.select("image_id", "ann_id", "cls", *BOX)


def matched(t):
    return M.match_predictions(_det(t), _gt(t)).select("image_id", "det_id", "cls", "conf", "tp_mask", "ann_id")


def counted(t, thresholds=M.THRESHOLDS):
    return M.evaluation_counts(_det(t), _gt(t), thresholds)


# matching straight from its definition: per threshold, best truth per detection, then best-ranked detection per truth
MATCH = """
pr AS ({pairs}),
p1 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id, thr, det_id ORDER BY sim DESC, ann_id) AS a1 FROM pr, {thr} WHERE sim >= thr),
p2 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id, thr, ann_id ORDER BY conf DESC, det_id) AS a2 FROM p1 WHERE a1 = 1),
mt AS (SELECT d.image_id, d.det_id, d.cls, d.conf, t.thr, p2.ann_id, CASE WHEN p2.ann_id IS NULL THEN 0 ELSE 1 END AS tp
  FROM {det} d CROSS JOIN {thr} LEFT JOIN (SELECT * FROM p2 WHERE a2 = 1) p2 ON d.image_id = p2.image_id AND d.det_id = p2.det_id AND t.thr = p2.thr)"""
BOX_PAIRS = f"SELECT a.image_id, det_id, ann_id, conf, {IOU} AS sim FROM {PAIR} AND a.cls = b.cls WHERE {IOU} >= 0.5"
BOX_MATCH = MATCH.format(pairs=BOX_PAIRS, thr=THR, det="det")


@query("x01_match", "det gt", f"WITH {BOX_MATCH} SELECT image_id, det_id, cls, round(conf, 6) AS conf, thr, tp = 1 AS tp, ann_id FROM mt")
def x01(t):
    out = M.match_long(matched(t))
    return out.select("image_id", "det_id", "cls", *r6(conf=F.col("conf")), "thr", "tp", "ann_id")


def _counts(out):
    rows = M.match_long(out)
    return rows.groupBy("cls", "thr").agg(F.count("*").alias("n"), F.count_if("tp").alias("tp"))


COUNTS = "SELECT cls, thr, count(*) AS n, CAST(sum(tp) AS BIGINT) AS tp FROM mt GROUP BY 1, 2"
ROT_PAIRS = (
    f"SELECT a.image_id, a.det_id, b.det_id AS ann_id, a.conf, {prob_sql()} AS sim FROM obb a JOIN og b ON a.image_id = b.image_id"
    f" AND a.cls = b.cls WHERE {prob_sql()} >= 0.5"
)
OG = "og AS (SELECT o.image_id, o.det_id, g.cls, o.cx + d.jit AS cx, o.cy + d.jit AS cy, o.w, o.h, o.r FROM obb o JOIN det d USING (image_id, det_id) JOIN gt g ON g.image_id = o.image_id AND g.ann_id = o.det_id)"


@query("x02_match_rotated", "obb gt", f"WITH {OG}, {MATCH.format(pairs=ROT_PAIRS, thr=THR, det='obb')} {COUNTS}")
def x02r(t):
    t = t.stored()
    shift = t.det.select("image_id", "det_id", "jit")
    truth = t.obb.drop("cls", "conf").join(shift, ["image_id", "det_id"])
    truth = truth.join(t.gt.select("image_id", F.col("ann_id").alias("det_id"), "cls"), ["image_id", "det_id"])
    truth = truth.select(
        "image_id", F.col("det_id").alias("ann_id"), "cls", (F.col("cx") + F.col("jit")).alias("cx"),
        (F.col("cy") + F.col("jit")).alias("cy"), "w", "h", "r",
    )
    return _counts(M.match_rotated(t.obb, truth))


KPT_PAIRS = f"""
SELECT image_id, det_id, ann_id, conf, sim FROM (
 SELECT a.image_id, det_id, ann_id, conf, sum(CASE WHEN (ann_id + k) % 7 <> 0 THEN exp(-((
  CASE WHEN k IN (0, 3) THEN pow(a.x1 - b.x1, 2) WHEN k IN (1, 2) THEN pow(a.x2 - b.x2, 2) ELSE pow((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, 2) END
  + CASE WHEN k IN (0, 1) THEN pow(a.y1 - b.y1, 2) WHEN k IN (2, 3) THEN pow(a.y2 - b.y2, 2) ELSE pow((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2) END)
  / (pow(2 * 0.2::DOUBLE, 2) * (0.53::DOUBLE * {sq('b')} + {EPS}) * 2))) ELSE 0 END) / (count(*) FILTER (WHERE (ann_id + k) % 7 <> 0) + {EPS}) AS sim
 FROM det a JOIN gt b ON a.image_id = b.image_id AND a.cls = b.cls, (VALUES (0), (1), (2), (3), (4)) s(k) GROUP BY 1, 2, 3, 4) z WHERE sim >= 0.5"""


@query("x02_match_keypoints", "det gt", f"WITH {MATCH.format(pairs=KPT_PAIRS, thr=THR, det='det')} {COUNTS}")
def x02k(t):
    t = t.stored()
    return _counts(M.match_keypoints(t.kpts, gt_keypoints(t), [0.2] * 5))


CONFUSION = f"""
WITH sure AS (SELECT * FROM det WHERE conf > 0.25),
pr AS (SELECT a.image_id, det_id, ann_id, {IOU} AS sim FROM sure a JOIN gt b ON a.image_id = b.image_id WHERE {IOU} > 0.45),
p1 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id, det_id ORDER BY sim DESC, ann_id) AS a1 FROM pr),
p2 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id, ann_id ORDER BY sim DESC, det_id) AS a2 FROM p1 WHERE a1 = 1),
m AS (SELECT * FROM p2 WHERE a2 = 1),
al AS (SELECT s.cls AS pred, g.cls AS actual FROM m JOIN sure s USING (image_id, det_id) JOIN gt g ON g.image_id = m.image_id AND g.ann_id = m.ann_id
  UNION ALL SELECT 5, cls FROM gt g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.image_id = g.image_id AND m.ann_id = g.ann_id)
  UNION ALL SELECT cls, 5 FROM sure s WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.image_id = s.image_id AND m.det_id = s.det_id))"""


@query("x03_confusion_match", "det gt", CONFUSION + " SELECT pred, actual, count(*) AS n FROM al GROUP BY 1, 2")
def x03(t):
    return A.confusion_counts(M.match_for_confusion(_det(t), _gt(t)), 5)


CELLS = ", c AS (SELECT i.range::INT AS pred, j.range::INT AS actual, (SELECT count(*) FROM al WHERE al.pred = i.range AND al.actual = j.range) AS n FROM range(6) i, range(6) j)"


@query(
    "a10_confusion", "det gt",
    CONFUSION + CELLS + " SELECT pred, actual, n, round(n / (sum(n) OVER (PARTITION BY actual) + 1e-9), 6) AS share FROM c",
)
def a10(t):
    return A.confusion_matrix(_det(t), _gt(t), 5, normalize=True).withColumn("share", F.round("share", 6))


@query(
    "a10_tp_fp", "det gt",
    CONFUSION + " SELECT pred AS cls, CAST(sum((pred = actual)::INT) AS BIGINT) AS tp, CAST(sum((pred <> actual)::INT) AS BIGINT) AS fp FROM al WHERE pred < 5 GROUP BY 1",
)
def a10b(t):
    return A.tp_fp(A.confusion_matrix(_det(t), _gt(t), 5), 5)


# curves straight from their definition: one row per detection, misses first among equal confidences
CURVE = BOX_MATCH + """,
nl AS (SELECT cls, count(*) AS n FROM gt GROUP BY 1),
cv AS (SELECT m.cls, thr, conf, tp, ROW_NUMBER() OVER w AS i, sum(tp) OVER (w ROWS UNBOUNDED PRECEDING) AS tpc, n FROM mt m JOIN nl USING (cls)
  WINDOW w AS (PARTITION BY m.cls, thr ORDER BY conf DESC, tp, image_id, det_id)),
rp AS (SELECT cls, thr, i, conf, tpc::DOUBLE / n AS r, tpc::DOUBLE / i AS p FROM cv)"""
# recall and precision with sentinels, the envelope, and linear interpolation on a grid
AP = CURVE + """,
st AS (SELECT cls, thr, i, r, p FROM rp UNION ALL SELECT DISTINCT cls, thr, 0, 0.0::DOUBLE, 1.0::DOUBLE FROM rp
  UNION ALL SELECT cls, thr, max(i) + 1, 1.0::DOUBLE, 0.0::DOUBLE FROM rp GROUP BY 1, 2),
ev AS (SELECT cls, thr, i, r, max(p) OVER (PARTITION BY cls, thr ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS e FROM st),
sg AS (SELECT cls, thr, i, r, e, lead(r) OVER w AS r2, lead(e) OVER w AS e2 FROM ev WINDOW w AS (PARTITION BY cls, thr ORDER BY i)),
gr AS (SELECT range AS g, CASE WHEN range = {last} THEN 1.0::DOUBLE ELSE range * (1.0::DOUBLE / {last}) END AS x FROM range({last} + 1)),
ip AS (SELECT cls, thr, g, x, CASE WHEN r2 IS NULL OR r = x THEN e ELSE (e2 - e) / (r2 - r) * (x - r) + e END AS y
  FROM sg JOIN gr ON x >= r AND (x < r2 OR r2 IS NULL))"""
AP101 = AP.format(last=100) + """,
ap0 AS (SELECT cls, thr, sum(s) AS ap FROM (SELECT cls, thr, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS s FROM ip WINDOW w AS (PARTITION BY cls, thr ORDER BY g)) q GROUP BY 1, 2),
ap AS (SELECT cls, thr, coalesce(ap, 0) AS ap FROM nl CROSS JOIN """ + THR + """ LEFT JOIN ap0 USING (cls, thr))"""


@query(
    "a01_pr_curve", "det gt",
    f"WITH {CURVE} SELECT cls, thr, round(conf, 6) AS conf, CAST(max(tpc) AS BIGINT) AS tp, CAST(max(i) - max(tpc) AS BIGINT) AS fp, round(max(r), 6) AS recall, round(arg_max(p, i), 6) AS precision"
    " FROM (SELECT cv.*, tpc::DOUBLE / n AS r, tpc::DOUBLE / i AS p FROM cv) z GROUP BY cls, thr, conf",
)
def a01(t):
    p = A.pr_points(A.pr_curve(counted(t)))
    return p.select("cls", "thr", *r6(conf=F.col("conf")), "tp", "fp", *r6(recall=F.col("recall"), precision=F.col("precision")))


@query("a02_average_precision", "det gt", f"WITH {AP101} SELECT cls, thr, round(ap, 6) AS ap FROM ap0")
def a02(t):
    ap = A.average_precision(A.pr_curve(counted(t)))
    return ap.select("cls", "thr", *r6(ap=F.col("ap")))


def _ap(t):
    return A.ap_per_class(counted(t))


@query("a03_ap_per_class", "det gt", f"WITH {AP101} SELECT cls, thr, round(ap, 6) AS ap FROM ap")
def a03(t):
    return _ap(t).select("cls", "thr", *r6(ap=F.col("ap")))


MAP = "avg(ap) FILTER (WHERE thr = 0.5) AS map50, avg(ap) FILTER (WHERE thr = 0.75) AS map75, avg(ap) AS map FROM ap"


@query("a04_map", "det gt", f"WITH {AP101} SELECT round(map50, 6) AS map50, round(map75, 6) AS map75, round(map, 6) AS map FROM (SELECT {MAP}) z")
def a04(t):
    return A.map_summary(_ap(t)).select(*r6(map50=F.col("map50"), map75=F.col("map75"), map=F.col("map")))


@query("a05_precision_on_recall", "det gt", f"WITH {AP.format(last=999)} SELECT cls, g AS i, round(x, 6) AS recall, round(y, 6) AS precision FROM ip WHERE thr = 0.5")
def a05p(t):
    c = A.precision_on_recall(counted(t, M.THRESHOLDS[:1]))
    return c.select("cls", "i", *r6(recall=F.col("recall"), precision=F.col("precision")))


CONF = CURVE + """,
q AS (SELECT *, lead(conf) OVER w AS c2, lead(r) OVER w AS r2, lead(p) OVER w AS p2 FROM rp WHERE thr = 0.5 WINDOW w AS (PARTITION BY cls ORDER BY i)),
gr AS (SELECT range AS g, CASE WHEN range = 999 THEN 1.0::DOUBLE ELSE range * (1.0::DOUBLE / 999) END AS x FROM range(1000)),
hit AS (SELECT cls, g, x, CASE WHEN c2 IS NULL OR conf = x THEN r ELSE r + (r2 - r) * (conf - x) / (conf - c2) END AS r,
  CASE WHEN c2 IS NULL OR conf = x THEN p ELSE p + (p2 - p) * (conf - x) / (conf - c2) END AS p FROM q JOIN gr ON x <= conf AND (x > c2 OR c2 IS NULL)),
cc AS (SELECT cls, n, g, gr.x, CASE WHEN cls NOT IN (SELECT cls FROM rp) THEN 0 ELSE coalesce(hit.r, 0) END AS r, CASE WHEN cls NOT IN (SELECT cls FROM rp) THEN 0 ELSE coalesce(hit.p, 1) END AS p
  FROM nl CROSS JOIN gr LEFT JOIN hit USING (cls, g)),
cf AS (SELECT *, 2 * p * r / (p + r + 1e-16) AS f1 FROM cc)"""


def _curves(t):
    return A.confidence_curves(counted(t, M.THRESHOLDS[:1]))


@query("a05_confidence_curves", "det gt", f"WITH {CONF} SELECT cls, g AS i, round(x, 6) AS conf, round(p, 6) AS p, round(r, 6) AS r, round(f1, 6) AS f1 FROM cf")
def a05(t):
    return _curves(t).select("cls", "i", *r6(**{c: F.col(c) for c in ("conf", "p", "r", "f1")}))


BEST = CONF + """,
mf AS (SELECT g, avg(f1) AS f FROM cf GROUP BY 1),
pad AS (SELECT g, f FROM mf UNION ALL SELECT -1 - range, (SELECT f FROM mf WHERE g = 0) FROM range(50) UNION ALL SELECT 1000 + range, (SELECT f FROM mf WHERE g = 999) FROM range(50)),
sm AS (SELECT g, avg(f) OVER (ORDER BY g ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS s FROM pad),
bi AS (SELECT g FROM sm WHERE g BETWEEN 0 AND 999 ORDER BY round(s, 12) DESC, g LIMIT 1),
bf AS (SELECT cls, n, p, r, f1, g, x, round_even(r * n, 0)::DOUBLE AS tp FROM cf JOIN bi USING (g))"""


@query(
    "a06_best_f1", "det gt",
    f"WITH {BEST} SELECT cls, g AS i, round(x, 6) AS conf, round(p, 6) AS p, round(r, 6) AS r, round(f1, 6) AS f1, tp, round_even(tp / (p + 1e-16) - tp, 0)::DOUBLE AS fp FROM bf",
)
def a06(t):
    return A.best_f1(_curves(t)).select("cls", "i", *r6(**{c: F.col(c) for c in ("conf", "p", "r", "f1")}), "tp", "fp")


REPORT = f"""WITH {AP101}, {BEST.replace(CURVE + ',', '')},
rw AS (SELECT cls, count(DISTINCT image_id) AS images, count(*) AS instances FROM gt GROUP BY 1),
pc AS (SELECT cls, max(ap) FILTER (WHERE thr = 0.5) AS ap50, avg(ap) AS ap FROM ap GROUP BY 1),
al AS (SELECT cls, images, instances, p, r, ap50, pc.ap FROM rw JOIN (SELECT cls, p, r FROM bf) b USING (cls) JOIN pc USING (cls))
SELECT cls, images, instances, round(p, 6) AS p, round(r, 6) AS r, round(ap50, 6) AS ap50, round(ap, 6) AS ap FROM al
UNION ALL SELECT NULL, (SELECT count(DISTINCT image_id) FROM gt), CAST(sum(instances) AS BIGINT), round(avg(p), 6), round(avg(r), 6), round(avg(ap50), 6), round(avg(ap), 6) FROM al"""


@query("a07_class_report", "det gt", REPORT.replace("gr AS (SELECT range AS g, CASE WHEN range = 999", "gr2 AS (SELECT range AS g, CASE WHEN range = 999").replace("q JOIN gr ON", "q JOIN gr2 ON").replace("gr.x", "gr2.x").replace("CROSS JOIN gr LEFT", "CROSS JOIN gr2 LEFT"))
def a07(t):
    r = A.class_report(counted(t), _gt(t))
    return r.select("cls", "images", "instances", *r6(**{c: F.col(c) for c in ("p", "r", "ap50", "ap")}))


@query(
    "a08_class_maps", "det gt",
    f"WITH {AP101}, m AS (SELECT cls, avg(ap) AS ap FROM ap GROUP BY 1) SELECT CAST(r_regionkey + 2 AS INT) AS cls, round(coalesce(m.ap, (SELECT avg(ap) FROM m)), 6) AS ap FROM region LEFT JOIN m ON m.cls = r_regionkey + 2",
)
def a08(t):
    classes = t.table("region").select((F.col("r_regionkey") + 2).cast("int").alias("cls"))
    return A.class_maps(_ap(t), classes).select("cls", *r6(ap=F.col("ap")))


@query("a09_fitness", "det gt", f"WITH {AP101} SELECT round(0.1::DOUBLE * map50 + 0.9::DOUBLE * map, 6) AS fitness, round(0.1::DOUBLE * map50 + 0.9::DOUBLE * map + 0.1::DOUBLE * map75 + 0.9::DOUBLE * map, 6) AS two_heads FROM (SELECT {MAP}) z")
def a09(t):
    s = A.map_summary(_ap(t))
    both = A.two_head_fitness(s, s.select(F.col("map75").alias("map50"), "map"))
    return both.select(*r6(fitness=F.col("box"), two_heads=F.col("fitness")))


def image_probs(t):
    e = t.table("embeddings")
    return e.select("vec_id", F.col("label").alias("target"), softmax(F.slice("embedding", 1, 10)).alias("probs"))


PROBS = """
WITH e AS (SELECT vec_id, label, unnest(embedding[1:10])::DOUBLE AS v, unnest(range(10))::INT AS c FROM embeddings),
s AS (SELECT vec_id, label, c, exp(v - max(v) OVER (PARTITION BY vec_id)) AS x FROM e),
pb AS (SELECT vec_id, label, c, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM s),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY p DESC, c) AS k FROM pb)"""


@query(
    "a11_top_accuracy", "",
    PROBS + ", h AS (SELECT vec_id, max((k = 1 AND c = label)::INT) AS t1, max((k <= 5 AND c = label)::INT) AS t5 FROM rk GROUP BY 1)"
    " SELECT round(avg(t1), 6) AS top1, round(avg(t5), 6) AS topk, round((avg(t1) + avg(t5)) / 2, 6) AS fitness FROM h",
)
def a11(t):
    return A.top_accuracy(image_probs(t)).select(*r6(**{c: F.col(c) for c in ("top1", "topk", "fitness")}))


@query("a11_classification_confusion", "", PROBS + " SELECT c AS pred, label AS actual, count(*) AS n FROM rk WHERE k = 1 GROUP BY 1, 2")
def a11b(t):
    return A.classification_confusion(image_probs(t))


