"""Queries over dataset statistics, splits and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions.text import softmax
from ..operators import stats as ST
from ..sources import files as FI
from ..sources import sinks as K
from .evaluation import PROBS, image_probs
from .ingest import NAME_SQL, NAMES
from .registry import query, r6, rounded, sql6

BOX = ("x1", "y1", "x2", "y2")
CELLS = "(SELECT DISTINCT split FROM images) s, (SELECT range::INT AS cls FROM range(6)) c"


@query(
    "a12_instance_stats", "gt images",
    f"SELECT split, cls, (SELECT count(*) FROM gt JOIN images i USING (image_id) WHERE gt.cls = c.cls AND i.split = s.split) AS n, (SELECT count(*) FROM gt JOIN images i USING (image_id) WHERE i.split = s.split) AS total FROM {CELLS}",
)
def a12(t):
    return ST.instance_stats(t.images, t.gt, 6)


IMG_STATS = f"""SELECT split, cls, (SELECT count(DISTINCT image_id) FROM gt JOIN images i USING (image_id) WHERE gt.cls = c.cls AND i.split = s.split) AS n,
 (SELECT count(*) FROM images i WHERE i.split = s.split) AS total, (SELECT count(*) FROM images i WHERE i.split = s.split AND image_id NOT IN (SELECT image_id FROM gt)) AS unlabelled FROM {CELLS}"""


@query("a13_image_stats", "gt images", IMG_STATS)
def a13(t):
    return ST.image_stats(t.images, t.gt, 6)


@query("a14_label_listing", "gt images", "SELECT image_id, ann_id, cls, printf('%.4f', ((x1 + x2) / 2) / width)::DOUBLE AS cx, printf('%.4f', (y2 - y1) / height)::DOUBLE AS h FROM gt JOIN images USING (image_id)")
def a14(t):
    g = t.gt.join(t.images, "image_id")
    n = B.xyxy2xywhn(*BOX, "width", "height")
    rows = g.select(F.struct("image_id", "ann_id").alias("image_id"), "cls", n["cx"].alias("cx"), n["h"].alias("h"))
    return ST.label_listing(rows, ("cx", "h")).select("image_id.*", "cls", "cx", "h")


def _tree(t):
    i = F.col("o_orderkey")
    path = F.concat(F.lit("/d/"), F.when(i % 10 < 8, "train").otherwise("val"), F.lit("/"), F.col("o_orderstatus"), F.lit("/"), i.cast("string"), F.lit(".jpg"))
    return FI.class_tree(t.table("orders").select(path.alias("path")))


@query(
    "a15_classification_stats", "",
    "WITH f AS (SELECT CASE WHEN o_orderkey % 10 < 8 THEN 'train' ELSE 'val' END AS split, o_orderstatus AS class_name FROM orders)"
    " SELECT split, CAST(dense_rank() OVER (PARTITION BY split ORDER BY class_name) - 1 AS INT) AS cls, class_name, count(*) AS n FROM f GROUP BY split, class_name",
)
def a15(t):
    return ST.classification_stats(_tree(t))


@query("a15_class_count_check", "", "SELECT CASE WHEN o_orderkey % 10 < 8 THEN 'train' ELSE 'val' END AS split, count(DISTINCT o_orderstatus) AS classes, 4 AS expected, count(DISTINCT o_orderstatus) = 4 AS ok FROM orders GROUP BY 1")
def a15b(t):
    return ST.class_count_check(_tree(t), 4)


def _norm(t):
    g = t.gt.join(t.images, "image_id")
    return g.select("cls", *B.named(B.xyxy2xywhn(*BOX, "width", "height")))


NORM = "SELECT cls, ((x1 + x2) / 2) / width AS cx, ((y1 + y2) / 2) / height AS cy, (x2 - x1) / width AS w, (y2 - y1) / height AS h FROM gt JOIN images USING (image_id)"


@query("a16_class_histogram", "gt", "SELECT cls, count(*) AS n FROM gt GROUP BY 1")
def a16(t):
    return ST.class_histogram(t.gt)


@query("a16_box_histogram", "gt images", f"SELECT CAST(least(floor(w * 50), 49) AS BIGINT) AS bx, CAST(least(floor(h * 50), 49) AS BIGINT) AS by, count(*) AS n FROM ({NORM}) q WHERE w <= 1 AND h <= 1 GROUP BY 1, 2")
def a16h(t):
    return ST.hist2d(_norm(t), "w", "h", 50, (0, 1), (0, 1))


PAIRS = [("cx", "cy"), ("cx", "w"), ("cx", "h"), ("cy", "w"), ("cy", "h"), ("w", "h")]


@query("a16_box_correlation", "gt images", f"WITH q AS ({NORM}) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM q" for a, b in PAIRS))
def a16c(t):
    return ST.box_correlation(_norm(t)).select("a", "b", *r6(corr=F.col("corr")))


@query(
    "a17_point_density", "gt",
    "WITH e AS (SELECT min(x1) AS a, max(x1) AS b, min(y1) AS c, max(y1) AS d FROM gt), q AS (SELECT image_id, ann_id, least(floor((x1 - a) / (b - a) * 20), 19) AS bx, least(floor((y1 - c) / (d - c) * 20), 19) AS yb FROM gt, e)"
    " SELECT image_id, ann_id, count(*) OVER (PARTITION BY bx, yb) AS n FROM q",
)
def a17(t):
    return ST.point_density(t.gt.select("image_id", "ann_id", "x1", "y1"), "x1", "y1").select("image_id", "ann_id", "n")


@query(
    "a18_describe", "det images",
    f"WITH n AS (SELECT image_id, cls, count(*) AS n FROM det GROUP BY 1, 2), s AS (SELECT image_id, string_agg(n || ' ' || {NAME_SQL} || CASE WHEN n > 1 THEN 's' ELSE '' END, ', ' ORDER BY cls) AS text FROM n GROUP BY 1)"
    " SELECT image_id, coalesce(text, '(no detections)') AS text FROM images LEFT JOIN s USING (image_id)",
)
def a18(t):
    classes = t.spark.createDataFrame(list(enumerate(NAMES)), "cls int, name string")
    return ST.describe_all(t.images, t.det, classes)


@query("a19_speed_summary", "", f"SELECT count(*) AS images, {sql6(preprocess='avg(l_tax * 10)', inference='avg(l_extendedprice / 100)', postprocess='avg(l_discount)')} FROM lineitem")
def a19(t):
    s = t.table("lineitem").select((F.col("l_tax") * 10).alias("preprocess"), (F.col("l_extendedprice") / 100).alias("inference"), F.col("l_discount").alias("postprocess"))
    return ST.speed_summary(s).select("images", *r6(**{c: F.col(c) for c in ("preprocess", "inference", "postprocess")}))


def _clip_sql(rounds):
    parts, src = [], "(SELECT o_orderpriority AS g, o_totalprice * o_totalprice / 1e6 AS v FROM orders)"
    for k in range(rounds):
        parts.append(f"m{k} AS (SELECT g, avg(v) AS m, stddev_pop(v) AS s FROM {src} q GROUP BY 1)")
        parts.append(f"r{k} AS (SELECT g, v FROM {src} q JOIN m{k} USING (g) WHERE (v > m - 2 * s AND v < m + 2 * s) OR s = 0)")
        src = f"r{k}"
    return f"WITH {', '.join(parts)} SELECT g, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std FROM {src} GROUP BY 1"


@query("a21_sigma_clip", "", _clip_sql(3))
def a21(t):
    o = t.table("orders").select(F.col("o_orderpriority").alias("g"), (F.col("o_totalprice") * F.col("o_totalprice") / 1e6).alias("v"))
    return ST.clipped_stats(o, "v", ["g"]).select("g", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query(
    "w07_batch_shapes", "images",
    "WITH r AS (SELECT *, height / width AS ar, (ROW_NUMBER() OVER (ORDER BY height / width, image_id) - 1) // 16 AS batch FROM images),"
    " e AS (SELECT batch, min(ar) AS lo, max(ar) AS hi FROM r GROUP BY 1)"
    " SELECT image_id, batch, CAST(ceil(CASE WHEN hi < 1 THEN hi ELSE 1 END * 640 / 32 + 0.5::DOUBLE) * 32 AS INT) AS batch_h, CAST(ceil(CASE WHEN hi < 1 THEN 1 WHEN lo > 1 THEN 1 / lo ELSE 1 END * 640 / 32 + 0.5::DOUBLE) * 32 AS INT) AS batch_w FROM r JOIN e USING (batch)",
)
def w07(t):
    return ST.batch_shapes(t.images, 16, pad=0.5).select("image_id", "batch", "batch_h", "batch_w")


@query("l03_top_classes", "", PROBS + " SELECT vec_id, CAST(k AS INT) AS place, c AS cls, round(p, 6) AS conf FROM rk WHERE k <= 5")
def l03(t):
    return ST.top_classes(image_probs(t)).select("vec_id", "place", "cls", *r6(conf=F.col("conf")))


@query("l04_leading_fraction", "images", "SELECT image_id FROM (SELECT image_id, ROW_NUMBER() OVER (ORDER BY split, image_id) AS r, count(*) OVER () AS n FROM images) q WHERE r <= round_even(n * 0.25::DOUBLE, 0)")
def l04(t):
    return FI.leading_fraction(t.images, 0.25, "split", "image_id").select("image_id")


U = "('0x' || substr(sha256(path), 1, 13))::BIGINT::DOUBLE / 4503599627370496"


@query("l05_autosplit", "images", f"WITH f AS (SELECT '/d/images/' || image_id || '.jpg' AS path FROM images), u AS (SELECT path, {U} AS u FROM f) SELECT path, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.7::DOUBLE + 0.2::DOUBLE THEN 'val' ELSE 'test' END AS split FROM u")
def l05(t):
    f = t.images.select(F.concat(F.lit("/d/images/"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("path"))
    return ST.autosplit(f, (0.7, 0.2, 0.1))


@query("k09_split_lists", "images gt", f"WITH f AS (SELECT '/d/images/' || image_id || '.jpg' AS path FROM images WHERE image_id IN (SELECT image_id FROM gt)), u AS (SELECT path, {U} AS u FROM f) SELECT 'autosplit_' || CASE WHEN u < 0.9 THEN 'train' WHEN u < 0.9::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'test' END AS split, './' || path AS line FROM u")
def k09(t):
    from ..session import scratch_path

    def path(df, folder, ext):
        return df.select(F.concat(F.lit(f"/d/{folder}/"), F.col("image_id").cast("string"), F.lit(ext)).alias("path"))

    s = ST.autosplit(path(t.images, "images", ".jpg"), annotated=path(t.gt.select("image_id").distinct(), "labels", ".txt"))
    out = scratch_path(t.spark, "splits")
    K.write_splits(s, out)
    return t.spark.read.text(out).select("split", F.col("value").alias("line"))


@query(
    "k08_stats_json", "gt images",
    f"WITH a AS ({IMG_STATS}) SELECT split, CAST(max(total) AS BIGINT) AS images, CAST(max(unlabelled) AS BIGINT) AS unlabelled, CAST(sum(n) AS BIGINT) AS labelled_classes FROM a GROUP BY 1",
)
def k08(t):
    from ..session import scratch_path

    path = scratch_path(t.spark, "stats")
    K.write_stats(ST.instance_stats(t.images, t.gt, 6), ST.image_stats(t.images, t.gt, 6), path)
    schema = "image_stats struct<total: bigint, unlabelled: bigint, per_class: array<bigint>>"
    back = t.spark.read.text(path).select("split", F.from_json("value", schema).alias("s")).select("split", "s.image_stats.*")
    total = F.aggregate("per_class", F.lit(0).cast("bigint"), lambda a, v: a + v)
    return back.select("split", F.col("total").alias("images"), "unlabelled", total.alias("labelled_classes"))


@query("l09_every_nth", "tracks", "SELECT video_id, frame_no, track_id FROM tracks WHERE frame_no % 3 = 0")
def l09(t):
    return ST.every_nth(t.tracks, 3).select("video_id", "frame_no", "track_id")


@query(
    "c11_softmax", "",
    "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64))::INT AS c FROM embeddings), s AS (SELECT vec_id, c, v, exp(v - max(v) OVER (PARTITION BY vec_id)) AS x FROM e)"
    " SELECT vec_id, c, round(x / sum(x) OVER (PARTITION BY vec_id), 9) AS p, round(1 / (1 + exp(-v)), 9) AS s FROM s",
)
def c11(t):
    from ..functions.text import sigmoid

    e = t.table("embeddings").select("vec_id", "embedding", softmax("embedding").alias("p"))
    e = e.select("vec_id", "embedding", F.posexplode("p").alias("c", "p"))
    v = F.element_at("embedding", F.col("c") + 1).cast("double")
    return e.select("vec_id", "c", *rounded({"p": F.col("p"), "s": sigmoid(v)}, 9))


@query("c12_half_even", "", "SELECT p_partkey, printf('%.2f', p_retailprice / 8)::DOUBLE AS a, round_even(p_size / 4.0::DOUBLE, 0)::DOUBLE AS b FROM part")
def c12(t):
    from ..functions.numbers import py_round

    return t.table("part").select("p_partkey", py_round(F.col("p_retailprice") / 8, 2).alias("a"), py_round(F.col("p_size") / 4, 0).alias("b"))


