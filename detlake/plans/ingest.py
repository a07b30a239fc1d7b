"""Queries over sources and sinks. Inputs in foreign formats are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import text as X
from ..session import scratch_path
from ..sources import documents as D
from ..sources import files as FI
from ..sources import formats as FM
from ..sources import labels as LB
from ..sources import sinks as K
from ..sources.commits import LabelSnapshot
from .geometry import CORNERS
from .registry import query, r6, rounded, sql6, sql9

BOX = ("x1", "y1", "x2", "y2")
NAMES = ["person", "car", "bus", "dog", "sports ball"]
NAME_SQL = "CASE cls WHEN 0 THEN 'person' WHEN 1 THEN 'car' WHEN 2 THEN 'bus' WHEN 3 THEN 'dog' ELSE 'sports ball' END"
XYWHN = {"cx": "((x1 + x2) / 2) / width", "cy": "((y1 + y2) / 2) / height", "w": "(x2 - x1) / width", "h": "(y2 - y1) / height"}


def _det(t):
    return t.det.select("image_id", "det_id", "cls", "conf", *BOX).join(t.images, "image_id")


def _files(t):
    """A file table: one image, video or other file per order."""
    i = F.col("o_orderkey")
    ext = F.element_at(F.array(*[F.lit(e) for e in ("jpg", "PNG", "txt", "mp4", "webp")]), (i % 5 + 1).cast("int"))
    folder = F.when(i % 10 < 8, "train").otherwise("val")
    path = F.concat(F.lit("/data/images/"), folder, F.lit("/images/"), i.cast("string"), F.lit("."), ext)
    return t.table("orders").select(path.alias("path"), (i % 1000 + 10).alias("length"))


PATHS = """SELECT '/data/images/' || CASE WHEN o_orderkey % 10 < 8 THEN 'train' ELSE 'val' END || '/images/' || o_orderkey || '.'
 || CASE o_orderkey % 5 WHEN 0 THEN 'jpg' WHEN 1 THEN 'PNG' WHEN 2 THEN 'txt' WHEN 3 THEN 'mp4' ELSE 'webp' END AS path, o_orderkey % 1000 + 10 AS length FROM orders"""


@query("s01_scan_images", "", f"WITH f AS ({PATHS}), i AS (SELECT path, ROW_NUMBER() OVER (ORDER BY path) AS r, count(*) OVER () AS n FROM f WHERE path NOT LIKE '%.txt' AND path NOT LIKE '%.mp4') SELECT path FROM i WHERE r <= round_even(n * 0.3::DOUBLE, 0)")
def s01(t):
    return FI.select_images(_files(t).select("path"), 0.3)


@query("s02_scan_media", "", f"WITH f AS ({PATHS}) SELECT path, CASE WHEN path LIKE '%.mp4' THEN 'video' ELSE 'image' END AS kind FROM f WHERE path NOT LIKE '%.txt'")
def s02(t):
    return FI.with_kind(_files(t).select("path"))


@query("s03_list_file", "", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN '/data/lists/images/' || o_orderkey || '.jpg' ELSE '/abs/' || o_orderkey || '.jpg' END AS path FROM orders")
def s03(t):
    i = F.col("o_orderkey")
    value = F.concat(F.when(i % 2 == 0, "./images/").otherwise("/abs/"), i.cast("string"), F.lit(".jpg"))
    folder = scratch_path(t.spark, "lists")
    t.table("orders").select(value.alias("value")).write.text(folder)
    out = FI.scan_list(t.spark, folder).select(F.regexp_replace("path", "^" + folder, "/data/lists").alias("path"))
    return out


def label_lines(t):
    """Label text of the detections with planted faults; one file per image."""
    d = _det(t).withColumn("path", F.concat(F.lit("/data/labels/"), F.col("image_id").cast("string"), F.lit(".txt")))
    i, k = F.col("image_id"), F.col("det_id")
    good = F.format_string("%d %.9f %.9f %.9f %.9f", F.col("cls"), *B.xyxy2xywhn(*BOX, "width", "height").values())
    fault = (
        F.when((i % 50 == 1) & (k == 1), F.concat(F.col("cls").cast("string"), F.lit(" 1.500000 0.500000 0.100000 0.100000")))
        .when((i % 50 == 2) & (k == 1), F.concat(F.col("cls").cast("string"), F.lit(" 0.500000 0.500000 -0.100000 0.100000")))
        .when((i % 50 == 3) & (k == 1), F.lit("5 0.500000 0.500000 0.100000 0.100000"))
        .when((i % 50 == 4) & (k == 1), F.lit("1 0.500000 0.500000 0.100000"))
        .when((i % 50 == 5) & (k == 1), F.lit("6 0.500000 0.500000 0.100000 0.100000"))
        .when(i % 50 == 6, F.lit("2 0.250000 0.250000 0.100000 0.100000"))
        .when((i % 50 == 7) & (k == 1), F.lit("3 0.100000 0.100000 0.400000 0.100000 0.400000 0.300000 0.100000 0.300000"))
        .when((i % 50 == 8) & (k == 1), F.lit("x 0.500000 0.500000 0.100000 0.100000"))
    )
    return d.select("path", F.col("det_id").cast("bigint").alias("pos"), F.coalesce(fault, good).alias("line"))


FMT = "printf('%d %.9f %.9f %.9f %.9f', cls, ((x1 + x2) / 2) / width, ((y1 + y2) / 2) / height, (x2 - x1) / width, (y2 - y1) / height)"
LINES = f"""SELECT '/data/labels/' || image_id || '.txt' AS path, image_id, det_id AS pos, CASE
 WHEN image_id % 50 = 1 AND det_id = 1 THEN cls || ' 1.500000 0.500000 0.100000 0.100000' WHEN image_id % 50 = 2 AND det_id = 1 THEN cls || ' 0.500000 0.500000 -0.100000 0.100000'
 WHEN image_id % 50 = 3 AND det_id = 1 THEN '5 0.500000 0.500000 0.100000 0.100000' WHEN image_id % 50 = 4 AND det_id = 1 THEN '1 0.500000 0.500000 0.100000'
 WHEN image_id % 50 = 5 AND det_id = 1 THEN '6 0.500000 0.500000 0.100000 0.100000' WHEN image_id % 50 = 6 THEN '2 0.250000 0.250000 0.100000 0.100000'
 WHEN image_id % 50 = 7 AND det_id = 1 THEN '3 0.100000 0.100000 0.400000 0.100000 0.400000 0.300000 0.100000 0.300000'
 WHEN image_id % 50 = 8 AND det_id = 1 THEN 'x 0.500000 0.500000 0.100000 0.100000' ELSE {FMT} END AS line FROM det JOIN images USING (image_id)"""
# a polygon file reads every line as points; a five-token line is a polygon of two points
PARSED = f"""ln AS ({LINES}), tk AS (SELECT *, string_split(line, ' ') AS p FROM ln), fl AS (SELECT path, max(len(p)) > 6 AS poly FROM tk GROUP BY 1),
nm AS (SELECT path, image_id, pos, poly, len(p) AS n, list_transform(p, lambda s: TRY_CAST(s AS DOUBLE)) AS v FROM tk JOIN fl USING (path)),
bx AS (SELECT *, CASE WHEN poly THEN list_transform(range(1, n // 2 + 1), lambda i: v[2 * i]) END AS xs, CASE WHEN poly THEN list_transform(range(1, n // 2 + 1), lambda i: v[2 * i + 1]) END AS ys FROM nm),
ps AS (SELECT path, image_id, pos, poly, n, v[1] AS cls, list_contains(list_transform(v, lambda x: x IS NULL), true) AS bad,
 CASE WHEN poly THEN (list_min(xs) + list_max(xs)) / 2 ELSE v[2] END AS cx, CASE WHEN poly THEN (list_min(ys) + list_max(ys)) / 2 ELSE v[3] END AS cy,
 CASE WHEN poly THEN list_max(xs) - list_min(xs) ELSE v[4] END AS w, CASE WHEN poly THEN list_max(ys) - list_min(ys) ELSE v[5] END AS h, xs FROM bx),
au AS (SELECT path, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) - count(DISTINCT (cls, cx, cy, w, h)) AS BIGINT) AS duplicates,
 CASE WHEN bool_or(bad) THEN 'unreadable' WHEN bool_or(NOT poly AND n <> 5) THEN 'columns' WHEN max(greatest(cx, cy, w, h)) > 1 THEN 'out of bounds'
 WHEN min(least(cls, cx, cy, w, h)) < 0 THEN 'negative' WHEN max(cls) > 5 THEN 'class' END AS reason, coalesce(max(cls) = 5, false) OR coalesce(bool_or(cls = 5), false) AS class_at_limit FROM ps GROUP BY 1)"""


@query(
    "s04_read_labels", "det images",
    f"WITH {PARSED} SELECT path, CAST(cls AS INT) AS cls, {sql9(cx='cx', cy='cy', w='w', h='h').replace(', 9)', ', 12)')}, CAST(max(coalesce(len(xs), 0)) AS INT) AS points FROM ps JOIN au USING (path) WHERE reason IS NULL GROUP BY path, cls, cx, cy, w, h",
)
def s04(t):
    parsed = LB.parse_labels(label_lines(t))
    good = LB.good_labels(parsed, LB.audit_labels(parsed, 5))
    points = F.coalesce(F.size("polygon"), F.lit(0))
    return good.select("path", "cls", *rounded({c: F.col(c) for c in ("cx", "cy", "w", "h")}, 12), points.alias("points"))


@query("s04_read_pose_labels", "det images", f"SELECT image_id, CAST(sum(cls) AS BIGINT) AS cls, round(sum(((x1 + x2) / 2) / width), 7) AS cx, CAST(count(*) * 2 AS BIGINT) AS points FROM (SELECT DISTINCT image_id, cls, x1, y1, x2, y2, width FROM det JOIN images USING (image_id)) q GROUP BY 1")
def s04p(t):
    d = _det(t)
    n = B.normalize_box(*BOX, "width", "height")
    line = F.format_string(
        "%d %.9f %.9f %.9f %.9f %.9f %.9f %.9f %.9f", F.col("cls"), *B.xyxy2xywhn(*BOX, "width", "height").values(), *n.values()
    )
    lines = d.select(F.concat(F.lit("/l/"), F.col("image_id").cast("string"), F.lit(".txt")).alias("path"), F.col("det_id").cast("bigint").alias("pos"), line.alias("line"))
    parsed = LB.parse_labels(lines, "pose", 2, 2)
    good = LB.good_labels(parsed, LB.audit_labels(parsed, 5, "pose", 2, 2), "pose")
    return good.groupBy(X.numeric_id("path").alias("image_id")).agg(
        F.sum("cls").alias("cls"), F.round(F.sum("cx"), 7).alias("cx"), F.sum(F.size("keypoints")).alias("points")
    )


@query("s05_label_path", "", f"WITH f AS ({PATHS}) SELECT path, regexp_replace(regexp_replace(path, '^(.*)/images/', '\\1/labels/'), '\\.[^./]*$', '.txt') AS label FROM f")
def s05(t):
    return _files(t).select("path", X.label_path("path").alias("label"))


def _documents(t, polygons=False, lvis=False):
    """Annotation documents written as JSON: one document per 500 images."""
    g, im = t.gt, t.images
    shard = F.floor(F.col("image_id") / 500).alias("shard")
    name = F.concat(F.col("image_id").cast("string"), F.lit(".jpg"))
    i = im.select(
        shard,
        F.struct(
            F.col("image_id").alias("id"), "width", "height", name.alias("file_name"),
            F.concat(F.lit("http://images.example.org/"), F.col("split"), F.lit("/"), name).alias("coco_url"),
            F.concat(F.lit("a photo of "), F.col("split"), F.lit(" things")).alias("caption"), name.alias("name"),
        ).alias("i"),
    )
    box = F.array("x1", "y1", F.col("x2") - F.col("x1"), F.when(F.col("ann_id") % 6 == 0, 0.0).otherwise(F.col("y2") - F.col("y1")))
    seg = F.array(F.array("x1", "y1", "x2", "y1", "x2", "y2"), F.array("x1", "y2", "x2", "y2", "x1", "y1"))
    first = F.when(F.col("cls") % 2 == 0, F.array(F.array(F.lit(0), F.lit(1)), F.array(F.lit(2), F.lit(7)))).otherwise(F.array(F.array(F.lit(2), F.lit(7))))
    a = g.select(
        shard,
        F.struct(
            (F.col("image_id") * 64 + F.col("ann_id")).alias("id"), "image_id", (F.col("cls") + 1).alias("category_id"),
            box.alias("bbox"), (F.col("ann_id") % 5 == 0).cast("int").alias("iscrowd"),
            F.when(F.col("ann_id") % 2 == 0, F.slice(seg, 1, 1)).otherwise(seg).alias("segmentation"),
            F.array("x1", "y1", F.lit(2.0), "x2", "y2", F.lit(0.0)).alias("keypoints"), first.alias("tokens_positive"),
        ).alias("a"),
    )
    docs = i.groupBy("shard").agg(F.collect_list("i").alias("images"))
    docs = docs.join(a.groupBy("shard").agg(F.sort_array(F.collect_list("a")).alias("annotations")), "shard")
    path = scratch_path(t.spark, "documents")
    docs.drop("shard").write.option("compression", "gzip").json(path)
    return path


GOOD = "gt g JOIN images i USING (image_id) WHERE ann_id % 5 <> 0 AND ann_id % 6 <> 0"
FIRST = "min(image_id * 64 + ann_id) AS ann_id"
GROUP = "GROUP BY image_id, cls, x1, y1, x2, y2, width, height"


@query("s06_read_coco", "gt images", f"SELECT image_id || '.jpg' AS path, {FIRST}, CASE cls WHEN 2 THEN NULL ELSE cls + 10 END AS cls, {sql9(**XYWHN)} FROM {GOOD} {GROUP}")
def s06(t):
    a = D.read_coco(t.spark, _documents(t), {1: 10, 2: 11, 3: None, 4: 13, 5: 14}, multiline=False)
    return a.select("path", "ann_id", "cls", *rounded({c: F.col(c) for c in ("cx", "cy", "w", "h")}, 9))


@query("s06_read_coco_polygons", "gt images", f"SELECT image_id || '.jpg' AS path, {FIRST}, CAST(CASE WHEN min(ann_id) % 2 = 0 THEN 3 ELSE 6 END AS INT) AS points, 2 AS keypoints FROM {GOOD} {GROUP}")
def s06b(t):
    a = D.read_coco(t.spark, _documents(t), segments=True, keypoints=True, multiline=False)
    return a.select("path", "ann_id", F.size(F.flatten("parts")).alias("points"), F.size("keypoints").alias("keypoints"))


@query("s07_read_lvis", "gt images", f"SELECT split || '/' || image_id || '.jpg' AS path, {FIRST}, cls FROM {GOOD} {GROUP}, split")
def s07(t):
    return D.read_coco(t.spark, _documents(t), flavour="lvis", multiline=False).select("path", "ann_id", "cls")


@query(
    "s08_read_grounding", "gt images",
    f"WITH k AS (SELECT image_id, ann_id, CASE WHEN g.cls % 2 = 0 THEN 'a photo' ELSE 'photo' END AS phrase, x1, y1, x2, y2 FROM {GOOD}),"
    " f AS (SELECT image_id, phrase, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY min(ann_id)) - 1 AS c FROM k GROUP BY 1, 2)"
    " SELECT image_id, min(image_id * 64 + ann_id) AS ann_id, CAST(c AS INT) AS cls, phrase FROM k JOIN f USING (image_id, phrase) GROUP BY image_id, c, phrase, x1, y1, x2, y2",
)
def s08(t):
    return D.read_coco(t.spark, _documents(t), flavour="grounding", multiline=False).select("image_id", "ann_id", "cls", "phrase")


AERIAL = "CASE cls WHEN 0 THEN 'plane' WHEN 1 THEN 'ship' WHEN 2 THEN 'harbor' WHEN 3 THEN 'zeppelin' ELSE 'helipad' END"


@query(
    "s09_read_dota", "det images",
    f"SELECT image_id, CASE cls WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 7 WHEN 3 THEN NULL ELSE 17 END AS cls, {AERIAL} AS class_name, round(x1 / width, 9) AS x, round(y2 / height, 9) AS y FROM det JOIN images USING (image_id)",
)
def s09(t):
    name = F.when(F.col("cls") == 0, "plane").when(F.col("cls") == 1, "ship").when(F.col("cls") == 2, "harbor").when(F.col("cls") == 3, "zeppelin").otherwise("helipad")
    nums = F.concat_ws(" ", "x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2")
    lines = t.det.select("image_id", F.concat_ws(" ", nums, name, F.lit("0")).alias("line"))
    head = t.images.select("image_id", F.lit("gsd:0.1").alias("line"))
    out = FM.parse_dota(lines.unionByName(head), t.images)
    return out.select("image_id", "cls", "class_name", *rounded({"x": F.col("polygon")[3]["x"], "y": F.col("polygon")[3]["y"]}, 9))


@query("s10_read_visdrone", "det images", f"SELECT image_id, cls, {sql9(cx='(trunc(x1) + trunc(x2 - x1) / 2) / width', cy='(trunc(y1) + trunc(y2 - y1) / 2) / height', w='trunc(x2 - x1) / width', h='trunc(y2 - y1) / height')} FROM det JOIN images USING (image_id) WHERE det_id % 4 <> 0")
def s10(t):
    i = [c.cast("int").cast("string") for c in B.xyxy2ltwh(*BOX).values()]
    line = F.concat_ws(",", *i, (F.col("det_id") % 4).cast("string"), (F.col("cls") + 1).cast("string"), F.lit("0"), F.lit("0"))
    out = FM.parse_visdrone(t.det.select("image_id", line.alias("line")), t.images)
    return out.select("image_id", "cls", *rounded({c: F.col(c) for c in ("cx", "cy", "w", "h")}, 9))


@query("s11_read_sku", "det images", f"SELECT CAST(image_id AS VARCHAR) AS image_id, 0 AS cls, {sql9(**XYWHN)} FROM det JOIN images USING (image_id)")
def s11(t):
    path = scratch_path(t.spark, "shelves")
    d = _det(t).withColumn("image", F.concat(F.col("image_id").cast("string"), F.lit(".jpg")))
    d.select("image", *BOX, F.lit("object"), "width", "height").write.csv(path)
    return FM.read_sku(t.spark, path).select("image_id", "cls", *rounded({c: F.col(c) for c in ("cx", "cy", "w", "h")}, 9))


@query(
    "s12_read_voc", "det images",
    f"SELECT CAST(image_id AS VARCHAR) AS image_id, CASE cls WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS cls, {sql9(cx='((x1 + x2) / 2 - 1) / width', cy='((y1 + y2) / 2 - 1) / height', w='(x2 - x1) / width', h='(y2 - y1) / height')}"
    " FROM det JOIN images USING (image_id) WHERE cls < 3 AND det_id % 3 <> 0",
)
def s12(t):
    name = F.element_at(F.array(*[F.lit(n) for n in ("cat", "dog", "cow", "unknown", "other")]), F.col("cls") + 1)
    obj = F.format_string(
        "<object><name>%s</name><difficult>%d</difficult><bndbox><xmin>%s</xmin><ymin>%s</ymin><xmax>%s</xmax><ymax>%s</ymax></bndbox></object>",
        name, (F.col("det_id") % 3 == 0).cast("int"), *[F.col(c).cast("string") for c in BOX],
    )
    head = F.format_string("<annotation><filename>%d.jpg</filename><size><width>%d</width><height>%d</height><depth>3</depth></size>", "image_id", "width", "height")
    docs = _det(t).groupBy("image_id", "width", "height").agg(F.array_join(F.collect_list(obj), "").alias("o"))
    path = scratch_path(t.spark, "voc")
    # a well-formed file has one root element: one file per shard of 500 images
    one = F.concat(head, "o", F.lit("</annotation>"))
    shards = docs.groupBy(F.floor(F.col("image_id") / 500)).agg(F.array_join(F.collect_list(one), "").alias("d"))
    shards.select(F.concat(F.lit("<set>"), "d", F.lit("</set>"))).write.option("maxRecordsPerFile", 1).text(path)
    out = FM.read_voc(t.spark, path, ["cat", "dog", "cow"])
    return out.select("image_id", "cls", *rounded({c: F.col(c) for c in ("cx", "cy", "w", "h")}, 9))


TYPES = "CASE cls WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 3 END"
C9 = {"cx": "((a + c) / 2) / width", "cy": "((b + d) / 2) / height", "w": "(c - a) / width", "h": "(d - b) / height"}


@query(
    "s13_read_xview", "det images",
    f"WITH k AS (SELECT image_id, {TYPES} AS cls, width, height, greatest(trunc(x1) - 30, 0) AS a, greatest(trunc(y1) - 30, 0) AS b, least(trunc(x2), width) AS c, least(trunc(y2), height) AS d FROM det JOIN images USING (image_id) WHERE det_id % 5 <> 0)"
    f" SELECT image_id, cls, {sql9(**C9)} FROM k WHERE cls IS NOT NULL",
)
def s13(t):
    b = [F.col("x1").cast("int") - 30, F.col("y1").cast("int") - 30, F.col("x2").cast("int"), F.col("y2").cast("int")]
    bounds = F.when(F.col("det_id") % 5 == 0, F.lit("1,2,3")).otherwise(F.concat_ws(",", *[c.cast("string") for c in b]))
    prop = F.struct(bounds.alias("bounds_imcoords"), F.col("image_id").cast("string").alias("image_id"), (F.col("cls") + 11).alias("type_id"))
    path = scratch_path(t.spark, "geojson")
    t.det.select(F.array(F.struct(prop.alias("properties"))).alias("features")).write.json(path)
    frames = t.images.withColumn("image_id", F.col("image_id").cast("string"))
    out = FM.read_xview(t.spark, path, frames, multiline=False)
    return out.select(F.col("image_id").cast("bigint").alias("image_id"), "cls", *rounded({c: F.col(c) for c in ("cx", "cy", "w", "h")}, 9))


@query("s14_read_argoverse", "gt images", f"SELECT image_id * 64 + ann_id AS ann_id, image_id || '.jpg' AS path, cls + 1 AS cls, {sql9(cx='((x1 + x2) / 2) / 1920', cy='(y1 + CASE WHEN ann_id % 6 = 0 THEN 0 ELSE (y2 - y1) / 2 END) / 1200', w='(x2 - x1) / 1920', h='CASE WHEN ann_id % 6 = 0 THEN 0 ELSE y2 - y1 END / 1200')} FROM gt JOIN images USING (image_id)")
def s14(t):
    images, ann = D.read_documents(t.spark, _documents(t), multiline=False)
    out = D.drive_annotations(images, ann)
    return out.select("ann_id", "path", "cls", *rounded({c: F.col(c) for c in ("cx", "cy", "w", "h")}, 9))


@query(
    "s15_read_objects", "gt images",
    "WITH k AS (SELECT image_id * 64 + ann_id AS ann_id, cls, width, height, least(x1, width) AS a, least(y1, height) AS b, least(x2, width) AS c, least(CASE WHEN ann_id % 6 = 0 THEN y1 ELSE y2 END, height) AS d FROM gt JOIN images USING (image_id))"
    f" SELECT ann_id, cls, {sql9(**C9)} FROM k",
)
def s15(t):
    images, ann = D.read_documents(t.spark, _documents(t), multiline=False)
    cats = ann.select(F.col("category_id").alias("id"))
    out = D.objects_annotations(images, ann, cats)
    return out.select("ann_id", "cls", *rounded({c: F.col(c) for c in ("cx", "cy", "w", "h")}, 9))


@query(
    "s16_class_tree", "",
    "WITH f AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 < 8 THEN 'train' ELSE 'val' END AS split, lower(o_orderpriority[3:5]) AS class_name FROM orders),"
    " c AS (SELECT split, class_name, ROW_NUMBER() OVER (PARTITION BY split ORDER BY class_name) - 1 AS cls FROM (SELECT DISTINCT split, class_name FROM f) q)"
    " SELECT '/d/' || split || '/' || class_name || '/' || k || '.jpg' AS path, split, class_name, CAST(cls AS INT) AS cls FROM f JOIN c USING (split, class_name)",
)
def s16(t):
    i = F.col("o_orderkey")
    path = F.concat(
        F.lit("/d/"), F.when(i % 10 < 8, "train").otherwise("val"), F.lit("/"), F.lower(F.substring("o_orderpriority", 3, 3)), F.lit("/"), i.cast("string"), F.lit(".jpg")
    )
    return FI.class_tree(t.table("orders").select(path.alias("path"))).select("path", "split", "class_name", "cls")


@query("s18_read_runs", "runs", "SELECT CAST(epoch AS INT) AS epoch, m AS metric, CAST(count(*) AS BIGINT) AS n, round(sum(CASE m WHEN 'fitness' THEN round(fitness, 6) ELSE epoch * 2.0 END), 4) AS total FROM runs, (VALUES ('fitness'), ('time')) v(m) GROUP BY 1, 2")
def s18(t):
    path = scratch_path(t.spark, "logs")
    r = t.runs.select("run_id", F.col("epoch").alias(" epoch"), (F.col("epoch") * 2.0).alias("   time"), F.round("fitness", 6).alias("  fitness"))
    r.drop("run_id").write.option("header", "true").csv(path)
    long = FM.read_runs(t.spark, path)
    return long.groupBy("epoch", "metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("s19_concat_datasets", "det gt", "SELECT 0 AS source, image_id, conf FROM det UNION ALL SELECT 1, image_id, NULL FROM gt")
def s19(t):
    out = FM.concat_datasets(t.det.select("image_id", "conf"), t.gt.select("image_id", "cls"))
    return out.select("source", "image_id", "conf")


@query("k01_label_lines", "det images", f"SELECT image_id, cls || ' ' || format('{{:g}}', ((x1 + x2) / 2) / width) || ' ' || format('{{:g}}', ((y1 + y2) / 2) / height) || ' ' || format('{{:g}}', (x2 - x1) / width) || ' ' || format('{{:g}}', (y2 - y1) / height) || ' ' || format('{{:g}}', conf) AS line FROM det JOIN images USING (image_id)")
def k01(t):
    return K.label_lines(_det(t), conf=True)


@query("k01_label_files", "det images", "SELECT image_id, CAST(count(*) AS BIGINT) AS n FROM det GROUP BY 1")
def k01b(t):
    path = scratch_path(t.spark, "labels")
    K.write_labels(K.label_lines(_det(t)), path, shards=16)
    back = t.spark.read.text(path).select(F.substring_index("value", "\t", 1).cast("bigint").alias("image_id"))
    return back.groupBy("image_id").agg(F.count("*").alias("n"))


@query("k02_predictions", "det", f"SELECT image_id, det_id, CASE cls WHEN 4 THEN NULL ELSE cls * 10 + 1 END AS category_id, {sql6(x='x1', y='y1', w='x2 - x1', h='y2 - y1', score='conf')} FROM det")
def k02(t):
    d = t.det
    p = K.predictions(d.withColumn("image_id", F.struct("image_id", "det_id")), class_map={0: 1, 1: 11, 2: 21, 3: 31})
    b = {n: F.col("bbox")[i] for i, n in enumerate(("x", "y", "w", "h"))}
    return p.select("image_id.*", "category_id", *r6(**b, score=F.col("score")))


@query("k02_keypoint_predictions", "det", "SELECT image_id, det_id, 15::INT AS numbers, round(x2, 6) AS second_x FROM det")
def k02k(t):
    p = K.predictions(t.kpts.withColumn("image_id", F.struct("image_id", "det_id")), "kpts")
    return p.select("image_id.*", F.size("keypoints").alias("numbers"), *r6(second_x=F.col("keypoints")[3]))


@query("k03_rotated_predictions", "obb", f"SELECT image_id, det_id, printf('%.3f', max(x) FILTER (WHERE pt = 0))::DOUBLE AS px, printf('%.3f', max(y) FILTER (WHERE pt = 0))::DOUBLE AS py FROM ({CORNERS}) c GROUP BY 1, 2")
def k03(t):
    p = K.predictions(t.obb.withColumn("image_id", F.struct("image_id", "det_id")), "obb")
    return p.select("image_id.*", F.col("poly")[0].alias("px"), F.col("poly")[1].alias("py"))


@query("k04_by_class", "obb", f"SELECT replace({NAME_SQL}, ' ', '-') AS class_name, CAST(count(*) AS BIGINT) AS n FROM obb GROUP BY 1")
def k04(t):
    path = scratch_path(t.spark, "classes")
    K.write_by_class(t.obb, path, NAMES)
    return t.spark.read.text(path).groupBy("class_name").agg(F.count("*").alias("n"))


@query("k05_summary", "det images", f"SELECT image_id, {NAME_SQL} AS name, cls AS class, round(conf, 5) AS confidence, {sql6(x1='x1 / width', y2='y2 / height').replace(', 6)', ', 4)')} FROM det JOIN images USING (image_id)".replace("x1 / width, 4", "round(x1 / width, 7), 7").replace("y2 / height, 4", "round(y2 / height, 7), 7"))
def k05(t):
    s = K.summary(_det(t), NAMES, normalize=True, decimals=7)
    return s.select("image_id", "name", "class", *rounded({"confidence": F.col("confidence"), "x1": F.col("box.x1"), "y2": F.col("box.y2")}, 7))


@query("k06_summary_files", "det images", f"SELECT f AS format, {NAME_SQL} AS name, CAST(count(*) AS BIGINT) AS n, round(sum(round(x1, 5)), 3) AS x1 FROM det, (VALUES ('csv'), ('json'), ('xml')) v(f) GROUP BY 1, 2")
def k06(t):
    rows = K.summary(_det(t), NAMES)
    out = None
    for fmt in ("csv", "json", "xml"):
        path = scratch_path(t.spark, fmt)
        K.write_summary(rows, path, fmt)
        if fmt == "csv":
            back = t.spark.read.option("header", "true").csv(path).select("name", F.col("box_x1").cast("double").alias("x1"))
        elif fmt == "json":
            back = t.spark.read.schema("name string, box struct<x1: double>").json(path).select("name", "box.x1")
        else:
            back = t.spark.read.format("xml").option("rowTag", "detection").schema("name string, box struct<x1: double>").load(path).select("name", "box.x1")
        part = back.groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("x1"), 3).alias("x1")).withColumn("format", F.lit(fmt))
        out = part if out is None else out.unionByName(part)
    return out.select("format", "name", "n", "x1")


@query("k07_snapshot", "gt", "SELECT cls, CAST(count(*) AS BIGINT) AS n FROM gt GROUP BY 1")
def k07(t):
    path = scratch_path(t.spark, "snapshot")
    for _ in range(2):  # the second call reads what the first wrote
        snap = K.snapshot(t.spark, _files(t), lambda: t.gt, path)
    return snap.groupBy("cls").agg(F.count("*").alias("n"))


@query("k07_snapshot_files", "gt", "SELECT image_id, ann_id, cls, x1, x2 FROM gt WHERE ann_id % 5 <> 4 UNION ALL SELECT image_id, ann_id, cls + 10, x1, x2 FROM gt WHERE ann_id % 5 = 4 AND image_id % 3 <> 0")
def k07_files(t):
    """A snapshot of one file per truth row, after an update in which one kind of file changed and some of them went."""
    t = t.stored()
    rows = t.gt.select("image_id", "ann_id", "cls", "x1", "x2", F.concat_ws("/", F.col("image_id").cast("string"), F.col("ann_id").cast("string")).alias("path"))
    files = rows.select("path", F.lit(1).alias("length"), "ann_id", "image_id")
    snap = LabelSnapshot(t.spark, scratch_path(t.spark, "labels"))
    snap.update(files, lambda some: rows.join(some.select("path"), "path", "left_semi"))
    later = files.withColumn("length", F.when(F.col("ann_id") % 5 == 4, 2).otherwise(1)).filter("ann_id % 5 <> 4 OR image_id % 3 <> 0")
    snap.update(later, lambda some: rows.join(some.select("path"), "path", "left_semi").withColumn("cls", F.col("cls") + 10))
    return snap.read().select("image_id", "ann_id", "cls", "x1", "x2")


@query("k01_label_files_again", "det images", "SELECT image_id, count(*) AS n, CASE WHEN image_id % 2 = 0 THEN max(conf) ELSE max(conf) / 2 END AS conf FROM det GROUP BY 1")
def k01_again(t):
    """Label files written twice, the second time only half of the images, with their confidences."""
    path = scratch_path(t.spark, "again")
    d = _det(t)
    K.write_labels(K.label_lines(d.withColumn("conf", F.col("conf") / 2), conf=True), path, shards=16)
    for _ in range(2):
        K.write_labels(K.label_lines(d.filter("image_id % 2 = 0"), conf=True), path, shards=16)
    back = t.spark.read.text(path).select(F.split("value", "\t").alias("v")).select(F.col("v")[0].cast("bigint").alias("image_id"), F.substring_index(F.col("v")[1], " ", -1).cast("double").alias("c"))
    return back.groupBy("image_id").agg(F.count("*").alias("n"), F.max("c").alias("conf"))


@query("k10_append_metrics", "runs", "SELECT run_id, epoch, format('{:g}', CASE WHEN epoch % 3 = 0 THEN fitness * 2 ELSE fitness END) AS fitness FROM runs")
def k10_append(t):
    """A log of which some rows are written again."""
    path = scratch_path(t.spark, "log")
    K.append_metrics(t.runs, path, ["fitness"], shards=16)
    for _ in range(2):
        K.append_metrics(t.runs.filter("epoch % 3 = 0").withColumn("fitness", F.col("fitness") * 2), path, ["fitness"], shards=16)
    return t.spark.read.schema("run_id bigint, epoch int, fitness string").option("header", "true").csv(path).select("run_id", "epoch", "fitness")


@query("k10_metric_rows", "runs", "SELECT run_id, epoch, format('{:g}', fitness) AS fitness FROM runs")
def k10(t):
    rows = t.runs
    return rows.select("run_id", "epoch", X.format_g("fitness").alias("fitness"))


@query("c01_clean_str", "", "SELECT p_partkey, regexp_replace(replace(p_name, ' ', '#') || '%' || p_brand || '(' || p_type || ')', '[|@#!¡·$€%&()=?¿^*;:,¨´><+]', '_', 'g') AS name FROM part")
def c01(t):
    raw = F.concat(F.replace("p_name", F.lit(" "), F.lit("#")), F.lit("%"), "p_brand", F.lit("("), "p_type", F.lit(")"))
    return t.table("part").select("p_partkey", X.clean_str(raw).alias("name"))


@query("c02_path_parts", "", "SELECT url, regexp_extract(url, '([^/]*?)(\\.[^./]*)?$', 1) AS stem, lower(regexp_extract(url, '\\.([^./]*)$', 1)) AS suffix FROM pages")
def c02(t):
    return t.table("pages").select("url", X.stem("url").alias("stem"), X.suffix("url").alias("suffix"))


@query("c03_format_g", "", "SELECT o_orderkey, format('{:g}', o_totalprice) AS a, format('{:g}', o_totalprice * 1000) AS b, format('{:g}', o_totalprice / 1e11) AS c FROM orders")
def c03(t):
    p = F.col("o_totalprice")
    return t.table("orders").select("o_orderkey", X.format_g(p).alias("a"), X.format_g(p * 1000).alias("b"), X.format_g(p / 1e11).alias("c"))


@query(
    "c04_class_names", "",
    "WITH n AS (SELECT CASE WHEN n_nationkey % 7 = 3 THEN 'x' || n_nationkey WHEN n_nationkey % 7 = 5 THEN '' || (n_nationkey + 100) ELSE '' || n_nationkey END AS cls, n_name AS name FROM nation), k AS (SELECT TRY_CAST(cls AS INT) AS cls, name, count(*) OVER () AS n FROM n)"
    " SELECT cls, name, CASE WHEN cls IS NULL THEN 'not a number' WHEN cls >= n THEN 'out of range' END AS problem FROM k",
)
def c04(t):
    k = F.col("n_nationkey")
    key = F.when(k % 7 == 3, F.concat(F.lit("x"), k.cast("string"))).when(k % 7 == 5, (k + 100).cast("string")).otherwise(k.cast("string"))
    return FM.check_class_names(t.table("nation").select(key.alias("cls"), F.col("n_name").alias("name")))


@query("c05_tile_parts", "obb", "SELECT 'P' || image_id AS image_id, det_id, CAST(image_id % 4 * 200 AS DOUBLE) AS tile_x, CAST(det_id * 100 AS DOUBLE) AS tile_y FROM obb")
def c05(t):
    from ..operators.suppress import tile_parts

    i, k = F.col("image_id"), F.col("det_id")
    tile = F.concat(F.lit("P"), i.cast("string"), F.lit("__1024__"), (i % 4 * 200).cast("string"), F.lit("___"), (k * 100).cast("string"))
    d = t.obb.select(tile.alias("image_id"), "det_id")
    p = tile_parts()
    return d.select("det_id", *[c.alias(n) for n, c in p.items()])


@query("c06_sha256", "", "SELECT doc_id, sha256(text) AS digest FROM documents")
def c06(t):
    return t.table("documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("c10_json", "", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events")
def c10(t):
    lines = K.to_json_lines(t.table("events").select("event_id", "props"))
    back = K.parse_json_lines(lines, "event_id bigint, props string")
    return back.select("event_id", F.get_json_object("props", "$.k").alias("k"))


