"""Queries that write files from the given tables and read them through the sources, and lines of every label kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rotated import point
from ..operators import augment as AU
from ..operators import runs as RU
from ..operators import video as V
from ..session import scratch_path
from ..sources import files as FI
from ..sources import formats as FM
from ..sources import labels as LB
from ..sources import sinks as K
from .logs import TOP, _trials
from .registry import query

BOX = ("x1", "y1", "x2", "y2")
BUCKETS = 40


def _folders(t, df: DataFrame, *by: str, suffix: str = "jpg") -> str:
    """One file per value of ``by``, in folders named ``column=value``."""
    path = scratch_path(t.spark, "files")
    df.repartition(*by).write.partitionBy(*by).option("extension", suffix).csv(path)
    return path


def _folder_of(name: str):
    return F.regexp_extract("path", f"{name}=([^/]+)", 1)


def _bucketed(t) -> DataFrame:
    return t.images.select("image_id", "split", (F.col("image_id") % BUCKETS).alias("bucket"))


@query("s01_scan_image_files", "images", f"SELECT DISTINCT split, CAST(image_id % {BUCKETS} AS VARCHAR) AS bucket, true AS filled FROM images")
def s01_files(t):
    """Image files of a folder tree; ids are paths below the root."""
    path = _folders(t, _bucketed(t), "split", "bucket")
    found = FI.scan_images(t.spark, path, root=path).withColumn("path", F.col("image_id"))
    return found.select(_folder_of("split").alias("split"), _folder_of("bucket").alias("bucket"), (F.col("bytes") > 0).alias("filled"))


@query("s02_scan_media_files", "images", f"SELECT DISTINCT CAST(image_id % {BUCKETS} AS VARCHAR) AS bucket, kind FROM images, (VALUES ('image'), ('video')) k(kind)")
def s02_files(t):
    """Images and videos of two folder trees, other files left out."""
    trees = [_folders(t, _bucketed(t).drop("split"), "bucket", suffix=s) for s in ("png", "mov", "txt")]
    return FI.scan_media(t.spark, trees).select(_folder_of("bucket").alias("bucket"), "kind")


G = "format('{{:g}}', {0})::DOUBLE AS {1}"
NORMAL = ", ".join(G.format(e, n) for e, n in (("((x1 + x2) / 2) / width", "cx"), ("((y1 + y2) / 2) / height", "cy"), ("(x2 - x1) / width", "w"), ("(y2 - y1) / height", "h")))


@query("s04_read_label_files", "gt images", f"SELECT DISTINCT CAST(image_id % {BUCKETS} AS VARCHAR) AS bucket, cls, {NORMAL} FROM gt JOIN images USING (image_id)")
def s04_files(t):
    """Label files read from their folder, checked, equal lines of a file once."""
    lines = K.label_lines(t.gt.join(t.images.select("image_id", "width", "height"), "image_id"))
    path = scratch_path(t.spark, "labels")
    lines.select((F.col("image_id") % BUCKETS).alias("bucket"), "line").repartition("bucket").write.partitionBy("bucket").text(path)
    found = LB.read_labels(t.spark, path, 5)
    return found.select(_folder_of("bucket").alias("bucket"), "cls", "cx", "cy", "w", "h")


@query("s09_read_dota_files", "det", "SELECT CASE cls WHEN 0 THEN 'plane' WHEN 1 THEN 'ship' ELSE 'harbor' END AS class_name, round(x1 / 1000, 9) AS x, round(y2 / 800, 9) AS y FROM det")
def s09_files(t):
    name = F.when(F.col("cls") == 0, "plane").when(F.col("cls") == 1, "ship").otherwise("harbor")
    line = F.concat_ws(" ", "x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2", name, F.lit("0"))
    path = scratch_path(t.spark, "aerial")
    t.det.select(line.alias("value")).write.text(path)
    images = FI.list_files(t.spark, path).select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("image_id"), F.lit(1000).alias("width"), F.lit(800).alias("height"))
    found = FM.read_dota(t.spark, path, images)
    return found.select("class_name", F.round(F.col("polygon")[3]["x"], 9).alias("x"), F.round(F.col("polygon")[3]["y"], 9).alias("y"))


@query("s10_read_visdrone_files", "det", "SELECT cls, round((trunc(x1) + trunc(x2 - x1) / 2) / 1000, 9) AS cx, round(trunc(y2 - y1) / 800, 9) AS h FROM det WHERE det_id % 4 <> 0")
def s10_files(t):
    line = F.concat_ws(",", *[c.cast("int").cast("string") for c in (F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))], (F.col("det_id") % 4).cast("string"), (F.col("cls") + 1).cast("string"), F.lit("0"), F.lit("0"))
    path = scratch_path(t.spark, "drone")
    t.det.select(line.alias("value")).write.text(path)
    images = FI.list_files(t.spark, path).select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("image_id"), F.lit(1000).alias("width"), F.lit(800).alias("height"))
    return FM.read_visdrone(t.spark, path, images).select("cls", F.round("cx", 9).alias("cx"), F.round("h", 9).alias("h"))


@query("s16_read_class_files", "images", "WITH c AS (SELECT DISTINCT split, image_id % 7 AS k FROM images) SELECT split, CAST(k AS VARCHAR) AS class_name, CAST(ROW_NUMBER() OVER (PARTITION BY split ORDER BY k) - 1 AS INT) AS cls FROM c")
def s16_files(t):
    """Images of a tree with a folder per split and class."""
    path = _folders(t, t.images.select("image_id", "split", (F.col("image_id") % 7).alias("k")), "split", "k")
    found = FI.read_class_tree(t.spark, path)
    return found.select(_folder_of("split").alias("split"), _folder_of("k").alias("class_name"), "cls")


def _g(*numbers: str) -> str:
    return " || ' ' || ".join(f"format('{{:g}}', {n})" for n in numbers)


FOUR = [f"{a} / width" if a[0] == "x" else f"{a} / height" for a in ("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2")]


@query("k01_polygon_lines", "det images", f"SELECT image_id, cls || ' ' || {_g(*FOUR)} AS line FROM det JOIN images USING (image_id)")
def k01_polygons(t):
    four = F.array(point("x1", "y1"), point("x2", "y1"), point("x2", "y2"), point("x1", "y2"))
    return K.label_lines(t.det.join(t.images, "image_id").withColumn("polygon", four), "polygon")


@query("k01_keypoint_lines", "det images", f"SELECT image_id, cls || ' ' || {_g('((x1 + x2) / 2) / width', '((y1 + y2) / 2) / height', '(x2 - x1) / width', '(y2 - y1) / height', 'x1 / width', 'y1 / height', '2.0', 'x2 / width', 'y2 / height', '1.0', 'conf')} AS line FROM det JOIN images USING (image_id)")
def k01_keypoints(t):
    two = F.expr("array(named_struct('x', x1, 'y', y1, 'v', 2.0D), named_struct('x', x2, 'y', y2, 'v', 1.0D))")
    return K.label_lines(t.det.join(t.images, "image_id").withColumn("keypoints", two), conf=True)


ROT = (
    "WITH v AS (SELECT image_id, det_id, cls, cx, cy, cos(r) * w / 2 AS ax, sin(r) * w / 2 AS ay, -sin(r) * h / 2 AS bx, cos(r) * h / 2 AS \"by\", width, height FROM obb JOIN images USING (image_id))"
    " SELECT image_id, cls, format('{:g}', (cx + ax + bx) / width)::DOUBLE AS x1, format('{:g}', (cy + ay + \"by\") / height)::DOUBLE AS y1, format('{:g}', (cx - ax - bx) / width)::DOUBLE AS x3, format('{:g}', (cy - ay - \"by\") / height)::DOUBLE AS y3, 9 AS n FROM v"
)


@query("k01_rotated_lines", "obb images", ROT)
def k01_rotated(t):
    """Two opposite corners, read again from the lines."""
    lines = K.label_lines(t.obb.join(t.images.select("image_id", "width", "height"), "image_id"), "rotated")
    v = lines.select("image_id", F.split("line", " ").alias("v"))
    nums = {"x1": 1, "y1": 2, "x3": 5, "y3": 6}
    return v.select("image_id", F.col("v")[0].cast("int").alias("cls"), *[F.col("v")[i].cast("double").alias(n) for n, i in nums.items()], F.size("v").alias("n"))


@query("k01_class_lines", "", "WITH p AS (SELECT vec_id, unnest(range(0, 3)) AS rank, CASE WHEN vec_id % 2 = 0 THEN [0.5, 0.3, 0.2] ELSE [0.125, 0.25, 0.625] END AS probs FROM embeddings) SELECT vec_id AS image_id, CAST(rank AS INT) AS rank, CASE WHEN vec_id % 2 = 0 THEN ['0.50 cat', '0.30 dog', '0.20 owl'][rank + 1] ELSE ['0.62 owl', '0.25 dog', '0.12 cat'][rank + 1] END AS line FROM p")
def k01_classes(t):
    probs = F.when(F.col("vec_id") % 2 == 0, F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2))).otherwise(F.array(F.lit(0.125), F.lit(0.25), F.lit(0.625)))
    return K.class_lines(t.table("embeddings").select(F.col("vec_id").alias("image_id"), probs.alias("probs")), ["cat", "dog", "owl"])


@query("l06_prompt_texts", "gt", "WITH o AS (SELECT image_id, cls, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY cls) AS k FROM (SELECT DISTINCT image_id, cls FROM gt) q), l AS (SELECT image_id, list('a ' || ['cat', 'dog', 'owl', 'fox', 'hen'][cls + 1] || '.' ORDER BY cls) AS l FROM o GROUP BY 1) SELECT image_id, array_to_string(list_concat(l, list_transform(range(0, 8 - len(l)), lambda i: '-')), '|') AS texts FROM l")
def l06_texts(t):
    """Texts of each image's own classes, padded to eight."""
    own = t.gt.select("image_id", "cls").distinct().select("image_id", "cls", F.col("cls").alias("new_cls"))
    out = AU.prompt_texts(own, ["cat", "dog", "owl", "fox", "hen"], "a {}.", 8, "-")
    return out.select("image_id", F.array_join("texts", "|").alias("texts"))


@query(
    "v06_normalized_heat", "tracks",
    "WITH b AS (SELECT video_id, trunc(x1)::INT AS x1, trunc(y1)::INT AS y1, trunc(x2)::INT AS x2, trunc(y2)::INT AS y2 FROM tracks), c AS (SELECT *, (x1 + x2) // 2 AS mx, (y1 + y2) // 2 AS my, least(x2 - x1, y2 - y1) // 2 AS r FROM b),"
    " p AS (SELECT video_id, mx, my, r, x1, x2, unnest(range(y1, y2))::INT AS y FROM c), q AS (SELECT video_id, mx, my, r, y, unnest(range(x1, x2))::INT AS x FROM p),"
    " h AS (SELECT video_id, x, y, count(*) * 2.0::DOUBLE AS heat FROM q WHERE x >= 300 AND x < 400 AND y >= 360 AND y < 400 AND (x - mx) * (x - mx) + (y - my) * (y - my) <= r * r GROUP BY 1, 2, 3),"
    " e AS (SELECT video_id, max(heat) AS hi, CASE WHEN count(*) >= 4000 THEN min(heat) ELSE 0 END AS lo FROM h GROUP BY 1)"
    " SELECT video_id, x, y, round(coalesce((heat - lo) * 255 / nullif(hi - lo, 0), 0), 6) AS heat FROM h JOIN e USING (video_id)",
)
def v06_scaled(t):
    """Heat of a part of the picture that boxes cover throughout, between its own ends."""
    part = V.heatmap(t.tracks, width=640, height=1000).filter("x >= 300 AND x < 400 AND y >= 360 AND y < 400")
    return V.normalized_heat(part, pixels=4000).withColumn("heat", F.round("heat", 6))


@query("l07_choose_parent", "", f"WITH {TOP}, s AS (SELECT run_id, weight / sum(weight) OVER () AS share, fitness FROM w), c AS (SELECT run_id, sum(share) OVER (ORDER BY fitness DESC, run_id) AS upto FROM s) SELECT run_id FROM c WHERE upto > 0.6 ORDER BY upto LIMIT 1")
def l07_parent(t):
    return RU.choose_parent(_trials(t), 0.6).select("run_id")
