"""JSON annotation documents with image and annotation lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..operators.joins import map_classes

# Ids in 1..91 that name no class in the 80-class list.
UNUSED_IDS = [12, 26, 29, 30, 45, 66, 68, 69, 71, 83, 91]


def to80() -> dict[int, int | None]:
    """Category id 1..91 to class 0..79; unused ids give None."""
    out, n = {}, 0
    for i in range(1, 92):
        out[i] = None if i in UNUSED_IDS else n
        n += i not in UNUSED_IDS
    return out


def to91() -> dict[int, int]:
    """Class 0..79 back to the category id."""
    return {v: k for k, v in to80().items() if v is not None}


IMAGE = "id: bigint, width: int, height: int, file_name: string, coco_url: string, caption: string, name: string, sid: int"
ANN = (
    "id: bigint, image_id: bigint, category_id: int, bbox: array<double>, iscrowd: int, area: double, "
    "segmentation: array<array<double>>, keypoints: array<double>, tokens_positive: array<array<int>>"
)
SCHEMA = f"images array<struct<{IMAGE}>>, annotations array<struct<{ANN}>>, categories array<struct<id: int, name: string>>"


def read_documents(spark: SparkSession, path, multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(images, annotations)``, one row per list entry, with the source ``file``.

    A file is the unit of reading; large datasets come as many files (or with ``multiline=False`` many lines).
    """
    doc = spark.read.schema(SCHEMA).option("multiLine", str(multiline).lower()).json(path)
    doc = doc.withColumn("file", F.col("_metadata.file_path"))
    images = doc.select("file", F.explode("images").alias("i")).select("file", "i.*")
    ann = doc.select("file", F.posexplode("annotations").alias("pos", "a")).select("file", "pos", "a.*")
    return images, ann


def _joined(images: DataFrame, ann: DataFrame, cols: list[str]) -> DataFrame:
    right = images.select("file", F.col("id").alias("image_id"), "width", "height", *cols)
    return ann.withColumnRenamed("id", "ann_id").join(right, ["file", "image_id"])


def normalized_box(clip: bool = False, width="width", height="height") -> dict[str, Column]:
    """Top-left box array ``bbox`` to normalised centre format."""
    x, y, w, h = (F.col("bbox")[i] for i in range(4))
    if clip:
        return B.xyxy2xywhn(x, y, x + w, y + h, width, height, clip=True)
    return {"cx": (x + w / 2) / F.col(width), "cy": (y + h / 2) / F.col(height), "w": w / F.col(width), "h": h / F.col(height)}


def usable(joined: DataFrame) -> DataFrame:
    """Without crowds and boxes of no width or height."""
    return joined.filter((F.coalesce("iscrowd", F.lit(0)) == 0) & (F.col("w") > 0) & (F.col("h") > 0))


def first_per_box(df: DataFrame, cls="cls") -> DataFrame:
    """Of annotations of an image with the same class and box the first one."""
    key = ["file", "image_id", cls, "cx", "cy", "w", "h"]
    rest = [c for c in df.columns if c not in key]
    out = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col("pos")).alias("_r"))
    return out.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def polygon_parts(width="width", height="height") -> Column:
    """``segmentation`` as normalised parts, each a point array."""
    w, h = F.col(width), F.col(height)

    def part(s):
        return F.transform(
            F.sequence(F.lit(0), F.floor(F.size(s) / 2).cast("int") - 1),
            lambda i: F.struct((F.element_at(s, i * 2 + 1) / w).alias("x"), (F.element_at(s, i * 2 + 2) / h).alias("y")),
        )

    return F.transform(F.filter("segmentation", lambda s: F.size(s) >= 2), part)


def keypoint_array(width="width", height="height") -> Column:
    k, w, h = F.col("keypoints"), F.col(width), F.col(height)
    n = F.floor(F.size(k) / 3).cast("int")
    pts = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            (F.element_at(k, i * 3 + 1) / w).alias("x"), (F.element_at(k, i * 3 + 2) / h).alias("y"),
            F.element_at(k, i * 3 + 3).alias("v"),
        ),
    )
    return F.when(n > 0, pts)


def coco_annotations(
    images: DataFrame, ann: DataFrame, class_map: dict | None = None, segments=False, keypoints=False, flavour="coco"
) -> DataFrame:
    """Annotations with class, normalised box and, on request, polygon parts and keypoints.

    ``class_map`` maps category ids to classes (holes give NULL); without it the class is the id less one. ``flavour="lvis"``
    takes the image's relative path from its URL.
    """
    df = _joined(images, ann, ["file_name", "coco_url"]).withColumns(normalized_box())
    df = usable(df)
    if class_map is None:
        df = df.withColumn("cls", F.col("category_id") - 1)
    else:
        df = map_classes(df, class_map, "category_id", "cls")
    df = first_per_box(df)
    path = F.regexp_extract("coco_url", r"^https?://[^/]+/(.*)$", 1) if flavour == "lvis" else F.col("file_name")
    out = df.withColumn("path", path)
    cols = ["file", "path", "image_id", "ann_id", "cls", "cx", "cy", "w", "h"]
    if segments:
        out = out.withColumn("parts", polygon_parts())
        cols.append("parts")
    if keypoints:
        out = out.withColumn("keypoints", keypoint_array())
        cols.append("keypoints")
    return out.select(*cols)


def read_coco(spark, path, class_map=None, segments=False, keypoints=False, flavour="coco", multiline=True) -> DataFrame:
    images, ann = read_documents(spark, path, multiline)
    if flavour == "grounding":
        return grounding_annotations(images, ann)
    return coco_annotations(images, ann, class_map, segments, keypoints, flavour)


def grounding_annotations(images: DataFrame, ann: DataFrame) -> DataFrame:
    """Annotations whose class is a phrase of the caption; ids number an image's phrases by first appearance."""
    slim = ann.select("file", "pos", "id", "image_id", "bbox", "iscrowd", "tokens_positive")  # outlines and the like stay behind
    df = usable(_joined(images, slim, ["file_name", "caption"]).withColumns(normalized_box()))
    caption = F.col("caption")
    phrase = F.array_join(
        F.transform("tokens_positive", lambda t: F.substring(caption, t[0] + 1, t[1] - t[0])), " "
    )
    df = df.withColumn("phrase", phrase).drop("bbox", "iscrowd", "tokens_positive", "caption", "width", "height")
    # one row per image and phrase; the window sees the phrases of one caption
    first = df.groupBy("file", "image_id", "phrase").agg(F.min("pos").alias("_p"))
    rank = F.row_number().over(Window.partitionBy("file", "image_id").orderBy("_p")) - 1
    df = df.join(first.withColumn("cls", rank).drop("_p"), ["file", "image_id", "phrase"])
    return first_per_box(df).select("file", F.col("file_name").alias("path"), "image_id", "ann_id", "cls", "phrase", "cx", "cy", "w", "h")


def objects_annotations(images: DataFrame, ann: DataFrame, categories: DataFrame) -> DataFrame:
    """Large detection sets in the same layout: boxes clipped to the image, class = place of the category id.

    ``categories`` has one row per class (``id``).
    """
    ids = categories.select("id").distinct()
    ids = ids.withColumn("cls", F.row_number().over(Window.orderBy("id")) - 1)  # one row per class
    df = _joined(images, ann, ["file_name"]).withColumns(normalized_box(clip=True))
    return df.join(ids.withColumnRenamed("id", "category_id"), "category_id").select(
        F.col("file_name").alias("path"), "image_id", "ann_id", "cls", "cx", "cy", "w", "h"
    )


def drive_annotations(images: DataFrame, ann: DataFrame, width: float = 1920.0, height: float = 1200.0) -> DataFrame:
    """Driving sets whose frames all have one size; the class is the category id itself."""
    df = ann.withColumnRenamed("id", "ann_id").withColumns({"width": F.lit(width), "height": F.lit(height)})
    df = df.withColumns(normalized_box())
    names = images.select("file", F.col("id").alias("image_id"), F.col("name").alias("path"))
    return df.join(names, ["file", "image_id"]).select(
        "path", "image_id", "ann_id", F.col("category_id").alias("cls"), "cx", "cy", "w", "h"
    )
