"""Dataset-specific text, CSV, XML and GeoJSON annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import text as X
from ..functions.rotated import point
from ..operators.joins import map_classes

# Aerial class names, in id order.
AERIAL_NAMES = [
    "plane", "ship", "storage-tank", "baseball-diamond", "tennis-court", "basketball-court", "ground-track-field",
    "harbor", "bridge", "large-vehicle", "small-vehicle", "helicopter", "roundabout", "soccer-ball-field",
    "swimming-pool", "container-crane", "airport", "helipad",
]

# Satellite type ids that name a class; their order is the class id.
SATELLITE_TYPES = [
    11, 12, 13, 15, 17, 18, 19, 20, 21, 23, 24, 25, 26, 27, 28, 29, 32, 33, 34, 35, 36, 37, 38, 40, 41, 42, 44, 45, 47,
    49, 50, 51, 52, 53, 54, 55, 56, 57, 59, 60, 61, 62, 63, 64, 65, 66, 71, 72, 73, 74, 76, 77, 79, 83, 84, 86, 89, 91,
    93, 94,
]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("recursiveFileLookup", "true").text(path)
    src = F.regexp_replace("_metadata.file_path", "^file:(//)?", "")
    return df.select(X.stem(src).alias("image_id"), F.col("value").alias("line"))


def parse_dota(lines: DataFrame, images: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Lines ``x1 y1 ... x4 y4 class difficulty`` to class and normalised polygon; short lines are headers.

    ``images`` has ``image_id, width, height``. An unknown class name gives a NULL class.
    """
    names = names or AERIAL_NAMES
    p = lines.withColumn("p", F.split(F.trim("line"), r"\s+")).filter(F.size("p") >= 9)
    p = map_classes(p.withColumn("class_name", F.get("p", F.lit(8))), {n: i for i, n in enumerate(names)}, "class_name", "cls")
    p = p.join(images.select("image_id", "width", "height"), "image_id")
    num = [F.get("p", F.lit(i)).try_cast("double") / F.col("width" if i % 2 == 0 else "height") for i in range(8)]
    poly = F.array(*[point(num[2 * i], num[2 * i + 1]) for i in range(4)])
    return p.select("image_id", "cls", "class_name", poly.alias("polygon"))


def read_dota(spark, path, images, names=None) -> DataFrame:
    return parse_dota(_lines(spark, path), images, names)


def parse_visdrone(lines: DataFrame, images: DataFrame) -> DataFrame:
    """Lines ``left,top,width,height,score,category,...``; a score field of 0 marks an ignored region."""
    p = lines.withColumn("p", F.split("line", ",")).filter((F.size("p") >= 6) & (F.trim(F.get("p", F.lit(4))) != "0"))
    x, y, w, h = (F.get("p", F.lit(i)).try_cast("int") for i in range(4))
    p = p.join(images.select("image_id", "width", "height"), "image_id")
    return p.select(
        "image_id",
        (F.get("p", F.lit(5)).try_cast("int") - 1).alias("cls"),
        ((x + w / 2) / F.col("width")).alias("cx"),
        ((y + h / 2) / F.col("height")).alias("cy"),
        (w / F.col("width")).alias("w"),
        (h / F.col("height")).alias("h"),
    )


def read_visdrone(spark, path, images) -> DataFrame:
    return parse_visdrone(_lines(spark, path), images)


SHELF_SCHEMA = "image string, x1 double, y1 double, x2 double, y2 double, class string, width double, height double"


def parse_sku(rows: DataFrame) -> DataFrame:
    """Shelf rows with corners and image size; there is one class, 0."""
    return rows.select(
        X.stem("image").alias("image_id"), F.lit(0).alias("cls"), *B.named(B.xyxy2xywhn("x1", "y1", "x2", "y2", "width", "height"))
    )


def read_sku(spark, path) -> DataFrame:
    return parse_sku(spark.read.schema(SHELF_SCHEMA).csv(path))


VOC_SCHEMA = (
    "filename string, size struct<width: int, height: int, depth: int>, object array<struct<name: string, difficult: int, "
    "bndbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>>>"
)


def parse_voc(docs: DataFrame, names: list[str]) -> DataFrame:
    """Documents with an object list; difficult objects and unknown names are left out, centres move by one pixel."""
    o = docs.select(X.stem("filename").alias("image_id"), "size", F.explode("object").alias("o"))
    o = o.filter(F.coalesce(F.col("o.difficult"), F.lit(0)) != 1).withColumn("name", F.col("o.name"))
    o = map_classes(o, {n: i for i, n in enumerate(names)}, "name", "cls").filter(F.col("cls").isNotNull())
    b, w, h = F.col("o.bndbox"), F.col("size.width"), F.col("size.height")
    return o.select(
        "image_id",
        "cls",
        (((b["xmin"] + b["xmax"]) / 2 - 1) / w).alias("cx"),
        (((b["ymin"] + b["ymax"]) / 2 - 1) / h).alias("cy"),
        ((b["xmax"] - b["xmin"]) / w).alias("w"),
        ((b["ymax"] - b["ymin"]) / h).alias("h"),
    )


def read_voc(spark, path, names: list[str]) -> DataFrame:
    docs = spark.read.format("xml").option("rowTag", "annotation").schema(VOC_SCHEMA).load(path)
    return parse_voc(docs, names)


FEATURES = "features array<struct<properties: struct<bounds_imcoords: string, image_id: string, type_id: int>>>"


def parse_xview(features: DataFrame, images: DataFrame) -> DataFrame:
    """Feature rows ``image_id, bounds, type_id``; unknown types and malformed bounds are skipped, boxes are clipped."""
    f = map_classes(features, {t: i for i, t in enumerate(SATELLITE_TYPES)}, "type_id", "cls").filter(F.col("cls").isNotNull())
    f = f.withColumn("p", F.transform(F.split("bounds", ","), lambda s: F.trim(s).try_cast("double")))
    f = f.filter((F.size("p") == 4) & ~F.exists("p", lambda v: v.isNull()))
    f = f.join(images.select("image_id", "width", "height"), "image_id")
    box = B.xyxy2xywhn(*[F.get("p", F.lit(i)) for i in range(4)], "width", "height", clip=True)
    return f.select("image_id", "cls", *B.named(box))


def read_xview(spark, path, images, multiline=True) -> DataFrame:
    doc = spark.read.schema(FEATURES).option("multiLine", str(multiline).lower()).json(path)
    f = doc.select(F.explode("features.properties").alias("p"))
    f = f.select(F.col("p.image_id").alias("image_id"), F.col("p.bounds_imcoords").alias("bounds"), F.col("p.type_id").alias("type_id"))
    return parse_xview(f.filter(F.coalesce("bounds", F.lit("")) != ""), images)


def check_class_names(names: DataFrame) -> DataFrame:
    """Class table ``cls, name`` with whole-number ids; ``problem`` says what is wrong with a row, NULL when it is fine.

    Ids must lie in 0 .. n - 1 for n classes.
    """
    n = names.agg(F.count("*").alias("_n"))  # one row
    out = names.select(F.col("cls").try_cast("int").alias("cls"), F.col("name").cast("string").alias("name")).join(F.broadcast(n))
    problem = F.when(F.col("cls").isNull(), "not a number").when((F.col("cls") < 0) | (F.col("cls") >= F.col("_n")), "out of range")
    return out.select("cls", "name", problem.alias("problem"))


def concat_datasets(*dfs: DataFrame) -> DataFrame:
    """Datasets one after the other; columns missing in one are NULL there. ``source`` numbers the parts."""
    out = None
    for i, df in enumerate(dfs):
        df = df.withColumn("source", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_runs(spark: SparkSession, path) -> DataFrame:
    """Training logs (CSV with a header per file) as ``run, epoch, metric, value`` rows."""
    raw = spark.read.option("header", "true").option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").csv(path)
    src = X.stem(F.regexp_replace("_metadata.file_path", "^file:(//)?", "")).alias("run")
    return runs_long(raw.select(src, *[F.col(f"`{c}`").alias(c.strip()) for c in raw.columns]))


def runs_long(wide: DataFrame, fixed=("run", "epoch")) -> DataFrame:
    metrics = [c for c in wide.columns if c not in fixed]
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").try_cast("double").alias("value")) for m in metrics])
    out = wide.select(*fixed[:-1], F.col(fixed[-1]).cast("int").alias(fixed[-1]), F.explode(pairs).alias("m"))
    return out.select(*fixed, "m.metric", "m.value")
