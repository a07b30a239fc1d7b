"""Listing of image and video files, list files, class folders and dataset fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.ordered import with_global_rank

# Recognised file suffixes.
IMAGE_SUFFIXES = ["bmp", "dng", "jpeg", "jpg", "mpo", "png", "tif", "tiff", "webp", "pfm", "heic"]
VIDEO_SUFFIXES = ["asf", "avi", "gif", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "ts", "wmv", "webm"]


def media_kind(path) -> Column:
    """``image``, ``video`` or NULL."""
    s = X.suffix(path)
    return F.when(s.isin(IMAGE_SUFFIXES), F.lit("image")).when(s.isin(VIDEO_SUFFIXES), F.lit("video"))


def list_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``path, length`` of the files below directories or matching globs. File contents are not read."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return df.select(F.regexp_replace("path", "^file:", "").alias("path"), "length")


def scan_list(spark: SparkSession, path: str) -> DataFrame:
    """Paths named in list files, one per line; ``./`` means the list file's own folder."""
    lines = spark.read.text(path).select("value", F.regexp_replace("_metadata.file_path", "^file:(//)?", "").alias("src"))
    return rebase(lines.filter(F.trim("value") != ""))


def rebase(lines: DataFrame) -> DataFrame:
    """``value`` (a line) and ``src`` (its list file) to ``path``."""
    folder = F.regexp_replace("src", "/[^/]*$", "/")
    line = F.trim("value")
    return lines.select(
        F.when(line.startswith("./"), F.concat(folder, F.substring(line, F.lit(3), F.length(line)))).otherwise(line).alias("path")
    )


def select_images(files: DataFrame, fraction: float = 1.0) -> DataFrame:
    """Image rows of a ``path`` table, in path order the leading ``fraction`` of them."""
    images = files.filter(media_kind("path") == "image")
    return images if fraction >= 1.0 else leading_fraction(images, fraction, "path")


def leading_fraction(df: DataFrame, fraction: float, *order: str) -> DataFrame:
    """First round(n * fraction) rows in the given order (at least one)."""
    ranked = with_global_rank(df, *order, name="_rank")
    # one row
    limit = ranked.agg(F.greatest(F.bround(F.count("*") * fraction, 0), F.lit(1)).alias("_limit"))
    return ranked.join(F.broadcast(limit), F.col("_rank") <= F.col("_limit")).drop("_rank", "_limit")


def scan_images(spark: SparkSession, paths, fraction: float = 1.0, root: str | None = None) -> DataFrame:
    """Image files with ``image_id``, ``path`` and size in bytes. The id is the path below ``root`` (see ``image_key``); give one
    whenever the files lie in several folders."""
    out = select_images(list_files(spark, paths), fraction)
    return out.select(X.image_key("path", root).alias("image_id"), "path", F.col("length").alias("bytes"))


def scan_media(spark: SparkSession, paths) -> DataFrame:
    """``path, kind`` of images and videos; sort by ``kind, path`` for images first."""
    files = list_files(spark, paths)
    return with_kind(files.select("path"))


def with_kind(files: DataFrame) -> DataFrame:
    return files.withColumn("kind", media_kind("path")).filter(F.col("kind").isNotNull())


def class_tree(files: DataFrame, root: str = "") -> DataFrame:
    """Images of a ``root/split/class/file`` tree: ``path, split, class_name, cls``.

    Class ids number the sorted class names of each split from 0.
    """
    img = files.filter(media_kind("path") == "image")
    img = img.withColumn("class_name", X.parent_name("path"))
    img = img.withColumn("split", F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]*$", 1))
    names = img.select("split", "class_name").distinct()
    ids = names.withColumn("cls", F.row_number().over(Window.partitionBy("split").orderBy("class_name")) - 1)
    return img.join(ids, ["split", "class_name"])


def read_class_tree(spark: SparkSession, root: str) -> DataFrame:
    return class_tree(list_files(spark, root)).withColumn("image_id", X.stem("path"))


def dataset_hash(files: DataFrame, path="path", size="length") -> DataFrame:
    """One-row fingerprint of a file table: total size, number of files and a digest that ignores row order.

    Each path is hashed; the four 15-hex-digit leading parts of the hashes are combined by XOR and by sum, which merge
    partially on every executor. A digest over the joined path list would pass all paths through one task.
    """
    h = F.sha2(F.concat_ws("|", F.col(path), F.coalesce(F.col(size), F.lit(0)).cast("string")), 256)
    parts = [F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("bigint") for i in range(4)]
    agg = files.agg(
        F.coalesce(F.sum(size), F.lit(0)).alias("bytes"),
        F.count("*").alias("files"),
        *[F.coalesce(F.bit_xor(p), F.lit(0)).alias(f"x{i}") for i, p in enumerate(parts)],
        F.coalesce(F.sum(parts[0].cast("decimal(38,0)")), F.lit(0)).alias("s"),
    )
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in ("bytes", "files", "x0", "x1", "x2", "x3", "s")])
    return agg.select("bytes", "files", F.sha2(text, 256).alias("digest"))
