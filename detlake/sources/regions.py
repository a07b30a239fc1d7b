"""Region files: named outlines of parking slots, queues and counting lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_regions(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """``region_id, points`` (and ``video_id`` if any region names one) from JSON objects with ``points`` as [x, y] pairs.

    ``multiline`` reads files that hold one array, otherwise there is one object per line. Regions without a ``region_id`` are
    numbered in the order of files and lines, above the ids that are given. Regions are configuration: few rows, numbered in one task. Points that are not two numbers, and regions left with fewer than two points, are dropped.
    """
    raw = spark.read.schema("region_id bigint, video_id bigint, name string, points array<array<double>>").json(path, multiLine=multiline)
    good = F.filter("points", lambda p: (F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull())
    points = F.transform(good, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    place = Window.orderBy("_file", "_from", "_row").rowsBetween(Window.unboundedPreceding, 0)
    above = F.coalesce(F.max("region_id").over(Window.partitionBy(F.lit(0))), F.lit(-1)) + F.count_if(F.col("region_id").isNull()).over(place)
    out = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_row"))
    out = out.select(F.coalesce("region_id", above).alias("region_id"), "video_id", "name", points.alias("points"))
    out = out.where(F.size("points") >= 2)
    return out if out.where("video_id IS NOT NULL").limit(1).count() else out.drop("video_id")
