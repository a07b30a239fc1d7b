"""Dataset statistics, histograms, timings and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import py_round
from ..functions.text import plural_count
from .ordered import with_global_rank


def _fill(counts: DataFrame, splits: DataFrame, nc: int) -> DataFrame:
    """Zero rows for classes that a split lacks."""
    cells = splits.select("split", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("cls"))
    return cells.join(counts, ["split", "cls"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def instance_stats(images: DataFrame, ann: DataFrame, nc: int) -> DataFrame:
    """Objects per split and class, zeros included, with the split's total."""
    s = ann.select("image_id", "cls").join(images.select("image_id", "split"), "image_id")
    out = _fill(s.groupBy("split", "cls").agg(F.count("*").alias("n")), images.select("split").distinct(), nc)
    total = out.groupBy("split").agg(F.sum("n").alias("total"))
    return out.join(total, "split")


def image_stats(images: DataFrame, ann: DataFrame, nc: int) -> DataFrame:
    """Images per split and class, with the split's number of images and of unlabelled ones."""
    pairs = ann.select("image_id", "cls").distinct().join(images.select("image_id", "split"), "image_id")
    out = _fill(pairs.groupBy("split", "cls").agg(F.count("*").alias("n")), images.select("split").distinct(), nc)
    has = ann.select("image_id").distinct().withColumn("has", F.lit(1))
    total = images.join(has, "image_id", "left").groupBy("split").agg(
        F.count("*").alias("total"), F.count_if(F.col("has").isNull()).alias("unlabelled")
    )
    return out.join(total, "split")


def classification_stats(tree: DataFrame) -> DataFrame:
    """Images per split and class of a class-folder tree."""
    return tree.groupBy("split", "cls", "class_name").agg(F.count("*").alias("n"))


def class_count_check(tree: DataFrame, nc: int) -> DataFrame:
    """Splits whose number of class folders differs from ``nc``."""
    n = tree.select("split", "class_name").distinct().groupBy("split").agg(F.count("*").alias("classes"))
    return n.withColumn("expected", F.lit(nc)).withColumn("ok", F.col("classes") == nc)


def label_listing(ann: DataFrame, columns: Sequence[str], decimals: int = 4) -> DataFrame:
    """One row per label: class and coordinates rounded half to even."""
    return ann.select("image_id", "cls", *[py_round(c, decimals).alias(c) for c in columns])


def class_histogram(ann: DataFrame) -> DataFrame:
    return ann.groupBy("cls").agg(F.count("*").alias("n"))


def _bin(c: Column, lo, hi, bins: int) -> Column:
    """0-based equal-width bin; the upper end belongs to the last bin."""
    i = F.floor((c - lo) / (hi - lo) * bins)
    return F.when(c == hi, bins - 1).when((c < lo) | (c > hi), None).otherwise(F.least(i, F.lit(bins - 1)))


def hist2d(df: DataFrame, x: str, y: str, bins: int = 50, x_range=None, y_range=None) -> DataFrame:
    """Counts per cell of an even grid over the given ranges, or over the data's own."""
    if x_range is None or y_range is None:
        ends = df.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
        df = df.join(F.broadcast(ends))  # one row
        xr, yr = (F.col("_x0"), F.col("_x1")), (F.col("_y0"), F.col("_y1"))
    else:
        xr, yr = tuple(F.lit(float(v)) for v in x_range), tuple(F.lit(float(v)) for v in y_range)
    cells = df.select(_bin(F.col(x), *xr, bins).alias("bx"), _bin(F.col(y), *yr, bins).alias("by"))
    return cells.filter(F.col("bx").isNotNull() & F.col("by").isNotNull()).groupBy("bx", "by").agg(F.count("*").alias("n"))


def point_density(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """Adds to each row the number of rows in its grid cell (``n``)."""
    ends = df.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    d = df.join(F.broadcast(ends))  # one row
    d = d.withColumns(
        {
            "_bx": _bin(F.col(x), F.col("_x0"), F.col("_x1"), bins),
            "_by": _bin(F.col(y), F.col("_y0"), F.col("_y1"), bins),
        }
    ).drop("_x0", "_x1", "_y0", "_y1")
    n = d.groupBy("_bx", "_by").agg(F.count("*").alias("n"))  # at most bins * bins rows
    return d.join(F.broadcast(n), ["_bx", "_by"]).drop("_bx", "_by")


def box_correlation(ann: DataFrame, columns: Sequence[str] = ("cx", "cy", "w", "h")) -> DataFrame:
    """Pairwise correlation of the columns, one row per pair; all rows count."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = ann.agg(*[F.corr(a, b).alias(f"{a}_{b}") for a, b in pairs])
    items = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}").alias("corr")) for a, b in pairs])
    return row.select(F.explode(items).alias("r")).select("r.*")


def describe(det: DataFrame, classes: DataFrame) -> DataFrame:
    """``2 persons, 1 car`` per image, in class order. The list per image is bounded by the number of classes."""
    n = det.groupBy("image_id", "cls").agg(F.count("*").alias("n")).join(classes, "cls")
    words = F.sort_array(F.collect_list(F.struct("cls", plural_count("n", "name").alias("s"))))
    out = n.groupBy("image_id").agg(words.alias("w"))
    return out.select("image_id", F.array_join(F.transform("w", lambda s: s["s"]), ", ").alias("text"))


def describe_all(images: DataFrame, det: DataFrame, classes: DataFrame) -> DataFrame:
    """As ``describe``, with ``(no detections)`` for the other images."""
    out = images.select("image_id").join(describe(det, classes), "image_id", "left")
    return out.withColumn("text", F.coalesce("text", F.lit("(no detections)")))


def speed_summary(timings: DataFrame, stages: Sequence[str] = ("preprocess", "inference", "postprocess")) -> DataFrame:
    """Mean milliseconds per image of each stage."""
    return timings.agg(F.count("*").alias("images"), *[F.avg(s).alias(s) for s in stages])


def sigma_clip(timings: DataFrame, value: str, group: Sequence[str], sigma: float = 2, rounds: int = 3) -> DataFrame:
    """Values that survive ``rounds`` rounds of dropping what lies more than ``sigma`` deviations from the group's mean.

    What is left of a group is an interval. Each round makes the next intervals, one row per group, from an aggregate over
    the rows within the present ones; the rows themselves are cut once, by the last. Missing values do not survive.
    """
    group = list(group)
    v, least, most = F.col(value), F.lit(float("-inf")), F.lit(float("inf"))
    inside = (v > F.col("_lo")) & (v < F.col("_hi"))
    limits = None
    for _ in range(rounds):
        rest = timings if limits is None else timings.join(limits, group).filter(inside)
        held = [F.max(c).alias(c) for c in ("_lo", "_hi")] if limits is not None else [F.lit(x).alias(c) for c, x in (("_lo", least), ("_hi", most))]
        m = rest.groupBy(*group).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), *held)
        # a group whose values are all equal has no spread and keeps them
        low = F.when(F.col("_s") == 0, F.col("_lo")).otherwise(F.greatest("_lo", F.col("_m") - sigma * F.col("_s")))
        high = F.when(F.col("_s") == 0, F.col("_hi")).otherwise(F.least("_hi", F.col("_m") + sigma * F.col("_s")))
        limits = m.select(*group, low.alias("_lo"), high.alias("_hi"))
    return timings if limits is None else timings.join(limits, group).filter(inside).drop("_lo", "_hi")


def clipped_stats(timings: DataFrame, value: str, group: Sequence[str], sigma=2, rounds=3) -> DataFrame:
    rest = sigma_clip(timings, value, group, sigma, rounds)
    return rest.groupBy(*group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def autosplit(images: DataFrame, weights=(0.9, 0.1, 0.0), path="path", annotated: DataFrame | None = None) -> DataFrame:
    """Adds ``split`` by a hash of the path: independent of order and of the other files.

    With ``annotated`` (a ``path`` table of label files) only images that have a label file are split.
    """
    if annotated is not None:
        from ..functions.text import label_path

        have = annotated.select(F.col("path").alias("_label")).distinct()
        images = images.join(have, label_path(path) == F.col("_label"), "left_semi")
    # first 13 hex digits of the path's hash as a fraction of 1
    u = F.conv(F.substring(F.sha2(F.col(path), 256), 1, 13), 16, 10).cast("double") / float(16**13)
    split = F.when(u < weights[0], "train").when(u < weights[0] + weights[1], "val").otherwise("test")
    return images.withColumn("split", split)


def batch_shapes(images: DataFrame, batch: int, imgsz: int = 640, stride: int = 32, pad: float = 0.0) -> DataFrame:
    """Images in order of height/width in batches of ``batch``; adds ``batch``, ``batch_h``, ``batch_w``."""
    ar = images.withColumn("_ar", F.col("height") / F.col("width"))
    ranked = with_global_rank(ar, "_ar", "image_id", name="_rank")
    ranked = ranked.withColumn("batch", F.floor((F.col("_rank") - 1) / batch))
    ends = ranked.groupBy("batch").agg(F.min("_ar").alias("lo"), F.max("_ar").alias("hi"))

    def up(v):
        return (F.ceil(v * imgsz / stride + pad) * stride).cast("int")

    h = F.when(F.col("hi") < 1, F.col("hi")).otherwise(F.lit(1.0))
    w = F.when(F.col("hi") < 1, F.lit(1.0)).when(F.col("lo") > 1, 1 / F.col("lo")).otherwise(F.lit(1.0))
    shapes = ends.select("batch", up(h).alias("batch_h"), up(w).alias("batch_w"))
    return ranked.join(shapes, "batch").drop("_ar", "_rank")


def top_classes(image_probs: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most probable classes of each image with their probability: ``vec_id, place, cls, conf``."""
    from .metrics import class_order

    order = F.slice(class_order(F.col("probs")), 1, k)
    out = image_probs.select("vec_id", "probs", F.posexplode(order).alias("place", "cls"))
    return out.select("vec_id", (F.col("place") + 1).alias("place"), "cls", F.element_at("probs", F.col("cls") + 1).alias("conf"))


def every_nth(df: DataFrame, n: int, frame="frame_no") -> DataFrame:
    return df.filter(F.col(frame) % n == 0)


__all__ = [
    "autosplit", "batch_shapes", "box_correlation", "class_count_check", "class_histogram", "classification_stats",
    "clipped_stats", "describe", "describe_all", "every_nth", "hist2d", "image_stats", "instance_stats", "label_listing",
    "point_density", "sigma_clip", "speed_summary", "top_classes",
]
