"""Point grids, crops and sliding windows per image."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def point_grid(images: DataFrame, n: int) -> DataFrame:
    """``n`` x ``n`` even points per image in pixels: ``image_id, i, j, x, y``."""
    at = F.sequence(F.lit(0), F.lit(n - 1))
    g = images.select("image_id", "width", "height", F.explode(at).alias("i")).withColumn("j", F.explode(at))
    half, step = 1 / (2 * n), (1 - 1 / n) / (n - 1) if n > 1 else 0.0
    return g.select(
        "image_id", "i", "j", ((F.col("j") * step + half) * F.col("width")).alias("x"), ((F.col("i") * step + half) * F.col("height")).alias("y")
    )


def crop_boxes(images: DataFrame, layers: int = 1, overlap: float = 512 / 1500) -> DataFrame:
    """The image and, per layer, 2^layer crops per side that overlap: ``image_id, layer, x1, y1, x2, y2``."""
    w, h = F.col("width"), F.col("height")

    def box(layer, x1, y1, x2, y2):
        return F.struct(
            F.lit(layer).alias("layer"), *[c.cast("int").alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2))]
        )

    def crops(layer):
        n = 2**layer
        over = F.floor(F.least(w, h) * (overlap * 2 / n))
        cw, ch = F.ceil((over * (n - 1) + w) / n), F.ceil((over * (n - 1) + h) / n)
        side = F.sequence(F.lit(0), F.lit(n - 1))

        def cell(i, j):
            x, y = (cw - over) * i, (ch - over) * j
            return box(layer, x, y, F.least(x + cw, w), F.least(y + ch, h))

        return F.flatten(F.transform(side, lambda i: F.transform(side, lambda j: cell(i, j))))

    whole = F.array(box(0, F.lit(0), F.lit(0), w, h))
    boxes = F.concat(whole, *[crops(k) for k in range(1, layers + 1)])
    return images.select("image_id", F.explode(boxes).alias("b")).select("image_id", "b.*")


def _starts(size: Column, crop: int, step: int) -> Column:
    n = F.when(size <= crop, F.lit(1)).otherwise(F.ceil((size - crop) / step + 1).cast("int"))
    # the last window moves back to end at the border
    return F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.when((n > 1) & (i * step + crop > size), size - crop).otherwise(i * step)
    )


def windows(images: DataFrame, crop_sizes: Sequence[int] = (1024,), gaps: Sequence[int] = (200,), rate: float = 0.6, eps: float = 0.01) -> DataFrame:
    """Sliding windows per image: ``image_id, window_id, x1, y1, x2, y2``.

    Windows of which more than ``rate`` is image stay; if there are none, those within ``eps`` of the best. Computed inside
    the image's row.
    """
    w, h = F.col("width"), F.col("height")

    def cells(crop, gap):
        if crop <= gap:
            raise ValueError(f"gap {gap} must be smaller than the crop size {crop}")

        def cell(x, y):
            share = (F.least(x + crop, w) - x) * (F.least(y + crop, h) - y) / (crop * crop)
            return F.struct(x.alias("x"), y.alias("y"), F.lit(crop).alias("size"), share.alias("share"))

        xs, ys = _starts(w, crop, crop - gap), _starts(h, crop, crop - gap)
        return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: cell(x, y))))

    parts = [cells(c, g) for c, g in zip(crop_sizes, gaps)]
    d = images.select("image_id", F.concat(*parts).alias("_all"))
    d = d.withColumn("_top", F.array_max(F.transform("_all", lambda c: c["share"])))
    top = F.col("_top")
    kept = F.filter("_all", lambda c: F.when(top > rate, c["share"] > rate).otherwise(F.abs(c["share"] - top) < eps))
    d = d.select("image_id", F.posexplode(kept).alias("window_id", "c"))
    x, y, s = F.col("c.x"), F.col("c.y"), F.col("c.size")
    return d.select("image_id", "window_id", x.alias("x1"), y.alias("y1"), (x + s).alias("x2"), (y + s).alias("y2"))
