"""Joins: overlapping boxes, previous position of a track, lookups, containment in regions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import regions as RG
from ..functions import similarity as S
from ..functions.points import shoelace
from ..functions.rotated import envelope
from . import grid

BOX = ("x1", "y1", "x2", "y2")
# smallest grid cell in pixels: a few cells per ordinary photo, so most boxes touch one or two
CELL = 512.0


def candidate_pairs(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    a_box: Sequence | Callable[[grid.Side], Sequence] = BOX,
    b_box: Sequence | Callable[[grid.Side], Sequence] = BOX,
    condition: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
    cell: float = CELL,
    like: tuple[DataFrame, DataFrame] | None = None,
    few: bool = False,
    many: bool = False,
) -> DataFrame:
    """Pairs with equal ``keys`` whose envelopes touch; columns of ``b`` come back prefixed with ``b_``.

    Both sides are spread over a grid whose cells grow with the boxes (see :mod:`grid`) and joined on keys and cell, so one
    crowded key is divided by position and never compared as a whole, on a photo or on a raster of any size. ``cell`` is the
    smallest cell in pixels. A pair that meets in several cells is kept in one of them, which avoids a distinct. A box is names or columns, or
    a function that makes it from a side's columns: names and functions are looked up on both sides of the shuffle, columns go through it.
    ``condition(a, b)`` runs inside the join; ``like`` are tables with the same boxes that are cheaper to read. ``few`` says that
    ``b`` is a configured table of some rows: it goes to the rows of ``a``, which then stay where they are. ``many`` says that neither
    side is small, whatever Spark makes of its files: both are shuffled, none goes whole to every task.
    """
    left, right = grid.spread_pair(a, b, *[box(F.col) if callable(box) else box for box in (a_box, b_box)], cell, like)
    extra = {"_by", "_lv", "_s", "_gx", "_gy", "_x1", "_y1", "_x2", "_y2"}
    right = right.select(*[F.col(c).alias(f"b_{c}") for c in right.columns])
    L, R = (lambda c: F.col(c)), (lambda c: F.col(f"b_{c}"))
    on = grid.meet(grid.after_shuffle(L, a_box, cell), grid.after_shuffle(R, b_box, cell))
    for k in keys:
        on = on & (L(k) == R(k))
    if condition is not None:
        on = on & condition(L, R)
    keep = [c for c in a.columns] + [f"b_{c}" for c in b.columns if c not in keys and c not in extra]
    right = F.broadcast(right) if few else right.hint("merge") if many else right
    return left.join(right, on).select(*keep)


def overlap_join(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str] = ("image_id",),
    threshold: float = 0.0,
    measure=S.iou,
    strict: bool = False,
    strategy: str = "grid",
    cell: float = CELL,
    name: str = "sim",
    like: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Pairs of boxes with the same keys whose ``measure`` reaches the threshold (exceeds it when ``strict``).

    ``strategy="direct"`` skips the grid and joins on the keys alone; it fits tables known to have few boxes per key.
    """

    def sim(L, R):
        return measure([L(c) for c in BOX], [R(c) for c in BOX])

    def ok(L, R):
        s = sim(L, R)  # boxes with NaN or infinite coordinates have no overlap
        return ~F.isnan(s) & (s > threshold if strict or threshold <= 0 else s >= threshold)

    if strategy == "direct":
        right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
        on = ok(F.col, lambda c: F.col(f"b_{c}"))
        for k in keys:
            on = on & (F.col(k) == F.col(f"b_{k}"))
        pairs = a.join(right, on).drop(*[f"b_{k}" for k in keys])
    elif strategy == "grid":
        pairs = candidate_pairs(a, b, keys, condition=ok, cell=cell, like=like)
    else:
        raise ValueError(strategy)
    return pairs.withColumn(name, sim(F.col, lambda c: F.col(f"b_{c}")))


def outranks(L, R, score="conf", uid="det_id") -> Column:
    """Left row comes before the right one: higher score, then lower id."""
    return (L(score) > R(score)) | ((L(score) == R(score)) & (L(uid) < R(uid)))


def self_overlap(df: DataFrame, keys=("image_id",), threshold=0.0, measure=S.iou, score="conf", uid="det_id", cell=CELL):
    """Overlapping pairs inside one table, the better-scored box on the left."""

    def ok(L, R):
        s = measure([L(c) for c in BOX], [R(c) for c in BOX])
        return outranks(L, R, score, uid) & (s >= threshold if threshold > 0 else s > 0)

    pairs = candidate_pairs(df, df, keys, condition=ok, cell=cell)
    return pairs.withColumn("sim", measure([F.col(c) for c in BOX], [F.col(f"b_{c}") for c in BOX]))


def window_join(ann: DataFrame, windows: DataFrame, iof: float = 0.7, key="image_id", polygon="polygon", cell=1024.0):
    """Objects of each window: those with at least ``iof`` of their polygon inside it.

    Envelope and area of a polygon are worked out once per object, the share once per pair of an object and a window that its envelope
    meets: both come out of a generator, since plain columns would be written out again wherever a filter or a join uses them.
    """
    box, own = ["_ex1", "_ey1", "_ex2", "_ey2"], "_area"
    shape = F.struct(*[v.alias(n) for n, v in zip(box, envelope(polygon).values(), strict=True)], shoelace(polygon).alias(own))
    shaped = ann.select("*", F.inline(F.array(shape)))

    def meets(L, R):
        return S.intersection([L(c) for c in box], [R(c) for c in BOX]) > 0

    pairs = candidate_pairs(shaped, windows, [key], a_box=box, condition=meets, cell=cell, many=True)
    share = S.window_share(polygon, *[F.col(f"b_{c}") for c in BOX], shape=(*box, own))
    out = pairs.select(*[c for c in pairs.columns if c not in (*box, own)], F.explode(F.array(share)).alias("iof"))
    return out.filter(F.col("iof") >= iof if iof > 0 else F.col("iof") > 0)


def window_labels(ann: DataFrame, windows: DataFrame, images: DataFrame, iof: float = 0.7, key="image_id", polygon="polygon", cell=1024.0):
    """Labels of each window: the objects of :func:`window_join` with ``polygon`` as seen from the window.

    Points are shifted to the window's corner and divided by the size of what the window shows: where it reaches beyond the
    image (``images`` has ``width`` and ``height``), only the part inside counts. Corners outside the window stay outside 0 to 1.
    """
    w, h = (F.greatest(F.least(hi, size) - lo, F.lit(0)).cast("double") for lo, hi, size in ((F.col("x1"), F.col("x2"), F.col("width")), (F.col("y1"), F.col("y2"), F.col("height"))))
    shown = windows.join(images.select(key, "width", "height"), key).select(*windows.columns, w.alias("shown_w"), h.alias("shown_h"))
    pairs = window_join(ann, shown.where("shown_w > 0 AND shown_h > 0"), iof, key, polygon, cell)

    def seen(q):
        x, y = (q["x"] - F.col("b_x1")) / F.col("b_shown_w"), (q["y"] - F.col("b_y1")) / F.col("b_shown_h")
        return F.struct(x.alias("x"), y.alias("y"))

    return pairs.withColumn(polygon, F.transform(polygon, seen)).drop("b_shown_w", "b_shown_h")


def region_keys(regions: DataFrame) -> list[str]:
    """Regions may belong to a video."""
    return ["video_id"] if "video_id" in regions.columns else []


def in_region(points: DataFrame, regions: DataFrame, x="cx", y="cy", inclusive=False) -> DataFrame:
    """Points joined to every region that contains them; the outline counts only when ``inclusive``.

    Regions are cut into cells that lie inside or on the outline, and each point looks only into its own cell (see :mod:`grid`). Regions
    with a ``video_id`` hold for that video only, which is then part of the join key. Spark broadcasts the region side by itself
    when it is small.
    """
    return grid.points_in_regions(points, regions, region_keys(regions), x, y, inclusive)


def near_regions(steps: DataFrame, regions: DataFrame, px="px", py="py", x="cx", y="cy", cell=CELL) -> DataFrame:
    """Track steps joined to the regions whose envelope the step's envelope touches; regions with a ``video_id`` hold for that
    video only.

    Pictures have few cells, however many steps there are: regions that hold everywhere are sent to the steps, which would else meet
    in as few tasks. Those of videos may be many and are joined by video and cell.
    """
    a = [F.least(px, x), F.least(py, y), F.greatest(px, x), F.greatest(py, y)]
    keys = region_keys(regions)
    out = candidate_pairs(steps, regions, keys, a_box=a, b_box=list(envelope("points").values()), cell=cell, few=not keys)
    return out.withColumnsRenamed({f"b_{c}": c for c in regions.columns if c not in keys})


def step_crosses(steps: DataFrame, regions: DataFrame, **kw) -> DataFrame:
    """Steps that meet a region: cross or touch a line, or touch or enter a polygon."""
    near = near_regions(steps, regions, **kw)
    return near.filter(RG.step_meets_region("points", "px", "py", "cx", "cy"))


def missing_labels(images: DataFrame, ann: DataFrame, key="image_id") -> DataFrame:
    """Images without any annotation."""
    return images.join(ann.select(key), key, "left_anti")


def with_labels(images: DataFrame, ann: DataFrame, key="image_id") -> DataFrame:
    """All images with their annotations, NULL where there is none."""
    return images.join(ann, key, "left")


def mapping_table(spark, mapping: dict) -> DataFrame:
    first = next(iter(mapping))
    src = T.StringType() if isinstance(first, str) else T.IntegerType()
    schema = T.StructType([T.StructField("_from", src), T.StructField("_to", T.IntegerType())])
    return spark.createDataFrame(list(mapping.items()), schema)


def map_classes(df: DataFrame, mapping: dict, src="cls", dst="cls") -> DataFrame:
    """Replace class ids by a dictionary held in the program; ids without an entry become NULL."""
    m = mapping_table(df.sparkSession, mapping)
    out = df.join(m, df[src] == m["_from"], "left").drop("_from")
    if src == dst:
        out = out.drop(src)
    return out.withColumnRenamed("_to", dst)


def merge_tracks(a: DataFrame, b: DataFrame, uid="track_id") -> DataFrame:
    """Union by id; rows of ``a`` win."""
    return a.unionByName(b.join(a.select(uid), uid, "left_anti").select(*a.columns))


def subtract_tracks(a: DataFrame, b: DataFrame, uid="track_id") -> DataFrame:
    return a.join(b.select(uid), uid, "left_anti")


def drop_duplicate_tracks(a: DataFrame, b: DataFrame, dist=0.15, keys=("video_id",), cell=CELL):
    """Remove tracks that appear in both sets at nearly the same place.

    Of each pair closer than ``dist`` (one minus IoU) the shorter-lived one goes; on a tie the one from ``a``. Rows carry
    ``track_id``, ``start_frame``, ``frame_no`` and the box. Returns the two remaining sets.
    """
    pairs = overlap_join(a, b, keys, threshold=1 - dist, strict=True, cell=cell)
    age_a = F.col("frame_no") - F.col("start_frame")
    age_b = F.col("b_frame_no") - F.col("b_start_frame")
    lose_b = pairs.filter(age_a > age_b).select(*keys, F.col("b_track_id").alias("track_id"))
    lose_a = pairs.filter(age_a <= age_b).select(*keys, "track_id")
    on = [*keys, "track_id"]
    return a.join(lose_a, on, "left_anti"), b.join(lose_b, on, "left_anti")


def with_prior_labels(det: DataFrame, ann: DataFrame) -> DataFrame:
    """Known labels enter as detections with score 1; ids continue below zero so they stay apart."""
    extra = ann.withColumn("det_id", -F.col("ann_id") - 1).withColumn("conf", F.lit(1.0))
    return det.unionByName(extra.select(*[c for c in det.columns if c in extra.columns]), allowMissingColumns=True)
