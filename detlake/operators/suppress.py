"""Filtering, suppressing and merging detections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from .joins import BOX, CELL, outranks
from .match import rotated_pairs


def keep(df: DataFrame, conf: float = 0.25, classes: Sequence[int] | None = None, single_cls: bool = False) -> DataFrame:
    """Rows above a confidence (strictly), of the given classes; ``single_cls`` sets every class to 0."""
    out = df.filter(F.col("conf") > conf)
    if classes is not None:
        out = out.filter(F.col("cls").isin(list(classes)))
    return out.withColumn("cls", F.lit(0)) if single_cls else out


def drop_empty(df: DataFrame) -> DataFrame:
    return df.filter(B.area(*BOX) > 0)


def box_candidates(df: DataFrame, before: Sequence[str], after: Sequence[str] = BOX, **thresholds) -> DataFrame:
    return df.filter(B.is_candidate(before, after, **thresholds))


def snap_full_image(df: DataFrame, iou: float = 0.9) -> DataFrame:
    """Boxes that nearly cover the whole image (columns ``width``, ``height``) become exactly the image."""
    from ..functions.similarity import iou as box_iou

    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    whole = {"x1": F.lit(0.0), "y1": F.lit(0.0), "x2": w, "y2": h}
    near = box_iou([F.lit(0.0), F.lit(0.0), w, h], [F.col(c) for c in BOX]) > iou
    return df.withColumns({c: F.when(near, whole[c]).otherwise(F.col(c)) for c in BOX})


# up to this many rows per group Spark trims every input partition by itself before a ranking shuffle
SMALL_LIMIT = 1000
SALTS = 64


def top_per_group(df: DataFrame, n: int, keys: Sequence[str] = ("image_id",), score="conf", uid="det_id") -> DataFrame:
    """Best ``n`` rows per group by score.

    For large ``n`` a group is first ranked in salted parts, so that a group that holds much of the table reaches the final
    ranking with at most ``SALTS * n`` rows.
    """
    order = [F.col(score).desc(), F.col(uid)]
    if n > SMALL_LIMIT:
        df = df.withColumn("_salt", F.pmod(F.xxhash64(uid), F.lit(SALTS)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_rn", F.row_number().over(part)).filter(F.col("_rn") <= n).drop("_rn", "_salt")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def pass_through(det: DataFrame, conf=0.25, max_det=300, classes=None) -> DataFrame:
    """Post-processing of models that suppress by themselves: threshold, then the first ``max_det``."""
    out = top_per_group(det.filter(F.col("conf") > conf), max_det)
    return out if classes is None else out.filter(F.col("cls").isin(list(classes)))


def decode_scores(df: DataFrame, scores="scores", conf=0.0, multi_label=False) -> DataFrame:
    """Class-score arrays to ``cls`` and ``conf``: the best class, or with ``multi_label`` every class above ``conf``.

    The new ``det_id`` orders first by the old one, then by class.
    """
    if multi_label:
        rows = df.select("*", F.posexplode(scores).alias("cls", "conf")).filter(F.col("conf") > conf)
        n = F.size(scores)
        return rows.withColumn("det_id", F.col("det_id").cast("bigint") * n + F.col("cls")).drop(scores)
    top = F.array_max(scores)
    out = df.withColumn("conf", top).withColumn("cls", (F.array_position(scores, top) - 1).cast("int"))
    return out.filter(F.col("conf") > conf).drop(scores)


def scale_decoded(df: DataFrame, width="width", height="height") -> DataFrame:
    """Normalised centre-format boxes to pixel corners, for models that need no suppression."""
    return df.withColumns(B.xywhn2xyxy("cx", "cy", "w", "h", width, height)).drop("cx", "cy", "w", "h")


def _plain_iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    i = w * h
    total = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - i
    return F.when(i > 0, i / total).otherwise(F.lit(0.0))


def greedy_keep(ranked: Column, iou: float, limit: int) -> Column:
    """Walk a best-first box array and keep each box that no kept box overlaps by more than ``iou``.

    Stops adding after ``limit`` boxes, since later ones cannot be among the best ``limit``.
    """
    none = F.filter(ranked, lambda _: F.lit(False))

    def step(kept, c):
        blocked = (F.size(kept) >= limit) | F.exists(kept, lambda k: _plain_iou(k, c) > iou)
        return F.when(blocked, kept).otherwise(F.concat(kept, F.array(c)))

    return F.aggregate(ranked, none, step)


def nms(
    det: DataFrame,
    iou: float = 0.7,
    conf: float = 0.25,
    classes: Sequence[int] | None = None,
    agnostic: bool = False,
    max_nms: int = 30000,
    max_det: int = 300,
    key: str = "image_id",
    uid: str = "det_id",
) -> DataFrame:
    """Non-maximum suppression per image, and per class unless ``agnostic``.

    Groups are bounded before anything is collected: each image keeps its best ``max_nms`` candidates, which is part of
    the operator's definition. Only id, score and box go through the cap, the grouping and the final cut; whatever else the rows
    hold (embeddings, keypoints, masks) is fetched for the kept ones by ``key`` and ``uid``, which identify a row.
    """
    group = [key] if agnostic else [key, "cls"]
    slim = list(dict.fromkeys([key, "cls", uid, "conf", *BOX]))
    cand = top_per_group(keep(det, conf, classes).select(*slim), max_nms, (key,), "conf", uid)
    row = F.struct((-F.col("conf")).alias("_s"), F.col(uid).alias("_u"), *BOX, *([F.col("cls")] if agnostic else []))
    kept = cand.groupBy(*group).agg(F.sort_array(F.collect_list(row)).alias("_r"))
    kept = kept.select(*group, F.explode(greedy_keep(F.col("_r"), iou, max_det)).alias("_k"))
    named = {"conf": -F.col("_k._s"), uid: F.col("_k._u")} | {c: F.col(f"_k.{c}") for c in slim if c not in (*group, uid, "conf")}
    out = top_per_group(kept.select(*group, *[v.alias(c) for c, v in named.items()]), max_det, (key,), "conf", uid)
    if set(det.columns) <= set(slim):
        return out.select(*det.columns)
    return det.join(out.select(key, uid), [key, uid], "left_semi").select(*det.columns)


def rotated_nms(det: DataFrame, thr: float = 0.45, keys=("image_id", "cls"), uid="det_id", cell=CELL) -> DataFrame:
    """Drop every rotated box that a better-scored one (kept or not) resembles by at least ``thr``.

    Exact copies are settled first: only the best of them can stay, so the pair join never sees a pile of equal boxes.
    """
    rb = ("cx", "cy", "w", "h", "r")
    best = F.max_by(F.struct(uid, "conf"), F.struct("conf", (-F.col(uid)).alias("n")))
    firsts = det.groupBy(*keys, *rb).agg(best.alias("b"))
    firsts = firsts.select(*keys, *rb, F.col(f"b.{uid}").alias(uid), F.col("b.conf").alias("conf"))
    lost = rotated_pairs(firsts, firsts, list(keys), thr, lambda L, R: outranks(L, R, "conf", uid), cell, like=(det, det))
    lost = lost.select(*keys, F.col(f"b_{uid}").alias(uid)).distinct()
    left = firsts.select(*keys, uid).join(lost, [*keys, uid], "left_anti")
    return det.join(left, [*keys, uid], "left_semi")


def tile_parts(tile="image_id") -> dict[str, Column]:
    """Original name and offset from a tile id such as ``P0001__1024__0___824``."""
    t = F.col(tile)
    return {
        "image_id": F.regexp_extract(t, r"^(.*?)__", 1),
        "tile_x": F.regexp_extract(t, r"(\d+)___(\d+)", 1).cast("double"),
        "tile_y": F.regexp_extract(t, r"(\d+)___(\d+)", 2).cast("double"),
    }


def merge_rotated_tiles(det: DataFrame, thr: float = 0.3, tile="image_id", uid="det_id") -> DataFrame:
    """Rotated detections of tiles, shifted to the original image and suppressed per class. ``uid`` must be unique."""
    parts = tile_parts(tile)
    # names are read once per row: behind a generator no filter or aggregate writes them out again
    told = det.withColumn("_t", F.explode(F.array(F.struct(*[v.alias(c) for c, v in parts.items()]))))
    d = told.withColumns({"image_id": F.col("_t.image_id"), "cx": F.col("cx") + F.col("_t.tile_x"), "cy": F.col("cy") + F.col("_t.tile_y")})
    return rotated_nms(d.drop("_t"), thr, ("image_id", "cls"), uid)


def merge_tiles(det: DataFrame, windows: DataFrame, iou: float = 0.5, conf=0.0, **kw) -> DataFrame:
    """Detections of sliding windows (``window_id``) put on the whole image and suppressed across windows."""
    w = windows.select("image_id", "window_id", F.col("x1").alias("_wx"), F.col("y1").alias("_wy"))
    d = det.join(w, ["image_id", "window_id"])
    d = d.withColumns(B.uncrop_box(*BOX, "_wx", "_wy")).drop("_wx", "_wy")
    return nms(d, iou, conf, **kw)


def merge_views(*views: tuple[DataFrame, float, int], width="width", height="height", iou=0.7, conf=0.25, **kw) -> DataFrame:
    """Detections of scaled and flipped views ``(df, scale, flip)`` in centre format, undone, united and suppressed."""
    parts = None
    for i, (df, scale, flip) in enumerate(views):
        back = B.undo_view("cx", "cy", "w", "h", scale, flip, width, height)
        d = df.withColumns(B.xywh2xyxy(*back.values())).drop("cx", "cy", "w", "h")
        d = d.withColumn("view", F.lit(i))
        parts = d if parts is None else parts.unionByName(d)
    parts = parts.withColumn("det_id", F.col("det_id").cast("bigint") * len(views) + F.col("view"))
    return nms(parts, iou, conf, **kw)


__all__ = [
    "box_candidates", "decode_scores", "drop_empty", "greedy_keep", "keep", "merge_rotated_tiles", "merge_tiles",
    "merge_views", "nms", "pass_through", "rotated_nms", "scale_decoded", "snap_full_image", "tile_parts", "top_per_group",
]
