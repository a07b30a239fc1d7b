"""Matching predictions to ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions.rotated import envelope, gaussian, gaussian_similarity, reach
from .joins import BOX, CELL, candidate_pairs, overlap_join

# The ten overlap thresholds of the evaluation.
THRESHOLDS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)


def _best(rows: DataFrame, by: Sequence[str], order: str, value: str, carry: Sequence[str] = ()) -> DataFrame:
    """Per ``by`` the greatest ``order`` and the lowest ``value`` that has it, with the greatest of each column of ``carry``.

    Two aggregates over plain numbers: the first leaves one value per order, so the second has no ties. Both run as hash
    aggregates, which structs as aggregate buffers would not.
    """
    kept = [F.max(c).alias(c) for c in carry]
    lowest = rows.groupBy(*by, order).agg(F.min(value).alias(value), *kept)
    return lowest.groupBy(*by).agg(F.max_by(value, order).alias(value), F.max(order).alias(order), *kept)


def _taken(pairs: DataFrame, key: str, carry: Sequence[str] = ()) -> DataFrame:
    """Each detection with its most similar truth (ties: lowest ``ann_id``).

    A detection meets few distinct truths: its pairs are brought together as they are, and are nearly as many groups as rows. A window
    over sorted rows then holds a part once; the hash tables of :func:`_best` would hold it four times.
    """
    own = Window.partitionBy(key, "det_id")  # the few truths that one detection meets
    place = F.row_number().over(own.orderBy(F.col("sim").desc(), F.col("ann_id").asc_nulls_last()))
    near = pairs.repartition(key, "det_id").withColumns({"_place": place} | {c: F.max(c).over(own) for c in carry})
    return near.filter("_place = 1").select(key, "det_id", "ann_id", "sim", *carry)


def _winners(pairs: DataFrame, thresholds: Sequence[float], key: str, carry: Sequence[str] = ()) -> DataFrame:
    """Per truth and threshold the detection that gets it: ``key, ann_id, i, det_id, conf`` (i numbers the thresholds).

    A detection takes its most similar truth (ties: lowest ``ann_id``). At each threshold a truth then goes to its
    best-scored taker (ties: lowest ``det_id``); a detection that loses is not matched again. The most similar truth does
    not depend on the threshold, so one pass serves all of them. The takers of a truth are combined before the
    shuffle, and so a truth wanted by very many detections does no harm. Without a confidence a detection comes last.
    """
    k = range(len(thresholds))
    carry = list(carry)
    taken = _taken(pairs, key, ("conf", *carry)).withColumn("_c", F.coalesce("conf", F.lit(float("-inf"))))
    kept = [F.max(c).alias(c) for c in carry]
    each = taken.groupBy(key, "ann_id", "_c").agg(*[F.min(F.when(F.col("sim") >= t, F.col("det_id"))).alias(f"d{i}") for i, t in enumerate(thresholds)], *kept)
    reached = [F.when(F.col(f"d{i}").isNotNull(), F.col("_c")) for i in k]
    won = each.groupBy(key, "ann_id").agg(
        *[F.max_by(f"d{i}", reached[i]).alias(f"d{i}") for i in k], *[F.max(reached[i]).alias(f"c{i}") for i in k], *kept
    )
    wins = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"d{i}").alias("det_id"), F.col(f"c{i}").alias("conf")) for i in k])
    rows = won.select(key, "ann_id", *carry, F.explode(F.filter(wins, lambda w: w["det_id"].isNotNull())).alias("h"))
    known = F.when(F.col("h.conf") > float("-inf"), F.col("h.conf"))
    return rows.select(key, "ann_id", *carry, "h.i", "h.det_id", known.alias("conf"))


def match_pairs(det: DataFrame, pairs: DataFrame, thresholds: Sequence[float] = THRESHOLDS, key="image_id") -> DataFrame:
    """Turn similar pairs ``(key, det_id, conf, ann_id, sim)`` into true-positive flags.

    Adds ``tp_mask`` (bit i set: true positive at threshold i) and the matched ``ann_id`` to ``det``.
    """
    bit = F.pow(F.lit(2), F.col("i")).cast("int")
    mask = _winners(pairs, thresholds, key).groupBy(key, "det_id").agg(
        F.bit_or(bit).alias("tp_mask"), F.max("ann_id").alias("ann_id")
    )
    out = det.join(mask, [key, "det_id"], "left")
    return out.withColumn("tp_mask", F.coalesce("tp_mask", F.lit(0)))


def match_counts(det: DataFrame, pairs: DataFrame, ann: DataFrame, thresholds: Sequence[float] = THRESHOLDS, key="image_id") -> DataFrame:
    """Detections and true positives per class and confidence: ``cls, conf, n, tp0, tp1, ..., n_truth``.

    All that the curves need. The winners know their class and confidence, so they are counted as they are and never
    joined back to the detections. The truths of a class are counted in a row without confidence. ``pairs`` carries ``cls``.
    """
    k = range(len(thresholds))
    zero = [F.lit(0).alias(f"tp{i}") for i in k]
    hits = _winners(pairs, thresholds, key, ("cls",)).select(
        "cls", "conf", F.lit(0).alias("n"), *[(F.col("i") == i).cast("int").alias(f"tp{i}") for i in k], F.lit(0).alias("n_truth")
    )
    rows = det.select("cls", "conf", F.lit(1).alias("n"), *zero, F.lit(0).alias("n_truth"))
    truth = ann.select("cls", F.lit(None).cast("double").alias("conf"), F.lit(0).alias("n"), *zero, F.lit(1).alias("n_truth"))
    sums = ["n", *[f"tp{i}" for i in k], "n_truth"]
    return rows.unionByName(hits).unionByName(truth).groupBy("cls", "conf").agg(*[F.sum(c).alias(c) for c in sums])


def _distinct_truth(ann: DataFrame, on: Sequence[str]) -> DataFrame:
    """Of identical truths only the lowest id can ever be chosen; the copies are left out of the join."""
    return ann.groupBy(*on).agg(F.min("ann_id").alias("ann_id"))


def box_pairs(det, ann, threshold: float, similarity=S.iou, key="image_id", cell=CELL, strategy="grid") -> DataFrame:
    """Same-class pairs of boxes that reach ``threshold``: ``key, cls, det_id, conf, ann_id, sim``."""
    truth = _distinct_truth(ann, (key, "cls", *BOX))
    pairs = overlap_join(
        det.select(key, "cls", "det_id", "conf", *BOX), truth, (key, "cls"), threshold, similarity, strategy=strategy, cell=cell,
        like=(det, ann),
    )
    return pairs.select(key, "cls", "det_id", "conf", F.col("b_ann_id").alias("ann_id"), "sim")


def match_predictions(
    det: DataFrame,
    ann: DataFrame,
    thresholds: Sequence[float] = THRESHOLDS,
    similarity=S.iou,
    key="image_id",
    cell: float = CELL,
    strategy: str = "grid",
) -> DataFrame:
    """Match boxes of the same class by ``similarity`` (a function of two boxes that is 0 for disjoint ones)."""
    return match_pairs(det, box_pairs(det, ann, min(thresholds), similarity, key, cell, strategy), thresholds, key)


def evaluation_counts(det, ann, thresholds=THRESHOLDS, similarity=S.iou, key="image_id", cell=CELL, strategy="grid") -> DataFrame:
    """Match and count in one go; the input of ``metrics.pr_curve`` and all that follows."""
    return match_counts(det, box_pairs(det, ann, min(thresholds), similarity, key, cell, strategy), ann, thresholds, key)


def match_rotated(det: DataFrame, ann: DataFrame, thresholds=THRESHOLDS, key="image_id", cell=CELL) -> DataFrame:
    """Match rotated boxes by the similarity of their Gaussians."""
    rb = ("cx", "cy", "w", "h", "r")
    truth = _distinct_truth(ann, (key, "cls", *rb))
    pairs = rotated_pairs(det.select(key, "cls", "det_id", "conf", *rb), truth, (key, "cls"), min(thresholds), cell=cell, like=(det, ann))
    return match_pairs(det, pairs.select(key, "det_id", "conf", F.col("b_ann_id").alias("ann_id"), "sim"), thresholds, key)


def rotated_pairs(a, b, keys, threshold, condition=None, cell=CELL, like=None) -> DataFrame:
    """Pairs of rotated boxes with Gaussian similarity of at least ``threshold``."""
    rb = ("cx", "cy", "w", "h", "r")

    def square(side):
        x, y, s = (side(c) for c in ("cx", "cy", "_reach"))
        return [x - s, y - s, x + s, y + s]

    def sim(L, R):
        return gaussian_similarity(L("_g"), R("_g"))

    def ok(L, R):
        c = sim(L, R) >= threshold
        return c if condition is None else condition(L, R) & c

    far = reach("w", "h", threshold)
    a, b = (d.withColumns({"_g": gaussian(*rb), "_reach": far}) for d in (a, b))
    like = like and tuple(d.withColumn("_reach", far) for d in like)
    pairs = candidate_pairs(a, b, keys, a_box=square, b_box=square, condition=ok, cell=cell, like=like)
    return pairs.withColumn("sim", sim(F.col, lambda c: F.col(f"b_{c}"))).drop("_g", "b__g", "_reach", "b__reach")


def match_keypoints(det, ann, sigmas: Sequence[float], thresholds=THRESHOLDS, key="image_id", cell=CELL) -> DataFrame:
    """Match poses by keypoint similarity; truth area is 0.53 of its box.

    A similarity of t needs at least one visible keypoint with closeness t, which bounds how far the pose can be off:
    the truth's keypoint box is widened by that distance before the grid join.
    """
    import math

    lo, widest = min(thresholds), max(sigmas)
    size = F.lit(0.53) * (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    around = {f"_e{c}": v for c, v in envelope("keypoints").items()}
    truth = ann.select(key, "cls", "ann_id", "keypoints", size.alias("size"), *[v.alias(c) for c, v in around.items()])
    pred = det.select(key, "cls", "det_id", "conf", "keypoints", *[v.alias(c) for c, v in around.items()])

    def wide(side):
        far = F.sqrt((side("size") + S.EPS) * 2 * math.log(1 / lo)) * (2 * widest) * 1.001
        x1, y1, x2, y2 = (side(c) for c in around)
        return [x1 - far, y1 - far, x2 + far, y2 + far]

    def sim(L, R):
        return S.keypoint_similarity(R("keypoints"), L("keypoints"), R("size"), list(sigmas))

    pairs = candidate_pairs(
        pred, truth, (key, "cls"), a_box=list(around), b_box=wide, condition=lambda L, R: sim(L, R) >= lo, cell=cell
    ).withColumn("sim", sim(F.col, lambda c: F.col(f"b_{c}")))
    return match_pairs(det, pairs.select(key, "det_id", "conf", F.col("b_ann_id").alias("ann_id"), "sim"), thresholds, key)


def match_long(matched: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """One row per detection and threshold: ``thr``, ``tp`` and the truth it took (NULL when it is a false positive)."""
    rows = F.array(
        *[F.struct(F.lit(t).alias("thr"), (F.col("tp_mask").bitwiseAND(F.lit(1 << i)) > 0).alias("tp")) for i, t in enumerate(thresholds)]
    )
    out = matched.withColumn("_t", F.explode(rows))
    out = out.withColumn("thr", F.col("_t.thr")).withColumn("tp", F.col("_t.tp"))
    return out.withColumn("ann_id", F.when(F.col("tp"), F.col("ann_id"))).drop("_t", "tp_mask")


def match_for_confusion(det: DataFrame, ann: DataFrame, conf=0.25, iou=0.45, key="image_id", cell=CELL, pairs=None) -> DataFrame:
    """Class-free matching: ``(key, pred_cls, true_cls)`` with NULL for background on either side.

    Each detection above ``conf`` takes its most overlapping truth, then each truth keeps its most overlapping taker.
    """
    sure = det.filter(F.col("conf") > conf)
    if pairs is None:
        # of identical truths the lowest id wins; its copies count as missed
        truth = _distinct_truth(ann, (key, *BOX))
        pairs = overlap_join(sure.select(key, "det_id", *BOX), truth, (key,), iou, strict=True, cell=cell, like=(det, ann))
        pairs = pairs.select(key, "det_id", F.col("b_ann_id").alias("ann_id"), "sim")
    won = _best(_taken(pairs, key), (key, "ann_id"), "sim", "det_id").select(key, "ann_id", "det_id")
    seen = ann.select(key, "ann_id", F.col("cls").alias("true_cls")).join(won, [key, "ann_id"], "left")
    both = sure.select(key, "det_id", F.col("cls").alias("pred_cls")).join(seen, [key, "det_id"], "full")
    return both.select(key, "pred_cls", "true_cls")
