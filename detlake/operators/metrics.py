"""Evaluation metrics over matched detections.

Detections of equal confidence enter a curve together, misses first. Precision then only rises inside such a group, so the
group's end point carries all that the interpolated precision needs, and the curve can be built from one row per
(class, confidence) however many detections share it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .match import THRESHOLDS, match_for_confusion
from .ordered import running

GRID = 1000


def conf_block(conf: Column, per_e: int = 512) -> Column:
    """Block number along descending confidence; steps shrink with the confidence, where most detections sit."""
    return F.floor(-F.log(F.greatest(conf, F.lit(1e-12))) * per_e)


def truth_counts(ann: DataFrame) -> DataFrame:
    return ann.groupBy("cls").agg(F.count("*").alias("n_truth"))


def curve_counts(matched: DataFrame, ann: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Counts per class and confidence from ``match.match_predictions``, in the form of ``match.evaluation_counts``."""
    k = range(len(thresholds))
    groups = matched.groupBy("cls", "conf").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("tp_mask").bitwiseAND(F.lit(1 << i)) > 0).alias(f"tp{i}") for i in k],
    )
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("n", *[f"tp{i}" for i in k])]
    truth = truth_counts(ann).select("cls", F.lit(None).cast("double").alias("conf"), *zero, "n_truth")
    return groups.withColumn("n_truth", F.lit(0).cast("bigint")).unionByName(truth)


def pr_curve(counts: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Running counts down the confidences of each class: ``cls, conf, n, tp0.., seen, hit0.., n_truth``.

    ``counts`` is ``match.evaluation_counts`` or ``curve_counts``. Only classes present in the truth stay. Each class keeps
    its row without confidence, in front of all others, so that a class without predictions is not lost.
    """
    k = range(len(thresholds))
    groups = counts.select("cls", "conf", "n", *[f"tp{i}" for i in k], F.col("n_truth").alias("_t"))
    block = F.when(F.col("conf").isNull(), -1).otherwise(conf_block(F.col("conf")))
    run = running(
        groups, ["cls"], [F.col("conf").desc_nulls_first()], block,
        sums={"seen": "n", "n_truth": "_t"} | {f"hit{i}": f"tp{i}" for i in k},
    )
    return run.filter("n_truth > 0").drop("_t")


def pr_points(curve: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Long form of the curve: ``cls, thr, conf, tp, fp, recall, precision`` at the end of each confidence group."""
    rows = F.array(*[F.struct(F.lit(t).alias("thr"), F.col(f"hit{i}").alias("hit")) for i, t in enumerate(thresholds)])
    return curve.filter("conf IS NOT NULL").select("cls", "conf", "seen", "n_truth", F.explode(rows).alias("r")).select(
        "cls",
        F.col("r.thr").alias("thr"),
        "conf",
        F.col("r.hit").alias("tp"),
        (F.col("seen") - F.col("r.hit")).alias("fp"),
        (F.col("r.hit") / F.col("n_truth")).alias("recall"),
        (F.col("r.hit") / F.col("seen")).alias("precision"),
    )


def _steps_below(x: Column, step: float) -> Column:
    """How many grid points i * step lie strictly below x (i from 0)."""
    c = F.ceil(x / step)
    # the quotient may round across an integer: check the neighbours against the grid values themselves
    return c - F.when((c > 0) & ((c - 1) * step >= x), 1).otherwise(0) + F.when(c * step < x, 1).otherwise(0)


def _interpolated(curve: DataFrame, thresholds: Sequence[float], points: int) -> DataFrame:
    """Interpolated precision on an even recall grid: ``cls, k, thr, g`` with ``g`` an array of ``i, x, y``.

    At recall x it is the highest precision of any later point (recall > x). Past the last true positive it falls in a
    straight line to 0 at recall 1. Each curve row votes for the last grid point below its recall; what remains is one row
    per (class, threshold, grid point), few enough to finish as an array.
    """
    step = 1.0 / (points - 1)
    rows = F.array(
        *[F.struct(F.lit(i).alias("k"), F.col(f"tp{i}").alias("tp"), F.col(f"hit{i}").alias("hit")) for i in range(len(thresholds))]
    )
    long = curve.select("cls", "seen", "n_truth", F.explode(rows).alias("r"))
    hit, found = F.col("r.hit"), F.col("r.tp") > 0
    # a group without a true positive casts no vote but still counts for the curve's end (i = -1)
    last_below = F.when(found, _steps_below(hit / F.col("n_truth"), step) - 1).otherwise(F.lit(-1))
    votes = long.groupBy("cls", F.col("r.k").alias("k"), last_below.cast("int").alias("i")).agg(
        F.max(F.when(found, hit / F.col("seen"))).alias("p"),
        F.max(hit).alias("hit"),
        F.max("seen").alias("seen"),
        F.max("n_truth").alias("n_truth"),
    )
    # at most one entry per grid point
    ends = votes.groupBy("cls", "k").agg(
        *[F.max(c).alias(c) for c in ("hit", "seen", "n_truth")],
        F.map_from_entries(F.collect_list(F.when(F.col("i") >= 0, F.struct("i", "p")))).alias("v"),
    )
    ends = ends.withColumns({"r_end": F.col("hit") / F.col("n_truth"), "p_end": F.coalesce(F.try_divide("hit", "seen"), F.lit(0.0))})

    def value(i, best):
        x = F.when(i == points - 1, F.lit(1.0)).otherwise(i * step)
        tail = F.col("p_end") - F.col("p_end") * F.try_divide(x - F.col("r_end"), 1.0 - F.col("r_end"))
        y = F.coalesce(best, F.when((x >= 1.0) | (F.col("r_end") >= 1.0), F.lit(0.0)).otherwise(tail))
        return F.struct(i.alias("i"), x.alias("x"), y.alias("y"))

    def back(acc, i):
        best = F.greatest(acc["best"], F.try_element_at(F.col("v"), i))
        return F.struct(best.alias("best"), F.concat(F.array(value(i, best)), acc["g"]).alias("g"))

    none = F.array().cast("array<struct<i:int,x:double,y:double>>")
    start = F.struct(F.lit(None).cast("double").alias("best"), none.alias("g"))
    grid = F.aggregate(F.sequence(F.lit(points - 1), F.lit(0)), start, back)["g"]
    thr = F.element_at(F.array(*[F.lit(t) for t in thresholds]), F.col("k") + 1)
    return ends.select("cls", "k", thr.alias("thr"), grid.alias("g"))


def average_precision(curve: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Area under the interpolated curve (101 points, trapezoids) per class and threshold."""
    strips = F.zip_with(
        F.slice("g", 1, 100), F.slice("g", 2, 100), lambda a, b: (b["x"] - a["x"]) * (a["y"] + b["y"]) / 2
    )
    area = F.aggregate(strips, F.lit(0.0), lambda s, v: s + v)
    return _interpolated(curve, thresholds, 101).select("cls", "thr", area.alias("ap"))


def ap_per_class(counts: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """AP of every class present in the truth at every threshold; 0 for a class without predictions."""
    return average_precision(pr_curve(counts, thresholds), thresholds)


def map_summary(ap: DataFrame) -> DataFrame:
    """Mean AP at 0.50, at 0.75 and over all thresholds."""
    return ap.agg(
        F.avg(F.when(F.col("thr") == 0.5, F.col("ap"))).alias("map50"),
        F.avg(F.when(F.col("thr") == 0.75, F.col("ap"))).alias("map75"),
        F.avg("ap").alias("map"),
    )


def precision_on_recall(counts: DataFrame, points: int = GRID) -> DataFrame:
    """Interpolated precision at overlap 0.50 on an even recall grid: ``cls, i, recall, precision``."""
    t = THRESHOLDS[:1]
    g = _interpolated(pr_curve(counts, t), t, points)
    return g.select("cls", F.explode("g").alias("g")).select(
        "cls", F.col("g.i").cast("bigint").alias("i"), F.col("g.x").alias("recall"), F.col("g.y").alias("precision")
    )


def confidence_curves(counts: DataFrame, points: int = GRID) -> DataFrame:
    """Precision, recall and F1 at overlap 0.50 against confidence: ``cls, i, conf, p, r, f1, n_truth``.

    Values are linear between neighbouring detections, precision 1 and recall 0 above the highest confidence, constant
    below the lowest. Classes without predictions are 0 throughout. Curve rows are first reduced to the highest and the
    lowest confidence of each grid interval.
    """
    step = 1.0 / (points - 1)
    curve = pr_curve(counts, THRESHOLDS[:1])
    seen0, hit0 = F.col("seen") - F.col("n"), F.col("hit0") - F.col("tp0")
    miss_first = F.col("n") > F.col("tp0")
    first_hit = F.when(miss_first, hit0).otherwise(hit0 + 1)
    row = F.struct(
        "conf",
        (F.col("hit0") / F.col("n_truth")).alias("r"),
        (F.col("hit0") / F.col("seen")).alias("p"),
        (first_hit / F.col("n_truth")).alias("r_in"),
        (first_hit / (seen0 + 1)).alias("p_in"),
    )
    # last grid point not above the confidence
    at = F.least(_steps_below(F.col("conf"), step), F.lit(points - 1))
    at = at - F.when(at * step > F.col("conf"), 1).otherwise(0)
    some = F.col("conf").isNotNull()
    place = F.when(some, at.cast("bigint")).otherwise(F.lit(0))
    ends = curve.groupBy("cls", place.alias("i")).agg(
        F.min(F.when(some, row)).alias("lo"), F.max(F.when(some, row)).alias("hi"), F.max("n_truth").alias("n_truth")
    )
    per = ends.groupBy("cls").agg(F.max("n_truth").alias("n_truth"), (F.count("lo") > 0).alias("any"))
    grid = per.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(points - 1).cast("bigint"))))
    g = grid.join(ends.drop("n_truth"), ["cls", "i"], "left")
    by = Window.partitionBy("cls").orderBy("i")  # one row per grid point
    g = g.withColumns(
        {
            "x": F.when(F.col("i") == points - 1, F.lit(1.0)).otherwise(F.col("i") * step),
            "up": F.first("lo", True).over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
            "down": F.last("hi", True).over(by.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )

    def value(end, start, left):
        a, b = F.col(f"up.{end}"), F.col(f"down.{start}")
        t = (F.col("up.conf") - F.col("x")) / (F.col("up.conf") - F.col("down.conf"))
        inside = F.when((F.col("up.conf") == F.col("x")) | F.col("down").isNull(), a).otherwise(a + (b - a) * t)
        return F.when(~F.col("any"), F.lit(0.0)).when(F.col("up").isNull(), F.lit(left)).otherwise(inside)

    g = g.withColumns({"p": value("p", "p_in", 1.0), "r": value("r", "r_in", 0.0)})
    f1 = 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r") + 1e-16)
    return g.select("cls", "i", F.col("x").alias("conf"), "p", "r", f1.alias("f1"), "n_truth")


def smoothed_f1(curves: DataFrame, share: float = 0.1, points: int = GRID) -> DataFrame:
    """Mean F1 over classes per grid point, box-filtered with repeated edge values: ``i, conf, f1, smooth``.

    The input is one row per class and grid point, so the windows here see ``points`` rows.
    """
    half = round(points * share * 2) // 2 // 2
    width = 2 * half + 1
    mean = curves.groupBy("i").agg(F.first("conf").alias("conf"), F.avg("f1").alias("f1"))
    w = Window.orderBy("i")
    near = w.rowsBetween(-half, half)
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.greatest(F.lit(half) - F.col("i"), F.lit(0))
    after = F.greatest(F.col("i") + half - (points - 1), F.lit(0))
    total = F.sum("f1").over(near) + before * F.first("f1").over(full) + after * F.last("f1").over(full)
    return mean.withColumn("smooth", total / width)


def best_f1(curves: DataFrame, share: float = 0.1, points: int = GRID) -> DataFrame:
    """Per class precision, recall, F1 and counts at the confidence with the highest smoothed mean F1."""
    curves = materialize(curves, "curves")  # read twice: for the best confidence, and there
    top = smoothed_f1(curves, share, points).agg(F.max_by("i", F.struct("smooth", (-F.col("i")).alias("n"))).alias("i"))
    at = curves.join(F.broadcast(top), "i")
    tp = F.bround(F.col("r") * F.col("n_truth"), 0)
    return at.select(
        "cls", "i", "conf", "p", "r", "f1", tp.alias("tp"), F.bround(tp / (F.col("p") + 1e-16) - tp, 0).alias("fp")
    )


def class_report(counts: DataFrame, ann: DataFrame) -> DataFrame:
    """Per class: images, instances, precision, recall, AP at 0.50 and mean AP; the row with NULL class is the mean.

    The counts, at most one row per class and confidence, are written once: both kinds of curves start from them.
    """
    counts = materialize(counts, "counts")
    ap = ap_per_class(counts).groupBy("cls").agg(
        F.max(F.when(F.col("thr") == 0.5, F.col("ap"))).alias("ap50"), F.avg("ap").alias("ap")
    )
    pairs = ann.groupBy("cls", "image_id").agg(F.count("*").alias("n"))
    n = pairs.groupBy("cls").agg(F.count("*").alias("images"), F.sum("n").alias("instances"))
    point = best_f1(confidence_curves(counts)).select("cls", "p", "r")
    rows = n.join(point, "cls").join(ap, "cls")
    total = pairs.select("image_id").distinct().agg(F.count("*").alias("images"))
    mean = rows.agg(*[F.avg(c).alias(c) for c in ("p", "r", "ap50", "ap")], F.sum("instances").alias("instances"))
    # one row on each side
    mean = mean.join(F.broadcast(total)).withColumn("cls", F.lit(None).cast("int"))
    return rows.unionByName(mean.select(*rows.columns))


def class_maps(ap: DataFrame, classes: DataFrame) -> DataFrame:
    """Mean AP of every known class; classes absent from the truth get the overall mean."""
    per = ap.groupBy("cls").agg(F.avg("ap").alias("ap"))
    mean = per.agg(F.avg("ap").alias("_mean"))
    out = classes.join(per, "cls", "left").join(F.broadcast(mean))
    return out.withColumn("ap", F.coalesce("ap", "_mean")).drop("_mean")


def fitness(summary: DataFrame) -> DataFrame:
    """One number per summary row: 0.1 of mAP50 and 0.9 of mAP50-95."""
    return summary.withColumn("fitness", 0.1 * F.col("map50") + 0.9 * F.col("map"))


def two_head_fitness(box: DataFrame, other: DataFrame) -> DataFrame:
    """Sum of the box fitness and that of a mask or pose head. Both are one-row summaries."""
    b = fitness(box).select(F.col("fitness").alias("box"))
    o = fitness(other).select(F.col("fitness").alias("other"))
    return b.join(F.broadcast(o)).withColumn("fitness", F.col("box") + F.col("other"))


def confusion_counts(pairs: DataFrame, nc: int) -> DataFrame:
    """Counts per (pred, actual); background has the index ``nc``."""
    p = pairs.select(F.coalesce("pred_cls", F.lit(nc)).alias("pred"), F.coalesce("true_cls", F.lit(nc)).alias("actual"))
    return p.groupBy("pred", "actual").agg(F.count("*").alias("n"))


def confusion_matrix(det, ann, nc: int, conf=0.25, iou=0.45, normalize=False) -> DataFrame:
    """All (pred, actual) cells, zeros included; ``normalize`` adds the share of each actual class."""
    counts = confusion_counts(match_for_confusion(det, ann, conf, iou), nc)
    cells = det.sparkSession.range(nc + 1).select(
        F.col("id").cast("int").alias("pred"), F.explode(F.sequence(F.lit(0), F.lit(nc))).alias("actual")
    )
    out = cells.join(counts, ["pred", "actual"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if normalize:
        col = F.sum("n").over(Window.partitionBy("actual"))  # nc + 1 rows each
        out = out.withColumn("share", F.col("n") / (col + 1e-9))
    return out


def tp_fp(matrix: DataFrame, nc: int) -> DataFrame:
    """True and false positives per predicted class, background left out."""
    return matrix.filter(F.col("pred") < nc).groupBy(F.col("pred").alias("cls")).agg(
        F.sum(F.when(F.col("actual") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("actual") != F.col("pred"), F.col("n")).otherwise(0)).alias("fp"),
    )


def class_order(probs) -> Column:
    """Class indices by descending probability, lower index first on ties."""
    rows = F.transform(probs, lambda v, i: F.struct((-v).alias("p"), i.alias("i")))
    return F.transform(F.array_sort(rows), lambda r: r["i"])


def top_accuracy(image_probs: DataFrame, k: int = 5) -> DataFrame:
    """Share of images whose class is first / among the first ``k``, and their mean."""
    order = class_order(F.col("probs"))
    s = image_probs.select("target", order.alias("o"))
    hit1 = (F.element_at("o", 1) == F.col("target")).cast("double")
    hitk = F.array_contains(F.slice("o", 1, k), F.col("target")).cast("double")
    out = s.agg(F.avg(hit1).alias("top1"), F.avg(hitk).alias("topk"))
    return out.withColumn("fitness", (F.col("top1") + F.col("topk")) / 2)


def classification_confusion(image_probs: DataFrame) -> DataFrame:
    first = F.element_at(class_order(F.col("probs")), 1)
    return image_probs.groupBy(first.alias("pred"), F.col("target").alias("actual")).agg(F.count("*").alias("n"))
