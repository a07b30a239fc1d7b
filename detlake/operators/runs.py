"""Training-run tables: early stopping, smoothing, choice among finished runs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import scan, stencil

BLOCK = 4096


def early_stop(runs: DataFrame, patience: int, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Per epoch the best epoch so far (later one on ties) and whether training stops; ``first_stop`` per run.

    Columns ``epoch, fitness`` in; ``best_epoch, stop, first_stop`` added. Rows without a fitness are skipped.
    """
    keys = list(keys)
    r = runs.filter(F.col("fitness").isNotNull())
    # the start counts as a best of 0 at epoch 0
    best = F.when(F.col("fitness") >= 0, F.struct(F.col("fitness").alias("f"), F.col("epoch").alias("e")))
    r = scan(r, keys, ["epoch"], F.floor(F.col("epoch") / BLOCK), maxima={"_best": best})
    r = r.withColumn("best_epoch", F.coalesce("_best.e", F.lit(0))).drop("_best")
    r = r.withColumn("stop", F.col("epoch") - F.col("best_epoch") >= patience)
    first = r.filter("stop").groupBy(*keys).agg(F.min("epoch").alias("first_stop"))
    return r.join(first, keys, "left")


def smooth(runs: DataFrame, sigma: float = 3, value: str = "fitness", keys: Sequence[str] = ("run_id",), order="epoch") -> DataFrame:
    """Adds ``smooth``: Gaussian smoothing along each run, mirrored at both ends.

    A long run is cut into blocks that carry a margin of their neighbours. ``order`` numbers the rows of a run without gaps.
    """
    keys = list(keys)
    r = int(4.0 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    w = [v / sum(w) for v in w]
    ends = runs.groupBy(*keys).agg(F.min(order).alias("_lo"), F.count("*").alias("_n"))
    base = runs.join(ends, keys).withColumn("_i", (F.col(order) - F.col("_lo")).cast("bigint"))
    return stencil(base, keys, "_i", "_n", BLOCK, value, w, "smooth").select(*runs.columns, "smooth")


def best_runs(trials: DataFrame, n: int = 5, score="fitness", uid="run_id") -> DataFrame:
    """Top ``n`` trials with the weight each has as a parent: score above the worst of them plus 1e-6, as a share."""
    top = trials.orderBy(F.col(score).desc(), uid).limit(n)
    floor = top.agg(F.min(score).alias("_min"))
    w = top.join(F.broadcast(floor)).withColumn("weight", F.col(score) - F.col("_min") + 1e-6).drop("_min")  # n rows
    total = w.agg(F.sum("weight").alias("_sum"))
    return w.join(F.broadcast(total)).withColumn("share", F.col("weight") / F.col("_sum")).drop("_sum")


def weighted_parent(trials: DataFrame, params: Sequence[str], n: int = 5, score="fitness", uid="run_id") -> DataFrame:
    """Weighted mean of the parameters of the top ``n`` trials."""
    top = best_runs(trials, n, score, uid)
    return top.agg(*[(F.sum(F.col(p) * F.col("weight")) / F.sum("weight")).alias(p) for p in params])


def choose_parent(trials: DataFrame, u: float, n: int = 5, score="fitness", uid="run_id") -> DataFrame:
    """The trial whose interval of cumulated shares holds ``u`` in [0, 1), best trial first."""
    from pyspark.sql import Window

    top = best_runs(trials, n, score, uid)
    upto = F.sum("share").over(Window.orderBy(F.col(score).desc(), uid))  # n rows
    return top.withColumn("_c", upto).filter(F.col("_c") > u).orderBy("_c").limit(1).drop("_c")
