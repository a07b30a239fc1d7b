"""Queries over training-run tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import runs as RU
from .registry import query, r6


@query(
    "w05_early_stop", "runs",
    "WITH m AS (SELECT *, max(fitness) OVER (PARTITION BY run_id ORDER BY epoch) AS top FROM runs), b AS (SELECT *, max(CASE WHEN fitness >= top THEN epoch ELSE 0 END) OVER (PARTITION BY run_id ORDER BY epoch) AS best_epoch FROM m),"
    " s AS (SELECT *, epoch - best_epoch >= 3 AS stop FROM b) SELECT run_id, epoch, best_epoch, stop, min(epoch) FILTER (WHERE stop) OVER (PARTITION BY run_id) AS first_stop FROM s",
)
def w05(t):
    return RU.early_stop(t.runs, 3).select("run_id", "epoch", "best_epoch", "stop", "first_stop")


_W = [math.exp(-0.5 * (k / 3) ** 2) for k in range(-12, 13)]
_WEIGHTS = ", ".join(f"({k}, {v / sum(_W)!r}::DOUBLE)" for k, v in zip(range(-12, 13), _W))


@query(
    "w06_smooth", "runs",
    f"WITH i AS (SELECT run_id, epoch, fitness, epoch - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM runs), q AS (SELECT run_id, epoch, n, w, ((i + k) % (2 * n) + 2 * n) % (2 * n) AS m FROM i, (VALUES {_WEIGHTS}) v(k, w)),"
    " a AS (SELECT run_id, epoch, w, CASE WHEN m < n THEN m ELSE 2 * n - 1 - m END AS j FROM q) SELECT a.run_id, a.epoch, round(sum(w * i.fitness), 6) AS smooth FROM a JOIN i ON i.run_id = a.run_id AND i.i = j GROUP BY 1, 2",
)
def w06(t):
    return RU.smooth(t.runs).select("run_id", "epoch", *r6(smooth=F.col("smooth")))


TOP = "t AS (SELECT o_orderkey AS run_id, o_totalprice / 500000 AS fitness, o_orderkey % 17 AS lr FROM orders ORDER BY fitness DESC, run_id LIMIT 5), w AS (SELECT *, fitness - min(fitness) OVER () + 1e-6 AS weight FROM t)"


def _trials(t):
    k = F.col("o_orderkey")
    return t.table("orders").select(k.alias("run_id"), (F.col("o_totalprice") / 500000).alias("fitness"), (k % 17).alias("lr"))


@query("l07_best_runs", "", f"WITH {TOP} SELECT run_id, round(weight, 9) AS weight, round(weight / sum(weight) OVER (), 6) AS share FROM w")
def l07(t):
    return RU.best_runs(_trials(t)).select("run_id", F.round("weight", 9).alias("weight"), *r6(share=F.col("share")))


@query("l07_weighted_parent", "", f"WITH {TOP} SELECT round(sum(lr * weight) / sum(weight), 6) AS lr FROM w")
def l07w(t):
    return RU.weighted_parent(_trials(t), ["lr"]).select(*r6(lr=F.col("lr")))
