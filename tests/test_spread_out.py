"""Steps whose tasks must stay small or fast on large tables: what a task holds, and that the results are those of the plain definition."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from detlake.functions import text as X
from detlake.operators import joins as J
from detlake.operators import masks as K
from detlake.operators import match as M

REGIONS = [(1, [(20.0, 380.0), (1080.0, 380.0)]), (2, [(0.0, 0.0), (500.0, 0.0), (500.0, 500.0)])]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_steps_stay_where_they_are(spark):
    """Steps that all lie in one cell meet the regions in all their tasks, not in one."""
    steps = spark.range(800).repartition(8).select("id", *[F.lit(float(v)).alias(c) for c, v in (("px", 300), ("py", 370), ("cx", 310), ("cy", 390))])
    regions = spark.createDataFrame(REGIONS, "region_id int, points array<struct<x:double,y:double>>")
    near = J.near_regions(steps, regions).withColumn("task", F.spark_partition_id())
    assert near.groupBy("region_id").count().orderBy("region_id").collect() == [(1, 800), (2, 800)]
    assert near.select("task").distinct().count() == 8
    of_videos = J.near_regions(steps.withColumn("video_id", F.col("id") % 2), regions.withColumn("video_id", F.lit(1).cast("bigint")))
    assert of_videos.count() == 800


def test_taken_truth_holds_a_part_once(spark):
    rows = [("a", 1, 0.5, 9, 0.7), ("a", 1, 0.5, 4, 0.7), ("a", 1, 0.6, 2, 0.6), ("a", 2, None, 3, 0.9), ("b", 1, 0.1, 8, float("nan")), ("b", 1, 0.1, 7, 0.99)]
    pairs = spark.createDataFrame(rows, "image_id string, det_id int, conf double, ann_id int, sim double")
    taken = M._taken(pairs, "image_id", ("conf",))
    got = {(r.image_id, r.det_id): (r.ann_id, r.sim, r.conf) for r in taken.collect()}
    assert got[("a", 1)] == (4, 0.7, 0.6) and got[("a", 2)] == (3, 0.9, None) and got[("b", 1)][0] == 8
    assert "HashAggregate" not in plan(taken)


def bridge(parts):
    """The definition, one row at a time."""
    ties = []
    for p, q in zip(parts, parts[1:]):
        d = ((p[:, None, :] - q[None, :, :]) ** 2).sum(-1)
        ties.append(divmod(int(d.argmin()), len(q)))
    out, back = [], []
    for k, ring in enumerate(parts):
        if k in (0, len(parts) - 1):
            ring = np.roll(ring, -(ties[0][0] if k == 0 else ties[-1][1]), axis=0)
            out.append(np.vstack([ring, ring[:1]]))
            continue
        enter, leave = ties[k - 1][1], ties[k][0]
        ring = np.roll(ring[::-1] if enter > leave else ring, -min(enter, leave), axis=0)
        ring, side = np.vstack([ring, ring[:1]]), abs(leave - enter)
        out.append(ring[: side + 1])
        back.append(ring[side:])
    return np.vstack(out + back[::-1])


def test_rings_are_bridged_together():
    rng = np.random.default_rng(5)
    for sizes in ((4, 4), (1, 3), (4, 5, 6), (3, 1, 7, 4), (2, 8, 8, 8, 1)):
        parts = [rng.integers(0, 30, (50, m, 2)).astype(float) for m in sizes]
        got = K._bridges(parts)
        assert all(np.array_equal(got[i], bridge([p[i] for p in parts])) for i in range(50))


def test_merge_parts_of_any_lengths(spark):
    rng = random.Random(3)
    rows = [(i, [[(float(rng.randrange(50)), float(rng.randrange(50))) for _ in range(rng.randrange(1, 6))] for _ in range(rng.randrange(1, 5))]) for i in range(300)]
    rows += [(300, []), (301, None), (302, [[(None, 1.0), (2.0, 2.0)], [(3.0, 3.0)]])]
    df = spark.createDataFrame(rows, "id int, parts array<array<struct<x:double,y:double>>>")
    found = K.merge_parts(df, ["id"]).collect()
    got = {r.id: r.polygon and [tuple(p) for p in r.polygon] for r in found}
    assert len(found) == 302 and 301 not in got and got[300] is None and (None, 1.0) in got[302]
    for i, rings in rows[:300]:
        want = rings[0] if len(rings) == 1 else [tuple(p) for p in bridge([np.array(r) for r in rings]).tolist()]
        assert got[i] == want


def test_stem_reads_long_folders_once(spark):
    names = ["a/b.c/d.e.txt", "x", "", "a/", "/.hid", "a.b/c", "a/b.", "p/q\n", "é/ü.ö", "a/b..txt", "file:///r/s t.jpeg", None]
    old = F.regexp_extract("p", r"([^/]*?)(\.[^./]*)?$", 1)
    found = spark.createDataFrame([(n,) for n in names], "p string").select(X.stem("p").alias("new"), old.alias("old")).collect()
    assert all(r.new == r.old for r in found) and found[0].new == "d.e"
    deep = spark.range(0, 100, 1, 1).select(F.concat(F.repeat(F.lit("k"), 30000), F.lit("/"), F.col("id").cast("string"), F.lit(".txt")).alias("p"))
    begun = time.monotonic()
    assert deep.select(X.stem("p").alias("s")).agg(F.sum(F.col("s").cast("int"))).collect() == [(4950,)]
    assert time.monotonic() - begun < 10  # squares of the folder's length took over a second a row
