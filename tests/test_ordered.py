"""Blocked scans, stencils and ranks against plain loops, and what their plans shuffle."""

import math
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from detlake import plans
from detlake.operators import ordered as O
from detlake.operators import runs as R
from detlake.operators import stats as S

from .conftest import DATA

plans.load()


def series(seed, keys=3, rows=300, gap=7):
    rnd, out = random.Random(seed), []
    for k in range(keys):
        f = 0
        for _ in range(rows if k else 2 * rows):
            f += rnd.randrange(1, gap)
            out.append((k, f, rnd.choice([None, 0, 1, 1, 2, 9]), rnd.uniform(-5, 5)))
    rnd.shuffle(out)
    return pd.DataFrame(out, columns=["k", "f", "v", "x"]).astype({"v": "Int64"})


@pytest.mark.parametrize("width", [1, 5, 40, 10_000])
def test_scan_equals_a_loop(spark, width):
    pdf = series(width)
    df = spark.createDataFrame([(int(r.k), int(r.f), None if pd.isna(r.v) else int(r.v), float(r.x)) for r in pdf.itertuples()], "k int, f int, v int, x double")
    up = lambda a, b: F.when(a["v"].isNull(), 100).when(b["v"] > a["v"], 1).otherwise(0)
    gap = lambda a, b: F.coalesce(b["f"] - a["f"], F.lit(0))
    top = F.struct(F.col("x"), F.col("f").alias("at"))
    got = O.scan(df, ["k"], ["f"], F.floor(F.col("f") / width), {"v": "v", "f": "f"}, F.col("v").isNotNull(), {"ups": up, "gaps": gap}, {"most": F.col("x"), "best": top})
    assert got.columns == ["k", "f", "v", "x", "before", "ups", "gaps", "most", "best"]
    mine = {(r.k, r.f): r for r in got.collect()}
    assert len(mine) == len(pdf)
    for k, rows in pdf.groupby("k"):
        last, ups, gaps, best = None, 0, 0, None
        for r in rows.sort_values("f").itertuples():
            m = mine[k, r.f]
            assert (m.before and tuple(m.before)) == last
            if not pd.isna(r.v):
                ups += 100 if last is None else int(r.v > last[0])
                gaps += 0 if last is None else r.f - last[1]
                last = (int(r.v), r.f)
            best = max(best, (r.x, r.f)) if best else (r.x, r.f)
            assert (m.ups, m.gaps, m.most, tuple(m.best)) == (ups, gaps, best[0], best)


def test_scan_without_events_and_of_an_empty_table(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (1, 1, 2.0), (1, 2, None)], "k int, f int, x double")
    got = O.scan(df, ["k"], ["f"], F.lit(0), maxima={"m": F.col("x")})
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2.0, 2.0), (1, 2, None, 2.0)]
    assert O.scan(df.limit(0), ["k"], ["f"], F.lit(0), maxima={"m": F.col("x")}).count() == 0


@pytest.mark.parametrize("name,key", [("w05_early_stop", "run_id"), ("v09_count_reps", "video_id"), ("t04_track_sessions", "video_id")])
def test_rows_are_shuffled_once_by_key_and_block(spark, name, key):
    df = plans.QUERIES[name](spark, DATA)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    made = [x for x in plan.splitlines() if re.search(rf"- Exchange hashpartitioning\({key}#\d+L?, .*_blk#", x)]
    assert len(made) == 1 and "ReusedExchange" in plan


def plain_smooth(values, w):
    n, r, out = len(values), len(w) // 2, []
    for i in range(n):
        near = []
        for k in range(-r, r + 1):
            m = (i + k) % (2 * n)
            near.append(values[m if m < n else 2 * n - 1 - m])
        known = [a * b for a, b in zip(w, near, strict=True) if b is not None]
        out.append(sum(known) if known else None)
    return out


@pytest.mark.parametrize("block", [1, 4, 13, 64])
def test_stencil_mirrors_and_keeps_borders(spark, block):
    rnd, rows = random.Random(block), []
    for k, n in enumerate([1, 2, 3, 9, 13, 30, 200]):
        rows += [(k, i, n, rnd.choice([None, 0.0, rnd.uniform(-9, 9)])) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, i long, n long, v double").repartition(5)
    w = [0.05 * (j + 1) for j in range(25)]
    got = O.stencil(df, ["k"], "i", "n", block, "v", w, "s")
    mine = {(r.k, r.i): r.s for r in got.collect()}
    assert len(mine) == len(rows)
    for k in range(7):
        own = sorted(r for r in rows if r[0] == k)
        for (_, i, _, _), want in zip(own, plain_smooth([r[3] for r in own], w), strict=True):
            assert mine[k, i] == (None if want is None else pytest.approx(want, abs=1e-9))


def test_stencil_sends_few_rows_more(spark):
    """Own rows, and len(weights) - 1 more per block of 100."""
    df = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.lit(5000).alias("n"), F.sin("id").alias("v"))
    out = O.stencil(df, ["k"], "i", "n", 100, "v", [1.0] * 25, "s")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan()
    written = []

    def walk(node):
        if "Exchange" in node.nodeName() and "_blk" in node.toString().splitlines()[0]:
            written.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "AdaptiveSparkPlan":
            children = [node.executedPlan()]
        elif "QueryStage" in node.nodeName():
            children = [node.plan()]
        for c in children:
            walk(c)

    walk(plan)
    assert len(written) == 1 and 5000 < written[0] <= 5000 + 50 * 24


def jobs(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_rank_with_ties_nulls_and_hot_keys(spark, parts):
    rnd = random.Random(parts)
    rows = [(rnd.choice([1.0, 1.0, 1.0, None, float("nan"), rnd.random()]), f"p{rnd.randrange(50)}", i) for i in range(4000)]
    df = spark.createDataFrame(rows, "a double, b string, u int").repartition(6)
    before = jobs(spark)
    ranked = O.with_global_rank(df, "a", "b", "u", parts=parts)
    assert jobs(spark) == before
    got = sorted(ranked.collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 4001))
    order = lambda r: (r[0] is not None, math.inf if r[0] is not None and math.isnan(r[0]) else r[0] or 0.0, r[1], r[2])
    assert [r.u for r in got] == [r[2] for r in sorted(rows, key=order)]


def test_buckets_of_a_rank_are_even_though_one_key_is_hot(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("u"))
    ranked = O.with_global_rank(df, "k", "u", parts=20)
    sizes = {}
    for r in ranked.withColumn("t", F.spark_partition_id()).groupBy("t").count().collect():
        sizes[r.t] = r["count"]
    assert len(sizes) > 3 and max(sizes.values()) < 40_000 / 2
    assert O.with_global_rank(df.limit(0), "k", "u").count() == 0


def test_sigma_clip_equals_rounds_of_filtering(spark):
    rnd = random.Random(1)
    rows = [(g, rnd.gauss(0, 1) * rnd.choice([1, 1, 1, 30])) for g in range(3) for _ in range(400)] + [(7, 2.0)] * 5 + [(8, None)]
    got = sorted(map(tuple, S.sigma_clip(spark.createDataFrame(rows, "g int, v double"), "v", ["g"]).collect()))
    want = []
    for g in (0, 1, 2, 7):
        v = [x for k, x in rows if k == g]
        for _ in range(3):
            m = sum(v) / len(v)
            s = (sum((x - m) ** 2 for x in v) / len(v)) ** 0.5
            v = v if s == 0 else [x for x in v if m - 2 * s < x < m + 2 * s]
        want += [(g, x) for x in v]
    assert got == sorted(want)
