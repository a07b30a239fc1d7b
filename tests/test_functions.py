import math
import random

import numpy as np
from pyspark.sql import functions as F

from detlake.functions import points as P
from detlake.functions import regions as RG
from detlake.functions import rotated as R
from detlake.functions import similarity as S
from detlake.functions import text as X
from detlake.functions.numbers import py_round
from detlake.operators import joins as J

PTS = "id int, p array<struct<x:double,y:double>>"


def test_format_g_matches_c(spark):
    rnd = random.Random(1)
    vals = [rnd.uniform(-1, 1) * 10 ** rnd.randint(-9, 12) for _ in range(3000)]
    vals += [0.0, 1.0, -1.0, 0.0001, 0.00001, 123456.0, 1234567.0, 999999.5, 9.999995, 0.1062925, 1e6, 1e-5, 100000.0, 0.5046875]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double").select("v", X.format_g("v").alias("s")).collect()
    assert [(r.v, r.s) for r in rows if r.s != "%g" % r.v] == []


def test_joined_g_writes_lists(spark):
    lists = [[0.1 + 0.2, -0.0, None, 1e-5], [], None, [float("inf"), float("nan"), 1234567.0], [None], [2.0]]
    rows = spark.createDataFrame(list(enumerate(lists)), "i int, v array<double>").coalesce(1).select("i", X.joined_g("v").alias("s")).collect()
    assert {r.i: r.s for r in rows} == {0: "0.3 0 1e-05", 1: "", 2: None, 3: "inf nan 1.23457e+06", 4: "", 5: "2"}


def test_py_round_matches_python(spark):
    rnd = random.Random(2)
    vals = [rnd.uniform(-1000, 1000) for _ in range(2000)] + [k / 800 for k in range(800)] + [0.5, 1.5, 2.5, 2.675, 1.005]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for d in (0, 2, 4):
        bad = [(r.v, r.s) for r in df.select("v", py_round("v", d).alias("s")).collect() if r.s != round(r.v, d)]
        assert bad == []


def test_min_area_box_recovers_rotated_box(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.uniform(-50, 50), rnd.uniform(-50, 50), rnd.uniform(20, 90), rnd.uniform(5, 19), rnd.uniform(0, math.pi)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, cx double, cy double, w double, h double, r double")
    df = df.withColumn("p", R.corners("cx", "cy", "w", "h", "r"))
    b = R.min_area_box("p")
    for x in df.select("*", *[c.alias("n_" + k) for k, c in b.items()]).collect():
        assert math.isclose(x.n_cx, x.cx, abs_tol=1e-6) and math.isclose(x.n_cy, x.cy, abs_tol=1e-6)
        assert math.isclose(max(x.n_w, x.n_h), x.w, abs_tol=1e-6) and math.isclose(min(x.n_w, x.n_h), x.h, abs_tol=1e-6)
        assert 0 <= x.n_r < math.pi / 2


def test_resample_follows_interpolation(spark):
    rnd = random.Random(4)
    polys = [(i, [(rnd.uniform(0, 9), rnd.uniform(0, 9)) for _ in range(3 + i % 20)]) for i in range(60)]
    for n in (10, 21, 50):
        got = spark.createDataFrame(polys, PTS).select("id", "p", P.resample("p", n).alias("q")).collect()
        for r in got:
            s = np.array(r.p)
            q = np.array(r.q)
            assert len(q) == n
            if len(s) == n:
                continue
            ring = np.vstack([s, s[:1]])
            k = len(ring)
            t = np.linspace(0, k - 1, n - k if k < n else n)
            if k < n:
                t = np.sort(np.concatenate([t, np.arange(k)]))
            for c in (0, 1):
                assert np.allclose(q[:, c], np.interp(t, np.arange(k), ring[:, c]))


def test_window_clip_conserves_area(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.uniform(20, 80), rnd.uniform(20, 80), rnd.uniform(5, 60), rnd.uniform(5, 60), rnd.uniform(0, 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, cx double, cy double, w double, h double, r double")
    p = R.corners("cx", "cy", "w", "h", "r")
    cuts = [P.shoelace(P.clip_to_window(p, a, b, a + 50.0, b + 50.0)) for a in (-50.0, 0.0, 50.0, 100.0) for b in (-50.0, 0.0, 50.0, 100.0)]
    for x in df.select("w", "h", *[c.alias(f"c{i}") for i, c in enumerate(cuts)]).collect():
        assert math.isclose(sum(x[f"c{i}"] for i in range(16)), x.w * x.h, rel_tol=1e-9)


def test_containment_edges(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    pts = [(5.0, 5.0, True, True), (0.0, 5.0, False, True), (10.0, 10.0, False, True), (11.0, 5.0, False, False), (5.0, 0.0, False, True)]
    df = spark.createDataFrame([(square, *q) for q in pts], "p array<struct<x:double,y:double>>, x double, y double, s boolean, i boolean")
    for r in df.select("s", "i", RG.in_polygon("p", "x", "y").alias("a"), RG.in_polygon("p", "x", "y", True).alias("b")).collect():
        assert (r.a, r.b) == (r.s, r.i)


def test_flip_twice_is_identity(spark):
    df = spark.createDataFrame([(1, [(1.0, 2.0), (3.0, 4.0)])], PTS)
    out = df.select("p", P.flip_points(P.flip_points("p", 640, 480), 640, 480).alias("q")).first()
    assert out.p == out.q


def test_label_path_last_occurrence(spark):
    df = spark.createDataFrame([("/a/images/b/images/c.x.jpg",)], "p string")
    assert df.select(X.label_path("p")).first()[0] == "/a/images/b/labels/c.x.txt"
    assert df.select(F.concat(X.stem("p"), F.lit("|"), X.suffix("p"))).first()[0] == "c.x|jpg"


def test_window_area_is_the_clipped_area(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.uniform(-20, 120), rnd.uniform(-20, 120), rnd.uniform(1, 90), rnd.uniform(1, 90), rnd.choice([0.0, rnd.uniform(0, 3)])) for i in range(300)]
    rows += [(300, 50.0, 50.0, 20.0, 0.0, 0.0), (301, 0.0, 0.0, 0.0, 0.0, 0.0), (302, 25.0, 25.0, 50.0, 50.0, 0.0), (303, 1e6, 1e6, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, cx double, cy double, w double, h double, r double").select(R.corners("cx", "cy", "w", "h", "r").alias("p"))
    for w in ((0, 0, 50, 50), (-10, 20, 200, 30), (40, 40, 40, 90)):
        w = [F.lit(v) for v in w]
        for r in df.select(P.area_in_window("p", *w).alias("a"), P.shoelace(P.clip_to_window("p", *w)).alias("b")).collect():
            assert math.isclose(r.a, r.b, rel_tol=1e-9, abs_tol=1e-7)


def test_window_share_of_odd_polygons(spark):
    inf, nan = float("inf"), float("nan")
    rows = [([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], 0.5), ([(1.0, 1.0), (3.0, 1.0), (3.0, 2.0), (1.0, 2.0)], 1.0), ([(6.0, 6.0), (9.0, 6.0), (9.0, 9.0), (6.0, 9.0)], 0.0)]
    rows += [([(2.0, 2.0)], 0.0), ([], 0.0)]
    df = spark.createDataFrame(rows, "p array<struct<x:double,y:double>>, s double")
    for r in df.select("s", S.window_share("p", 0, 0, 5, 10).alias("t")).collect():
        assert r.s == r.t
    odd = spark.createDataFrame([([(0.0, 0.0), (v, 0.0), (10.0, 10.0), (0.0, 10.0)],) for v in (inf, nan, None)] + [(None,)], "p array<struct<x:double,y:double>>")
    by_clip = F.when(S.intersection(tuple(R.envelope("p").values()), (0, 0, 5, 10)) > 0, P.shoelace(P.clip_to_window("p", 0, 0, 5, 10)) / F.greatest(P.shoelace("p"), F.lit(1e-6))).otherwise(0.0)
    for r in odd.select(S.window_share("p", 0, 0, 5, 10).alias("a"), by_clip.alias("b")).collect():
        assert repr(r.a) == repr(r.b)


def test_window_join_works_a_share_out_once(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    ann = spark.createDataFrame([(1, 1, square), (1, 2, square[:3]), (2, 3, square), (None, 4, square)], "image_id int, det_id int, polygon array<struct<x:double,y:double>>")
    windows = spark.createDataFrame([(1, 0, 0, 0, 7, 10), (1, 1, 7, 0, 17, 10), (None, 0, 0, 0, 9, 9)], "image_id int, window_id int, x1 int, y1 int, x2 int, y2 int")
    out = J.window_join(ann, windows, 0.7)
    assert out.columns == ["image_id", "det_id", "polygon", "b_window_id", "b_x1", "b_y1", "b_x2", "b_y2", "iof"]
    assert sorted((r.det_id, r.b_window_id, r.iof) for r in out.collect()) == [(1, 0, 0.7)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and not any("lambdafunction" in line for line in joins)
    assert "Broadcast" not in out._jdf.queryExecution().sparkPlan().toString()
