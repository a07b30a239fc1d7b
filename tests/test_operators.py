import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from detlake.operators import joins as J
from detlake.operators import masks as K
from detlake.operators import match as M
from detlake.operators import metrics as A
from detlake.operators import ordered as O
from detlake.operators import suppress as X
from detlake.operators import video as V
from detlake.operators.assign import solve

BOX = ["x1", "y1", "x2", "y2"]


def iou(a, b, eps=1e-7):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    i = max(w, 0) * max(h, 0)
    return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i + eps)


def boxes(seed, images, per, span=300, classes=3, hot=0):
    """Random boxes; image 0 gets ``hot`` more of them, among them exact copies."""
    rnd = random.Random(seed)
    rows = []
    for im in range(images):
        for k in range(per + (hot if im == 0 else 0)):
            x, y, w, h = rnd.uniform(-40, span), rnd.uniform(-40, span), rnd.uniform(20, 120), rnd.uniform(20, 120)
            if rows and rnd.random() < 0.2 and rows[-1][0] == im:
                x, y, w, h = rows[-1][4], rows[-1][5], rows[-1][6] - rows[-1][4], rows[-1][7] - rows[-1][5]
            rows.append((im, k, rnd.randrange(classes), round(rnd.random(), 2), x, y, x + w, y + h))
    return pd.DataFrame(rows, columns=["image_id", "det_id", "cls", "conf", *BOX])


def jitter(df, seed):
    rnd = random.Random(seed)
    g = df[[rnd.random() < 0.8 for _ in range(len(df))]].copy()
    g[BOX] += np.array([[rnd.uniform(-9, 9) for _ in range(4)] for _ in range(len(g))])
    return g.rename(columns={"det_id": "ann_id"}).drop(columns="conf")


@pytest.fixture(scope="module")
def data(spark):
    d = boxes(1, 30, 8, hot=150)
    g = jitter(d, 2)
    return d, g, spark.createDataFrame(d), spark.createDataFrame(g)


def test_grid_equals_direct(data):
    _, _, d, g = data
    key = ["image_id", "det_id", "b_ann_id"]
    for cell in (32.0, 100.0, 512.0):
        a = J.overlap_join(d, g, threshold=0.3, cell=cell).select(*key)
        b = J.overlap_join(d, g, threshold=0.3, strategy="direct").select(*key)
        assert sorted(a.collect()) == sorted(b.collect())


def test_grid_join_survives_corrupt_boxes(data, spark):
    _, _, d, g = data
    inf, nan = float("inf"), float("nan")
    odd = [(0, 900 + i, 0, 0.5, *b) for i, b in enumerate([(0.0, 0.0, 1e9, 300.0), (-inf, -inf, inf, inf), (nan, 0.0, 9.0, 9.0), (1e300, 0.0, 1e301, 5.0), (-1e12, -1e12, 1e12, 1e12), (70_000.0, 5.0, 70_100.0, 90.0)])]
    d2 = d.unionByName(spark.createDataFrame(odd, d.schema))
    far = spark.createDataFrame([(0, 901, 0, 70_010.0, 5.0, 70_100.0, 90.0), (0, 902, 0, -1e12, -1e12, 1e12, 0.9e12)], g.schema)
    g2 = g.unionByName(far)
    key = ["image_id", "det_id", "b_ann_id"]
    a = J.overlap_join(d2, g2, threshold=0.3).select(*key).collect()
    assert sorted(a) == sorted(J.overlap_join(d2, g2, threshold=0.3, strategy="direct").select(*key).collect())
    assert {(r.det_id, r.b_ann_id) for r in a} >= {(905, 901), (904, 902)}


def test_match_equals_loops(data):
    d, g, ds, gs = data
    want = {}
    for im, dd in d.groupby("image_id"):
        gg = g[g.image_id == im]
        for t in M.THRESHOLDS:
            taken = {}
            for r in dd.sort_values(["conf", "det_id"], ascending=[False, True]).itertuples():
                c = [(iou((r.x1, r.y1, r.x2, r.y2), (q.x1, q.y1, q.x2, q.y2)), -q.ann_id) for q in gg.itertuples() if q.cls == r.cls]
                c = [v for v in c if v[0] >= t]
                if c and max(c)[1] not in taken:
                    taken[max(c)[1]] = r.det_id
            want[im, t] = sorted(taken.values())
    got = M.match_long(M.match_predictions(ds, gs, cell=64.0)).filter("tp").toPandas()
    mine = {k: sorted(v.det_id) for k, v in got.groupby(["image_id", "thr"])}
    assert {k: v for k, v in want.items() if v} == mine


def test_metrics_equal_numpy(data):
    d, g, ds, gs = data
    long = M.match_long(M.match_predictions(ds, gs)).toPandas()
    ap = {(r.cls, r.thr): r.ap for r in A.ap_per_class(M.evaluation_counts(ds, gs)).collect()}
    both = {(r.cls, r.thr): r.ap for r in A.ap_per_class(A.curve_counts(M.match_predictions(ds, gs), gs)).collect()}
    assert ap == pytest.approx(both)
    for (c, t), rows in long.groupby(["cls", "thr"]):
        n = (g.cls == c).sum()
        tp = rows.sort_values(["conf", "tp"], ascending=[False, True]).tp.to_numpy(float)
        hit = tp.cumsum()
        r, p = np.r_[0, hit / n, 1], np.r_[1, hit / np.arange(1, len(tp) + 1), 0]
        p = np.maximum.accumulate(p[::-1])[::-1]
        x = np.linspace(0, 1, 101)
        y = np.interp(x, r, p)
        assert ap[c, t] == pytest.approx(((x[1:] - x[:-1]) * (y[1:] + y[:-1]) / 2).sum(), abs=1e-9)


def test_class_without_predictions_and_without_truth(spark):
    d = spark.createDataFrame([(0, 0, 1, 0.9, 0.0, 0.0, 9.0, 9.0)], "image_id int, det_id int, cls int, conf double, x1 double, y1 double, x2 double, y2 double")
    g = spark.createDataFrame([(0, 0, 2, 0.0, 0.0, 9.0, 9.0)], "image_id int, ann_id int, cls int, x1 double, y1 double, x2 double, y2 double")
    c = M.evaluation_counts(d, g)
    assert {(r.cls, r.ap) for r in A.ap_per_class(c).collect()} == {(2, 0.0)}
    curve = A.confidence_curves(c).filter("i = 500").collect()
    assert [(r.cls, r.p, r.r) for r in curve] == [(2, 0.0, 0.0)]


def test_confusion_totals(data):
    d, g, ds, gs = data
    m = A.confusion_matrix(ds, gs, 3).toPandas()
    assert m[m.actual < 3].n.sum() == len(g)
    assert m[m.pred < 3].n.sum() == (d.conf > 0.25).sum()
    assert len(m) == 16


def greedy(df, thr, limit, agnostic):
    out = []
    for _, im in df[df.conf > 0.25].groupby("image_id"):
        kept = []
        for r in im.sort_values(["conf", "det_id"], ascending=[False, True]).itertuples():
            b = (r.x1, r.y1, r.x2, r.y2)
            if not any((agnostic or k.cls == r.cls) and iou(b, (k.x1, k.y1, k.x2, k.y2), 0) > thr for k in kept):
                kept.append(r)
        out += [(r.image_id, r.det_id) for r in kept[:limit]]
    return sorted(out)


@pytest.mark.parametrize("agnostic,limit", [(False, 300), (True, 300), (False, 5), (True, 5)])
def test_nms_equals_loops(data, agnostic, limit):
    d, _, ds, _ = data
    got = X.nms(ds, iou=0.4, agnostic=agnostic, max_det=limit)
    assert sorted((r.image_id, r.det_id) for r in got.collect()) == greedy(d, 0.4, limit, agnostic)


def test_nms_is_idempotent(data):
    ds = data[2]
    once = X.nms(ds, iou=0.4)
    assert sorted(X.nms(once, iou=0.4).collect()) == sorted(once.collect())


def test_rotated_nms_with_copies(spark):
    rnd = random.Random(7)
    rows = [(0, i, 0, round(rnd.random(), 3), 50.0, 50.0, 30.0, 10.0, 0.3) for i in range(500)]
    rows += [(0, 500 + i, 0, round(rnd.random(), 3), 50.0 + 40 * (i % 20), 120.0 + 40 * (i // 20), 30.0, 10.0, 0.3) for i in range(100)]
    d = spark.createDataFrame(rows, "image_id int, det_id int, cls int, conf double, cx double, cy double, w double, h double, r double")
    kept = X.rotated_nms(d).collect()
    best = max((r for r in rows if r[1] < 500), key=lambda r: (r[3], -r[1]))
    assert {r.det_id for r in kept} == {best[1]} | set(range(500, 600))


def test_assignment_equals_brute_force():
    rnd = np.random.default_rng(3)
    for _ in range(150):
        n, m = rnd.integers(1, 5, 2)
        cost, limit = rnd.uniform(0, 1, (n, m)), 0.6
        got = sum(cost[a, b] - limit for a, b in solve(cost, limit))
        best = 0.0
        for k in range(1, min(n, m) + 1):
            for rows in itertools.combinations(range(n), k):
                for cols in itertools.permutations(range(m), k):
                    best = min(best, sum(min(cost[a, b] - limit, 9) for a, b in zip(rows, cols)))
        assert got == pytest.approx(best, abs=1e-9)


def test_running_previous_trailing_over_many_blocks(spark):
    rnd = random.Random(5)
    pdf = pd.DataFrame([(k, f, rnd.randrange(100)) for k in range(3) for f in sorted(rnd.sample(range(500), 200))], columns=["k", "f", "v"])
    df = spark.createDataFrame(pdf)
    blk = F.floor(F.col("f") / 7)
    r = O.running(df, ["k"], ["f"], blk, sums={"s": "v"}, maxima={"m": "v"})
    r = O.previous(r, ["k"], ["f"], blk, {"p": "v"})
    r = O.previous(r, ["k"], ["f"], blk, {"q": "v"}, when=F.col("v") > 80)
    r = O.trailing(r, ["k"], "f", blk, F.col("v"), 30, "t").toPandas().sort_values(["k", "f"])
    for _, g in r.groupby("k"):
        v = g.v.tolist()
        assert g.s.tolist() == np.cumsum(v).tolist()
        assert g.m.tolist() == np.maximum.accumulate(v).tolist()
        assert [None if pd.isna(x) else int(x) for x in g.p] == [None, *v[:-1]]
        assert [list(x) for x in g.t] == [v[max(0, i - 29) : i + 1] for i in range(len(v))]
        last, want = None, []
        for x in v:
            want.append(last)
            last = x if x > 80 else last
        assert [None if pd.isna(x) else int(x) for x in g.q] == want


def test_global_rank_with_equal_keys(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), F.col("id").alias("u"))
    got = O.with_global_rank(df, "k", "u", parts=16).orderBy("k", "u").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001))


def test_track_operators_with_short_blocks(tables, monkeypatch):
    regions = tables.regions.filter("region_id <= 2")
    want = sorted(map(tuple, V.crossings(tables.tracks, regions).collect()))
    reps = tables.tracks.select("video_id", "track_id", "frame_no", ((F.col("track_id") * 37 + F.col("frame_no") * 53) % 180).cast("double").alias("angle"))
    stages = sorted(map(tuple, V.count_reps(reps).collect()))
    monkeypatch.setattr(V, "BLOCK", 3)
    assert sorted(map(tuple, V.crossings(tables.tracks, regions).collect())) == want
    assert sorted(map(tuple, V.count_reps(reps).collect())) == stages


def test_filled_rotated_boxes_have_their_area(tables):
    from detlake.functions.rotated import corners

    o = tables.obb.withColumn("polygon", corners("cx", "cy", "w", "h", "r")).filter("image_id < 40")
    area = K.run_area(K.polygon_runs(o, ("image_id", "det_id")), ("image_id", "det_id")).join(o, ["image_id", "det_id"]).collect()
    assert area and all(abs(r.area - r.w * r.h) <= 2 * (r.w + r.h) for r in area)


def test_merge_parts_order(spark):
    a = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    b = [(20.0, 0.0), (30.0, 0.0), (30.0, 10.0), (20.0, 10.0)]
    df = spark.createDataFrame([(1, [a, b]), (2, [a])], "id int, parts array<array<struct<x:double,y:double>>>")
    got = {r.id: [tuple(p) for p in r.polygon] for r in K.merge_parts(df, ["id"]).collect()}
    assert got[2] == a
    assert got[1] == [*a[1:], a[0], a[1], *b, b[0]]


def test_slots_add_up(tables):
    out = V.slot_occupancy(tables.tracks, tables.regions.filter("region_id >= 3")).collect()
    assert out and all(r.occupied + r.available == 2 for r in out)
