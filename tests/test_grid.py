"""Hierarchical grid and region cells against direct joins."""

import math
import random

import pytest
from pyspark.sql import functions as F

from detlake.functions import regions as RG
from detlake.operators import grid
from detlake.operators import joins as J

BOX = ["x1", "y1", "x2", "y2"]
SCHEMA = "image_id int, det_id int, x1 double, y1 double, x2 double, y2 double"


def raster(seed, n, uid=0, span=200_000):
    """Boxes of 4 to 30,000 pixels on one raster, with touching neighbours."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        side = 4 * 2 ** rnd.uniform(0, 13)
        x, y, w, h = rnd.uniform(-span / 2, span / 2), rnd.uniform(-span / 2, span / 2), side * rnd.uniform(0.2, 1), side
        if rows and rnd.random() < 0.3:
            x, y = rows[-1][4], rows[-1][3] + rnd.choice([0, 1])
        rows.append((0, uid + i, x, y, x + w, y + h))
    return rows


def pairs(df):
    return sorted(map(tuple, df.select("det_id", "b_det_id").collect()))


@pytest.fixture(scope="module")
def wide(spark):
    inf, nan = float("inf"), float("nan")
    odd = [(0.0, 0.0, 1e9, 300.0), (-inf, -inf, inf, inf), (nan, 0.0, 9.0, 9.0), (1e300, 0.0, 1e301, 5.0), (-1e12, -1e12, 1e12, 1e12), (inf, 0.0, inf, 5.0)]
    a = raster(1, 1500) + [(0, 9000 + i, *b) for i, b in enumerate(odd)] + [(0, 9100, None, 0.0, 1.0, 1.0)]
    b = raster(2, 1200) + [(0, 9000 + i, *b) for i, b in enumerate(odd)]
    return spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)


@pytest.mark.parametrize("cell", [16.0, 100.0, 512.0, 1e6])
def test_boxes_of_all_sizes_equal_the_direct_join(wide, cell):
    a, b = wide
    touching = lambda L, R: F.lit(True)
    got = J.candidate_pairs(a, b, ["image_id"], condition=touching, cell=cell)
    sound = lambda d: d.filter(~F.isnan(F.greatest(*BOX)) & (F.col("x1") + F.col("x2")).isNotNull())
    right = sound(b).select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    on = (F.col("x1") <= F.col("b_x2")) & (F.col("b_x1") <= F.col("x2")) & (F.col("y1") <= F.col("b_y2")) & (F.col("b_y1") <= F.col("y2"))
    assert pairs(got) == pairs(sound(a).join(right, on))
    assert pairs(J.overlap_join(a, b, cell=cell)) == pairs(J.overlap_join(a, b, strategy="direct"))


def test_rows_of_a_large_raster(wide):
    a, b = (d.filter("det_id < 9000") for d in wide)
    left, right = grid.spread_pair(a, b, BOX, BOX, 512.0)
    for rows, table in ((left, a), (right, b)):
        assert rows.groupBy("det_id", "_lv", "_by").count().agg({"count": "max"}).first()[0] <= 4
        assert rows.count() < 12 * table.count()
    L, R = (lambda c: F.col(c)), (lambda c: F.col(f"b_{c}"))
    other = right.select(*[F.col(c).alias(f"b_{c}") for c in right.columns])
    same = (L("_by") == R("_by")) & (L("_lv") == R("_lv")) & (L("_gx") == R("_gx")) & (L("_gy") == R("_gy"))
    compared = left.join(other, same).count()
    assert compared < 0.05 * a.count() * b.count()


def star(cx, cy, r, n):
    return [(cx + (r if i % 2 else r / 3) * math.cos(math.pi * i / n), cy + (r if i % 2 else r / 3) * math.sin(math.pi * i / n)) for i in range(2 * n)]


@pytest.mark.parametrize("inclusive", [False, True])
def test_region_cells_equal_the_exact_test(spark, inclusive):
    rnd = random.Random(4)
    nan, inf = float("nan"), float("inf")
    outlines = [
        star(500, 400, 300, 7), star(-20_000, 9000, 15_000, 40), [(20.0, 400.0), (1080.0, 400.0), (1080.0, 360.0), (20.0, 360.0)],
        [(0.0, 0.0), (64.0, 0.0), (64.0, 64.0), (0.0, 64.0)], [(20.0, 380.0), (1080.0, 380.0)], [(5.0, 5.0)], star(3e-4, 1e-4, 2e-4, 3),
        [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 0.0), (-10.0, -10.0), (0.0, -10.0)],
    ]
    regions = spark.createDataFrame([(i, p) for i, p in enumerate(outlines)], "region_id int, points array<struct<x:double,y:double>>")
    spots = [p for o in outlines for p in o] + [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for o in outlines for a, b in zip(o, o[1:])]
    spots += [(rnd.uniform(-50, 1200), rnd.uniform(0, 800)) for _ in range(1500)] + [(rnd.uniform(-40_000, 0), rnd.uniform(-9000, 26_000)) for _ in range(1500)]
    spots += [(float(x), float(y)) for x in range(-2, 70, 4) for y in range(-2, 70, 4)] + [(nan, 5.0), (inf, 0.0), (1e300, 1e300), (rnd.uniform(1e-4, 5e-4), 1e-4)]
    points = spark.createDataFrame([(i, *s) for i, s in enumerate(spots)], "uid int, cx double, cy double")
    got = J.in_region(points, regions, inclusive=inclusive).select("uid", "region_id").collect()
    finite = points.filter((F.abs("cx") < inf) & (F.abs("cy") < inf))
    want = finite.crossJoin(regions).filter(RG.in_polygon("points", "cx", "cy", inclusive)).select("uid", "region_id").collect()
    assert want and sorted(got) == sorted(want)


def test_inside_cells_need_no_outline(spark):
    regions = spark.createDataFrame([(1, star(0, 0, 1e5, 500)), (2, [(0.0, float("nan")), (1.0, 1.0)]), (3, [])], "region_id int, points array<struct<x:double,y:double>>")
    cells = grid.region_cells(regions)
    assert {r.region_id for r in cells.select("region_id").distinct().collect()} == {1}
    assert cells.count() <= (grid.ACROSS + 1) ** 2
    square = spark.createDataFrame([(1, [(0.0, 0.0), (1000.0, 0.0), (1000.0, 1000.0), (0.0, 1000.0)])], "region_id int, points array<struct<x:double,y:double>>")
    kinds = {r["_inside"]: r["count"] for r in grid.region_cells(square).groupBy("_inside").count().collect()}
    assert kinds[True] > kinds[False] * 2  # a tenth of a square's points at most lies in cells of its outline
