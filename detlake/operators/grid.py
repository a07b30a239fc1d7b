"""Grids whose cells grow with the boxes: a box touches at most four cells of its own level, whatever its size or place."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import regions as RG
from ..functions.boxes import col, cols
from ..functions.rotated import envelope

#: Cells grow by this factor from level to level; the last level is one cell that holds everything, infinite boxes too.
STEP, TOP = 4, 60
#: Cells along a region's longer side: more than a quarter of this, at most one more than this.
ACROSS = 32
#: Beyond it neighbouring whole numbers are no longer told apart by doubles.
_FAR = float(1 << 53)
_MOST = 1e308

Side = Callable[[str], Column]


def _size(level: Column, cell: float) -> Column:
    """Length of a cell; endless at the last level."""
    return F.when(level < TOP, F.lit(cell) * F.pow(F.lit(float(STEP)), level)).otherwise(F.lit(float("inf")))


def _place(v: Column, size: Column) -> Column:
    """Number of the cell that holds ``v``; never decreases with ``v``. An endless cell is number 0."""
    return F.floor(F.least(F.greatest(F.least(F.greatest(v, F.lit(-_MOST)), F.lit(_MOST)) / size, F.lit(-_FAR)), F.lit(_FAR)))


def _side(box: Sequence) -> Column:
    x1, y1, x2, y2 = cols(*box)
    return F.greatest(x2 - x1, y2 - y1)


def level_of(side: str, cell: float) -> Column:
    """First level whose cells are at least as long as the box's longer side; undefined sides (of infinite boxes) have the last."""
    v = F.col(side)
    steps = F.when(v <= cell, 0).otherwise(F.least(F.ceil(F.log(v / cell) / math.log(STEP)), F.lit(TOP)))
    return F.when(F.isnan(v), TOP).otherwise(F.coalesce(steps, F.lit(0))).cast("int")


def levels_in(sides: DataFrame, level: Column) -> Column:
    """The levels that occur among ``sides``, as one array of at most ``TOP + 1`` numbers."""
    return sides.select(level.alias("_l")).agg(F.collect_set("_l")).scalar()


def _spread(df: DataFrame, names: Sequence[str], cell: float, others: Column, left: bool) -> DataFrame:
    """One row per mark and cell in which a box looks for partners: at its own level ``_own``, and at each of the levels of ``others`` above
    it. Levels at which there is nobody to meet are left out."""
    x1, y1, x2, y2 = cols(*names)
    own, lowest = F.col("_lv") == F.col("_own"), F.array_min("_others")
    if left:  # at its own level it meets equal and smaller boxes, above it larger ones
        marks = F.when(~own, F.array(F.lit(1))).when(lowest <= F.col("_own"), F.array(F.lit(0)))
    else:  # at its own level and above it meets equal and larger boxes, at its own level also smaller ones
        marks = F.array_compact(F.array(F.when(F.array_contains("_others", F.col("_lv")), 0), F.when(own & (lowest < F.col("_own")), 1)))
    out = df.withColumn("_others", others).withColumn("_lv", F.explode(F.array_union(F.array("_own"), F.col("_others")))).filter("_lv >= _own")
    out = out.withColumn("_by", F.explode(marks)).withColumn("_s", _size(F.col("_lv"), cell)).drop("_own", "_others")

    def span(lo: Column, hi: Column) -> Column:
        a = _place(lo, F.col("_s"))
        return F.sequence(a, F.greatest(_place(hi, F.col("_s")), a))

    return out.withColumn("_gx", F.explode(span(x1, x2))).withColumn("_gy", F.explode(span(y1, y2)))


def spread_pair(
    a: DataFrame, b: DataFrame, a_box: Sequence, b_box: Sequence, cell: float, like: tuple[DataFrame, DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_x1, _y1, _x2, _y2`` and the cells ``_by, _lv, _gx, _gy`` (of length ``_s``) on which they meet.

    Two boxes meet at the level of the larger one, and only there: under mark 0 if that is the left one or both are of one level, else
    under mark 1. The levels that occur on the other side come from an aggregate of one row, read from ``like``: tables with the
    same boxes that cost less than the sides themselves. Boxes with a missing or undefined coordinate touch nothing and are left out.
    """
    names = ("_x1", "_y1", "_x2", "_y2")

    def placed(df: DataFrame, box: Sequence) -> DataFrame:
        return df.withColumns(dict(zip(names, [F.col(c) if isinstance(c, str) else c for c in box], strict=True)))

    def ready(df: DataFrame, box: Sequence) -> DataFrame:
        whole = F.col("_x1") + F.col("_y1") + F.col("_x2") + F.col("_y2")
        sound = whole.isNotNull() & ~F.isnan(F.greatest(*names).cast("double"))  # an undefined number is the greatest
        out = placed(df, box).filter(sound).withColumn("_side", _side(names))
        return out.withColumn("_own", level_of("_side", cell)).drop("_side")

    def found(df: DataFrame, box: Sequence) -> Column:
        return levels_in(placed(df, box).select(*names).select(_side(names).alias("_side")), level_of("_side", cell))

    like = like or (a, b)
    in_a, in_b = found(like[0], a_box), found(like[1], b_box)
    return _spread(ready(a, a_box), names, cell, in_b, True), _spread(ready(b, b_box), names, cell, in_a, False)


def after_shuffle(side: Side, box: Sequence | Callable[[Side], Sequence], cell: float) -> Side:
    """Columns of one side of :func:`spread_pair`; the box, unless it is given as columns, and the length of the cell are worked out from
    the others, so that they need not be shuffled beside them."""
    names = ("_x1", "_y1", "_x2", "_y2")
    made = {"_s": _size(side("_lv"), cell)}
    if callable(box) or all(isinstance(c, str) for c in box):
        made |= dict(zip(names, box(side) if callable(box) else map(side, box), strict=True))
    return lambda c: made[c] if c in made else side(c)


def meet(L: Side, R: Side) -> Column:
    """Rows of :func:`spread_pair` that touch, each pair in one cell only: the one of its intersection's top-left corner."""
    on = (L("_by") == R("_by")) & (L("_lv") == R("_lv")) & (L("_gx") == R("_gx")) & (L("_gy") == R("_gy"))
    on = on & (L("_x1") <= R("_x2")) & (R("_x1") <= L("_x2")) & (L("_y1") <= R("_y2")) & (R("_y1") <= L("_y2"))
    on = on & (_place(F.greatest(L("_x1"), R("_x1")), L("_s")) == L("_gx"))
    return on & (_place(F.greatest(L("_y1"), R("_y1")), L("_s")) == L("_gy"))


# --- regions -------------------------------------------------------------------------------------------------------------------


def _region_level(side: str) -> Column:
    steps = F.ceil(F.log(F.col(side) / ACROSS) / math.log(STEP))
    return F.least(F.greatest(F.coalesce(steps, F.lit(0)), F.lit(-20)), F.lit(TOP - 1)).cast("int")


def _with_side(regions: DataFrame, points: str) -> DataFrame:
    names = ("_x1", "_y1", "_x2", "_y2")
    r = regions.withColumns(dict(zip(names, envelope(points).values(), strict=True)))
    return r.withColumn("_side", _side(names).cast("double"))


def _touched(points: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """An edge of the outline comes into the rectangle, or near it."""

    def hit(q: Column, i: Column) -> Column:
        r = F.element_at(points, (i + 1) % F.size(points) + 1)
        dx, dy = r["x"] - q["x"], r["y"] - q["y"]
        beside = (F.greatest(q["x"], r["x"]) < x1) | (F.least(q["x"], r["x"]) > x2) | (F.greatest(q["y"], r["y"]) < y1) | (F.least(q["y"], r["y"]) > y2)
        # the farthest corners along the edge's normal
        low = dx * (F.when(dx > 0, y1).otherwise(y2) - q["y"]) - dy * (F.when(dy > 0, x2).otherwise(x1) - q["x"])
        high = dx * (F.when(dx > 0, y2).otherwise(y1) - q["y"]) - dy * (F.when(dy > 0, x1).otherwise(x2) - q["x"])
        return ~beside & (low <= 0) & (high >= 0)

    return F.exists(F.transform(points, hit), lambda v: v)


def region_cells(regions: DataFrame, points: str = "points") -> DataFrame:
    """``regions`` with one row per grid cell of theirs: ``_lv, _gx, _gy`` and ``_inside``.

    Cells that the outline does not come near are inside or outside as a whole, told by their centre; those outside are
    dropped. ``_inside`` is false where the outline passes: only there must a point be tested. A region's cells are as large
    as its size asks for, so their number is bounded. A region with a corner that is not a finite number holds nothing.
    """
    finite = F.forall(col(points), lambda q: (F.abs(q["x"]) < float("inf")) & (F.abs(q["y"]) < float("inf")))
    r = _with_side(regions.filter(F.coalesce(finite, F.lit(False)) & (F.size(points) > 0)), points)
    r = r.withColumn("_lv", _region_level("_side"))
    s = _size(F.col("_lv"), 1.0)
    for c, lo, hi in (("_gx", "_x1", "_x2"), ("_gy", "_y1", "_y2")):
        r = r.withColumn(c, F.explode(F.sequence(F.floor(F.col(lo) / s), F.floor(F.col(hi) / s))))
    x, y = F.col("_gx") * s, F.col("_gy") * s
    # wider than any rounding of the edges' equations
    names = ("_x1", "_y1", "_x2", "_y2")
    more = s * 1e-6 + F.greatest(*[F.abs(c) for c in names]) * 1e-12
    r = r.withColumn("_near", _touched(col(points), x - more, y - more, x + s + more, y + s + more))
    r = r.withColumn("_inside", ~F.col("_near") & RG.in_polygon(points, x + s / 2, y + s / 2))
    return r.filter(F.col("_near") | F.col("_inside")).drop("_near", "_side", *names)


def points_in_regions(points: DataFrame, regions: DataFrame, keys: Sequence[str], x="cx", y="cy", inclusive=False) -> DataFrame:
    """Points joined to every region that holds them: those in inside cells without a look at the outline, the others by the exact test.

    A point looks into its cell of every level that occurs among the regions, an array of one row. A point without a defined place is
    in no region.
    """
    cells = region_cells(regions)
    levels = levels_in(_with_side(regions, "points").select("_side"), _region_level("_side"))
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    p = points.filter(~F.isnan(px) & ~F.isnan(py) & (F.abs(px) < float("inf")) & (F.abs(py) < float("inf"))).withColumn("_lv", F.explode(levels))
    s = _size(F.col("_lv"), 1.0)

    p = p.withColumns({"_gx": _place(px, s), "_gy": _place(py, s)})
    out = p.join(cells, [*keys, "_lv", "_gx", "_gy"])
    held = F.when(F.col("_inside"), F.lit(True)).otherwise(RG.in_polygon("points", x, y, inclusive))
    return out.filter(held).drop("_lv", "_gx", "_gy", "_inside")
