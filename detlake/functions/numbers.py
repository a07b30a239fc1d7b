"""Decimal rounding of doubles by their exact binary value, as C and Python do it.

Spark's own rounding starts from the shortest decimal text of a double, which turns values just below a tie into ties.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boxes import col, let

_SPLIT = 134217729.0  # 2**27 + 1


def _halves(a: Column) -> tuple[Column, Column]:
    t = a * _SPLIT
    hi = t - (t - a)
    return hi, a - hi


def _product_error(a: Column, b: Column, p: Column) -> Column:
    """a * b - p, exactly, where p is the rounded product."""
    ah, al = _halves(a)
    bh, bl = _halves(b)
    return ((ah * bh - p) + ah * bl + al * bh) + al * bl


def _nearest(p: Column, rest: Column) -> Column:
    """Integer nearest to p + rest, halves to even; ``rest`` is smaller than the spacing of doubles at p."""
    low = F.floor(p).cast("double")
    d = p - low - 0.5
    up = (d > 0) | ((d == 0) & ((rest > 0) | ((rest == 0) & (F.pmod(low, F.lit(2.0)) == 1))))
    return low + F.when(up, 1.0).otherwise(0.0)


def py_round(c, digits: int = 0) -> Column:
    """Half-even rounding to ``digits`` decimals, for magnitudes whose scaled value stays below 2**53."""
    x = col(c).cast("double")
    s = 10.0**digits

    def one(a):
        return _nearest(a["p"], _product_error(a["a"], F.lit(s), a["p"])) / s

    n = let(F.struct(F.abs(x).alias("a"), (F.abs(x) * s).alias("p")), one)
    return F.when(x < 0, -n).otherwise(n)
