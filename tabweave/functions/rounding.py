"""Rounding that looks at the exact value of a double.

``bround`` rounds the shortest decimal text of a double, so 0.58625 (which is
a little more than that) goes down to 0.5862. Python's ``round`` goes by the
binary value and gives 0.5863; only true ties go to the even digit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: splits a double into two halves whose products are exact.
_SPLIT = 134217729.0


def half_even(x: Column, digits: int) -> Column:
    x = x.cast("double")
    scale = 10.0**digits
    twice = F.lit(2.0 * scale)
    shifted = x * F.lit(_SPLIT)
    high = shifted - (shifted - x)
    low = x - high
    below = F.floor(x * F.lit(scale))
    # 2 * scale * x against the odd number in the middle, without rounding error
    side = (high * twice - (2 * below + 1)) + low * twice
    up = (side > 0) | ((side == 0) & (F.pmod(below, F.lit(2)) == 1))
    rounded = (below + up.cast("int")).cast("double") / F.lit(scale)
    return F.when(F.isnan(x) | (F.abs(x) >= 1e15 / scale), x).otherwise(rounded)
