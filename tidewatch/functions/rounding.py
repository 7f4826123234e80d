"""Rounding of doubles, half to even, as scaled integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(c: Column | str, digits: int) -> Column:
    """Scale, round to the nearest integer (ties to even), scale back.

    This is how array libraries round; ``bround`` works on the decimal text of the number instead
    and differs on values such as 4.105, which is slightly above its text.
    """
    x = F.col(c) if isinstance(c, str) else c
    scale = F.lit(float(10**digits))
    return F.rint(x.cast("double") * scale) / scale
