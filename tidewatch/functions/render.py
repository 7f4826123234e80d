"""Numbers to text. Values are rounded half-to-even first, so text and number always agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.rounding import round_even


def fixed(c: Column, digits: int) -> Column:
    """Exactly ``digits`` decimals."""
    return round_even(c.cast("double"), digits).cast(f"decimal(18,{digits})").cast("string")


def percent(c: Column) -> Column:
    """A share as percent text with one decimal."""
    return F.concat(fixed(c * 100.0, 1), F.lit("%"))


def grouped(c: Column) -> Column:
    """An integer with thousands separators."""
    return F.format_number(c, 0)


def cell(c: Column) -> Column:
    """A numeric table cell: at most two decimals, no trailing zeros, a dash for null."""
    bare = F.regexp_replace(fixed(c, 2), r"\.?0+$", "")
    return F.coalesce(bare, F.lit("—"))


def cell_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("—"))


def exact_sum(c: Column, scale: int = 4) -> Column:
    """Sum of a day count as a double, computed in decimals so that row order cannot matter."""
    return F.sum(c.cast(f"decimal(18,{scale})")).cast("double")


def exact_mean(c: Column) -> Column:
    return exact_sum(c) / F.count(c)
