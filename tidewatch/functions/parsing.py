"""Coercion of raw cells to timestamps, numbers and day counts. Bad input gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.rounding import round_even

# The characters of a number text (no thousands separators, hex or type suffix).
NUMBER_CHARACTERS = "0123456789.+-eE"

# English month names; three letters of one are enough.
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
NAMED = r"(?i)^(?:(\d{1,2})[ -]([a-z]{3,9})\.?[ -](\d{4})|([a-z]{3,9})\.? (\d{1,2}),? (\d{4}))(?=$|[ T])"
HALF_DAY = r"(?i)[ T](\d{1,2}):(\d{2})(:\d{2})? ?([ap])m$"

# Accepted date layouts beside ISO (yyyyMMdd; yyyy/M/d, yyyy.M.d, yyyy年M月d日; M/d/yyyy, M-d-yyyy).
# One pattern with three alternatives: groups 1-3, 4-6 and 7-9 hold the parts of whichever matched.
DATE_LAYOUTS = (
    r"^(?:(\d{4})(\d{2})(\d{2})"
    r"|(\d{4})[/.年](\d{1,2})[/.月](\d{1,2})日?"
    r"|(\d{1,2})[/-](\d{1,2})[/-](\d{4}))(?=$|[ T])"
)
AS_ISO = "$1$4$9-$2$5$7-$3$6$8"
ISO = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,9})?)?)?$"


def _month_number(name: Column) -> Column:
    """1 to 12 for a name or its first three letters, else null."""
    short, full = F.array(*[F.lit(m[:3]) for m in MONTHS]), F.array(*[F.lit(m) for m in MONTHS])
    at = F.array_position(F.when(F.length(name) == 3, short).otherwise(full), name)
    return F.when(at > 0, at.cast("string"))


def _named_as_iso(text: Column) -> Column:
    """``5 Jan 2024`` and ``January 5, 2024`` with what follows, the month in figures."""
    part = lambda i, j: F.concat(F.regexp_extract(text, NAMED, i), F.regexp_extract(text, NAMED, j))
    month = _month_number(F.lower(part(2, 4)))
    return F.concat(part(3, 6), F.lit("-"), month, F.lit("-"), part(1, 5), F.regexp_replace(text, NAMED, ""))


def _full_day(text: Column) -> Column:
    """``8:30 PM`` at the end as ``20:30``; hours beyond 12 are no time."""
    part = lambda i: F.regexp_extract(text, HALF_DAY, i)
    hour = part(1).try_cast("int")
    hour = F.when(hour.between(1, 12), hour % 12 + F.when(F.lower(part(4)) == "p", 12).otherwise(0))
    return F.concat(F.regexp_replace(text, HALF_DAY, " "), hour.cast("string"), F.lit(":"), part(2), part(3))


def _as_iso(text: Column) -> Column:
    """Text of another layout as ISO text."""
    text = F.when(text.rlike(HALF_DAY), _full_day(text)).when(
        text.rlike(r"\dZ$"), F.regexp_replace(text, "Z$", "")
    ).otherwise(text)
    return F.when(text.rlike(NAMED), _named_as_iso(text)).otherwise(F.regexp_replace(text, DATE_LAYOUTS, AS_ISO))


def parse_timestamp(c: Column) -> Column:
    """Mixed-layout text to a zone-free timestamp. A trailing Z is passed over.

    ISO text, the common case, fits no other layout, so one pattern settles it; the others are tried on the rest only.
    """
    text = F.trim(c.cast("string"))
    other = _as_iso(text)
    return F.when(text.rlike(ISO), text.try_cast("timestamp_ntz")).when(other.rlike(ISO), other.try_cast("timestamp_ntz"))


def finite(c: Column) -> Column:
    """Null for NaN and the infinities (in Spark NaN compares greater than any number)."""
    bad = F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return F.when(~bad, c)


def parse_number(c: Column) -> Column:
    """Text to a finite double."""
    text = F.trim(c)
    plain = F.translate(text, NUMBER_CHARACTERS, "") == ""
    return finite(F.when(plain, text.try_cast("double")))


def to_number(c: Column, data_type: str) -> Column:
    return parse_number(c) if data_type == "string" else finite(c.cast("double"))


def to_timestamp(c: Column, data_type: str) -> Column:
    return parse_timestamp(c) if data_type == "string" else c.cast("timestamp_ntz")


def days_between(start: Column, end: Column) -> Column:
    """Days from start to end, two decimals, ties to even; negative when end is earlier."""
    seconds = (end - start).cast("interval second").cast("decimal(18,6)").cast("double")
    return round_even(seconds / F.lit(86400.0), 2)


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that a later filter reads as values.

    A predicate on a plain projected column is pushed below the projection and repeats everything
    behind it for every mention; it cannot pass a generator, so the parsing behind these columns
    runs once per row.
    """
    kept = [f"`{c}`" for c in df.columns if c not in columns]
    added = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*kept, F.inline(F.array(added)))
