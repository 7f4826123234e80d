"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every character that counts as blank at the ends of a text cell.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Cell texts that mean "missing" (case-sensitive).
NULL_MARKERS = ["", "nan", "NaN", "None", "null"]

# Line ends, as in universal line splitting.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    """Trim blanks of any script, U+3000 included (plain ``trim`` only knows the space)."""
    return F.btrim(c, F.lit(BLANKS))


def normalise_text(c: Column) -> Column:
    """Strip, then turn the missing-value markers into null."""
    bare = strip(c.cast("string"))
    return F.when(~bare.isin(NULL_MARKERS), bare)


def neutralise_formula(c: Column) -> Column:
    """Prefix an apostrophe to text a spreadsheet would run as a formula."""
    risky = F.ltrim(c, F.lit(BLANKS)).rlike(r"^[=+\-@]")
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)


def neutralise_frame(df: DataFrame) -> DataFrame:
    """Apply :func:`neutralise_formula` to the string columns; numbers stay as they are."""
    return df.select(
        *[
            neutralise_formula(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def plain_lines(c: Column) -> Column:
    """Markdown text to an array of plain lines: no blanks, markers, bold stars or backticks."""
    lines = F.filter(
        F.transform(F.split(F.coalesce(c, F.lit("")), LINE_END), strip), lambda s: s != ""
    )

    def unmark(s: Column) -> Column:
        s = F.regexp_replace(s, r"(?U)^#{1,6}\s*", "")
        s = F.regexp_replace(s, r"(?U)^[-*>]\s*", "")
        s = F.regexp_replace(s, r"\*\*([^*]+)\*\*", "$1")
        return F.replace(s, F.lit("`"), F.lit(""))

    return F.transform(lines, unmark)
