"""Display labels for users whose files carry the original headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.operators.rules import RULE_LABELS

CODED = {"severity": None, "sample_note": None, "risk": None, "anomaly_methods": ", ", "rule_reason": "; "}


def label(c: Column, separator: str | None = None) -> Column:
    """Code (or a list of codes in one text) to its label; unknown codes stay."""
    pairs = {**S.CODE_LABELS, **RULE_LABELS}
    labels = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    one = lambda code: F.coalesce(F.try_element_at(labels, code), code)
    if separator is None:
        return one(c)
    joint = "、" if separator == ", " else "；"
    return F.array_join(F.transform(F.split(c, separator), one), joint)


def localise(df: DataFrame) -> DataFrame:
    """Coded columns as labels, and known columns under their original headers."""
    headers = {v: k for k, v in S.HEADER_ALIASES.items()}
    return df.select(
        *[
            (label(F.col(c), CODED[c]) if c in CODED else F.col(c)).alias(headers.get(c, c))
            for c in df.columns
        ]
    )
