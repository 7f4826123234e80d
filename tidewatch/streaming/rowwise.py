"""Row-level parts of the batch operators on a streaming frame.

Everything here is a stateless expression; duplicate removal, statistics and the model need the
whole table and stay in the batch plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewatch.operators.validate import normalise_orders, row_issues, type_orders


def flag_rows(orders: DataFrame) -> DataFrame:
    """Normalise, type and flag raw orders, in a batch or a stream alike."""
    return row_issues(type_orders(normalise_orders(orders)))
