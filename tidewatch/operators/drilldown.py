"""Filters, category lists, point lookups and export views of a detection result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.functions.rounding import round_even
from tidewatch.functions.text import strip
from tidewatch.operators.insight import carrier_insight
from tidewatch.operators.metrics import only_anomalies

CATEGORY_LIMIT = 200


def filter_anomalies(
    result: DataFrame,
    severities: list[str] | None = None,
    carriers: list[str] | None = None,
    routes: list[str] | None = None,
) -> DataFrame:
    """Anomalies that match every given list; an empty list does not filter."""
    df = only_anomalies(result)
    for column, wanted in (("severity", severities), ("carrier", carriers), ("route", routes)):
        if wanted:
            df = df.where(F.col(column).isin(wanted))
    return df


def anomaly_detail(result: DataFrame, **filters) -> DataFrame:
    """The nine display columns under their display names."""
    names = {"anomaly_methods": "methods", "anomaly_score": "score", "reason": "explanation"}
    return filter_anomalies(result, **filters).select(
        *[F.col(c).alias(names.get(c, c)) for c in S.DETAIL_COLUMNS]
    )


def export_view(result: DataFrame, anomalies_only: bool) -> DataFrame:
    df = only_anomalies(result) if anomalies_only else result
    return df.select(*S.EXPORT_COLUMNS)


def explain_order(result: DataFrame, order_id: Column | str) -> DataFrame:
    """Explanation of one anomalous order, by id."""
    wanted = F.lit(order_id) if isinstance(order_id, str) else order_id
    return (
        only_anomalies(result)
        .where(F.col("order_id").cast("string") == wanted)
        .select("order_id", "severity", "anomaly_methods", round_even("anomaly_score", 1).alias("anomaly_score"), "reason")
        .limit(1)
    )


def explain_carrier(carriers: DataFrame, carrier: Column | str) -> DataFrame:
    """One carrier of the carrier table, by name, with its insight."""
    wanted = F.lit(carrier) if isinstance(carrier, str) else carrier
    one = carriers.where(F.col("carrier") == wanted)
    insight = carrier_insight(one).withColumnRenamed("carrier", "name")
    return one.join(insight, F.col("carrier") == F.col("name")).select(
        "carrier", "total_orders", "anomaly_orders", "sample_note", "insight"
    )


def category_options(df: DataFrame, column: str, limit: int = CATEGORY_LIMIT) -> DataFrame:
    """Most frequent non-blank values with their position, and whether the list was cut."""
    value = strip(F.col(column).cast("string"))
    counted = (
        df.select(value.alias("value"))
        .where(F.col("value").isNotNull() & (F.col("value") != ""))
        .groupBy("value")
        .agg(F.count("*").alias("orders"))
        .orderBy(F.desc("orders"), F.asc("value"))
        .limit(limit + 1)
    )
    # One row more than the list holds, so the window sees a bounded input.
    position = F.row_number().over(W.orderBy(F.desc("orders"), F.asc("value")))
    return (
        counted.withColumn("position", position)
        .withColumn("truncated", F.max("position").over(W.partitionBy(F.lit(0))) > limit)
        .where(F.col("position") <= limit)
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def present_severities(result: DataFrame) -> DataFrame:
    """Severities among the anomalies, in rank order."""
    rank = F.array_position(F.array(*[F.lit(s) for s in S.SEVERITIES]), F.col("severity"))
    return only_anomalies(result).select("severity").distinct().withColumn("rank", rank).orderBy("rank")


def row_fingerprint(df: DataFrame) -> DataFrame:
    """SHA-256 of each row as JSON with its nulls, first 16 hex digits, beside its key."""
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select("order_id", F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint"))
