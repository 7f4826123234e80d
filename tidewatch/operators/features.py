"""Derived order columns and the model's feature scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.functions.parsing import to_number, to_timestamp
from tidewatch.operators.quantiles import grouped_quantiles
from tidewatch.operators.validate import long_metrics

ARROW = "→"


def preprocess(orders: DataFrame) -> DataFrame:
    """Type the detector's columns and add ratio, calendar, route and unit-freight columns."""
    df = S.canonical_columns(orders)
    S.require_columns(df, S.DETECTOR_REQUIRED, "the detector input", ordered=False)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    df = df.withColumns(
        {
            "ship_ts": to_timestamp(F.col("ship_ts"), kinds["ship_ts"]),
            **{c: to_number(F.col(c), kinds[c]) for c in S.DETECTOR_NUMERIC},
        }
    )
    port = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    return df.withColumns(
        {
            "deviation_ratio": F.col("delay_days") / F.greatest("planned_days", F.lit(1.0)),
            "ship_month": F.month("ship_ts"),
            "ship_year": F.year("ship_ts"),
            "route": F.concat(port("origin"), F.lit(ARROW), port("dest")),
            "unit_freight": F.col("freight_usd") / F.greatest("weight_t", F.lit(0.01)),
        }
    )


def feature_scales(base: DataFrame, **quantile_options) -> DataFrame:
    """Median and interquartile range of each model feature."""
    q = grouped_quantiles(
        long_metrics(base, S.MODEL_FEATURES), ["metric"], "value", [0.25, 0.5, 0.75], **quantile_options
    )
    return q.select("metric", F.col("q1").alias("median"), (F.col("q2") - F.col("q0")).alias("iqr"))


def scale_features(base: DataFrame, **quantile_options) -> DataFrame:
    """Median-imputed, robustly scaled features: (x - median) / IQR, an IQR of 0 counting as 1."""
    scales = feature_scales(base, **quantile_options)
    at = lambda metric, c: F.max(F.when(F.col("metric") == metric, F.col(c)))
    # Five rows folded into one struct that the scan reads as a scalar.
    one = scales.agg(
        F.struct(
            *[at(f, "median").alias(f"m_{f}") for f in S.MODEL_FEATURES],
            *[at(f, "iqr").alias(f"i_{f}") for f in S.MODEL_FEATURES],
        ).alias("s")
    ).scalar()
    cols = []
    for f in S.MODEL_FEATURES:
        median, iqr = one.getField(f"m_{f}"), one.getField(f"i_{f}")
        unit = F.when(iqr == 0, F.lit(1.0)).otherwise(iqr)
        cols.append(((F.coalesce(F.col(f), median) - median) / unit).alias(f"{f}_scaled"))
    return base.select("order_id", *cols)
