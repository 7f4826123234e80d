"""Leave-one-out route z-score layer.

Each route is reduced to count, sum and sum of squares (one aggregate with map-side combine), and
every row takes itself out again by arithmetic; no group is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import DetectorConfig, check_threshold
from tidewatch.functions.rounding import round_even
from tidewatch.sources.staging import measured

MIN_SPREAD = 0.5


def route_sums(base: DataFrame) -> DataFrame:
    """Size, sum and sum of squares of the delay per route, exact in decimals."""
    x = F.col("delay_days").cast("decimal(14,4)")
    return base.groupBy(F.col("route").alias("_route")).agg(
        F.count("*").alias("_n"),
        F.sum(x).cast("double").alias("_sum"),
        F.sum(x * x).cast("double").alias("_sumsq"),
    )


def zscore_columns(config: DetectorConfig, included: bool = True) -> dict[str, Column]:
    """``included``: the row is one of those that its route's sums were taken over, and takes itself out."""
    x, n = F.col("delay_days"), F.coalesce("_n", F.lit(0))
    own, own_square = (x, x * x) if included else (F.lit(0.0), F.lit(0.0))
    m = (n - (1 if included else 0)).cast("double")
    mean = (F.col("_sum") - own) / F.nullif(m, F.lit(0.0))
    spread_sum = (F.col("_sumsq") - own_square) - m * mean * mean
    variance = F.greatest(spread_sum, F.lit(0.0)) / F.greatest(m - 1, F.lit(1.0))
    z = (x - mean) / F.greatest(F.sqrt(variance), F.lit(MIN_SPREAD))
    small = n < config.min_group_size
    z = F.when(~small, z).otherwise(F.lit(0.0))
    return {
        "zscore_anomaly": (F.abs(z) > F.lit(config.zscore_threshold)).cast("int"),
        "z_score": round_even(z, 3),
        "zscore_skipped": small,
    }


def with_zscore(
    base: DataFrame, config: DetectorConfig, sums: DataFrame | None = None, included: bool = True
) -> DataFrame:
    """Add the z-score columns. The route table is joined by its measured size; a route that it lacks is too small to judge."""
    sums = measured(route_sums(base)) if sums is None else sums
    joined = base.join(sums, F.col("route") == F.col("_route"), "inner" if included else "left")
    return joined.withColumns(zscore_columns(config, included)).drop("_route", "_n", "_sum", "_sumsq")


def zscore_layer(
    base: DataFrame, threshold: float | None = None, config: DetectorConfig | None = None
) -> DataFrame:
    config = config or DetectorConfig()
    if threshold is not None:
        config = DetectorConfig(**{**config.__dict__, "zscore_threshold": check_threshold(threshold)})
    return with_zscore(base, config).select(
        "order_id", "zscore_anomaly", "z_score", "zscore_skipped"
    )
