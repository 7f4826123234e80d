"""Exact quantiles per group (linear interpolation) that hold for groups of any size.

Two scans, whatever the size. The first takes a mergeable sketch per group, which brackets each wanted rank: it lies
between two values that are a few ten-thousandths of the group apart. The second counts what lies below, inside and
above each bracket and keeps the values inside, each with its count. The rank is then looked up among those.

Nulls and NaN are no values. Infinities rank at the ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.sources.staging import measured

ACCURACY = 10_000  # a sketch's rank is off by at most 1 / ACCURACY of its group


def _same(left: str, right: str, keys: list[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return condition


def _brackets(data: DataFrame, keys: list[str], probs: list[float], accuracy: int) -> DataFrame:
    """Per group its size and ``_ends``, for each quantile a value at or before its rank and one at or behind it."""
    margin = 3 / accuracy
    ends = [min(1.0, max(0.0, p + side * margin)) for p in probs for side in (-1, 1)]
    sketch = F.percentile_approx("_v", [float(e) for e in ends], accuracy)
    return data.groupBy(*keys).agg(F.count("*").alias("n"), sketch.alias("_ends"))


def grouped_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], accuracy: int = ACCURACY
) -> DataFrame:
    """Columns: the keys, ``n`` (values) and ``q0``, ``q1``, … in the order of ``probs``."""
    v = F.col(value).cast("double") + F.lit(0.0)  # one zero
    data = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    brackets = measured(_brackets(data, keys, probs, accuracy))
    low = lambda i: F.col("_ends")[2 * i]
    high = lambda i: F.col("_ends")[2 * i + 1]
    # per quantile -1 below its bracket, 0 inside, 1 above; values inside any bracket are kept apart
    zones = F.array(*[
        F.when(F.col("_v") < low(i), -1).when(F.col("_v") > high(i), 1).otherwise(0) for i in range(len(probs))
    ])
    counted = measured(
        data.alias("d").join(brackets.alias("b"), _same("d", "b", keys))
        .select(*[F.col(f"d.{k}").alias(k) for k in keys], "n", "_v", zones.alias("_zones"))
        .groupBy(*keys, "n", "_zones", F.when(F.array_contains("_zones", 0), F.col("_v")).alias("_inside"))
        .agg(F.count("*").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    )
    split = counted.select(*keys, "n", "_c", "_low", "_high", F.posexplode("_zones").alias("_i", "_zone"))
    # Below and above a bracket only a count and the nearest value remain: few rows beside those inside.
    slots = split.groupBy(*keys, "n", "_i", "_zone", F.when(F.col("_zone") == 0, F.col("_low")).alias("_at")).agg(
        F.sum("_c").alias("_c"), F.min("_low").alias("_low"), F.max("_high").alias("_high")
    )
    order = W.partitionBy(*keys, "_i").orderBy("_zone", "_at")
    slots = slots.withColumn("_end", F.sum("_c").over(order)).withColumn("_begin", F.col("_end") - F.col("_c"))
    prob = F.array(*[F.lit(float(p)) for p in probs])[F.col("_i")]
    rank = prob * (F.col("n") - 1)

    def at(k: Column) -> Column:
        """The value of rank k. Beside a bracket only the nearest value is known; it is never needed further away."""
        inside = (F.col("_begin") <= k) & (k < F.col("_end"))
        nearest = F.when((F.col("_zone") == -1) & (k == F.col("_end") - 1), F.col("_high")).when(
            (F.col("_zone") == 1) & (k == F.col("_begin")), F.col("_low")
        ).when(F.col("_zone") == 0, F.col("_low"))
        return F.max(F.when(inside, nearest))

    found = slots.groupBy(*keys, "n", "_i").agg(at(F.floor(rank)).alias("_a"), at(F.ceil(rank)).alias("_b"))
    a, b = F.col("_a"), F.col("_b")
    between = F.when(a == b, a).otherwise((F.ceil(rank) - rank) * a + (rank - F.floor(rank)) * b)
    missing = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
    q = F.when(a.isNull() | b.isNull(), missing).otherwise(between)
    found = found.withColumn("_q", q)
    wide = found.groupBy(*keys, "n").agg(*[
        F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(f"q{i}") for i in range(len(probs))
    ])
    return wide.select(*keys, "n", *[f"q{i}" for i in range(len(probs))])


def single_quantiles(df: DataFrame, value: str, probs: list[float], **options) -> DataFrame:
    """Quantiles over all rows: one row ``n, q0, q1, …``; none without values."""
    rows = df.select(F.lit(0).alias("all_rows"), value)
    return grouped_quantiles(rows, ["all_rows"], value, probs, **options).drop("all_rows")
