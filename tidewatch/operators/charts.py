"""The numbers behind each chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.render import exact_mean, percent
from tidewatch.operators.quantiles import grouped_quantiles
from tidewatch.sources.staging import measured

NORMAL_BINS = 30
ANOMALY_BINS = 20


def delay_histogram(
    result: DataFrame, normal_bins: int = NORMAL_BINS, anomaly_bins: int = ANOMALY_BINS
) -> DataFrame:
    """Density of the delay per class, equal-width bins over the class's own range.

    Bins are half open but for the last; edges are compared as numbers, so a value on an edge
    counts upward. A constant class gets a range of one.
    """
    delays = result.select("final_anomaly", F.col("delay_days").alias("x")).where(F.col("x").isNotNull())
    lo, hi = F.min("x"), F.max("x")
    flat = lo == hi
    # One row per class: two at most.
    classes = measured(
        delays.groupBy("final_anomaly").agg(
            F.count("*").alias("n"),
            F.when(flat, lo - 0.5).otherwise(lo).alias("lo"),
            F.when(flat, hi + 0.5).otherwise(hi).alias("hi"),
        ).withColumn(
            "bins", F.when(F.col("final_anomaly") == 1, F.lit(anomaly_bins)).otherwise(F.lit(normal_bins))
        )
    )

    def edge(i: Column) -> Column:
        step = (F.col("hi") - F.col("lo")) / F.col("bins")
        return F.when(i == F.col("bins"), F.col("hi")).otherwise(F.col("lo") + i * step)

    guess = F.least(
        F.floor((F.col("x") - F.col("lo")) * F.col("bins") / (F.col("hi") - F.col("lo"))),
        F.col("bins") - 1,
    ).cast("int")
    settled = (
        F.when(F.col("x") < edge(F.col("g")), F.col("g") - 1)
        .when((F.col("x") >= edge(F.col("g") + 1)) & (F.col("g") != F.col("bins") - 1), F.col("g") + 1)
        .otherwise(F.col("g"))
    )
    counts = (
        delays.join(F.broadcast(classes), "final_anomaly")
        .withColumn("g", guess)
        .withColumn("bin", settled)
        .groupBy("final_anomaly", "bin")
        .agg(F.count("*").alias("orders"))
    )
    grid = classes.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    width = edge(F.col("bin") + 1) - edge(F.col("bin"))
    orders = F.coalesce("orders", F.lit(0))
    return grid.join(F.broadcast(counts), ["final_anomaly", "bin"], "left").select(
        "final_anomaly",
        "bin",
        edge(F.col("bin")).alias("bin_start"),
        edge(F.col("bin") + 1).alias("bin_end"),
        orders.alias("orders"),
        (orders / (F.col("n") * width)).alias("density"),
    )


def delay_box(result: DataFrame, **quantile_options) -> DataFrame:
    """Box statistics of the delay per mode: quartiles, whiskers within 1.5 IQR, outlier count."""
    delays = result.select("mode", F.col("delay_days").alias("x")).where(
        F.col("x").isNotNull() & F.col("mode").isNotNull()
    )
    q = grouped_quantiles(delays, ["mode"], "x", [0.25, 0.5, 0.75], **quantile_options)
    iqr = F.col("q2") - F.col("q0")
    boxes = measured(
        q.select(
            F.col("mode").alias("_mode"), F.col("q0").alias("q1"), F.col("q1").alias("median"),
            F.col("q2").alias("q3"),
            (F.col("q0") - 1.5 * iqr).alias("fence_low"), (F.col("q2") + 1.5 * iqr).alias("fence_high"),
        )
    )
    inside_low = F.min(F.when(F.col("x") >= F.col("fence_low"), F.col("x")))
    inside_high = F.max(F.when(F.col("x") <= F.col("fence_high"), F.col("x")))
    # The furthest points inside the fences bound every point inside, so counting by fence is the
    # same as counting beyond the whiskers unless a whisker falls back to its quartile.
    rows = delays.join(boxes, F.col("mode") == F.col("_mode"))
    stats = rows.groupBy("mode", "q1", "median", "q3").agg(
        F.count("*").alias("orders"),
        inside_low.alias("low"),
        inside_high.alias("high"),
        F.count_if((F.col("x") < F.col("fence_low")) | (F.col("x") > F.col("fence_high"))).alias("outliers"),
    )
    return stats.select(
        "mode", "orders", "q1", "median", "q3",
        F.least(F.coalesce("low", "q1"), "q1").alias("whisker_low"),
        F.greatest(F.coalesce("high", "q3"), "q3").alias("whisker_high"),
        "outliers",
    )


def carrier_chart(carriers: DataFrame) -> DataFrame:
    """Carriers with the unweighted means, marks and bubble sizes of the two carrier charts."""
    means = carriers.agg(
        F.struct(
            exact_mean(F.col("anomaly_rate")).alias("rate"),
            exact_mean(F.col("avg_delay")).alias("delay"),
            F.max("total_orders").alias("largest"),
        ).alias("m")
    ).scalar()
    size = F.col("total_orders") / F.greatest(means.getField("largest").cast("double"), F.lit(1.0)) * 400 + 100
    return carriers.select(
        "carrier",
        "total_orders",
        "anomaly_rate",
        percent(F.col("anomaly_rate")).alias("rate_text"),
        means.getField("rate").alias("mean_rate"),
        (F.col("anomaly_rate") > 0.1).alias("rate_marked"),
        "avg_delay",
        means.getField("delay").alias("mean_delay"),
        (F.col("avg_delay") > means.getField("delay")).alias("delay_marked"),
        size.alias("bubble_size"),
    ).orderBy("anomaly_rate", "carrier")
