"""First-generation variants, which differ in rules, z-score, verdict, severity and rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.config import DetectorConfig
from tidewatch.functions.render import exact_mean, fixed, percent
from tidewatch.functions.rounding import round_even
from tidewatch.operators.features import ARROW, preprocess
from tidewatch.operators.iforest import with_forest
from tidewatch.operators.metrics import only_anomalies, share
from tidewatch.operators.quantiles import single_quantiles
from tidewatch.operators.zscore import route_sums
from tidewatch.sources.staging import measured
from tidewatch import schema as S

SEA_MODE = "海运"


def preprocess_v1(orders: DataFrame) -> DataFrame:
    """As the current preprocessing, but a missing port leaves the route null."""
    return preprocess(orders).withColumn("route", F.concat("origin", F.lit(ARROW), "dest"))


def with_rules_v1(base: DataFrame, sea_mode: str = SEA_MODE, **quantile_options) -> DataFrame:
    """Ratio, delay and raw-freight floor of one mode."""
    floor = single_quantiles(
        base.where(F.col("mode") == sea_mode), "freight_usd", [0.02], **quantile_options
    ).select("q0").scalar()
    hits = [
        ("delay_over_half", F.col("deviation_ratio") > 0.5),
        ("delay_over_7d", F.col("delay_days") > 7),
        ("low_freight", F.coalesce((F.col("mode") == sea_mode) & (F.col("freight_usd") < floor), F.lit(False))),
    ]
    codes = F.array_compact(F.array(*[F.when(h, F.lit(n)) for n, h in hits]))
    return base.withColumn("rule_codes", codes).withColumns(
        {
            "rule_anomaly": (F.size("rule_codes") > 0).cast("int"),
            "rule_reason": F.concat_ws("", F.transform("rule_codes", lambda c: F.concat(c, F.lit(";")))),
        }
    )


def with_zscore_v1(base: DataFrame, threshold: float = 2.5, sums: DataFrame | None = None) -> DataFrame:
    """Self-included z-score, sample deviation at least 0.1; orders without route drop out."""
    sums = measured(route_sums(base)) if sums is None else sums
    n, x = F.col("_n"), F.col("delay_days")
    mean = F.col("_sum") / n
    variance = F.greatest(F.col("_sumsq") - n * mean * mean, F.lit(0.0)) / F.greatest(n - 1, F.lit(1))
    z = F.when(n >= 5, (x - mean) / F.greatest(F.sqrt(variance), F.lit(0.1))).otherwise(F.lit(0.0))
    return (
        base.join(sums, F.col("route") == F.col("_route"))
        .withColumns({"z_score": round_even(z, 2), "zscore_anomaly": (F.abs(z) > F.lit(threshold)).cast("int")})
        .drop("_route", "_n", "_sum", "_sumsq")
    )


def with_forest_v1(base: DataFrame, rows: int | None = None) -> DataFrame:
    """100 trees at a fixed 5 %, missing features as 0, four decimals."""
    filled = base.withColumns({f: F.coalesce(F.col(f), F.lit(0.0)) for f in S.MODEL_FEATURES})
    return with_forest(filled, DetectorConfig(n_trees=100), rows, digits=4, min_rows=1)


def with_verdict_v1(df: DataFrame) -> DataFrame:
    """Two of three votes; severity looks at the delay before the verdict."""
    votes = F.col("rule_anomaly") + F.col("zscore_anomaly") + F.col("iforest_anomaly")
    delay = F.col("delay_days")
    severity = (
        F.when(delay > 14, F.lit("critical")).when(delay > 7, F.lit("moderate"))
        .when(F.col("final_anomaly") == 1, F.lit("minor")).otherwise(F.lit("normal"))
    )
    return df.withColumn("anomaly_votes", votes).withColumn(
        "final_anomaly", (votes >= 2).cast("int")
    ).withColumn("severity", severity)


def detect_v1(orders: DataFrame, forest: bool = True, sea_mode: str = SEA_MODE) -> DataFrame:
    base = preprocess_v1(orders)
    sums = measured(route_sums(base))
    df = with_forest_v1(base) if forest else base.withColumns(
        {"iforest_anomaly": F.lit(0), "iforest_score": F.lit(0.0)}
    )
    return with_verdict_v1(with_zscore_v1(with_rules_v1(df, sea_mode), sums=sums))


def carrier_stats_v1(result: DataFrame) -> DataFrame:
    anomalies = F.sum("final_anomaly").cast("bigint")
    return result.where(F.col("carrier").isNotNull()).groupBy("carrier").agg(
        F.count("order_id").alias("total_orders"),
        round_even(exact_mean(F.col("delay_days")), 2).alias("avg_delay"),
        round_even(share(F.count_if(F.col("delay_days") > 0), F.count("*")), 2).alias("late_rate"),
        anomalies.alias("anomaly_orders"),
        round_even(share(anomalies, F.count("order_id")), 3).alias("anomaly_rate"),
    ).orderBy(F.desc("anomaly_rate"), "carrier")


def route_stats_v1(result: DataFrame) -> DataFrame:
    anomalies = F.sum("final_anomaly").cast("bigint")
    return result.groupBy("route").agg(
        F.count("order_id").alias("orders"),
        round_even(exact_mean(F.col("delay_days")), 2).alias("avg_delay"),
        round_even(F.max("delay_days"), 2).alias("max_delay"),
        anomalies.alias("anomalies"),
        round_even(share(anomalies, F.count("order_id")), 3).alias("anomaly_rate"),
    ).orderBy(F.desc("avg_delay"), "route")


def monthly_v1(result: DataFrame) -> DataFrame:
    anomalies = F.sum("final_anomaly").cast("bigint")
    return result.where(F.col("ship_year").isNotNull() & F.col("ship_month").isNotNull()).groupBy(
        "ship_year", "ship_month"
    ).agg(
        F.count("order_id").alias("orders"),
        anomalies.alias("anomalies"),
        round_even(exact_mean(F.col("delay_days")), 2).alias("avg_delay"),
        round_even(share(anomalies, F.count("order_id")), 3).alias("anomaly_rate"),
    )


def kpis_v1(result: DataFrame) -> DataFrame:
    anomalies = F.sum("final_anomaly").cast("bigint")
    return result.agg(
        F.count("*").alias("total_orders"),
        anomalies.alias("total_anomalies"),
        round_even(share(anomalies, F.count("*")), 4).alias("anomaly_rate"),
        round_even(exact_mean(F.col("delay_days")), 2).alias("avg_delay"),
        F.max("delay_days").cast("bigint").alias("max_delay"),
    )


def severity_counts_v1(result: DataFrame) -> DataFrame:
    return result.groupBy("severity").agg(F.count("*").alias("orders")).orderBy(F.desc("orders"), "severity")


def top_v1(result: DataFrame, top: int = 10) -> DataFrame:
    return only_anomalies(result).select(
        "order_id", "carrier", "route", "mode", "delay_days", "severity", "rule_reason"
    ).orderBy(F.desc("delay_days"), "order_id").limit(top)


def best_worst_v1(carriers: DataFrame) -> DataFrame:
    """First and last carrier of the rate ranking."""
    rank: Column = F.struct(-F.col("anomaly_rate"), F.col("carrier"))
    return carriers.agg(
        F.min_by("carrier", rank).alias("worst_carrier"), F.max_by("carrier", rank).alias("best_carrier")
    )


def report_carriers_v1(carriers: DataFrame) -> DataFrame:
    return carriers.select(
        "carrier", "total_orders", "avg_delay", percent(F.col("late_rate")).alias("late_rate"),
        "anomaly_orders", percent(F.col("anomaly_rate")).alias("anomaly_rate"),
    )


def report_routes_v1(routes: DataFrame, top: int = 8) -> DataFrame:
    rank = F.row_number().over(W.orderBy(F.desc("_d"), "route"))
    return routes.orderBy(F.desc("avg_delay"), "route").limit(top).withColumn("_d", F.col("avg_delay")).select(
        rank.alias("position"), "route", "orders", round_even("avg_delay", 1).alias("avg_delay"),
        "max_delay", "anomalies", percent(F.col("anomaly_rate")).alias("anomaly_rate"),
    )


def prompt_lines_v1(carriers: DataFrame, routes: DataFrame) -> DataFrame:
    """Fact lines of all carriers and the five slowest routes."""
    carrier = carriers.select(
        F.lit("carrier").alias("kind"),
        F.concat(F.lit("- "), F.col("carrier"), F.lit(": anomaly rate "), percent(F.col("anomaly_rate")),
                 F.lit(", average delay "), fixed(F.col("avg_delay"), 1), F.lit(" days, "),
                 F.col("total_orders").cast("string"), F.lit(" orders")).alias("line"),
    )
    route = routes.orderBy(F.desc("avg_delay"), "route").limit(5).select(
        F.lit("route").alias("kind"),
        F.concat(F.lit("- "), F.col("route"), F.lit(": average delay "), fixed(F.col("avg_delay"), 1),
                 F.lit(" days, longest delay "), fixed(F.col("max_delay"), 1), F.lit(" days, anomaly rate "),
                 percent(F.col("anomaly_rate"))).alias("line"),
    )
    return carrier.unionByName(route)
