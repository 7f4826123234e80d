"""KPIs and rollups of a detection result. Every table here is one aggregate over one scan, or part of a rollup that several share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.functions.rounding import round_even
from tidewatch.sources.staging import measured

SMALL_SAMPLE = 5
PRIOR_STRENGTH = 10
TOP_REASONS = 8
TOP_ANOMALIES = 10


LEVELS = {"all": [], "carrier": ["carrier"], "route": ["route"], "month": ["ship_year", "ship_month"]}
METHODS = [("rules", "rule_anomaly"), ("route_zscore", "zscore_anomaly"), ("iforest", "iforest_anomaly")]


def check_result(result: DataFrame) -> None:
    S.require_columns(result, S.METRICS_REQUIRED, "the detection result", ordered=False)
    S.require_rows(result, "the detection result")


def only_anomalies(result: DataFrame) -> DataFrame:
    return result.where(F.col("final_anomaly") == 1)


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def _exact_sum(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(18,4)"))


def measures() -> dict[str, Column]:
    """What every rollup here is made of. A plan that reads some of them computes only those."""
    anomaly = lambda c: F.sum(c).cast("bigint")
    return {
        "_rows": F.count("*"), "_ids": F.count("order_id"), "_anomalies": anomaly("final_anomaly"),
        "_delays": F.count("delay_days"), "_delay_sum": _exact_sum("delay_days"), "_delay_max": F.max("delay_days"),
        "_late": F.count_if(F.col("delay_days") > 0),
        "_plans": F.count("planned_days"), "_plan_sum": _exact_sum("planned_days"),
        "_from": F.min("ship_ts"), "_to": F.max("ship_ts"),
        **{f"_{s}": F.count_if(F.col("severity") == s) for s in S.SEVERITIES},
        **{f"_{c}": anomaly(c) for _, c in METHODS},
    }


def merged(name: str) -> Column:
    """A measure of several groups together."""
    if name in ("_delay_max", "_to"):
        return F.max(name)
    if name == "_from":
        return F.min(name)
    total = F.sum(name)
    if name in ("_delay_sum", "_plan_sum"):
        return total
    counted = name not in ["_anomalies", *[f"_{c}" for _, c in METHODS]]
    return (F.coalesce(total, F.lit(0)) if counted else total).cast("bigint")


class Rollup:
    """The measures of a result at all levels, from one scan (grouping sets), for several reports over one result.

    Every function here and every report takes one in place of the result; those that need the rows read ``result``.
    """

    def __init__(self, result: DataFrame):
        keys = [k for level in LEVELS.values() for k in level]
        sets = [[F.col(k) for k in level] for level in LEVELS.values() if level]
        cube = result.groupingSets(sets, *keys).agg(
            *[c.alias(name) for name, c in measures().items()], F.grouping_id().alias("_level")
        )
        self.result, self.cube = result, measured(cube)

    def at(self, level: str) -> DataFrame:
        if not LEVELS[level]:  # a row of totals, also if there is no group
            return self.at("carrier").agg(*[merged(name).alias(name) for name in measures()])
        keys = [k for group in LEVELS.values() for k in group]
        # a bit for every key that the level does not group by
        number = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in LEVELS[level])
        return self.cube.where(F.col("_level") == number).select(*LEVELS[level], *measures())


def rows_of(result: DataFrame | Rollup) -> DataFrame:
    return result.result if isinstance(result, Rollup) else result


def _at(result: DataFrame | Rollup, level: str) -> DataFrame:
    if isinstance(result, Rollup):
        return result.at(level)
    return result.groupBy(*LEVELS[level]).agg(*[c.alias(name) for name, c in measures().items()])


def _mean(total: str, count: str) -> Column:
    return F.try_divide(F.col(total).cast("double"), F.col(count))


def kpis(result: DataFrame | Rollup) -> DataFrame:
    """Headline numbers in one row."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return _at(result, "all").select(
        F.col("_rows").alias("total_orders"),
        F.col("_anomalies").alias("total_anomalies"),
        round_even(share(F.col("_anomalies"), F.col("_rows")), 6).alias("anomaly_rate"),
        round_even(_mean("_delay_sum", "_delays"), 2).alias("avg_delay"),
        round_even(_mean("_plan_sum", "_plans"), 2).alias("avg_planned_transit"),
        round_even(F.col("_delay_max"), 2).alias("max_delay"),
        day("_from").alias("start_date"),
        day("_to").alias("end_date"),
    )


def severity_levels(result: DataFrame | Rollup) -> DataFrame:
    """One row with the orders of each severity."""
    return _at(result, "all").select(*[F.col(f"_{s}").alias(s) for s in S.SEVERITIES])


def severity_counts(result: DataFrame | Rollup) -> DataFrame:
    """Orders per severity over the whole fixed domain, zeros included."""
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("rank"), F.lit(s).alias("severity"), F.col(s).alias("orders"))
            for i, s in enumerate(S.SEVERITIES, 1)
        ]
    )
    return severity_levels(result).select(F.inline(pairs))


def severity_count(counts: DataFrame, level: str) -> int:
    """Count of one level, 0 for an unknown one."""
    row = counts.where(F.col("severity") == level).select("orders").first()
    return int(row["orders"]) if row else 0


def severity_share(result: DataFrame | Rollup) -> DataFrame:
    counts = severity_counts(result)
    total = F.greatest(F.sum("orders"), F.lit(1))
    # Four rows: the whole domain.
    whole = counts.groupBy().agg(total.alias("total"), F.collect_list(F.struct("rank", "severity", "orders")).alias("rows"))
    return whole.select("total", F.inline("rows")).select(
        "rank", "severity", "orders", share(F.col("orders"), F.col("total")).alias("share")
    )


def smoothed_rate(anomalies: Column, total: Column, global_rate: Column, prior_strength: int = PRIOR_STRENGTH) -> Column:
    """Rate shrunk towards the global one by ``prior_strength`` pseudo-orders."""
    k = F.lit(float(prior_strength))
    return round_even(F.try_divide(anomalies + global_rate * k, total + k), 4)


def with_smoothed_rate(
    grouped: DataFrame, total: str, anomalies: str, global_rate: Column,
    name: str = "smoothed_rate", prior_strength: int = PRIOR_STRENGTH,
) -> DataFrame:
    return grouped.withColumn(name, smoothed_rate(F.col(anomalies), F.col(total), global_rate, prior_strength))


def sample_note(total: Column) -> Column:
    return F.when(total < SMALL_SAMPLE, F.lit("small_sample")).otherwise(F.lit("enough_sample"))


def _global_rate(grouped: DataFrame, anomalies: str) -> Column:
    """Overall rate from the (materialised) rollup itself, so the facts are read once."""
    return grouped.agg(share(F.sum(anomalies), F.sum("_rows")).alias("rate")).scalar()


def _grouped(result: DataFrame | Rollup, level: str, columns: dict[str, Column]) -> DataFrame:
    """One level's table, materialised, since the overall rate is taken from it as well."""
    rows = _at(result, level).select(*LEVELS[level], *[c.alias(n) for n, c in columns.items()], "_rows")
    return rows if isinstance(result, Rollup) else measured(rows)


def carrier_stats(result: DataFrame | Rollup) -> DataFrame:
    grouped = _grouped(result, "carrier", {
        "total_orders": F.col("_ids"),
        "avg_delay": round_even(_mean("_delay_sum", "_delays"), 4),
        "late_rate": round_even(share(F.col("_late"), F.col("_rows")), 4),
        "anomaly_orders": F.col("_anomalies"),
        "critical_orders": F.col("_critical"),
    })
    rate = _global_rate(grouped, "anomaly_orders")
    return (
        with_smoothed_rate(
            grouped.withColumn("anomaly_rate", round_even(share(F.col("anomaly_orders"), F.col("total_orders")), 4)),
            "total_orders", "anomaly_orders", rate,
        )
        .withColumn("sample_note", sample_note(F.col("total_orders")))
        .drop("_rows")
    )


def carrier_rank() -> list[Column]:
    return [F.desc("smoothed_rate"), F.desc("total_orders"), F.asc("carrier")]


def route_stats(result: DataFrame | Rollup) -> DataFrame:
    grouped = _grouped(result, "route", {
        "orders": F.col("_ids"),
        "avg_delay": round_even(_mean("_delay_sum", "_delays"), 4),
        "max_delay": round_even(F.col("_delay_max"), 4),
        "anomalies": F.col("_anomalies"),
        "critical_orders": F.col("_critical"),
    })
    rate = _global_rate(grouped, "anomalies")
    return (
        with_smoothed_rate(
            grouped.withColumn("anomaly_rate", round_even(share(F.col("anomalies"), F.col("orders")), 4)),
            "orders", "anomalies", rate,
        )
        .withColumn("sample_note", sample_note(F.col("orders")))
        .drop("_rows")
    )


def route_rank() -> list[Column]:
    return [F.desc("smoothed_rate"), F.desc("orders"), F.desc("avg_delay"), F.asc("route")]


def ranked_carriers(result: DataFrame | Rollup, top: int | None = None) -> DataFrame:
    df = carrier_stats(result).orderBy(*carrier_rank())
    return df if top is None else df.limit(top)


def ranked_routes(result: DataFrame | Rollup, top: int | None = None) -> DataFrame:
    df = route_stats(result).orderBy(*route_rank())
    return df if top is None else df.limit(top)


def monthly_trend(result: DataFrame | Rollup) -> DataFrame:
    label = F.concat_ws("-", "ship_year", F.lpad(F.col("ship_month").cast("string"), 2, "0"))
    return _at(result, "month").select(
        "ship_year", "ship_month",
        F.col("_ids").alias("orders"),
        F.col("_anomalies").alias("anomalies"),
        round_even(_mean("_delay_sum", "_delays"), 2).alias("avg_delay"),
        round_even(share(F.col("_anomalies"), F.col("_ids")), 4).alias("anomaly_rate"),
        label.alias("month_label"),
    ).orderBy(F.asc_nulls_last("ship_year"), F.asc_nulls_last("ship_month"))


def method_hits(result: DataFrame | Rollup) -> DataFrame:
    """One row with the hits of each layer."""
    return _at(result, "all").select(*[F.col(f"_{c}").alias(c) for _, c in METHODS])


def method_counts(result: DataFrame | Rollup) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("hits")) for m, c in METHODS])
    return method_hits(result).select(F.inline(pairs))


def reason_counts(result: DataFrame | Rollup, top: int | None = TOP_REASONS) -> DataFrame:
    counted = (
        only_anomalies(rows_of(result))
        .select(F.explode("rule_codes").alias("rule"))
        .where(F.col("rule") != "")
        .groupBy("rule")
        .agg(F.count("*").alias("orders"))
        .orderBy(F.desc("orders"), F.asc("rule"))
    )
    return counted if top is None else counted.limit(top)


def top_anomalies(result: DataFrame | Rollup, top: int = TOP_ANOMALIES) -> DataFrame:
    """Worst anomalies by score, then delay, then id; planned as a per-task top-k."""
    return (
        only_anomalies(rows_of(result))
        .select(*S.TOP_COLUMNS)
        .orderBy(F.desc("anomaly_score"), F.desc("delay_days"), F.asc("order_id"))
        .limit(top)
    )
