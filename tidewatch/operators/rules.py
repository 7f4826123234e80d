"""Business-rule layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.quantiles import grouped_quantiles
from tidewatch.sources.staging import measured

# Rule limits.
MAX_DEVIATION = 0.5
MAX_DELAY = 7
CRITICAL_DELAY = 14
FLOOR_QUANTILE = 0.01
FLOOR_MIN_ROWS = 20

RULE_CODES = [
    "delay_over_half_plan", "delay_over_7d", "delay_over_14d", "low_unit_freight",
]
# Display texts of the rule codes.
RULE_LABELS = {
    "delay_over_half_plan": "实际延误超过计划运输时长的 50%",
    "delay_over_7d": "实际延误超过 7 天",
    "delay_over_14d": "实际延误超过 14 天，触发关键业务规则",
    "low_unit_freight": "单位运费低于同运输方式的第 1 百分位，需复核数据或报价",
}


def mode_floors(base: DataFrame, **quantile_options) -> DataFrame:
    """Rows and unit-freight floor of each transport mode."""
    q = grouped_quantiles(base, ["mode"], "unit_freight", [FLOOR_QUANTILE], **quantile_options)
    return q.select(F.col("mode").alias("_mode"), F.col("n").alias("_mode_rows"), F.col("q0").alias("_floor"))


def rule_columns() -> dict[str, Column]:
    """Rule outcome of a row that carries its mode's size and floor."""
    delay = F.col("delay_days")
    low = (F.col("_mode_rows") >= FLOOR_MIN_ROWS) & (F.col("unit_freight") < F.col("_floor"))
    hits = {
        "delay_over_half_plan": F.col("deviation_ratio") > MAX_DEVIATION,
        "delay_over_7d": delay > MAX_DELAY,
        "delay_over_14d": delay > CRITICAL_DELAY,
        # A row without mode has no floor and is never flagged by it.
        "low_unit_freight": F.coalesce(low, F.lit(False)),
    }
    codes = F.array_compact(F.array(*[F.when(hits[c], F.lit(c)) for c in RULE_CODES]))
    flagged = hits["delay_over_half_plan"] | hits["delay_over_7d"] | hits["low_unit_freight"]
    return {
        "rule_anomaly": flagged.cast("int"),
        "critical_rule": hits["delay_over_14d"],
        "rule_codes": codes,
        "rule_reason": F.array_join(codes, "; "),
    }


def with_rules(base: DataFrame, floors: DataFrame | None = None) -> DataFrame:
    """Add the rule columns. ``floors`` is joined by its measured size (one row per mode)."""
    floors = measured(mode_floors(base)) if floors is None else floors
    joined = base.join(floors, F.col("mode") == F.col("_mode"), "left")
    return joined.withColumns(rule_columns()).drop("_mode", "_mode_rows", "_floor")


def rule_layer(base: DataFrame) -> DataFrame:
    return with_rules(base).select(
        "order_id", "rule_anomaly", "critical_rule", "rule_codes", "rule_reason"
    )
