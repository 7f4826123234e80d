"""Column names, fixed domains and header handling for the order and throughput tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from tidewatch.errors import DataValidationError

TEXT_COLUMNS = ["order_id", "carrier", "mode", "origin", "dest"]
DATE_COLUMNS = ["ship_ts", "plan_arrival_ts", "actual_arrival_ts"]
POSITIVE_COLUMNS = ["weight_t", "freight_usd"]
ORDER_REQUIRED = TEXT_COLUMNS + DATE_COLUMNS + POSITIVE_COLUMNS

THROUGHPUT_REQUIRED = ["port", "year", "month", "cargo_10kt"]

DETECTOR_REQUIRED = [
    "order_id", "carrier", "mode", "origin", "dest", "ship_ts",
    "planned_days", "delay_days", "weight_t", "freight_usd",
]
DETECTOR_NUMERIC = ["delay_days", "planned_days", "weight_t", "freight_usd"]
MODEL_FEATURES = ["delay_days", "deviation_ratio", "weight_t", "freight_usd", "planned_days"]

METRICS_REQUIRED = [
    "order_id", "carrier", "route", "mode", "ship_ts", "ship_year", "ship_month",
    "delay_days", "planned_days", "final_anomaly", "severity", "rule_anomaly",
    "zscore_anomaly", "iforest_anomaly", "rule_codes", "anomaly_methods",
    "anomaly_score", "reason",
]

DETAIL_COLUMNS = [
    "order_id", "carrier", "route", "severity", "anomaly_methods", "reason",
    "anomaly_score", "mode", "delay_days",
]
EXPORT_COLUMNS = [
    "order_id", "carrier", "route", "mode", "ship_ts", "plan_arrival_ts",
    "actual_arrival_ts", "planned_days", "delay_days", "rule_anomaly",
    "zscore_anomaly", "iforest_anomaly", "anomaly_methods", "anomaly_score",
    "severity", "final_anomaly", "reason",
]
TOP_COLUMNS = [
    "order_id", "carrier", "route", "mode", "delay_days", "anomaly_methods",
    "anomaly_score", "severity", "reason",
]

SEVERITIES = ["critical", "moderate", "minor", "normal"]
DEFAULT_CARGO = "unspecified"

# Headers that order and throughput files carry, and the column each one fills.
HEADER_ALIASES = {
    "订单ID": "order_id",
    "承运商": "carrier",
    "货物类型": "cargo_type",
    "运输方式": "mode",
    "起运港": "origin",
    "目的港": "dest",
    "计划发货日期": "ship_ts",
    "计划到达日期": "plan_arrival_ts",
    "实际到达日期": "actual_arrival_ts",
    "计划运输天数": "planned_days",
    "实际延误天数": "delay_days",
    "货重_吨": "weight_t",
    "运费_USD": "freight_usd",
    "标注异常": "label_anomaly",
    "港口": "port",
    "年份": "year",
    "月份": "month",
    "货物吞吐量_万吨": "cargo_10kt",
    "集装箱吞吐量_万TEU": "container_10kteu",
}

# Display labels of the codes, for users whose files carry the headers above.
CODE_LABELS = {
    "critical": "严重",
    "moderate": "中等",
    "minor": "轻微",
    "normal": "正常",
    "rules": "业务规则",
    "route_zscore": "分组 Z-Score",
    "iforest": "Isolation Forest",
    "none": "无",
    "small_sample": "样本较少",
    "enough_sample": "样本充足",
    "high": "较高",
    "watch": "需要关注",
    "low": "相对较低",
}


def clean_header(name: str) -> str:
    """Drop byte-order marks and outer blanks, then map a known header to its column."""
    bare = str(name).replace("\ufeff", "").strip()
    return HEADER_ALIASES.get(bare, bare)


def canonical_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_header(c) for c in df.columns])


def require_columns(df: DataFrame, required: Iterable[str], what: str, ordered: bool = True) -> None:
    """Raise an error that names every missing column (declared order, or sorted)."""
    present = set(df.columns)
    missing = [c for c in required if c not in present]
    if missing:
        names = ", ".join(missing if ordered else sorted(missing))
        raise DataValidationError(f"{what} lacks the columns: {names}")


def require_rows(df: DataFrame, what: str) -> None:
    if df.isEmpty():
        raise DataValidationError(f"{what} has no rows")
