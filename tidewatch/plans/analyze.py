"""The whole analysis: read, validate, detect, and every report table over one staged result."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tidewatch.config import DetectorConfig
from tidewatch.errors import DataValidationError
from tidewatch.operators import charts, drilldown, insight, report, throughput
from tidewatch.operators import metrics as M
from tidewatch.operators.validate import ValidationResult, validate_orders
from tidewatch.plans.detect import detect
from tidewatch.sources.csv_files import POSITION, read_csv, union_sources
from tidewatch.sources.staging import stage


@dataclass
class Analysis:
    """The detection result, the tables derived from it, and the settings behind them."""

    result: DataFrame
    tables: dict[str, DataFrame]
    config: dict
    validation: ValidationResult | None = None
    extras: dict[str, DataFrame] = field(default_factory=dict)


def summary_tables(result: DataFrame | M.Rollup) -> dict[str, DataFrame]:
    """KPI and rollup tables of a detection result."""
    M.check_result(M.rows_of(result))
    return {
        "kpis": M.kpis(result),
        "severity_counts": M.severity_counts(result),
        "carrier_stats": M.ranked_carriers(result),
        "route_stats": M.ranked_routes(result),
        "monthly_trend": M.monthly_trend(result),
        "method_counts": M.method_counts(result),
        "reason_counts": M.reason_counts(result),
        "top_anomalies": M.top_anomalies(result),
    }


def chart_tables(result: DataFrame | M.Rollup, ports: DataFrame | None = None) -> dict[str, DataFrame]:
    """The numbers behind each chart; port charts only with a throughput table."""
    tables = {
        "severity_share": M.severity_share(result),
        "carrier_chart": charts.carrier_chart(M.carrier_stats(result)),
        "delay_histogram": charts.delay_histogram(M.rows_of(result)),
        "delay_box": charts.delay_box(M.rows_of(result)),
    }
    if ports is not None:
        tables["port_annual"] = throughput.port_annual(ports)
        tables["port_seasonality"] = throughput.port_seasonality(ports)
    return tables


def report_tables(result: DataFrame | M.Rollup, config: DetectorConfig, quality: DataFrame | None = None) -> dict[str, DataFrame]:
    return {
        "summary": insight.summary_row(result),
        "kpi_cards": report.kpi_cards(result),
        "overview": report.report_overview(result, config, quality),
        "report_carriers": report.report_carriers(result),
        "report_routes": report.report_routes(result),
        "report_cases": report.report_cases(result),
        "recommendations": report.recommendations(result),
    }


def analyze(
    orders: DataFrame,
    config: DetectorConfig | None = None,
    ports: DataFrame | None = None,
    *,
    unique: bool = True,
    quality: DataFrame | None = None,
) -> Analysis:
    """Detect on a validated table and derive every table.

    The result is staged once, so the forest scores each row once for all tables, and rolled up once: totals, carriers, routes and
    months come from one scan, whatever number of reports shows them. A throughput table only adds port charts; detection does not
    look at it.
    """
    config = config or DetectorConfig()
    result = stage(detect(orders, config, unique=unique), "result")
    rollup = M.Rollup(result)
    tables = {
        **summary_tables(rollup),
        **chart_tables(rollup, ports),
        **report_tables(rollup, config, quality),
        "anomalies": drilldown.export_view(result, True),
        "all_orders": drilldown.export_view(result, False),
    }
    return Analysis(result, tables, asdict(config))


def analyze_files(
    spark: SparkSession,
    orders: str | list[str],
    ports: str | list[str] | None = None,
    config: DetectorConfig | None = None,
) -> Analysis:
    """From CSV files to the full analysis."""
    validation = validate_orders(read_csv(spark, orders, "the order table").rows, POSITION)
    port_rows, warnings = None, validation.warnings
    if ports is not None:
        raw = read_csv(spark, ports, "the throughput table").rows.drop(*POSITION)
        port_rows = throughput.clean_throughput(raw)
        if port_rows.isEmpty():
            raise DataValidationError("the throughput table has no valid rows")
        warnings = union_sources(
            [warnings, throughput.throughput_warnings(throughput.throughput_quality(raw, port_rows))]
        )
    # Validation has already made the ids unique.
    out = analyze(validation.data, config, port_rows, unique=False, quality=validation.quality)
    out.validation = validation
    out.extras = {"warnings": warnings, "quarantine": validation.quarantine}
    return out
