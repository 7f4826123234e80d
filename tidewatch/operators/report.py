"""Report tables: the content of each report section as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.config import DetectorConfig
from tidewatch.functions.render import cell, cell_text, fixed, grouped, percent
from tidewatch.operators import metrics as M
from tidewatch.operators.insight import _first


def kpi_cards(result: DataFrame) -> DataFrame:
    """Five labelled headline values as text."""
    levels = _first(M.severity_levels(result))
    cards = [
        ("total_orders", grouped(F.col("total_orders"))),
        ("anomalies", grouped(F.col("total_anomalies"))),
        ("anomaly_rate", percent(F.col("anomaly_rate"))),
        ("average_delay", F.concat(fixed(F.col("avg_delay"), 1), F.lit(" days"))),
        ("critical", grouped(levels.getField("critical"))),
    ]
    rows = F.array(
        *[F.struct(F.lit(i).alias("position"), F.lit(n).alias("card"), v.alias("value")) for i, (n, v) in enumerate(cards, 1)]
    )
    return M.kpis(result).select(F.inline(rows))


def display_rates(rollup: DataFrame, rates: list[str]) -> DataFrame:
    """Rates as percentages."""
    return rollup.withColumns({c: F.col(c) * 100.0 for c in rates})


def _ranked(df: DataFrame, rank: list[Column]) -> DataFrame:
    """Position in an already limited frame."""
    return df.withColumn("position", F.row_number().over(W.orderBy(*rank)))


def risk_cards(ranked: DataFrame, rank: list[Column], entity: str, total: str, anomalies: str, top: int = 3) -> DataFrame:
    return _ranked(ranked.limit(top), rank).select(
        "position",
        F.col(entity).alias("entity"),
        percent(F.col("smoothed_rate")).alias("adjusted_rate"),
        F.col(total).alias("orders"),
        F.col(anomalies).alias("anomalies"),
    )


def carrier_cards(result: DataFrame) -> DataFrame:
    return risk_cards(M.ranked_carriers(result), M.carrier_rank(), "carrier", "total_orders", "anomaly_orders")


def route_cards(result: DataFrame) -> DataFrame:
    return risk_cards(M.ranked_routes(result), M.route_rank(), "route", "orders", "anomalies")


def report_carriers(result: DataFrame, top: int = 10) -> DataFrame:
    return _ranked(M.ranked_carriers(result, top), M.carrier_rank()).select(
        "position", "carrier", "total_orders", "anomaly_orders", "anomaly_rate", "avg_delay", "sample_note"
    )


def report_routes(result: DataFrame, top: int = 10) -> DataFrame:
    return _ranked(M.ranked_routes(result, top), M.route_rank()).select(
        "position", "route", "orders", "anomalies", "anomaly_rate", "avg_delay", "sample_note"
    )


def report_cells(result: DataFrame, top: int = 10) -> DataFrame:
    """The carrier table of the report with every cell as text."""
    t = report_carriers(result, top)
    rate = F.coalesce(percent(F.col("anomaly_rate")), F.lit("—"))
    return t.select(
        "position",
        cell_text(F.col("carrier")).alias("carrier"),
        cell_text(F.col("total_orders")).alias("total_orders"),
        cell_text(F.col("anomaly_orders")).alias("anomaly_orders"),
        rate.alias("anomaly_rate"),
        cell(F.col("avg_delay")).alias("avg_delay"),
        cell_text(F.col("sample_note")).alias("sample_note"),
    )


def report_cases(result: DataFrame) -> DataFrame:
    """Heading and body of each leading case."""
    order = [F.desc("anomaly_score"), F.desc("delay_days"), F.asc("order_id")]
    return _ranked(M.top_anomalies(result), order).select(
        "position",
        F.concat_ws(" | ", "order_id", "severity", F.concat(F.lit("risk score "), fixed(F.col("anomaly_score"), 1))).alias("heading"),
        F.concat(
            F.lit("carrier: "), F.col("carrier"), F.lit("; route: "), F.col("route"), F.lit("; methods: "),
            F.col("anomaly_methods"), F.lit("; delay: "), fixed(F.col("delay_days"), 1), F.lit(" days"),
        ).alias("facts"),
        F.concat(F.lit("reason: "), F.col("reason")).alias("why"),
    )


def report_overview(result: DataFrame, config: DetectorConfig | None = None, quality: DataFrame | None = None) -> DataFrame:
    """Summary, data, quality and method sentences of the report, in order."""
    config = config or DetectorConfig()
    levels = _first(M.severity_levels(result))
    hits = _first(M.method_hits(result))
    counted = lambda c: hits.getField(c).cast("string")
    sections = [
        ("summary", F.concat(
            F.lit("Covers "), grouped(F.col("total_orders")), F.lit(" orders with "), grouped(F.col("total_anomalies")),
            F.lit(" anomalies ("), percent(F.col("anomaly_rate")), F.lit("), "),
            levels.getField("critical").cast("string"), F.lit(" of them critical."))),
        ("data", F.concat(
            F.lit("From "), F.coalesce("start_date", F.lit("unknown")), F.lit(" to "), F.coalesce("end_date", F.lit("unknown")),
            F.lit("; average planned transit "), fixed(F.col("avg_planned_transit"), 1), F.lit(" days; average delay "),
            fixed(F.col("avg_delay"), 1), F.lit(" days; longest delay "), fixed(F.col("max_delay"), 1), F.lit(" days."))),
        ("hits", F.concat(
            F.lit("Rules hit "), counted("rule_anomaly"), F.lit(" orders, route z-score "), counted("zscore_anomaly"),
            F.lit(", isolation forest "), counted("iforest_anomaly"),
            F.lit(". Rules stand alone; otherwise two methods must agree."))),
        ("method", F.lit(
            f"z-score threshold {config.zscore_threshold}, contamination {config.iforest_contamination}; "
            "small routes are not judged; severity follows verdict, votes and the critical rule.")),
    ]
    if quality is not None:
        q = _first(quality.select("raw_rows", "valid_rows", "dropped_rows"))
        sections.insert(2, ("quality", F.concat(
            F.lit("Received "), q.getField("raw_rows").cast("string"), F.lit(" rows, usable "),
            q.getField("valid_rows").cast("string"), F.lit(", dropped "), q.getField("dropped_rows").cast("string"), F.lit("."))))
    rows = F.array(
        *[F.struct(F.lit(i).alias("position"), F.lit(n).alias("section"), v.alias("text")) for i, (n, v) in enumerate(sections, 1)]
    )
    return M.kpis(result).select(F.inline(rows))


def recommendations(result: DataFrame) -> DataFrame:
    """The recommendations that apply, numbered."""
    levels = M.severity_levels(result)
    carrier, route = _first(M.ranked_carriers(result, 1)), _first(M.ranked_routes(result, 1))
    c = carrier.getField
    small = F.when(c("sample_note") == "small_sample", F.lit(" (small sample, observe first)")).otherwise(F.lit(""))
    texts = [
        F.when(F.col("critical") > 0, F.concat(
            F.lit("Review "), F.col("critical").cast("string"), F.lit(" critical anomalies first and record their causes."))),
        F.concat(
            F.lit("For "), c("carrier"), F.lit(" review together orders "), c("total_orders").cast("string"),
            F.lit(", anomalies "), c("anomaly_orders").cast("string"), F.lit(" and anomaly rate "),
            percent(c("anomaly_rate")), small, F.lit(".")),
        F.concat(
            F.lit("Check planned transit and handovers of route "), route.getField("route"),
            F.lit(" and follow its adjusted rank by month.")),
        F.lit("Feed reviewed causes back into operations and recalibrate the thresholds regularly."),
    ]
    return levels.select(F.posexplode(F.array_compact(F.array(*texts))).alias("i", "recommendation")).select(
        (F.col("i") + 1).alias("position"), "recommendation"
    )
