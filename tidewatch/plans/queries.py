"""Registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.config import DetectorConfig
from tidewatch.functions import parsing as P
from tidewatch.functions import text as X
from tidewatch.functions.rounding import round_even
from tidewatch.operators import charts, dedup, drilldown, features, insight, legacy, report
from tidewatch.operators import iforest, rules, throughput, zscore
from tidewatch.operators import metrics as M
from tidewatch.operators import validate as V
from tidewatch.plans.detect import detect, run_layers
from tidewatch.sources import star_tables as T
from tidewatch.sources.csv_files import allow_charsets, read_csv, union_sources, write_csv
from tidewatch.sources.staging import drop_read_shuffles, find_staged, scratch, stage

Query = Callable[[SparkSession, str], DataFrame]

V1_SEA = "R"


# --- inputs -------------------------------------------------------------------------------------

def base(spark: SparkSession, d: str) -> DataFrame:
    """Preprocessed shipments over the staged table: a plain scan."""
    return features.preprocess(T.staged_shipments(spark, d))


def two_layer(spark: SparkSession, d: str) -> DataFrame:
    return run_layers(base(spark, d), DetectorConfig(), forest=False)


def staged_two_layer(spark: SparkSession, d: str) -> DataFrame:
    """The columns that reports read, for tables that combine several rollups of one result."""
    key = T.input_key(spark, d, T.SHIPMENT_TABLES)
    found = find_staged(spark, "two_layer", key)
    return found if found is not None else stage(
        two_layer(spark, d).select(*S.METRICS_REQUIRED), "two_layer", key
    )


def staged_raw(spark: SparkSession, d: str) -> DataFrame:
    """The raw rows, made from staged lines: what shuffles them next finds the disk free of the joins' shuffles."""
    return T.shipments_raw(spark, d, T.staged_lines(spark, d))


def checked(spark: SparkSession, d: str, counts: bool = True) -> DataFrame:
    return V.checked_orders(staged_raw(spark, d), T.RAW_ORDER, counts)


def staged_checked(spark: SparkSession, d: str) -> DataFrame:
    key = T.input_key(spark, d, T.SHIPMENT_TABLES)
    found = find_staged(spark, "checked", key)
    if found is None:
        found = stage(checked(spark, d), "checked", key)
        drop_read_shuffles(spark)
    return found


def throughput_raw(spark: SparkSession, d: str) -> DataFrame:
    """The throughput table as dirty text with repeated rows."""
    df = T.port_throughput(spark, d)
    year, month = F.col("year"), F.col("month")
    text = lambda c: c.cast("string")
    return df.select(
        F.when((month == 4) & (year % 3 == 0), F.lit("nan")).otherwise(F.concat(F.lit(" "), "port", F.lit(" "))).alias("port"),
        F.when((month == 5) & (year % 3 == 0), F.lit("unknown")).otherwise(text(year)).alias("year"),
        F.when((month == 1) & (year % 2 == 0), F.lit("13")).otherwise(text(month)).alias("month"),
        F.when((month == 2) & (year % 2 == 0), F.lit("-5"))
        .when((month == 6) & (year % 2 == 0), F.lit("inf"))
        .otherwise(text(F.col("cargo_10kt").cast("decimal(18,2)"))).alias("cargo_10kt"),
        F.when(month == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("cp"),
    ).withColumn("cp", F.explode("cp")).drop("cp")


# --- cells and rows -----------------------------------------------------------------------------

def text_normalise(spark, d):
    df = T.shipments_raw(spark, d)
    return df.select("src_ord", "cp", *[X.normalise_text(F.col(c)).alias(c) for c in S.TEXT_COLUMNS])


def date_parse(spark, d):
    return T.shipments_raw(spark, d).select(
        "src_ord", "cp", F.col("ship_ts").alias("ship_text"),
        *[P.parse_timestamp(F.col(c)).alias(c) for c in S.DATE_COLUMNS],
    )


def numeric_coerce(spark, d):
    return T.shipments_raw(spark, d).select(
        "src_ord", "cp", F.col("weight_t").alias("weight_text"),
        *[P.parse_number(F.col(c)).alias(c) for c in S.POSITIVE_COLUMNS],
    )


def derive_days(spark, d):
    ts = {c: P.parse_timestamp(F.col(c)) for c in S.DATE_COLUMNS}
    return T.shipments_raw(spark, d).select(
        "src_ord", "cp",
        P.days_between(ts["ship_ts"], ts["plan_arrival_ts"]).alias("planned_days"),
        P.days_between(ts["plan_arrival_ts"], ts["actual_arrival_ts"]).alias("delay_days"),
    )


def formula_escape(spark, d):
    return X.neutralise_frame(T.shipments_raw(spark, d).select("src_ord", "cp", "order_id", "weight_t", "carrier"))


def row_fingerprint(spark, d):
    return drilldown.row_fingerprint(T.shipments_raw(spark, d).drop("src_ord", "cp"))


def markdown_lines(spark, d):
    docs = T.table(spark, d, "documents")
    lines = docs.select("doc_id", F.posexplode(X.plain_lines(F.col("text"))).alias("i", "line"))
    return lines.select("doc_id", (F.col("i") + 1).alias("line_no"), "line")


# --- validation ---------------------------------------------------------------------------------

def dedup_exact(spark, d):
    return dedup.drop_exact(V.normalise_orders(T.shipments_raw(spark, d)), T.RAW_ORDER)


def dedup_key(spark, d):
    return V.dedup_orders(V.normalise_orders(staged_raw(spark, d)), T.RAW_ORDER, counts=False)


def row_issues(spark, d):
    return checked(spark, d, counts=False).select("src_ord", "cp", "order_id", *V.ISSUES, "corrected_plan", "corrected_delay")


def validate_orders(spark, d):
    return V.valid_orders(T.shipments_raw(spark, d), T.RAW_ORDER)


def quarantine(spark, d):
    return V.quarantine(checked(spark, d, counts=False)).select("src_ord", "cp", "order_id", F.array_join("issues", ",").alias("issues"))


def quality_summary(spark, d):
    return V.quality_summary(checked(spark, d))


def _quality(spark, d):
    rows = staged_checked(spark, d)
    return V.quality_summary(rows), V.extreme_counts(V.valid_rows(rows, T.RAW_ORDER))


def extreme_counts(spark, d):
    return _quality(spark, d)[1]


def quality_cards(spark, d):
    return V.quality_cards(*_quality(spark, d))


def quality_warnings(spark, d):
    ports = throughput.throughput_quality(throughput_raw(spark, d))
    return union_sources([V.quality_warnings(*_quality(spark, d)), throughput.throughput_warnings(ports)])


def union_of_sources(spark, d):
    # The first source is written before the second is shuffled.
    exact = stage(dedup.drop_exact(V.normalise_orders(staged_raw(spark, d)), T.RAW_ORDER), "exact")
    drop_read_shuffles(spark)
    return union_sources([exact, dedup_key(spark, d)])


# --- files --------------------------------------------------------------------------------------

def csv_round_trip(spark, d):
    """Shipments written as CSV files of three kinds beside two unusable ones, and read back together.

    The kinds differ in encoding, header language, column order and columns; one has lines with a field too many.
    """
    folder, day = scratch(spark, "csv"), F.col("planned_days").cast("int")
    note = (
        F.when(day % 5 == 0, "plain").when(day % 5 == 1, "=1+1").when(day % 5 == 2, 'say "hi", ok')
        .when(day % 5 == 3, "two\nlines")
    )
    rows = T.staged_shipments(spark, d).select(
        "order_id", "carrier", "mode", "origin", "dest", F.col("freight_usd").cast("decimal(18,2)").cast("string").alias("freight_usd"),
        note.alias("note"), day.alias("day"),
    )
    day = F.col("day")
    of = lambda k: rows.where(day % 3 == k)
    names = ["order_id", "carrier", "mode", "origin", "dest", "freight_usd"]
    write_csv(of(0).select(*names, "note"), f"{folder}/marked")
    chinese = {v: k for k, v in S.HEADER_ALIASES.items()}
    allow_charsets(spark)
    turned = of(1).select("note", *[F.col(c).alias(chinese[c]) for c in reversed(names)])
    turned.write.option("header", True).option("encoding", "GB18030").option("escape", '"').csv(f"{folder}/turned")
    order = ["freight_usd", "order_id", "dest", "origin", "mode", "carrier"]
    line = F.concat(F.concat_ws(",", *order), F.when(day % 7 == 0, ",surplus").otherwise(""))
    # one column whose name is the whole header; a tab is in none of its lines
    of(2).select(line.alias(",".join(order))).write.option("header", True).option("sep", "\t").csv(f"{folder}/lines")
    ports = T.table(spark, d, "nation").coalesce(1)
    ports.select(F.concat("n_name", F.char(F.lit(0)))).write.text(f"{folder}/binary")
    ports.select(F.lit("")).write.text(f"{folder}/empty")
    kinds = ["marked", "turned", "lines", "binary", "empty"]
    data = read_csv(spark, [f"{folder}/{k}" for k in kinds], unusable="quarantine")
    good = data.rows.select(F.lit("row").alias("kind"), *names, "note", F.lit(None).cast("string").alias("line"))
    kind = F.when(F.col("line").isNull(), "file").otherwise("line")
    left = data.quarantine.select(kind.alias("kind"), F.coalesce("line", "reason").alias("line"))
    return good.unionByName(left, allowMissingColumns=True)


# --- throughput ---------------------------------------------------------------------------------

def throughput_clean(spark, d):
    return throughput.clean_throughput(throughput_raw(spark, d))


def throughput_quality(spark, d):
    return throughput.throughput_quality(throughput_raw(spark, d))


def port_seasonality(spark, d):
    s = throughput.port_seasonality(T.port_throughput(spark, d))
    return s.withColumns({c: round_even(c, 6) for c in ("mean_cargo", "relative")})


def port_annual_fixed(spark, d):
    ports = [f"NATION_{i}" for i in range(1, 6)]
    return throughput.port_annual(T.port_throughput(spark, d), ports=ports)


# --- layers and verdict -------------------------------------------------------------------------

def preprocess(spark, d):
    return features.preprocess(T.shipments(spark, d)).select(
        "order_id", "deviation_ratio", "ship_month", "ship_year", "route", "unit_freight"
    )


def feature_scaling(spark, d):
    scaled = features.scale_features(base(spark, d))
    return scaled.select("order_id", *[round_even(c, 6).alias(c) for c in scaled.columns if c != "order_id"])


def layer_join(spark, d):
    b = base(spark, d)
    return dedup.one_to_one_join(rules.rule_layer(b).drop("rule_codes"), zscore.zscore_layer(b), "order_id")


def two_layer_detection(spark, d):
    extra = [
        "deviation_ratio", "ship_month", "ship_year", "unit_freight", "critical_rule", "rule_reason",
        "z_score", "zscore_skipped", "iforest_score", "iforest_skipped", "anomaly_votes",
    ]
    return two_layer(spark, d).select(*S.EXPORT_COLUMNS, *extra)


def full_detection(spark, d):
    extra = ["z_score", "iforest_score", "anomaly_votes"]
    result = detect(T.staged_shipments(spark, d), staged=True, unique=False)
    return result.select(*S.EXPORT_COLUMNS, *extra)


def _verdicts(result: DataFrame) -> DataFrame:
    return result.select("order_id", "z_score", "zscore_skipped", "rule_reason", "anomaly_votes", "anomaly_score", "severity", "reason")


def small_groups(spark, d):
    """Routes of fewer than 20 orders are not judged by their z-score."""
    return _verdicts(run_layers(base(spark, d), DetectorConfig(min_group_size=20), forest=False))


def early_arrivals(spark, d):
    """Every order three days earlier, so that most arrive before their plan."""
    orders = T.staged_shipments(spark, d).withColumn("delay_days", F.col("delay_days") - 3.0)
    return _verdicts(run_layers(features.preprocess(orders), DetectorConfig(), forest=False))


def fine_carriers(result: DataFrame) -> DataFrame:
    """Carrier statistics by carrier and route: mostly groups too small to judge."""
    return M.carrier_stats(result.withColumn("carrier", F.concat_ws("/", "carrier", "route")))


# --- first-generation variants ------------------------------------------------------------------

def v1(spark, d):
    return legacy.detect_v1(T.staged_shipments(spark, d), forest=False, sea_mode=V1_SEA)


def _of(f, source=two_layer, *columns):
    """A query that applies an operator to a shared input."""
    def query(spark: SparkSession, d: str) -> DataFrame:
        out = f(source(spark, d))
        return out.select(*columns) if columns else out
    return query


def _smoothed_modes(result: DataFrame) -> DataFrame:
    g = result.groupBy("mode").agg(
        F.count("*").alias("orders"), F.sum("final_anomaly").cast("bigint").alias("anomalies")
    )
    rate = g.agg(M.share(F.sum("anomalies"), F.sum("orders")).alias("r")).scalar()
    return M.with_smoothed_rate(g, "orders", "anomalies", rate, prior_strength=25)


def _worst_order(result: DataFrame) -> DataFrame:
    worst = M.top_anomalies(result, 1).select("order_id").scalar()
    return drilldown.explain_order(result, worst)


def _worst_carrier(result: DataFrame) -> DataFrame:
    stats = M.carrier_stats(result)
    worst = stats.orderBy(*M.carrier_rank()).limit(1).select("carrier").scalar()
    return drilldown.explain_carrier(stats, worst)


def queries() -> dict[str, Query]:
    carriers, routes = M.carrier_stats, M.route_stats
    q: dict[str, Query] = {
        "shipments": T.shipments,
        "text_normalise": text_normalise,
        "date_parse": date_parse,
        "numeric_coerce": numeric_coerce,
        "derive_days": derive_days,
        "formula_escape": formula_escape,
        "row_fingerprint": row_fingerprint,
        "markdown_lines": markdown_lines,
        "dedup_exact": dedup_exact,
        "dedup_key": dedup_key,
        "row_issues": row_issues,
        "validate_orders": validate_orders,
        "quarantine": quarantine,
        "quality_summary": quality_summary,
        "extreme_counts": extreme_counts,
        "quality_cards": quality_cards,
        "quality_warnings": quality_warnings,
        "union_sources": union_of_sources,
        "csv_round_trip": csv_round_trip,
        "throughput_clean": throughput_clean,
        "throughput_quality": throughput_quality,
        "top_ports": _of(throughput.top_ports, T.port_throughput),
        "port_annual": _of(throughput.port_annual, T.port_throughput),
        "port_annual_fixed": port_annual_fixed,
        "port_seasonality": port_seasonality,
        "preprocess": preprocess,
        "feature_scales": _of(features.feature_scales, base),
        "feature_scaling": feature_scaling,
        "rule_layer": _of(rules.rule_layer, base, "order_id", "rule_anomaly", "critical_rule", "rule_reason"),
        "zscore_layer": _of(zscore.zscore_layer, base),
        "iforest_scores": _of(iforest.forest_layer, base),
        "layer_join": layer_join,
        "ensemble": _of(lambda r: r, two_layer, "order_id", "anomaly_votes", "final_anomaly", "anomaly_score", "anomaly_methods"),
        "severity": _of(lambda r: r, two_layer, "order_id", "severity"),
        "explain": _of(lambda r: r, two_layer, "order_id", "reason"),
        "small_groups": small_groups,
        "early_arrivals": early_arrivals,
        "fine_carriers": _of(fine_carriers),
        "two_layer_detection": two_layer_detection,
        "full_detection": full_detection,
        "kpis": _of(M.kpis),
        "severity_counts": _of(M.severity_counts),
        "severity_share": _of(M.severity_share),
        "carrier_stats": _of(M.ranked_carriers),
        "route_stats": _of(M.ranked_routes),
        "smoothed_rate": _of(_smoothed_modes),
        "monthly_trend": _of(M.monthly_trend),
        "method_counts": _of(M.method_counts),
        "reason_counts": _of(M.reason_counts),
        "top_anomalies": _of(M.top_anomalies),
        "carrier_display": _of(lambda r: report.display_rates(carriers(r), ["late_rate", "anomaly_rate", "smoothed_rate"])),
        "route_display": _of(lambda r: report.display_rates(routes(r), ["anomaly_rate", "smoothed_rate"])),
        "carrier_top3": _of(report.carrier_cards),
        "route_top3": _of(report.route_cards),
        "delay_histogram": _of(charts.delay_histogram),
        "delay_box": _of(charts.delay_box),
        "carrier_chart": _of(lambda r: charts.carrier_chart(carriers(r))),
        "anomaly_detail": _of(drilldown.anomaly_detail),
        "filtered_anomalies": _of(
            lambda r: drilldown.filter_anomalies(
                r, ["critical", "moderate"], [],
                ["NATION_1→NATION_2", "NATION_7→NATION_19", "NATION_19→NATION_12"],
            ),
            two_layer, *S.EXPORT_COLUMNS,
        ),
        "order_explain": _of(_worst_order),
        "carrier_explain": _of(_worst_carrier),
        "category_options": _of(lambda r: drilldown.category_options(M.only_anomalies(r), "route")),
        "distinct_modes": _of(lambda s: drilldown.distinct_values(s, "mode"), T.shipments),
        "present_severities": _of(drilldown.present_severities),
        "export_anomalies": _of(lambda r: X.neutralise_frame(drilldown.export_view(r, True))),
        "export_all": _of(lambda r: X.neutralise_frame(drilldown.export_view(r, False))),
        "risk_band": _of(lambda r: insight.risk_bands(carriers(r), "carrier")),
        "summary_row": _of(insight.summary_row, staged_two_layer),
        "carrier_insight": _of(lambda r: insight.carrier_insight(carriers(r))),
        "insight_lines": _of(insight.insight_lines, staged_two_layer),
        "carrier_prompts": _of(lambda r: insight.carrier_prompts(carriers(r))),
        "analysis_prompt": _of(insight.analysis_prompt, staged_two_layer),
        "kpi_cards": _of(report.kpi_cards, staged_two_layer),
        "report_carriers": _of(report.report_carriers),
        "report_routes": _of(report.report_routes),
        "report_cells": _of(report.report_cells),
        "report_cases": _of(report.report_cases),
        "report_overview": _of(report.report_overview, staged_two_layer),
        "recommendations": _of(report.recommendations, staged_two_layer),
        "v1_rules": _of(lambda r: r, v1, "order_id", "rule_anomaly", "rule_reason"),
        "v1_zscore": _of(lambda r: r, v1, "order_id", "zscore_anomaly", "z_score"),
        "v1_iforest": _of(lambda s: legacy.with_forest_v1(legacy.preprocess_v1(s)), T.staged_shipments,
                          "order_id", "iforest_anomaly", "iforest_score"),
        "v1_ensemble": _of(lambda r: r, v1, "order_id", "anomaly_votes", "final_anomaly", "severity"),
        "v1_kpis": _of(legacy.kpis_v1, v1),
        "v1_carrier_stats": _of(legacy.carrier_stats_v1, v1),
        "v1_route_stats": _of(legacy.route_stats_v1, v1),
        "v1_monthly": _of(legacy.monthly_v1, v1),
        "v1_severity_counts": _of(legacy.severity_counts_v1, v1),
        "v1_top": _of(legacy.top_v1, v1),
        "v1_best_worst": _of(lambda r: legacy.best_worst_v1(legacy.carrier_stats_v1(r)), v1),
        "v1_report": _of(lambda r: legacy.report_carriers_v1(legacy.carrier_stats_v1(r)), v1),
        "v1_report_routes": _of(lambda r: legacy.report_routes_v1(legacy.route_stats_v1(r)), v1),
        "v1_prompt_lines": _of(
            lambda r: legacy.prompt_lines_v1(legacy.carrier_stats_v1(r), legacy.route_stats_v1(r)), v1
        ),
    }
    return q
