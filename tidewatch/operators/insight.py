"""Insight tables: facts of the rollups as rows and sentences. No external service is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.render import fixed, grouped, percent
from tidewatch.operators import metrics as M

HIGH_RATE = 0.15
WATCH_RATE = 0.05


def risk_band(rate: Column) -> Column:
    return F.when(rate >= HIGH_RATE, F.lit("high")).when(rate >= WATCH_RATE, F.lit("watch")).otherwise(F.lit("low"))


def risk_bands(rollup: DataFrame, key: str) -> DataFrame:
    return rollup.select(key, "anomaly_rate", risk_band(F.col("anomaly_rate")).alias("risk"))


def _small(note: Column, text: str) -> Column:
    return F.when(note == "small_sample", F.lit(text)).otherwise(F.lit(""))


def carrier_fact() -> Column:
    return F.concat(
        F.lit("- "), F.coalesce("carrier", F.lit("unknown")),
        F.lit(": orders "), F.col("total_orders").cast("string"),
        F.lit(", anomalies "), F.col("anomaly_orders").cast("string"),
        F.lit(", anomaly rate "), percent(F.col("anomaly_rate")),
        F.lit(", average delay "), fixed(F.col("avg_delay"), 1),
        F.lit(" days, sample "), F.col("sample_note"),
    )


def route_fact() -> Column:
    return F.concat(
        F.lit("- "), F.col("route"),
        F.lit(": orders "), F.col("orders").cast("string"),
        F.lit(", anomalies "), F.col("anomalies").cast("string"),
        F.lit(", anomaly rate "), percent(F.col("anomaly_rate")),
        F.lit(", longest delay "), fixed(F.col("max_delay"), 1),
        F.lit(" days, sample "), F.col("sample_note"),
    )


def insight_lines(result: DataFrame, top: int = 5) -> DataFrame:
    """Fact lines of the riskiest carriers and routes."""
    from pyspark.sql import Window as W

    def lines(df: DataFrame, kind: str, rank: list[Column], fact: Column) -> DataFrame:
        # Numbered after the limit: ``top`` rows.
        return df.select(F.lit(kind).alias("kind"), F.row_number().over(W.orderBy(*rank)).alias("position"), fact.alias("line"))

    return lines(M.ranked_carriers(result, top), "carrier", M.carrier_rank(), carrier_fact()).unionByName(
        lines(M.ranked_routes(result, top), "route", M.route_rank(), route_fact())
    )


def _first(df: DataFrame) -> Column:
    """The single row of ``df`` as a scalar struct."""
    return df.select(F.struct(*df.columns).alias("row")).scalar()


def _joined(lines: DataFrame, order: list[str], line: Column, sep: str = "\n") -> Column:
    """A bounded frame folded into one text, in order."""
    rows = lines.select(F.struct(*order, line.alias("_line")).alias("r"))
    texts = F.transform(F.array_sort(F.collect_list("r")), lambda r: r.getField("_line"))
    return rows.agg(F.array_join(texts, sep).alias("t")).scalar()


def summary_row(result: DataFrame) -> DataFrame:
    """The overall summary as fields of one row, with the summary text."""
    severity = M.severity_levels(result)
    carrier = _first(M.ranked_carriers(result, 1))
    route = _first(M.ranked_routes(result, 1))
    reasons = M.reason_counts(result, 3).select(
        (-F.col("orders")).alias("o"), "rule",
        F.concat(F.col("rule"), F.lit(" ("), F.col("orders").cast("string"), F.lit(")")).alias("text"),
    )
    levels = _first(severity)
    rate = F.col("anomaly_rate")
    facts = M.kpis(result).select(
        "total_orders", "total_anomalies", "anomaly_rate",
        risk_band(rate).alias("risk"),
        levels.getField("critical").alias("critical_orders"),
        levels.getField("moderate").alias("moderate_orders"),
        carrier.getField("carrier").alias("top_carrier"),
        carrier.getField("total_orders").alias("top_carrier_orders"),
        carrier.getField("anomaly_orders").alias("top_carrier_anomalies"),
        carrier.getField("anomaly_rate").alias("top_carrier_rate"),
        carrier.getField("sample_note").alias("top_carrier_sample"),
        route.getField("route").alias("top_route"),
        route.getField("orders").alias("top_route_orders"),
        route.getField("anomaly_rate").alias("top_route_rate"),
        route.getField("sample_note").alias("top_route_sample"),
        F.coalesce(F.nullif(_joined(reasons, ["o", "rule"], F.col("text"), ", "), F.lit("")), F.lit("none")).alias("top_reasons"),
    )
    text = F.concat(
        F.lit("Analysed "), grouped(F.col("total_orders")), F.lit(" orders, found "),
        grouped(F.col("total_anomalies")), F.lit(" anomalies ("), percent(rate), F.lit("), risk level "),
        F.col("risk"), F.lit("; critical "), F.col("critical_orders").cast("string"),
        F.lit(", moderate "), F.col("moderate_orders").cast("string"),
        F.lit(". Leading carrier after sample adjustment: "), F.coalesce("top_carrier", F.lit("unknown")),
        F.lit(" ("), F.col("top_carrier_orders").cast("string"), F.lit(" orders, "),
        F.col("top_carrier_anomalies").cast("string"), F.lit(" anomalies, rate "),
        percent(F.col("top_carrier_rate")), F.lit(")"),
        _small(F.col("top_carrier_sample"), ", a small sample that should not be judged alone"),
        F.lit("; leading route: "), F.coalesce("top_route", F.lit("unknown")), F.lit(" ("),
        F.col("top_route_orders").cast("string"), F.lit(" orders, rate "),
        percent(F.col("top_route_rate")), F.lit(")"),
        _small(F.col("top_route_sample"), ", to be reviewed with more data"),
        F.lit(". Main rule reasons: "), F.col("top_reasons"), F.lit("."),
    )
    return facts.withColumn("summary", text)


def carrier_insight(carriers: DataFrame) -> DataFrame:
    """One sentence per carrier with its sample caveat."""
    note = F.when(
        F.col("total_orders") < M.SMALL_SAMPLE, F.lit("Small sample: a first observation only.")
    ).otherwise(F.lit("The sample allows comparison within this data set."))
    text = F.concat(
        F.coalesce("carrier", F.lit("unknown")), F.lit(": "), F.col("total_orders").cast("string"),
        F.lit(" orders, "), F.col("anomaly_orders").cast("string"), F.lit(" anomalies ("),
        percent(F.col("anomaly_rate")), F.lit("), average delay "), fixed(F.col("avg_delay"), 1),
        F.lit(" days. "), note, F.lit(" Review together with routes and reasons."),
    )
    return carriers.select("carrier", text.alias("insight"))


def carrier_prompts(carriers: DataFrame) -> DataFrame:
    """One bounded prompt per carrier, from aggregates only."""
    lines = [
        F.concat(F.lit("Statistics of carrier "), F.coalesce("carrier", F.lit("unknown")), F.lit(" in this data set:")),
        F.concat(F.lit("- orders: "), F.col("total_orders").cast("string")),
        F.concat(F.lit("- average delay: "), fixed(F.col("avg_delay"), 2), F.lit(" days")),
        F.concat(F.lit("- late rate: "), fixed(F.col("late_rate") * 100.0, 2), F.lit("%")),
        F.concat(F.lit("- anomalies: "), F.col("anomaly_orders").cast("string")),
        F.concat(F.lit("- anomaly rate: "), fixed(F.col("anomaly_rate") * 100.0, 2), F.lit("%")),
        F.concat(F.lit("- sample: "), F.col("sample_note")),
        F.lit("Give two or three sentences on performance and next steps. Use only these numbers; "
              "state the uncertainty of a small sample."),
    ]
    return carriers.select("carrier", F.concat_ws("\n", *lines).alias("prompt"))


def analysis_prompt(result: DataFrame) -> DataFrame:
    """One bounded prompt for the whole data set: range, KPIs, top carriers, routes, reasons, cases."""
    levels = _first(M.severity_levels(result))
    lines = insight_lines(result)
    block = lambda kind: _joined(
        lines.where(F.col("kind") == kind), ["position"], F.col("line")
    )
    reasons = M.reason_counts(result, 6).select(
        (-F.col("orders")).alias("o"), "rule",
        F.concat(F.lit("- "), F.col("rule"), F.lit(": "), F.col("orders").cast("string")).alias("text"),
    )
    cases = M.top_anomalies(result, 5).select(
        (-F.col("anomaly_score")).alias("s"), (-F.col("delay_days")).alias("d"), "order_id",
        F.concat(
            F.lit("- "), F.concat_ws(" | ", "order_id", "carrier", "route", "severity",
            F.concat(F.lit("score "), fixed(F.col("anomaly_score"), 1)), "anomaly_methods"),
        ).alias("text"),
    )
    k = M.kpis(result)
    or_none = lambda c, text: F.coalesce(F.nullif(c, F.lit("")), F.lit(text))
    parts = [
        F.lit("Write a business analysis of this detection summary."),
        F.concat(F.lit("Range: "), F.coalesce("start_date", F.lit("unknown")), F.lit(" to "), F.coalesce("end_date", F.lit("unknown"))),
        F.concat(F.lit("Orders: "), F.col("total_orders").cast("string"), F.lit("; anomalies: "),
                 F.col("total_anomalies").cast("string"), F.lit("; rate: "), fixed(F.col("anomaly_rate") * 100.0, 2), F.lit("%")),
        F.concat(F.lit("Average delay: "), fixed(F.col("avg_delay"), 2), F.lit(" days; longest: "), fixed(F.col("max_delay"), 2), F.lit(" days")),
        F.concat(F.lit("Critical/moderate/minor: "), F.concat_ws(
            "/", *[levels.getField(s).cast("string") for s in ("critical", "moderate", "minor")])),
        F.lit("Riskiest carriers (sample-adjusted):"), or_none(block("carrier"), "- no data"),
        F.lit("Riskiest routes (sample-adjusted):"), or_none(block("route"), "- no data"),
        F.lit("Main rule reasons:"), or_none(_joined(reasons, ["o", "rule"], F.col("text")), "- none"),
        F.lit("Typical cases:"), or_none(_joined(cases, ["s", "d", "order_id"], F.col("text")), "- none"),
        F.lit("Do not invent numbers; separate findings from possible causes; state small-sample uncertainty."),
    ]
    return k.select(F.concat_ws("\n", *parts).alias("prompt"))
