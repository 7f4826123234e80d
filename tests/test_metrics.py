import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch import DataValidationError
from tidewatch.operators import charts, drilldown, insight, report, throughput
from tidewatch.operators import metrics as M


def test_severity_and_rate_have_one_source(detected):
    counts = M.severity_counts(detected)
    assert M.severity_count(counts, "critical") == 9 and M.severity_count(counts, "unknown") == 0
    assert [r["orders"] for r in counts.orderBy("rank").collect()] == [9, 0, 0, 1]
    k = M.kpis(detected).first()
    assert (k["total_orders"], k["total_anomalies"], k["anomaly_rate"]) == (10, 9, 0.9)
    assert (k["avg_delay"], k["max_delay"], k["start_date"], k["end_date"]) == (14.4, 16.0, "2024-01-01", "2024-01-10")


def test_carriers(detected):
    a = M.carrier_stats(detected).where("carrier = 'A'").first()
    assert (a["total_orders"], a["anomaly_orders"], a["anomaly_rate"], a["sample_note"]) == (6, 6, 1.0, "enough_sample")
    assert a["smoothed_rate"] == round((6 + 0.9 * 10) / 16, 4)
    assert M.carrier_stats(detected).where("carrier = 'B'").first()["sample_note"] == "small_sample"


def test_routes(detected):
    rows = M.route_stats(detected).collect()
    assert sum(r["orders"] for r in rows) == 10 and sum(r["anomalies"] for r in rows) == 9
    assert {r["route"] for r in rows} == {"r1", "r2"}


def test_null_carrier_is_a_group(detected):
    df = detected.withColumn("carrier", F.when(F.col("carrier") == "A", F.col("carrier")))
    assert {r["carrier"] for r in M.carrier_stats(df).collect()} == {"A", None}


def test_methods_reasons_and_top(detected):
    assert {r["method"]: r["hits"] for r in M.method_counts(detected).collect()} == {
        "rules": 9, "route_zscore": 5, "iforest": 3}
    assert [tuple(r) for r in M.reason_counts(detected).collect()] == [("delay_over_14d", 9)]
    assert [r["order_id"] for r in M.top_anomalies(detected, 3).collect()] == ["M-0", "M-1", "M-2"]
    assert [r["month_label"] for r in M.monthly_trend(detected).collect()] == ["2024-01"]


def test_metrics_need_columns_and_rows(detected):
    with pytest.raises(DataValidationError, match="reason, severity"):
        M.check_result(detected.drop("severity", "reason"))
    with pytest.raises(DataValidationError, match="no rows"):
        M.check_result(detected.where("false"))


def test_summary_and_prompt_quote_the_facts(detected):
    text = insight.summary_row(detected).first()["summary"]
    assert "critical 9" in text and "10 orders" in text and "risk level high" in text
    prompt = insight.analysis_prompt(detected).first()["prompt"]
    for part in ("Orders: 10", "anomalies: 9", "Critical/moderate/minor: 9/0/0", "M-0", "Do not invent"):
        assert part in prompt
    carrier = insight.carrier_prompts(M.carrier_stats(detected)).where("carrier = 'B'").first()["prompt"]
    assert "orders: 4" in carrier and "small_sample" in carrier


def test_summary_without_anomalies(detected):
    calm = detected.withColumns({"final_anomaly": F.lit(0), "severity": F.lit("normal")})
    row = insight.summary_row(calm).first()
    assert (row["risk"], row["top_reasons"], row["total_anomalies"]) == ("low", "none", 0)
    assert "- none" in insight.analysis_prompt(calm).first()["prompt"]
    assert report.recommendations(calm).count() == 3


def test_report_tables(detected):
    cards = {r["card"]: r["value"] for r in report.kpi_cards(detected).collect()}
    assert cards == {"total_orders": "10", "anomalies": "9", "anomaly_rate": "90.0%", "average_delay": "14.4 days", "critical": "9"}
    assert report.report_cases(detected).count() == 9
    assert report.recommendations(detected).count() == 4
    cell = report.report_cells(detected).where("carrier = 'A'").first()
    assert (cell["avg_delay"], cell["anomaly_rate"]) == ("16", "100.0%")


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(3)
    normal = [float(x) for x in rng.integers(0, 25, 500)]
    odd = [float(x) for x in rng.integers(3, 40, 77)]
    df = spark.createDataFrame([(0, x) for x in normal] + [(1, x) for x in odd], "final_anomaly int, delay_days double")
    got = charts.delay_histogram(df).orderBy("final_anomaly", "bin").collect()
    for cls, values, bins in ((0, normal, 30), (1, odd, 20)):
        want, _ = np.histogram(values, bins)
        density, edges = np.histogram(values, bins, density=True)
        rows = [r for r in got if r["final_anomaly"] == cls]
        assert [r["orders"] for r in rows] == want.tolist()
        assert np.allclose([r["density"] for r in rows], density)
        assert np.allclose([r["bin_start"] for r in rows], edges[:-1])


def test_histogram_of_a_constant_class(spark):
    df = spark.createDataFrame([(0, 2.0)] * 4, "final_anomaly int, delay_days double")
    rows = charts.delay_histogram(df).collect()
    assert len(rows) == 30 and sum(r["orders"] for r in rows) == 4
    assert min(r["bin_start"] for r in rows) == 1.5


def test_box_statistics(spark):
    values = [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 30.0, -40.0]
    df = spark.createDataFrame([("m", v) for v in values] + [(None, 1.0), ("m", None)], "mode string, delay_days double")
    box = charts.delay_box(df).collect()
    q1, med, q3 = np.percentile(values, [25, 50, 75])
    assert len(box) == 1
    assert (box[0]["q1"], box[0]["median"], box[0]["q3"]) == (q1, med, q3)
    assert (box[0]["whisker_low"], box[0]["whisker_high"], box[0]["outliers"]) == (0.0, 7.0, 2)


def test_category_options(spark):
    df = spark.createDataFrame([(f" v{i} ",) for i in range(5) for _ in range(5 - i)] + [("",), (None,)], "c string")
    got = drilldown.category_options(df, "c", 3).orderBy("position").collect()
    assert [(r["value"], r["orders"], r["truncated"]) for r in got] == [("v0", 5, True), ("v1", 4, True), ("v2", 3, True)]
    assert not drilldown.category_options(df, "c", 5).first()["truncated"]


def test_filters(detected):
    f = drilldown.filter_anomalies
    assert f(detected).count() == 9
    assert f(detected, carriers=["B"], routes=["r1"]).count() == 2
    assert f(detected, severities=["minor"]).count() == 0
    assert drilldown.explain_order(detected, "M-3").first()["reason"] == "test reason"
    assert drilldown.explain_order(detected, "M-9").count() == 0


def test_seasonality_fills_the_grid(spark):
    df = spark.createDataFrame([("p", 2024, 1, 10.0), ("p", 2024, 2, 30.0), ("z", 2024, 1, 0.0)],
                               "port string, year int, month int, cargo_10kt double")
    got = {(r["port"], r["month"]): r["relative"] for r in throughput.port_seasonality(df).collect()}
    assert len(got) == 24
    assert (got["p", 1], got["p", 2], got["p", 12], got["z", 7]) == (0.5, 1.5, 1.0, 0.0)
    assert throughput.seasonality_wide(throughput.port_seasonality(df)).columns[1:] == [str(m) for m in range(1, 13)]


def test_a_summary_without_names_says_unknown(detected):
    from tidewatch.operators.insight import summary_row

    nameless = detected.withColumn("carrier", F.lit(None).cast("string"))
    row = summary_row(nameless).first()
    assert row["top_carrier"] is None and "sample adjustment: unknown (" in row["summary"]


def test_a_rollup_gives_every_table_from_one_scan(spark, detected, tmp_path):
    path = str(tmp_path / "result")
    odd = detected.withColumn("carrier", F.when(F.col("order_id") != "M-3", F.col("carrier")))
    odd.write.parquet(path)
    result = spark.read.parquet(path)
    rollup = M.Rollup(result)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    tables = [
        M.kpis, M.severity_counts, M.severity_share, M.ranked_carriers, M.ranked_routes, M.monthly_trend, M.method_counts,
        report.kpi_cards, report.report_overview, report.report_carriers, report.report_routes, report.carrier_cards,
    ]
    for table in tables:
        from_rollup = table(rollup)
        assert same(from_rollup, table(result)), table.__name__
        assert from_rollup.columns == table(result).columns
        assert not set(from_rollup.inputFiles()) & set(result.inputFiles()), table.__name__  # no scan of the result
    for table in (insight.summary_row, insight.analysis_prompt, report.recommendations, M.reason_counts, M.top_anomalies):
        assert same(table(rollup), table(result)), table.__name__


def test_a_rollup_of_nothing(detected):
    rollup = M.Rollup(detected.where("1 = 0"))
    assert M.kpis(rollup).first()["total_orders"] == 0 and M.carrier_stats(rollup).count() == 0
