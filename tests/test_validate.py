import pytest
from pyspark.sql import functions as F

from conftest import order_rows
from tidewatch import DataValidationError, validate_orders
from tidewatch.operators import validate as V
from tidewatch.operators.throughput import clean_throughput, throughput_quality


def quality(frame):
    return V.quality_summary(V.checked_orders(frame, ["n"])).first()


def test_missing_columns_are_named_in_order(orders):
    with pytest.raises(DataValidationError, match="carrier, origin"):
        validate_orders(orders([0, 1]).drop("carrier", "origin"), ["n"])


def test_empty_table_is_rejected(orders):
    with pytest.raises(DataValidationError, match="no rows"):
        validate_orders(orders([]), ["n"])


def test_all_invalid_is_rejected(orders):
    rows = order_rows([0, 1])
    for r in rows:
        r["weight_t"] = "-1"
    with pytest.raises(DataValidationError, match="no valid rows"):
        validate_orders(orders(rows=rows), ["n"])


def test_null_and_infinite_numbers(orders):
    rows = order_rows([0, 1, 2])
    rows[0]["weight_t"] = None
    rows[1]["freight_usd"] = "inf"
    q = quality(orders(rows=rows))
    assert (q["valid_rows"], q["invalid_numeric_rows"]) == (1, 2)


def test_numeric_text_is_converted(orders):
    v = validate_orders(orders([0, 1]), ["n"])
    assert v.data.count() == 2
    assert dict(v.data.dtypes)["weight_t"] == "double"


def test_bad_date_and_bad_sequence(orders):
    rows = order_rows([0, 1, 2])
    rows[0]["actual_arrival_ts"] = "not-a-date"
    rows[1]["plan_arrival_ts"] = "2023-01-01"
    v = validate_orders(orders(rows=rows), ["n"])
    q = v.quality.first()
    assert v.data.count() == 1
    assert (q["invalid_date_rows"], q["invalid_date_sequence_rows"]) == (1, 1)
    warnings = {r["warning"]: r["affected"] for r in v.warnings.collect()}
    assert warnings["invalid_dates_dropped"] == 1 and warnings["bad_sequences_dropped"] == 1


def test_day_fields_are_recomputed(orders):
    rows = order_rows([3])
    rows[0]["planned_days"] = rows[0]["delay_days"] = "999"
    v = validate_orders(orders(rows=rows), ["n"])
    row, q = v.data.first(), v.quality.first()
    assert (row["planned_days"], row["delay_days"]) == (10.0, 3.0)
    assert (q["corrected_delay_days_rows"], q["corrected_plan_days_rows"]) == (1, 1)


def test_early_arrival_gives_negative_delay(valid):
    assert valid([-2]).first()["delay_days"] == -2.0


def test_zero_length_plan_is_dropped_without_counter(orders):
    rows = order_rows([0, 1])
    rows[0]["plan_arrival_ts"] = rows[0]["actual_arrival_ts"] = rows[0]["ship_ts"]
    q = quality(orders(rows=rows))
    assert q["valid_rows"] == 1 and q["dropped_rows"] == 1
    assert q["invalid_date_sequence_rows"] == 0


def test_duplicates_keep_the_first_even_if_invalid(orders):
    rows = order_rows([0, 1, 2])
    for i, r in enumerate(rows):
        r["order_id"] = " X " if i < 2 else "Y"
    rows[0]["weight_t"] = "-5"
    copy = dict(rows[2], n=3)
    q = quality(orders(rows=[*rows, copy]))
    assert q["raw_rows"] == 4
    assert q["exact_duplicates_removed"] == 1
    assert q["duplicate_order_ids_removed"] == 1
    assert q["nonpositive_numeric_rows"] == 1
    assert q["valid_rows"] == 1


def test_null_ids_are_kept_apart_and_counted(orders):
    rows = order_rows([0, 1, 2, 3])
    for r, text in zip(rows, ["nan", "", "null", " None "]):
        r["order_id"] = text
    q = quality(orders(rows=[*rows, dict(rows[0], n=9)]))
    assert q["exact_duplicates_removed"] == 1
    assert q["duplicate_order_ids_removed"] == 0
    assert q["missing_required_value_rows"] == 4


def test_valid_path_equals_checked_path(spark, orders):
    rows = order_rows(range(30))
    for i in (3, 9, 12):
        rows[i]["order_id"] = rows[0]["order_id"]
    rows[5]["carrier"] = "  "
    frame = orders(rows=rows + [dict(r, n=100 + r["n"]) for r in rows[:10]]).repartition(7)
    a = V.valid_rows(V.checked_orders(frame, ["n"]), ["n"])
    b = V.valid_orders(frame, ["n"])
    assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(
        map(str, b.select(*sorted(b.columns)).collect())
    )


def test_quarantine_names_every_issue(orders):
    rows = order_rows([0, 1])
    rows[0].update(carrier="nan", weight_t="0", ship_ts="?")
    got = V.quarantine(V.checked_orders(orders(rows=rows), ["n"])).first()
    assert got["issues"] == ["missing_text", "invalid_date", "nonpositive"]


def test_cargo_type_default(orders):
    frame = orders([0]).drop("cargo_type")
    assert V.valid_orders(frame, ["n"]).first()["cargo_type"] == "unspecified"


def test_original_headers_are_understood(spark, orders):
    from tidewatch.schema import HEADER_ALIASES

    names = {v: k for k, v in HEADER_ALIASES.items()}
    frame = orders([0, 5])
    frame = frame.toDF(*[" ﻿" + names[c] + " " if c in names else c for c in frame.columns])
    assert V.valid_orders(frame, ["n"]).count() == 2


def test_extreme_values(orders, valid):
    delays = [0, 1, 2, 3, 4, 5, 6, 7, 8, 400]
    counts = {r["metric"]: r["extreme_rows"] for r in V.extreme_counts(valid(delays)).collect()}
    assert counts == {"delay_days": 1, "planned_days": 0, "weight_t": 0, "freight_usd": 0}
    few = {r["extreme_rows"] for r in V.extreme_counts(valid([0, 1, 400])).collect()}
    assert few == {0}


def test_date_layouts(spark):
    from tidewatch.functions.parsing import parse_timestamp

    texts = [
        "2024-01-05", "2024/1/5", "20240105", "2024年1月5日", "1/5/2024", "2024.01.05",
        "2024-01-05T00:00:00", " 2024-01-05 00:00 ", "2024-13-05", "abc", "", None, "2024",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(F.date_format(parse_timestamp(F.col("t")), "yyyy-MM-dd")).collect()]
    assert got == ["2024-01-05"] * 8 + [None] * 5


def test_dates_with_month_names_and_half_days(spark):
    from tidewatch.functions.parsing import parse_timestamp

    want = {
        "5 Jan 2024": "2024-01-05 00:00", "Jan 5, 2024": "2024-01-05 00:00", "05-JAN-2024": "2024-01-05 00:00",
        "january 5 2024 8:30 pm": "2024-01-05 20:30", "1/5/2024 8:30 AM": "2024-01-05 08:30", "2024-01-05 12:05 AM": "2024-01-05 00:05",
        "1/5/2024 12:05 PM": "2024-01-05 12:05", "01-05-2024": "2024-01-05 00:00", "2024-01-05T06:07:08Z": "2024-01-05 06:07",
        "Sept 5, 2024": None, "5 Foo 2024": None, "1/5/2024 13:30 PM": None, "1/5/2024 0:30 AM": None, "32 Jan 2024": None,
    }
    df = spark.createDataFrame([(t,) for t in want], "t string")
    got = {r[0]: r[1] for r in df.select("t", F.date_format(parse_timestamp(F.col("t")), "yyyy-MM-dd HH:mm")).collect()}
    assert got == want


def test_number_texts(spark):
    from tidewatch.functions.parsing import parse_number

    texts = ["1", " 2.5 ", "-3e2", ".5", "1,234", "1d", "0x10", "inf", "nan", "", None, "1e999"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(parse_number(F.col("t"))).collect()]
    assert got == [1.0, 2.5, -300.0, 0.5] + [None] * 8


def test_fractional_days(spark):
    from tidewatch.functions.parsing import days_between, parse_timestamp

    df = spark.createDataFrame([("2024-01-01 00:00", "2024-01-03 12:00")], "a string, b string")
    a, b = parse_timestamp(F.col("a")), parse_timestamp(F.col("b"))
    assert list(df.select(days_between(a, b), days_between(b, a)).first()) == [2.5, -2.5]


def test_throughput(spark):
    raw = spark.createDataFrame(
        [("good", "2024", "1", "100"), ("good", "2024", "1", "100"), ("bad", "2024", "13", "20"),
         ("bad", "2024", "2", "-1"), (" nan ", "2024", "2", "1"), ("old", "1800", "2", "1")],
        "port string, year string, month string, cargo_10kt string",
    )
    clean = clean_throughput(raw)
    assert [tuple(r) for r in clean.collect()] == [("good", 2024, 1, 100.0)]
    assert tuple(throughput_quality(raw, clean).first()) == (6, 1, 5)


def test_throughput_container_column_must_be_filled(spark):
    raw = spark.createDataFrame(
        [("a", 2024, 1, 1.0, 2.0), ("b", 2024, 1, 1.0, None)],
        "port string, year int, month int, cargo_10kt double, container_10kteu double",
    )
    assert [r["port"] for r in clean_throughput(raw).collect()] == ["a"]


def test_rows_flagged_on_a_stream(spark, orders, tmp_path):
    from tidewatch.streaming.rowwise import flag_rows

    rows = order_rows([0, 1, 2])
    rows[1]["weight_t"] = "x"
    frame = orders(rows=rows)
    path = str(tmp_path / "in")
    frame.write.parquet(path)
    stream = flag_rows(spark.readStream.schema(frame.schema).parquet(path))
    query = stream.writeStream.format("memory").queryName("flagged").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("flagged").where("invalid_numeric").count() == 1


def test_counts_are_observed_while_rows_are_staged(spark, orders):
    from tidewatch.operators.validate import checked_orders, quality_summary, stage_with_quality

    rows = order_rows([0, 1, 2, 3, 3])
    rows[0]["weight_t"], rows[1]["ship_ts"], rows[2]["planned_days"] = "x", "never", "99"
    rows.append(dict(rows[4], n=5))
    checked = checked_orders(orders(rows=rows).repartition(3), ["n"])
    staged, quality = stage_with_quality(checked)
    assert quality.schema.names == quality_summary(checked).schema.names
    assert quality.collect() == quality_summary(staged).collect()
    assert quality.first()["exact_duplicates_removed"] == 1 and quality.first()["valid_rows"] == 3
