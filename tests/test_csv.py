import glob
import hashlib

import pytest

from conftest import order_rows
from tidewatch import DataValidationError, DetectorConfig, analyze_files
from tidewatch.plans.queries import queries
from tidewatch.schema import HEADER_ALIASES
from tidewatch.sources import csv_files
from tidewatch.sources.csv_files import POSITION, catalogue, file_signature, read_csv, union_sources, write_csv

NAMES = {v: k for k, v in HEADER_ALIASES.items()}


def csv_text(rows):
    keys = [k for k in rows[0] if k != "n"]
    lines = [",".join(NAMES[k] for k in keys)]
    return "\n".join(lines + [",".join(r[k] for k in keys) for r in rows]) + "\n"


def put(path, data):
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "gb18030", "gbk"])
def test_encodings(spark, tmp_path, encoding):
    text = csv_text(order_rows([0, 1], carriers=["远航物流"] * 2))
    rows = read_csv(spark, put(tmp_path / "o.csv", text.encode(encoding))).rows
    assert rows.columns[0] == "order_id"
    known = "UTF-8" if encoding.startswith("utf") else "GB18030"
    assert read_csv(spark, str(tmp_path / "o.csv"), encoding=known).rows.count() == 2
    assert [r["carrier"] for r in rows.collect()] == ["远航物流"] * 2


def test_files_of_mixed_encodings(spark, tmp_path):
    for i, encoding in enumerate(["utf-8", "gb18030", "utf-8-sig"]):
        text = csv_text(order_rows([i], carriers=[f"承运商{i}"]))
        put(tmp_path / f"{i}.csv", text.encode(encoding))
    rows = read_csv(spark, str(tmp_path)).rows
    assert {r["carrier"] for r in rows.collect()} == {"承运商0", "承运商1", "承运商2"}


@pytest.mark.parametrize("data, message", [(b"", "empty"), (b" \n \n", "empty"), (b"port,tons\nwest\x00east,4\n", "binary")])
def test_unusable_files(spark, tmp_path, data, message):
    with pytest.raises(DataValidationError, match=message):
        read_csv(spark, put(tmp_path / "x.csv", data))


def test_long_rows_are_quarantined_and_short_ones_filled(spark, tmp_path):
    data = read_csv(spark, put(tmp_path / "x.csv", b'a,b,c\n1,2,3\n4,5\n6,7,8,9\n"x,y",2,3\n'))
    assert sorted(map(str, [tuple(r)[:3] for r in data.rows.collect()])) == sorted(
        map(str, [("1", "2", "3"), ("4", "5", None), ("x,y", "2", "3")])
    )
    assert [r["line"] for r in data.quarantine.collect()] == ["6,7,8,9"]


def test_quotes_over_lines_and_leading_zeros(spark, tmp_path):
    data = read_csv(spark, put(tmp_path / "x.csv", b'a,b\n001,"two\nlines"\n'))
    assert [tuple(r)[:2] for r in data.rows.collect()] == [("001", "two\nlines")]


def test_headers_are_cleaned(spark, tmp_path):
    assert read_csv(spark, put(tmp_path / "x.csv", b"\xef\xbb\xbf a , b\n1,2\n")).rows.columns[:2] == ["a", "b"]


def test_position_gives_the_file_order(spark, tmp_path):
    body = "id\n" + "\n".join(str(i) for i in range(500))
    rows = read_csv(spark, put(tmp_path / "x.csv", body.encode())).rows.orderBy(*POSITION)
    assert [int(r["id"]) for r in rows.collect()] == list(range(500))


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("=SUM(A1)", -7), (" @x", 1), ("ok", 2), (None, 3)], "order_id string, n int")
    out = str(tmp_path / "out")
    write_csv(df.coalesce(1), out)
    payload = open(glob.glob(out + "/*.csv")[0], "rb").read()
    assert payload.startswith(b"\xef\xbb\xbf")
    text = payload.decode("utf-8-sig")
    assert "'=SUM(A1),-7" in text and "' @x,1" in text and "ok,2" in text
    back = read_csv(spark, out).rows
    assert back.columns[:2] == ["order_id", "n"] and back.count() == 4


def test_signature(spark, tmp_path):
    path = put(tmp_path / "x.csv", b"abc")
    assert file_signature(spark, path).first()["signature"] == hashlib.sha256(b"abc").hexdigest()[:16]


@pytest.mark.parametrize("data", [
    b"", b"\n", b"x", b"x\n", b"\xef\xbb\xbfa,b\n1,2", b"\xef\xbb\xbfa\n", b"\n\n", b"a\r\nb\r\n", b"\xff\xfe\x00\n\x00", b"\xef\xbb\xbf",
    b"line,of,text\n" * 200_000, b"y" * 3_000_000,
])
def test_signatures_are_those_of_the_bytes(spark, tmp_path, data):
    path = put(tmp_path / "x.csv", data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300000")  # several splits
    try:
        got = file_signature(spark, [path, put(tmp_path / "other.csv", b"z\n")]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["file"].rsplit("/", 1)[1]: r["signature"] for r in got} == {
        "x.csv": hashlib.sha256(data).hexdigest()[:16], "other.csv": hashlib.sha256(b"z\n").hexdigest()[:16],
    }


def test_files_with_other_column_orders(spark, tmp_path):
    put(tmp_path / "1.csv", b"order_id,carrier,mode\na,b,c\n")
    put(tmp_path / "2.csv", b"mode,order_id,carrier\nc2,a2,b2\nc3,a3,b3\n")
    put(tmp_path / "3.csv", "\ufeffcarrier,note,order_id\nb4,n,a4\n".encode())
    rows = read_csv(spark, str(tmp_path)).rows
    assert sorted(tuple(r) for r in rows.select("order_id", "carrier", "mode").fillna("-").collect()) == [
        ("a", "b", "c"), ("a2", "b2", "c2"), ("a3", "b3", "c3"), ("a4", "b4", "-")
    ]
    assert rows.where("note = 'n'").count() == 1


def test_many_files_are_read_by_kind(spark, tmp_path):
    for i in range(60):
        put(tmp_path / f"{i}.csv", b"a,b\n1,2\n" if i % 2 else b"b,a\n2,1\n")
    files = catalogue(spark, str(tmp_path))
    kinds = csv_files._kinds(files)
    assert len(kinds) == 2 and sorted(len(names) for *_, names in kinds) == [30, 30]
    rows = read_csv(spark, str(tmp_path)).rows
    assert rows.where("a = '1' and b = '2'").count() == 60 == rows.count()


def test_catalogue_rows(spark, tmp_path):
    put(tmp_path / "good.csv", b'\n \na,b\n1,"x\ny"\n')
    put(tmp_path / "none.csv", b"")
    put(tmp_path / "open.csv", b'a\n"x\n')
    put(tmp_path / "gb.csv", "名\n值\n".encode("gb18030"))
    got = {r["file"].rsplit("/", 1)[1]: r for r in catalogue(spark, str(tmp_path)).collect()}
    assert {k: r["problem"] for k, r in got.items()} == {
        "good.csv": None, "none.csv": "empty file", "open.csv": "a quote is not closed", "gb.csv": None,
    }
    assert got["gb.csv"]["encoding"] == "GB18030" and got["good.csv"]["multiline"] and not got["gb.csv"]["multiline"]
    assert bytes.fromhex(got["good.csv"]["header"]) == b"a,b"
    assert got["gb.csv"]["size"] == 6 and got["none.csv"]["size"] == 0


def test_unusable_files_can_go_to_the_quarantine(spark, tmp_path):
    put(tmp_path / "good.csv", b"a\n1\n2,3\n")
    put(tmp_path / "none.csv", b"")
    put(tmp_path / "nul.csv", b"a\n\x00\n")
    data = read_csv(spark, str(tmp_path), unusable="quarantine")
    assert data.rows.count() == 1
    assert sorted((r["file"].rsplit("/", 1)[1], r["line"], r["reason"]) for r in data.quarantine.collect()) == [
        ("good.csv", "2,3", "too many fields"), ("none.csv", None, "empty file"), ("nul.csv", None, "binary content"),
    ]
    with pytest.raises(DataValidationError, match="empty file.*binary content"):
        read_csv(spark, str(tmp_path))
    with pytest.raises(ValueError):
        read_csv(spark, str(tmp_path), unusable="skip")


def test_union_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([("y", 2)], "b string, a int")
    assert sorted(tuple(r) for r in union_sources([a, b]).collect()) == [(1, "x"), (2, "y")]


def test_analysis_from_files(spark, tmp_path):
    rows = order_rows([0] * 19 + [16])
    rows.append(dict(rows[0], weight_t="-1"))
    orders = put(tmp_path / "orders.csv", csv_text(rows).encode("gb18030"))
    ports = put(
        tmp_path / "ports.csv",
        "港口,年份,月份,货物吞吐量_万吨\neast,2023,4,71.5\nwest,2023,0,9\n".encode(),
    )
    out = analyze_files(spark, orders, ports, DetectorConfig(n_trees=20))
    assert out.result.count() == 20
    assert out.validation.quality.first()["duplicate_order_ids_removed"] == 1
    assert out.tables["kpis"].first()["total_anomalies"] >= 1
    assert out.tables["top_anomalies"].first()["order_id"] == "T-0019"
    assert out.tables["port_seasonality"].count() == 12
    assert "Received 21 rows, usable 20" in out.tables["overview"].where("section = 'quality'").first()["text"]
    assert {r["warning"] for r in out.extras["warnings"].collect()} >= {"invalid_or_duplicate_dropped"}
    assert out.config["n_trees"] == 20


@pytest.mark.parametrize("encoding", ["utf-8", "gb18030"])
def test_cells_with_line_breaks(spark, tmp_path, encoding):
    path = put(tmp_path / "x.csv", '单号,备注\n1,"远洋\n内河"\n2,"a ""b""\n\nc"\n'.encode(encoding))
    rows = read_csv(spark, path).rows.orderBy(*POSITION).collect()
    assert [tuple(r)[:2] for r in rows] == [("1", "远洋\n内河"), ("2", 'a "b"\n\nc')]


@pytest.mark.parametrize("encoding", ["utf-8", "gb18030"])
def test_a_quote_that_is_not_closed_is_refused(spark, tmp_path, encoding):
    path = put(tmp_path / "half.csv", '名,b\n1,"open\n2,x\n3,y\n'.encode(encoding))
    with pytest.raises(DataValidationError, match="half.csv: a quote is not closed"):
        read_csv(spark, path)


def test_other_encodings_need_the_setting(spark, tmp_path):
    path = put(tmp_path / "x.csv", "名\n1\n".encode("gb18030"))
    spark.conf.set("spark.sql.legacy.javaCharsets", "false")
    try:
        with pytest.raises(DataValidationError, match="javaCharsets"):
            read_csv(spark, path)
    finally:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def test_a_session_that_does_not_say_reads_other_encodings(spark, tmp_path):
    path = put(tmp_path / "x.csv", "名\n远\n".encode("gb18030"))
    spark.conf.unset(csv_files.CHARSETS)
    try:
        assert [r["名"] for r in read_csv(spark, path).rows.collect()] == ["远"]
        spark.conf.unset(csv_files.CHARSETS)
        assert csv_files.allow_charsets(spark)
        assert queries()["csv_round_trip"](spark, "/root/testdata/sf0.001").count() > 0
    finally:
        spark.conf.set(csv_files.CHARSETS, "true")


def test_signatures_of_several_files_without_bytes(spark, tmp_path):
    data = {"a b.csv": b"", "c[1].csv": b"", "d*.csv": b"\xef\xbb\xbf", "e%.csv": b"x\n"}
    for name, content in data.items():
        put(tmp_path / name, content)
    got = file_signature(spark, str(tmp_path)).collect()
    assert sorted(r["signature"] for r in got) == sorted(hashlib.sha256(x).hexdigest()[:16] for x in data.values())


def test_files_with_signs_in_their_names(spark, tmp_path):
    for i, name in enumerate(["a b.csv", "c[1].csv", "e%20.csv", "{f}.csv"]):
        put(tmp_path / name, f"a,b\n{i},2\n".encode())
    assert sorted(r["a"] for r in read_csv(spark, str(tmp_path)).rows.collect()) == ["0", "1", "2", "3"]
