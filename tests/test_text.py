from pyspark.sql import functions as F

from tidewatch.functions import render, text
from tidewatch.functions.rounding import round_even


def test_markers_and_blanks(spark):
    cells = ["　a b　", "nan", " NaN ", "None", "null", "", "NULL", None, "\xa0x\x1f"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [r[0] for r in df.select(text.normalise_text(F.col("c"))).collect()]
    assert got == ["a b", None, None, None, None, None, "NULL", None, "x"]


def test_plain_lines(spark):
    md = "### Title\r\n\n- **bold** item\n> quote `code`\n* star plain\n   "
    df = spark.createDataFrame([(md,), (None,)], "c string")
    got = [r[0] for r in df.select(text.plain_lines(F.col("c"))).collect()]
    assert got == [["Title", "bold item", "quote code", "star", "plain"], []]


def test_rounding_matches_array_libraries(spark):
    import numpy as np

    values = [0.125, 0.285, 1.005, 1.115, 2.675, 4.105, 1.275, -0.125, 2.5, 1234567.891]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (0, 1, 2, 3):
        got = [r[0] for r in df.select(round_even("v", k)).collect()]
        assert got == np.round(values, k).tolist()


def test_rendering(spark):
    df = spark.createDataFrame([(1234567, 0.12345, 10.5), (0, 1.0, 100.0), (5, 0.0, None)], "n long, r double, x double")
    got = df.select(render.grouped(F.col("n")), render.percent(F.col("r")), render.cell(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [("1,234,567", "12.3%", "10.5"), ("0", "100.0%", "100"), ("5", "0.0%", "—")]
