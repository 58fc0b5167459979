import datetime as dt
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabrecon.functions.text import PY_WHITESPACE, normalize_key, strip, text_form, to_number


def test_whitespace_set_equals_python_isspace():
    expected = {chr(i) for i in range(0x110000) if chr(i).isspace()}
    assert set(PY_WHITESPACE) == expected
    assert len(PY_WHITESPACE) == 29


FLOATS = [0.0, -0.0, 1.0, -1.5, 12345678.0, 0.0001, 0.001, 1e-05, 1.5e-05, 1e16, 1.2345e16, 9999999999999998.0,
          123.456, 1e22, 1e-300, 0.1, 2 / 3, 1234567.0, 1e7, 100.0, 1.7976931348623157e308,
          float("inf"), float("-inf")]


def test_float_text_matches_python_str(spark):
    df = spark.createDataFrame([(v,) for v in FLOATS] + [(float("nan"),), (None,)], "x double")
    got = [r[0] for r in df.select(text_form("x", T.DoubleType())).collect()]
    want = [str(v) for v in FLOATS] + ["nan", None]
    assert got == want


def test_other_text_forms(spark):
    df = spark.createDataFrame(
        [(True, dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5, 120000), 7)],
        "b boolean, d date, t timestamp, u timestamp, i int")
    r = df.select(*[text_form(c, f.dataType).alias(c) for c, f in zip(df.columns, df.schema.fields)]).first()
    assert r["b"] == "True" and r["d"] == "2024-01-02" and r["i"] == "7"
    assert r["t"] == "2024-01-02 03:04:05" and r["u"] == "2024-01-02 03:04:05.120000"


def test_normalize_key_strips_unicode_space_and_nulls(spark):
    df = spark.createDataFrame([("　 a \t",), (None,), ("  ",), ("\u001f3\t",), ("A",)], "k string")
    got = [r[0] for r in df.select(normalize_key("k", T.StringType())).collect()]
    assert got == ["a", "", "", "3", "A"]
    assert [r[0] for r in df.select(strip(F.col("k"))).collect()][0] == "a"


def test_normalize_key_integral_and_null_text(spark):
    df = spark.createDataFrame([(1,), (None,)], "k long")
    assert [r[0] for r in df.select(normalize_key("k", T.LongType())).collect()] == ["1", ""]
    assert [r[0] for r in df.select(normalize_key("k", T.LongType(), null_text="nan")).collect()] == ["1", "nan"]


@pytest.mark.parametrize("text,value", [
    (" 12 ", 12.0), ("1e3", 1000.0), ("inf", math.inf), ("-Infinity", -math.inf), (".5", 0.5), ("+3.", 3.0),
    ("1,5", None), ("12abc", None), ("1d", None), ("1f", None), ("1_000", None), ("", None), ("0x1p3", None),
    (None, None),
])
def test_to_number_reads_python_floats_only(spark, text, value):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(to_number("v", T.StringType())).first()[0] == value


def test_to_number_nan_text_is_nan(spark):
    df = spark.createDataFrame([("nan",)], "v string")
    assert math.isnan(df.select(to_number("v", T.StringType())).first()[0])


def test_to_number_refuses_dates(spark):
    with pytest.raises(ValueError):
        to_number("d", T.DateType())
