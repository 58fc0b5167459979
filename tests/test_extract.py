"""Extract conditions."""

import math

import pytest

from tabrecon import extract, predicate


@pytest.fixture()
def text(spark):
    return spark.createDataFrame([(1, "Abc"), (2, " abc "), (3, "x.y"), (4, ""), (5, None), (6, "nan"), (7, "xay")],
                                 "pk long, v string")


def pks(df):
    return sorted(r["pk"] for r in df.collect())


@pytest.mark.parametrize("cond,value,case,want", [
    ("eq", "abc", False, [1, 2]), ("eq", "Abc", True, [1]), ("eq", " abc", False, []),
    ("ne", "abc", False, [3, 4, 5, 6, 7]), ("contains", ".", False, [3]), ("contains", "B", False, [1, 2]),
    ("starts", "ab", False, [1, 2]), ("ends", "bc", True, [1, 2]), ("ends", "BC", True, []), ("empty", None, False, [4, 5]),
    ("not_empty", None, False, [1, 2, 3, 6, 7]),
])
def test_text_conditions(text, cond, value, case, want):
    assert pks(extract(text, "v", cond, value, case_sensitive=case)) == want


def test_null_text_option(text):
    assert pks(extract(text, "v", "contains", "an", null_text="nan")) == [5, 6]


def test_numbers_from_text(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([" 12 ", "1e3", "1,5", "12abc", "1d", "1_000", "inf",
                                                               "nan", "", None, "-3"])], "pk long, v string")
    assert pks(extract(df, "v", "gt", "5")) == [0, 1, 6]
    assert pks(extract(df, "v", "lt", "5")) == [10]


def test_nan_never_greater(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 5.0), (4, -1.0)], "pk long, v double")
    assert pks(extract(df, "v", "gt", "0")) == [3]
    assert pks(extract(df, "v", "lt", "0")) == [4]
    assert pks(extract(df, "v", "empty")) == [1, 2]


def test_bad_threshold_and_condition(text):
    with pytest.raises(ValueError, match="numeric"):
        predicate(text, "v", "gt", "abc")
    with pytest.raises(ValueError, match="unknown condition"):
        predicate(text, "v", "between", "1")
    assert pks(extract(text, "v", "gt", "nan")) == []
    assert not math.isnan(1.0)


def test_conditions_partition_the_table(text):
    for pos, neg in (("eq", "ne"), ("empty", "not_empty")):
        value = "abc" if pos == "eq" else None
        assert sorted(pks(extract(text, "v", pos, value)) + pks(extract(text, "v", neg, value))) == list(range(1, 8))


def test_numeric_filter_pushed_into_scan(spark, scratch):
    path = f"{scratch}/c.parquet"
    spark.createDataFrame([(1, 10.0)], "pk long, bal double").write.parquet(path)
    plan = extract(spark.read.parquet(path), "bal", "gt", "5")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(bal,5.0)" in plan
