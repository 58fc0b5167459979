"""Enrich (R17-R21) and stacking / combine / dedup."""

import pytest
from pyspark.sql import functions as F

from tabrecon import combine, enrich, reconcile_types, stack
from tests.conftest import rows


@pytest.fixture()
def a(spark):
    return spark.createDataFrame([(1, "1", 10), (2, " 2 ", None), (3, "", 30), (4, None, 40), (5, "9", 50)],
                                 "pk long, id string, n long")


@pytest.fixture()
def b(spark):
    return spark.createDataFrame([("1", "first", 2), ("1", "second", 1), ("2", "two", 3), ("", "blank", 4)],
                                 "id string, v string, ord long")


def test_enrich_left_first_match_skip_empty(a, b):
    res = enrich(a, b, "id", select_b=["v"], order_b=["ord"])
    assert res.data.columns == ["pk", "id", "n", "v", "id (B)"]
    assert rows(res.data, "pk", "v", "id (B)") == [(1, "second", "1"), (2, "two", "2"), (5, None, None)]
    assert rows(res.found, "pk") == [(1,), (2,)]


def test_enrich_keep_empty_matches_blank_to_blank(a, b):
    res = enrich(a, b, "id", select_b=["v"], order_b=["ord"], skip_empty=False)
    assert rows(res.data, "pk", "v") == [(1, "second"), (2, "two"), (3, "blank"), (4, "blank"), (5, None)]


def test_enrich_inner(a, b):
    res = enrich(a, b, "id", select_b=["v"], order_b=["ord"], how="inner")
    assert rows(res.data, "pk") == [(1,), (2,)]


def test_enrich_fill_every_null_as_text(a, b):
    res = enrich(a, b, "id", select_b=["v"], order_b=["ord"], fill="", skip_empty=False)
    got = {r["pk"]: r for r in res.data.collect()}
    assert got["2"]["n"] == "" and got["5"]["v"] == "" and got["4"]["id"] == ""
    assert dict(res.data.dtypes)["n"] == "string"


def test_enrich_helper_names_do_not_clash(spark):
    a = spark.createDataFrame([("1", "keep")], "id string, _match_key string")
    b = spark.createDataFrame([("1", "x")], "id string, v string")
    res = enrich(a, b, "id", select_b=["v"], order_b=["id"]).data
    assert res.first()["_match_key"] == "keep"


def test_enrich_case_clash_refused(spark):
    a = spark.createDataFrame([("1", "x")], "id string, ID2 string").withColumnRenamed("ID2", "Id")
    b = spark.createDataFrame([("1", "v")], "id string, v string")
    with pytest.raises(ValueError, match="case"):
        enrich(a, b, "id", select_b=["v"], order_b=["id"])


def test_enrich_requires_columns(a, b):
    with pytest.raises(ValueError):
        enrich(a, b, "id", select_b=[])


def test_stack_mixed_types_become_text(spark):
    x = spark.createDataFrame([(1, 1, "only")], "id long, x long, s string")
    y = spark.createDataFrame([("zz", 2.5)], "id string, x double")
    out = stack(x, y)
    assert out.columns == ["id", "x", "s"]
    assert dict(out.dtypes) == {"id": "string", "x": "double", "s": "string"}
    assert rows(out) == [("1", 1.0, "only"), ("zz", 2.5, None)]


def test_stack_dedup_rows_and_key(spark):
    x = spark.createDataFrame([("a", "x1", 2), ("b", "x2", 1), ("a", "x3", 1), (None, "x4", 5)], "k string, v string, pk long")
    y = spark.createDataFrame([("a", "y1", 0), ("a ", "y2", 1), (None, "y3", 0)], "k string, v string, pk long")
    first = stack(x, y, dedup=True, dedup_key="k", order_a=["pk"], order_b=["pk"])
    assert rows(first, "k", "v") == [("a", "x3"), ("a ", "y2"), ("b", "x2"), (None, "x4")]
    assert stack(x, x, dedup=True).count() == 4


def test_combine_columns_and_all_null_rows(spark):
    x = spark.createDataFrame([("s", 1)], "seg string, nk int")
    y = spark.createDataFrame([(5,), (6,)], "other int")
    out = combine([x, y], columns=["nk", "seg"])
    assert out.columns == ["nk", "seg"]
    assert rows(out) == [(1, "s"), (None, None), (None, None)]


def test_combine_unknown_dedup_key_raises(spark):
    x = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        combine([x], dedup=True, dedup_key="nope", orders=[["a"]])
    with pytest.raises(ValueError):
        combine([])


def test_reconcile_keeps_numeric_widening(spark):
    x = spark.createDataFrame([(1,)], "v int")
    y = spark.createDataFrame([(2,)], "v long")
    assert [f.dataType.simpleString() for f in reconcile_types([x, y])[0].schema] == ["int"]
    assert dict(stack(x, y).dtypes)["v"] == "bigint"


def test_default_order_is_file_order(spark, scratch):
    path = f"{scratch}/b.parquet"
    spark.createDataFrame([("1", "first"), ("1", "second")], "id string, v string").coalesce(1).write.parquet(path)
    b = spark.read.parquet(path)
    a = spark.createDataFrame([("1",)], "id string")
    assert enrich(a, b, "id", select_b=["v"]).data.first()["v"] == "first"
    with pytest.raises(ValueError, match="order_b"):
        enrich(a, b.where(F.lit(True)).groupBy("id").agg(F.first("v").alias("v")), "id", select_b=["v"])
