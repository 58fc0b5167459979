"""Subtract / intersect / not-found on dirty keys (rules R1-R10, D2, D3, D12)."""

import pytest
from pyspark.sql import functions as F

from tabrecon import intersect, membership_many_a, membership_many_b, not_found, subtract
from tests.conftest import SF_SMALL, rows

A_ROWS = [("1", 1), (" 1 ", 2), (" 2", 3), ("\u001f3\t", 4), ("", 5), ("  ", 6), (None, 7), ("1", 8), ("A", 9),
          ("a", 10), ("　4", 11)]


@pytest.fixture()
def keys_a(spark):
    return spark.createDataFrame(A_ROWS, "id string, pk long")


@pytest.fixture()
def keys_b(spark):
    return spark.createDataFrame([("1", "x", 1), ("1", "y", 2), ("9", "z", 3), ("a", "w", 4), ("4", "v", 5)],
                                 "id string, v string, pk long")


def pks(df):
    return sorted(r["pk"] for r in df.collect())


def test_subtract_keeps_blank_when_b_has_none(keys_a, keys_b):
    assert pks(subtract(keys_a, keys_b, "id")) == [3, 4, 5, 6, 7, 9]


def test_subtract_drops_blank_when_b_has_blank(spark, keys_a, keys_b):
    b = keys_b.unionByName(spark.createDataFrame([(None, "n", 6)], "id string, v string, pk long"))
    assert pks(subtract(keys_a, b, "id")) == [3, 4, 9]


def test_intersect_case_sensitive_and_keeps_duplicates(keys_a, keys_b):
    assert pks(intersect(keys_a, keys_b, "id").data) == [1, 2, 8, 10, 11]


def test_not_found_is_b_minus_a(keys_a, keys_b):
    res = intersect(keys_a, keys_b, "id", include_not_found=True)
    assert pks(res.not_found) == [3]
    assert rows(not_found(keys_a, keys_b, "id")) == rows(subtract(keys_b, keys_a, "id"))


def test_not_found_empty_is_a_dataframe(spark, keys_a):
    res = intersect(keys_a, keys_a, "id", include_not_found=True)
    assert res.not_found is not None and res.not_found.count() == 0


def test_subtract_plus_intersect_is_a(keys_a, keys_b):
    both = subtract(keys_a, keys_b, "id").unionByName(intersect(keys_a, keys_b, "id").data)
    assert rows(both) == rows(keys_a)


def test_integral_fast_path_equals_text_path(spark):
    a = spark.createDataFrame([(1,), (2,), (None,), (3,), (None,)], "k long")
    b = spark.createDataFrame([(1,), (None,), (7,)], "k int")
    b_text = b.select(F.col("k").cast("string").alias("k"))
    for fn in (subtract, lambda x, y, on: intersect(x, y, on).data):
        assert rows(fn(a, b, "k")) == rows(fn(a, b_text, "k"))
    assert rows(subtract(a, b, "k")) == [(2,), (3,)]


def test_long_vs_double_keys_differ_as_in_reference(spark):
    a = spark.createDataFrame([(1,)], "k long")
    b = spark.createDataFrame([(1.0,)], "k double")
    assert subtract(a, b, "k").count() == 1


def test_hot_blank_key_is_spread_and_correct(spark):
    a = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(
        F.col("id").cast("string")).alias("k"), F.col("id"))
    b = spark.createDataFrame([("",), ("5",)], "k string")
    assert intersect(a, b, "k").data.count() == 1000 + 1
    assert subtract(a, b, "k").count() == 2000 - 1


def test_select_a_ignores_unknown_names(keys_a, keys_b):
    res = intersect(keys_a, keys_b, "id", select_a=["pk", "nope"]).data
    assert res.columns == ["pk"]


def test_select_b_attaches_first_match(keys_a, keys_b):
    res = intersect(keys_a, keys_b, "id", select_a=["pk"], select_b=["v"], order_b=["pk"]).data
    assert rows(res) == [(1, "x"), (2, "x"), (8, "x"), (10, "w"), (11, "v")]


def test_principal_renaming(spark):
    a = spark.createDataFrame([(1, "a-name")], "key long, name string")
    b = spark.createDataFrame([(1, "b-name")], "key long, name string")
    ra = intersect(a, b, "key", select_a=["key", "name"], select_b=["name"], principal="A", order_b=["key"]).data
    assert ra.columns == ["key", "name", "name (B)"] and ra.first()["name (B)"] == "b-name"
    rb = intersect(a, b, "key", select_a=["key", "name"], select_b=["name"], principal="B", order_b=["key"]).data
    assert rb.columns == ["key (B)", "name (B)", "name"] and rb.first()["name"] == "b-name"


def test_suffix_collision_raises(spark):
    a = spark.createDataFrame([(1, "x", "y")], "key long, name string, `name (B)` string")
    b = spark.createDataFrame([(1, "z")], "key long, name string")
    with pytest.raises(ValueError, match="collides"):
        intersect(a, b, "key", select_a=["key"], select_b=["name"], order_b=["key"])


def test_many_b_and_many_a(spark, keys_a, keys_b):
    b2 = spark.createDataFrame([("2", "q", 9)], "id string, v string, pk long")
    assert pks(membership_many_b(keys_a, [keys_b, b2], "id", "id", minus=False).data) == [1, 2, 3, 8, 10, 11]
    nf = membership_many_b(keys_a, [keys_b, b2], "id", "id", minus=False, include_not_found=True).not_found
    assert pks(nf) == [3]
    a2 = spark.createDataFrame([(9, 100)], "id long, pk long")  # long key stacked over text keys
    res = membership_many_a([keys_a, a2], keys_b, "id", "id", minus=False, include_not_found=True)
    assert pks(res.data) == [1, 2, 8, 10, 11, 100]
    assert pks(res.not_found) == []


def test_null_text_nan_matches_like_astype_str(spark):
    a = spark.createDataFrame([(None, 1), ("nan", 2), ("", 3)], "k string, pk long")
    b = spark.createDataFrame([(None,)], "k string")
    assert pks(subtract(a, b, "k", null_text="nan")) == [3]
    assert pks(subtract(a, b, "k")) == [2]


def test_missing_key_column_raises(keys_a, keys_b):
    with pytest.raises(ValueError, match="not found"):
        subtract(keys_a, keys_b, ("nope", "id"))


def test_select_a_in_many_modes(spark, keys_a, keys_b):
    res = membership_many_b(keys_a, [keys_b], "id", "id", minus=True, select_a=["pk"]).data
    assert res.columns == ["pk"]
    res = membership_many_a([keys_a, keys_a], keys_b, "id", "id", minus=False, select_a=["pk", "zz"]).data
    assert res.columns == ["pk"] and res.count() == 10


def test_membership_stats_equal_operator_counts(spark):
    """One-join statistics equal the counts of subtract / intersect / not-found, for text
    keys with blanks on both sides and for integral keys with nulls."""
    from tabrecon import membership_stats, run_stats
    from tabrecon.plans.registry import dirty_events

    ev = dirty_events(spark, SF_SMALL).select("event_id", "k")
    b_text = dirty_events(spark, SF_SMALL).where("value > 250").select(F.col("k").alias("bk"))
    a_int = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,), (5,)], "id long")
    b_int = spark.createDataFrame([(1,), (None,), (3,), (3,)], "ref long")
    for a, b, on in ((ev, b_text, ("k", "bk")), (a_int, b_int, ("id", "ref")), (a_int, b_int.where("ref IS NOT NULL"), ("id", "ref"))):
        got = membership_stats(a, b, on).first().asDict()
        res = intersect(a, b, on, include_not_found=True)
        want = {"a_rows": a.count(), "b_rows": b.count(), "a_in_b_rows": res.data.count(),
                "a_not_in_b_rows": subtract(a, b, on).count(), "b_in_a_rows": intersect(b, a, on[::-1]).data.count(),
                "b_not_in_a_rows": res.not_found.count()}
        assert got == want
        generic = run_stats(spark, a=a, b=b, result=res.data, not_found=res.not_found).first().asDict()
        assert generic == {"a_rows": want["a_rows"], "b_rows": want["b_rows"], "result_rows": want["a_in_b_rows"],
                           "not_found_rows": want["b_not_in_a_rows"]}


def test_many_dispatch(spark):
    """subtract_many / intersect_many pick the many-A or many-B form from their inputs."""
    from tabrecon import intersect_many, scan, subtract_many

    cust = spark.read.parquet(f"{SF_SMALL}/customer.parquet")
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    ps, fs = orders.where("o_orderstatus = 'P'"), orders.where("o_orderstatus = 'F'")
    assert rows(subtract_many(cust, [ps, fs], ("c_custkey", "o_custkey"))) == rows(
        membership_many_b(cust, [ps, fs], "c_custkey", "o_custkey", minus=True).data)
    got = intersect_many([ps, fs], cust, ("o_custkey", "c_custkey"), include_not_found=True)
    want = membership_many_a([ps, fs], cust, "o_custkey", "c_custkey", minus=False, include_not_found=True)
    assert rows(got.data) == rows(want.data) and rows(got.not_found) == rows(want.not_found)
    assert rows(subtract_many(cust, ps, ("c_custkey", "o_custkey"))) == rows(subtract(cust, ps, ("c_custkey", "o_custkey")))
    with pytest.raises(ValueError):
        subtract_many([cust, cust], [ps, fs], ("c_custkey", "o_custkey"))
    meta = scan({"orders": orders}).first()
    assert meta["row_count"] == orders.count() and meta["columns"].startswith("o_orderkey,")
    with pytest.raises(ValueError):
        scan(orders)
