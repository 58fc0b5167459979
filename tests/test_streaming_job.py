"""Streaming forms of the row-wise operators, and declarative jobs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tabrecon import run_job
from tabrecon.streaming.reconcile import start, start_split, stream_dedup, stream_enrich, stream_extract, stream_subtract
from tests.conftest import SF_SMALL, rows


def _orders_stream(spark):
    schema = spark.read.parquet(f"{SF_SMALL}/orders.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(SF_SMALL)


def _drain(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_stream_subtract_equals_batch(spark):
    cust = spark.read.parquet(f"{SF_SMALL}/customer.parquet").where("c_nationkey < 10")
    got = _drain(stream_subtract(_orders_stream(spark), cust, ("o_custkey", "c_custkey")), "s_sub")
    from tabrecon import subtract
    want = subtract(spark.read.parquet(f"{SF_SMALL}/orders.parquet"), cust, ("o_custkey", "c_custkey"))
    assert rows(got, "o_orderkey") == rows(want, "o_orderkey")


def test_stream_enrich_extract_dedup(spark):
    cust = spark.read.parquet(f"{SF_SMALL}/customer.parquet")
    en = _drain(stream_enrich(_orders_stream(spark), cust, ("o_custkey", "c_custkey"), select_b=["c_name"],
                              order_b=["c_custkey"]), "s_en")
    assert en.count() == spark.read.parquet(f"{SF_SMALL}/orders.parquet").count()
    ex = _drain(stream_extract(_orders_stream(spark), "o_orderstatus", "eq", "p"), "s_ex")
    assert ex.count() == spark.read.parquet(f"{SF_SMALL}/orders.parquet").where("o_orderstatus = 'P'").count()
    dd = _drain(stream_dedup(_orders_stream(spark), "o_custkey"), "s_dd")
    assert dd.count() == spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_custkey").distinct().count()


def test_stream_split_sink(spark, scratch):
    q = start_split(_orders_stream(spark), ["o_orderstatus"], ["o_orderkey"], f"{scratch}/out",
                    checkpoint=f"{scratch}/ckpt", name="split_sink")
    q.processAllAvailable()
    q.stop()
    assert sorted(d for d in os.listdir(f"{scratch}/out") if d.startswith("_group=")) == \
        ["_group=F", "_group=O", "_group=P"]
    with pytest.raises(ValueError):
        start(spark.range(1), f"{scratch}/x")


def test_run_job_enrich_and_validation(spark, scratch):
    spec = {"operation": "enrich", "a": f"{SF_SMALL}/customer.parquet", "b": f"{SF_SMALL}/orders.parquet",
            "key_a": "c_custkey", "key_b": "o_custkey",
            "options": {"select_b": ["o_totalprice"], "order_b": ["o_orderkey"]},
            "output": {"path": f"{scratch}/enrich", "format": "csv"}}
    stats = run_job(spark, json.dumps(spec)).first().asDict()
    n_cust = spark.read.parquet(f"{SF_SMALL}/customer.parquet").count()
    assert stats["a_rows"] == n_cust and stats["result_rows"] == n_cust
    assert stats["found_rows"] == spark.read.option("header", True).csv(f"{scratch}/enrich/found").count()
    for bad in ({"operation": "nope"}, {"operation": "enrich", "a": "x", "b": "y", "key_a": "k", "key_b": "k",
                                        "output": {"path": "p"}}, {"operation": "extract", "a": "x"}):
        with pytest.raises(ValueError):
            run_job(spark, bad)


def test_run_job_split_lines_and_subtract(spark, scratch):
    spec = {"operation": "split_lines", "a": f"{SF_SMALL}/orders.parquet",
            "options": {"lines_per_file": 500, "order": ["o_orderkey"]}, "output": {"path": f"{scratch}/lines"}}
    assert run_job(spark, spec).first()["result_rows"] == 1500
    spec = {"operation": "subtract", "a": f"{SF_SMALL}/customer.parquet",
            "b": [f"{SF_SMALL}/orders.parquet"], "key_a": "c_custkey", "key_b": "o_custkey",
            "output": {"path": f"{scratch}/sub", "columns": ["c_name"]}}
    out = run_job(spark, spec).first()
    back = spark.read.parquet(f"{scratch}/sub/result")
    assert back.columns == ["c_name"] and back.count() == out["result_rows"]
    assert out["result_rows"] == spark.read.parquet(f"{SF_SMALL}/customer.parquet").join(
        spark.read.parquet(f"{SF_SMALL}/orders.parquet"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").count()


def test_export_format_from_suffix(spark, scratch):
    from tabrecon import export

    df = spark.read.parquet(f"{SF_SMALL}/region.parquet")
    assert export(df, f"{scratch}/out.csv") == {"result_rows": 5}
    assert spark.read.option("header", True).csv(f"{scratch}/out.csv/result").count() == 5
    export(df, f"{scratch}/out_pq")
    assert spark.read.parquet(f"{scratch}/out_pq/result").count() == 5


def test_stream_blank_keys_spread_against_large_b(spark, scratch):
    """A static B too large to broadcast: the stream is shuffled by key, its blank keys
    spread by the row hash, and the result still equals the batch one."""
    from tabrecon import enrich
    from tabrecon.plans.registry import dirty_events

    ev = dirty_events(spark, SF_SMALL).select("event_id", "k")
    ev.write.parquet(f"{scratch}/ev")
    stream = spark.readStream.schema(ev.schema).parquet(f"{scratch}/ev")
    b = dirty_events(spark, SF_SMALL).where("value > 250").select(
        F.col("k").alias("bk"), F.col("event_type").alias("t"), F.col("event_id").alias("bid"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = _drain(stream_enrich(stream, b, ("k", "bk"), select_b=["t"], order_b=["bid"], skip_empty=False), "s_blank")
        want = enrich(ev, b, ("k", "bk"), select_b=["t"], order_b=["bid"], skip_empty=False).data
        assert rows(got) == rows(want)
        assert got.where("k IS NULL OR trim(k) = ''").where("t IS NOT NULL").count() > 0  # blanks matched B's blank
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_stream_combine(spark):
    """Streams stack by name as tables do; whole-row dedup is streaming distinct; keep-first
    by key on a stream is first-arrival, through stream_dedup."""
    from tabrecon import combine

    nation, region = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("nation", "region"))

    def streams():
        return [spark.readStream.schema(df.schema).option("pathGlobFilter", f"{t}.parquet").parquet(SF_SMALL)
                for df, t in ((nation, "nation"), (region, "region"))]

    got = _drain(combine(streams()), "s_comb")
    assert got.columns == ["n_nationkey", "n_name", "n_regionkey", "r_regionkey", "r_name"] and got.count() == 30
    assert _drain(combine(streams(), dedup=True), "s_comb_rows").count() == 30
    with pytest.raises(ValueError, match="stream_dedup"):
        combine(streams(), dedup=True, dedup_key="n_name", orders=[["n_nationkey"], ["r_regionkey"]])
    firsts = _drain(stream_dedup(combine(streams()), "n_regionkey"), "s_comb_first")
    assert firsts.count() == 6  # five region keys among the nations, plus the null key of the region rows
