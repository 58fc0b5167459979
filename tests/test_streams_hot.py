"""Streams with hot keys (R2, R3, R17) and keep-first by a given order."""

import random

import pytest
from pyspark.sql import functions as F

from tabrecon import enrich, intersect, subtract
from tabrecon.operators.order import first_per_key
from tabrecon.streaming.reconcile import stream_enrich, stream_intersect, stream_keep_first, stream_subtract
from tests.conftest import SF_SMALL, rows


def written(spark, df, path, files):
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


@pytest.fixture()
def sides(spark):
    """A key that holds a third of A, null and blank keys, keys of several types."""
    id_ = F.col("o_orderkey")
    key = F.when(id_ % 3 == 0, "7").when(id_ % 11 == 0, None).when(id_ % 13 == 0, "  ").otherwise(F.col("o_custkey").cast("string"))
    a = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select(key.alias("k"), "o_orderkey")
    b = spark.read.parquet(f"{SF_SMALL}/customer.parquet").where("c_custkey < 80").select(F.concat(F.lit(" "), F.col("c_custkey").cast("string")).alias("k"), "c_name")
    return a, b.unionAll(spark.createDataFrame([(None, "none"), ("7", "second")], "k string, c_name string"))


@pytest.mark.parametrize("hot", [False, True])
def test_salted_streams_equal_batch(spark, scratch, sides, hot):
    a, b = sides
    stream = written(spark, a, f"{scratch}/a", 2)
    kw = {"salts": 5, "hot": spark.createDataFrame([("7",), (None,)], "k string") if hot else None}
    for name, got, want in (("sub", stream_subtract(stream, b, "k", **kw), subtract(a, b, "k")),
                            ("int", stream_intersect(stream, b, "k", **kw), intersect(a, b, "k").data),
                            ("enr", stream_enrich(stream, b, "k", select_b=["c_name"], order_b=["c_name"], **kw),
                             enrich(a, b, "k", select_b=["c_name"], order_b=["c_name"], skip_empty=False).data)):
        got = drain(got, f"salted_{name}_{hot}")
        assert got.columns == want.columns and rows(got) == rows(want)


def test_hot_key_is_spread_over_tasks(spark, scratch, sides):
    a, b = sides
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        share = {}
        for salts in (1, 16):
            stream = written(spark, a, f"{scratch}/a{salts}", 1)
            got = drain(stream_intersect(stream, b, "k", salts=salts).withColumn("task", F.spark_partition_id()), f"spread_{salts}")
            per_task = [r["count"] for r in got.groupBy("task").count().collect()]
            share[salts] = max(per_task) / sum(per_task)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert share[1] > 0.4 and share[16] < 0.3


def test_keep_first_by_order_of_shuffled_arrival(spark, scratch):
    rng = random.Random(2)
    data = [(rng.choice(["a", "b", None, "c"]), i, f"v{i}") for i in range(60)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, at int, v string")
    want = rows(first_per_key(df, "k", ["at"]))
    for n, part in enumerate([data[:20], data[20:40], data[40:]]):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")
    assert rows(drain(stream_keep_first(stream, "k", ["at"]), "first_all", "complete")) == want
    sent = drain(stream_keep_first(stream, "k", [F.col("at")]), "first_update", "update").collect()
    last = {}
    for r in sent:  # what was sent last for a key replaces what was sent before
        assert r["k"] not in last or r["at"] <= last[r["k"]]["at"]
        last[r["k"]] = r
    assert sorted(map(str, last.values())) == sorted(map(str, first_per_key(df, "k", ["at"]).collect()))
    with pytest.raises(ValueError):
        stream_keep_first(df, "k", ["at"])


def test_keep_first_ends_with_the_watermark(spark, scratch):
    df = spark.createDataFrame([("a", 3, "2024-01-01 00:00:05"), ("a", 1, "2024-01-01 00:00:07"), ("b", 2, "2024-01-01 00:00:01"), ("z", 0, "2024-01-01 01:00:00")],
                               "k string, at int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = written(spark, df, f"{scratch}/in", 1)
    got = drain(stream_keep_first(stream, "k", ["at"], event_time="ts", delay="1 minute"), "first_final", "append")
    assert sorted((r["k"], r["at"]) for r in got.collect()) == [("a", 1), ("b", 2)]
