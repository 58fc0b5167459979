"""One-pass and all-or-nothing exports (R41, R42, R46), packed split writes (R31, R35), real workbooks."""

import os

import pytest
from pyspark.sql import functions as F

from tabrecon import as_workbooks, enrich, export, intersect, parse_workbooks, read_export, read_workbooks, run_job, split_by_columns, write_split
from tabrecon.sinks import export as sink
from tests.conftest import SF_SMALL, rows
from tests.test_plans import _final_plan, big_b  # noqa: F401


def tables(spark):
    key = F.when(F.col("c_custkey") % 7 == 0, None).otherwise(F.col("c_custkey"))
    a = spark.read.parquet(f"{SF_SMALL}/customer.parquet").select(key.alias("k"), "c_name", F.array("c_nationkey").alias("list"))
    b = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select((F.col("o_custkey") * 2).alias("k"), "o_orderkey", "o_orderdate")
    return a, b


def test_both_sides_from_one_join(spark, big_b, scratch, monkeypatch):  # noqa: F811
    a, b = tables(spark)
    for blank in (False, True):
        b = b.unionAll(b.limit(3).withColumn("k", F.lit(None).cast("long"))) if blank else b
        res = intersect(a, b, "k", select_a=["c_name", "list"], include_not_found=True)
        plan = _final_plan(res.source)
        assert plan[:plan.find("== Initial Plan ==")].count("Join ") == 1
        assert rows(res.views["result"](res.source)) == rows(res.data)
        assert rows(res.views["not_found"](res.source)) == rows(res.not_found)
        monkeypatch.setattr(type(res.data), "persist", None, raising=False)
        counts = export(res, f"{scratch}/{blank}")
        assert counts == {"result_rows": res.data.count(), "not_found_rows": res.not_found.count()}
        assert rows(spark.read.parquet(f"{scratch}/{blank}/result")) == rows(res.data)
        assert rows(spark.read.parquet(f"{scratch}/{blank}/not_found")) == rows(res.not_found)


def test_enrich_export_reads_its_join_once(spark, scratch):
    a, b = tables(spark)
    res = enrich(a.drop("list"), b, "k", select_b=["o_orderkey"], order_b=["o_orderkey"], fill="-")
    counts = export(res, f"{scratch}/x")
    assert rows(spark.read.parquet(f"{scratch}/x/result")) == rows(res.data) and counts["found_rows"] == res.found.count()


def test_run_is_all_or_nothing(spark, scratch, monkeypatch):
    a, b = tables(spark)
    res = intersect(a, b, "k", include_not_found=True)
    path, written = f"{scratch}/out", []
    real = sink._writer

    def dies(df, fmt, mode):
        written.append(mode)
        if len(written) == 2:
            raise RuntimeError("killed between outputs")
        return real(df, fmt, mode)

    monkeypatch.setattr(sink, "_writer", dies)
    with pytest.raises(RuntimeError):
        export(res, path, run_id="r1")
    monkeypatch.setattr(sink, "_writer", real)
    for output in ("result", "not_found"):
        with pytest.raises(ValueError, match="no complete export"):
            read_export(spark, path, output)
    counts = export(res, path, run_id="r1")
    assert rows(read_export(spark, path)) == rows(res.data) and rows(read_export(spark, path, "not_found")) == rows(res.not_found)
    monkeypatch.setattr(sink, "_writer", None)  # a complete run writes nothing again
    assert export(res, path, run_id="r1") == counts == {"result_rows": res.data.count(), "not_found_rows": res.not_found.count()}
    monkeypatch.setattr(sink, "_writer", real)
    export(res.data.drop("list").limit(0), path, run_id="r2", fmt="csv")
    assert read_export(spark, path).count() == 0 and read_export(spark, path, run_id="r1").count() == counts["result_rows"]
    with pytest.raises(ValueError, match="has no output"):
        read_export(spark, path, "not_found", run_id="r2")
    with pytest.raises(ValueError, match="run_id"):
        export(res, path, run_id="a/b")


def test_job_with_run_id(spark, scratch):
    spec = {"operation": "subtract", "a": f"{SF_SMALL}/customer.parquet", "b": f"{SF_SMALL}/orders.parquet", "key_a": "c_custkey", "key_b": "o_custkey",
            "output": {"path": f"{scratch}/out", "run_id": "one"}}
    n = run_job(spark, spec).first()["result_rows"]
    assert read_export(spark, f"{scratch}/out").count() == n == run_job(spark, spec).first()["result_rows"]


def test_groups_are_packed_into_even_tasks(spark, scratch):
    """Ten thousand tiny groups and one that holds half the rows."""
    n = 40_000
    df = spark.range(n, numPartitions=7).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 20_000).cast("string"))).alias("g"),
                                                F.col("id"), F.repeat(F.lit("x"), 30).alias("pad"))
    tagged = split_by_columns(df, ["g"], ["id", "pad"])
    task = 200_000
    out = sink.packed(tagged, ["_group"], task)
    sizes = out.groupBy(F.spark_partition_id().alias("p"), "_group").count()
    per_task = {r["p"]: r["n"] for r in sizes.groupBy("p").agg(F.sum("count").alias("n")).collect()}
    row = 30 + 5 + 8 + 1
    assert sum(per_task.values()) == n and max(per_task.values()) * row < 2.5 * task
    assert len(per_task) <= 2 * n * row / task + 2
    tasks_of = {r["_group"]: r["count"] for r in sizes.groupBy("_group").count().collect()}
    assert tasks_of.pop("hot") >= n / 2 * row / task - 1 and set(tasks_of.values()) == {1} and len(tasks_of) == 10_000
    few = split_by_columns(df.where("id % 100 < 4"), ["g"], ["id", "pad"])
    write_split(few, f"{scratch}/s", task_bytes=5000)
    files = {d: [f for f in os.listdir(f"{scratch}/s/{d}") if f.startswith("part-")] for d in os.listdir(f"{scratch}/s") if d.startswith("_group=")}
    assert len(files.pop("_group=hot")) > 1 and {len(f) for f in files.values()} == {1}
    assert spark.read.parquet(f"{scratch}/s").count() == few.count()
    assert sink.packed(few.limit(0), ["_group"], 100).count() == 0


def test_workbooks_from_tables(spark, scratch):
    df = spark.createDataFrame([(1, "a & <b>", 1.5, True, None), (2, "é\n line", -3.0, False, "x"), (3, None, 1e20, True, " keep ")],
                               "id long, t string, f double, b boolean, u string")
    files = as_workbooks(df, F.lit("all.xlsx"), F.when(F.col("id") < 3, "low").otherwise("high & up"), order=["id"])
    long = parse_workbooks(files)
    assert sorted({(r["_sheet"], r["_sheet_index"], r["_sheet_count"]) for r in long.collect()}) == [("high & up", 0, 2), ("low", 1, 2)]
    with open(f"{scratch}/all.xlsx", "wb") as f:
        f.write(files.first()["content"])
    for table in (long, read_workbooks(spark, f"{scratch}/all.xlsx")):
        from tabrecon import combine_sheets

        assert rows(combine_sheets(table)) == rows(df)
