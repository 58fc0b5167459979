"""File order as the default (D1), readers that lose nothing, and jobs of every operation."""

import os

import pytest

from tabrecon import combine, enrich, intersect, run_job, stack
from tabrecon.operators.split import split_by_lines
from tabrecon.plans.job import OPERATIONS
from tabrecon.sources.csv import read_csv
from tabrecon.sources.scan import scan_workbooks
from tabrecon.sources.workbook import read_workbooks, select_sheet, sheet_list
from tests.conftest import SF_SMALL, rows
from tests.test_sources import _xlsx


def _write(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())
    return path


def test_enrich_and_intersect_take_the_first_csv_row(spark, scratch):
    b = read_csv(spark, _write(f"{scratch}/b.csv", "id,v\n1,first\n2,two\n1,second\n"))
    a = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    assert rows(enrich(a, b, "id", select_b=["v"]).data, "id", "v") == [("1", "first"), ("2", "two"), ("3", None)]
    assert rows(intersect(a, b, "id", select_a=["id"], select_b=["v"]).data) == [("1", "first"), ("2", "two")]


def test_enrich_takes_the_first_row_of_a_sheet(spark, scratch):
    path = _write(f"{scratch}/b.xlsx", _xlsx({"s": [["id", "v"], [1, "first"], [1, "second"]]}))
    b = select_sheet(read_workbooks(spark, path), None, 0)
    assert enrich(spark.createDataFrame([(1,)], "id long"), b, "id", select_b=["v"]).data.first()["v"] == "first"


def test_keep_first_by_key_without_an_order(spark, scratch):
    a = read_csv(spark, _write(f"{scratch}/a.csv", "k,v\n1,a1\n2,a2\n1,a3\n"))
    b = read_csv(spark, _write(f"{scratch}/b.csv", "k,w\n2,b2\n3,b3\n3,b4\n"))
    got = stack(a, b, dedup=True, dedup_key="k")
    assert got.columns == ["k", "v", "w"]
    assert rows(got) == [(1, "a1", None), (2, "a2", None), (3, None, "b3")]
    spark.createDataFrame([(3, "p3"), (4, "p4")], "k long, v string").coalesce(1).write.parquet(f"{scratch}/p.parquet")
    p = spark.read.parquet(f"{scratch}/p.parquet")
    assert rows(combine([a, p], columns=["k"], dedup=True, dedup_key="k")) == [(1,), (2,), (3,), (4,)]


def test_line_split_of_a_filtered_scan_is_exact(spark):
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet").where("o_orderstatus = 'P'")
    parts = [r["n"] for r in split_by_lines(orders, 20).groupBy("_part").count().withColumnRenamed("count", "n").orderBy("_part").collect()]
    assert all(n == 20 for n in parts[:-1]) and 0 < parts[-1] <= 20 and sum(parts) == orders.count()
    keys = [r["o_orderkey"] for r in orders.orderBy("o_orderkey").collect()]
    got = {r["o_orderkey"]: r["_part"] for r in split_by_lines(orders, 20).collect()}
    assert got == {k: i // 20 + 1 for i, k in enumerate(keys)}


def test_line_split_over_blocks_and_of_a_csv(spark, scratch, monkeypatch):
    import tabrecon.operators.split as split

    monkeypatch.setattr(split, "LINE_BLOCK", 7)
    for i, n in enumerate([30, 25]):
        spark.range(n).selectExpr(f"{i} AS f", "id").coalesce(1).write.parquet(f"{scratch}/m/p{i}")
    df = spark.read.parquet(f"{scratch}/m/p0", f"{scratch}/m/p1").where("id % 3 <> 0")
    want = [(f, i) for f, n in ((0, 30), (1, 25)) for i in range(n) if i % 3]
    assert rows(split_by_lines(df, 4), "f", "id", "_part") == [(f, i, k // 4 + 1) for k, (f, i) in enumerate(want)]
    csv = read_csv(spark, _write(f"{scratch}/c.csv", "x\n" + "".join(f"{i}\n" for i in range(50))))
    assert rows(split_by_lines(csv, 8)) == [(i, i // 8 + 1) for i in range(50)]


def test_csv_columns_go_by_name_over_files(spark, scratch):
    _write(f"{scratch}/d/a.csv", "id,name\n1,x\n")
    _write(f"{scratch}/d/b.csv", "name,id,more\ny,2,z\n")
    got = read_csv(spark, f"{scratch}/d")
    assert rows(got, "id", "name", "more") == [(1, "x", None), (2, "y", "z")]


def test_csv_with_too_many_fields_is_refused(spark, scratch):
    path = _write(f"{scratch}/r.csv", "id,name\n1,x,extra\n2,y\n")
    with pytest.raises(Exception, match="more fields than the header"):
        read_csv(spark, path).collect()
    short = _write(f"{scratch}/s.csv", "id,name\n1\n2,y\n")
    assert rows(read_csv(spark, short)) == [(1, None), (2, "y")]


def test_one_csv_file_is_read_by_several_tasks(spark, scratch):
    path = _write(f"{scratch}/big.csv", "id,name\n" + "".join(f"{i},name number {i}\n" for i in range(40000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        df = read_csv(spark, path)
        assert df.rdd.getNumPartitions() > 4 and df.count() == 40000
        first = stack(df, df, dedup=True, dedup_key="name")
        assert first.count() == 40000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    quoted = _write(f"{scratch}/q.csv", 'id,name\n1,"two\nlines"\n2,b\n')
    assert rows(read_csv(spark, quoted)) == [(1, "two\nlines"), (2, "b")]


def test_workbook_reader_loses_nothing(spark, scratch):
    path = _write(f"{scratch}/w.xlsx", _xlsx({
        "wide": [["id", "name"], [1, "a", "beyond"], [], [2, "NA"]], "empty": [["x", "y"]], "blank": []}))
    long = read_workbooks(spark, path)
    wide = select_sheet(long, None, "wide")
    assert wide.columns == ["id", "name", "Unnamed: 2"]
    assert rows(wide) == [(1, "a", "beyond"), (2, None, None), (None, None, None)]
    assert select_sheet(long, None, "empty").columns == ["x", "y"] and select_sheet(long, None, "empty").count() == 0
    assert {(r["sheet"], r["row_count"], r["columns"]) for r in scan_workbooks(long).collect()} == {
        ("wide", 3, "id,name,Unnamed: 2"), ("empty", 0, "x,y"), ("blank", 0, "")}
    assert [s for _, s in sheet_list(long)] == ["wide", "empty", "blank"]


def test_a_job_of_every_operation(spark, scratch):
    a = _write(f"{scratch}/a.csv", "id,name\n1,x\n2,y\n2,z\n")
    b = _write(f"{scratch}/b.csv", "id,v\n2,two\n2,dos\n9,nine\n")
    book = _write(f"{scratch}/w.xlsx", _xlsx({"one": [["k", "n"], [1, "a"]], "two": [["k", "m"], [2, "b"], [3, "c"]]}))
    keys = {"a": a, "b": b, "key_a": "id", "key_b": "id"}
    specs = {
        "subtract": (keys, {}, {"a_rows": 3, "b_rows": 3, "result_rows": 1}),
        "intersect": ({**keys, "a": [a, a.replace("a.csv", "b.csv")], "b": b}, {}, {"a_rows": 6, "b_rows": 3, "result_rows": 5}),
        "enrich": (keys, {"select_b": ["v"]}, {"result_rows": 3}),
        "stack": (keys, {"dedup": True, "dedup_key": "id"}, {"result_rows": 3}),
        "combine": ({"inputs": [a, b]}, {"dedup": True, "dedup_key": "id"}, {"result_rows": 3}),
        "extract": ({"a": a}, {"column": "name", "condition": "eq", "value": "y"}, {"result_rows": 1}),
        "split_columns": ({"a": a}, {"split_columns": ["id"], "keep_columns": ["name"]}, {"result_rows": 3}),
        "split_lines": ({"a": a}, {"lines_per_file": 2}, {"result_rows": 3}),
        "split_sources": ({"inputs": book}, {}, {"result_rows": 3}),
    }
    assert set(specs) == set(OPERATIONS)
    for op, (where, options, want) in specs.items():
        spec = {"operation": op, **where, "options": options, "output": {"path": f"{scratch}/out/{op}", "format": "csv"}}
        got = run_job(spark, spec).first().asDict()
        assert {k: got[k] for k in want} == want, op
    assert sorted(d for d in os.listdir(f"{scratch}/out/split_sources") if "=" in d) == ["_target=w_one", "_target=w_two"]
    one = spark.read.option("header", True).csv(f"{scratch}/out/split_sources/_target=w_one")
    assert rows(one, "k", "n") == [("1", "a")]


def test_a_split_without_output_says_so(spark, scratch):
    empty = _write(f"{scratch}/e.csv", "id,name\n")
    for op, options in (("split_lines", {}), ("split_columns", {"split_columns": ["id"], "keep_columns": ["name"]})):
        with pytest.raises(ValueError, match="no data|no group"):
            run_job(spark, {"operation": op, "a": empty, "options": options, "output": {"path": f"{scratch}/{op}"}})


def test_streams_do_not_share_a_checkpoint(spark, scratch):
    from tabrecon.streaming.reconcile import start

    schema = spark.read.parquet(f"{SF_SMALL}/region.parquet").schema
    os.makedirs(f"{scratch}/in")
    with pytest.raises(ValueError, match="name"):
        start(spark.readStream.schema(schema).parquet(f"{scratch}/in"), f"{scratch}/out")
