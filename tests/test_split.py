"""Splits: group tokens (R32, D15), manifests, line split (R33), by source (R34), writes."""

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabrecon import (as_sheets, line_numbers, manifest, split_by_columns, split_by_lines, split_by_source,
                      split_manifest, write_split)
from tests.conftest import rows


@pytest.fixture()
def groups(spark):
    data = [("a/b", "x", 1), ("a:b", "x", 2), ("a", "x", 3), ("a ", "x", 4), ("", "", 5), (None, "x", 6),
            ("y" * 300, "x", 7), ("a", "x", 8), ("a_b", "c", 9), ("a", "b_c", 10)]
    return spark.createDataFrame(data, "g1 string, g2 string, v long")


def test_tokens(groups):
    t = {r["v"]: r["_group"] for r in split_by_columns(groups, ["g1", "g2"], ["v"]).collect()}
    assert t[3] == t[8] == "a_x"
    assert t[1].startswith("a_b_x~") and t[2].startswith("a_b_x~") and t[1] != t[2]
    assert t[4].startswith("a_x~")
    assert t[5].startswith("(vide)~")
    assert t[6].startswith("(null)_x~")
    assert len(t[7]) == 200 and "~" in t[7]
    assert t[9] != t[10]
    assert len(set(t.values())) == 9


def test_single_column_clean_tokens_have_no_hash(spark):
    df = spark.createDataFrame([("A_1",), ("B",)], "g string")
    assert rows(split_by_columns(df, ["g"], ["g"]), "_group") == [("A_1",), ("B",)]


def test_split_validation(groups):
    with pytest.raises(ValueError):
        split_by_columns(groups, ["nope"], ["v"])
    with pytest.raises(ValueError):
        split_by_columns(groups, [], ["v"])
    with pytest.raises(ValueError):
        split_by_columns(groups, ["g1"], [])
    assert split_by_columns(groups, ["g1", "nope"], ["v", "nope"]).columns == ["v", "_group"]


def test_manifest_counts_sum(groups):
    m = manifest(split_by_columns(groups, ["g1", "g2"], ["v"]))
    assert m.agg(F.sum("n_rows")).first()[0] == groups.count()
    assert rows(split_manifest(groups, ["g1", "g2"])) == rows(m)


@pytest.mark.parametrize("n_rows", [0, 1, 199, 200, 201, 1000])
def test_split_by_lines_parts(spark, n_rows):
    df = spark.range(n_rows).repartition(5).select(F.col("id").alias("pk"))
    tagged = split_by_lines(df, 200, order=["pk"])
    got = rows(tagged, "pk", "_part")
    assert got == [(i, i // 200 + 1) for i in range(n_rows)]


def test_line_numbers_equal_row_number(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.col("id")).repartition(7)
    ours = line_numbers(df, ["k", "id"], "ln")
    ref = df.withColumn("ln", F.row_number().over(Window.orderBy("k", "id")))
    assert rows(ours, "id", "ln") == rows(ref, "id", "ln")


def test_line_numbers_plan_keeps_rows_distributed(spark):
    df = spark.range(1000).select(F.col("id").alias("pk"))
    plan = line_numbers(df, ["pk"], "ln")._jdf.queryExecution().executedPlan().toString()
    data_side = plan.split("BroadcastExchange")[0]
    assert "SinglePartition" not in data_side


def test_split_by_source(spark):
    nation = spark.createDataFrame([(1, "n1"), (2, "n2")], "k int, name string")
    region = spark.createDataFrame([(1, "r1")], "k int, name string")
    solo = spark.createDataFrame([(1, "s")], "k int, name string")
    long = as_sheets("dir/all.xlsx", {"nation": nation, "region": region}).unionByName(
        as_sheets("dir/one.xlsx", {"only": solo}))
    m = manifest(split_by_source(long, "{fichier}_{onglet}/x"), by="_target")
    assert rows(m) == [("all_nation_x", 2), ("all_region_x", 1)]


def test_write_split_folders(spark, scratch, groups):
    tagged = split_by_columns(groups, ["g2"], ["v"])
    write_split(tagged, f"{scratch}/cols", fmt="csv")
    dirs = sorted(d for d in os.listdir(f"{scratch}/cols") if d.startswith("_group="))
    assert len(dirs) == 4
    back = spark.read.option("header", True).csv(f"{scratch}/cols")
    assert back.count() == groups.count()
    lines = split_by_lines(groups.select("v"), 3, order=["v"])
    write_split(lines, f"{scratch}/lines")
    assert sorted(d for d in os.listdir(f"{scratch}/lines") if d.startswith("_part="))[:3] == ["_part=1", "_part=2", "_part=3"]


def test_per_sheet_split(spark):
    long = as_sheets("f.xlsx", {"s/1": spark.createDataFrame([("a",)], "g string")})
    tagged = split_by_columns(long.select("_sheet", F.col("cells")["g"].alias("g")), ["g"], ["g"], per_sheet=True)
    assert tagged.first()["_sheet_dir"] == "s_1"


def test_file_order_lines_match_file_row_number(spark):
    import duckdb

    from tabrecon.operators.split import file_line_numbers

    path = "/root/testdata/sf0.01/lineitem.parquet"
    ours = file_line_numbers(spark.read.parquet(path), "ln").select("l_orderkey", "l_linenumber", "ln")
    ref = duckdb.sql(f"SELECT l_orderkey, l_linenumber, file_row_number + 1 AS ln "
                     f"FROM read_parquet('{path}', file_row_number=true)").fetchall()
    assert rows(ours) == sorted(ref)
    plan = ours._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Sort [" not in plan.split("BroadcastExchange")[0]


def test_file_order_lines_across_files(spark, scratch):
    for i, n in enumerate([3, 5]):
        spark.range(n).selectExpr(f"{i} AS f", "id").coalesce(1).write.parquet(f"{scratch}/multi/part{i}")
    df = spark.read.parquet(f"{scratch}/multi/part0", f"{scratch}/multi/part1")
    got = rows(split_by_lines(df, 2), "f", "id", "_part")
    assert got == [(0, 0, 1), (0, 1, 1), (0, 2, 2), (1, 0, 2), (1, 1, 3), (1, 2, 3), (1, 3, 4), (1, 4, 4)]
    with pytest.raises(ValueError, match="moved"):
        split_by_lines(spark.range(3).orderBy("id"), 2)


def test_line_numbers_with_a_hot_order_value_spread_over_partitions(spark):
    df = spark.range(40000).select(F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep the range partitions visible
    try:
        numbered = line_numbers(df, ["k"], "ln")
        sizes = numbered.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r["ln"] for r in numbered.select("ln").collect()) == list(range(1, 40001))
    assert len(sizes) > 3 and max(r["count"] for r in sizes) < 40000 / 3
