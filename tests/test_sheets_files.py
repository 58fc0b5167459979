"""All sheets in one job (R38, R40), file sets of keys (R7–R10), line offsets without one task."""

import pytest
from pyspark.sql import functions as F

from tabrecon import combine, intersect_many, split_by_lines, subtract_many
from tabrecon.operators.membership import with_file_sets
from tabrecon.sources.workbook import combine_sheets, read_all_sheets, read_workbooks, select_sheet, sheet_schemas
from tests.conftest import SF_SMALL, rows
from tests.test_plans import _final_plan, big_b  # noqa: F401
from tests.test_sources import _xlsx


def jobs_of(spark, act):
    group = f"jobs-{id(act)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        return act(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def workbooks(folder, sheets, files=("one", "two")):
    content = {f"s{k}": [["id", "v", "x" if k % 2 else "y", "mix"]] + [[i, i + 0.5 if k % 3 else i, f"t{i}", True if k % 4 == 1 else i] for i in range(k % 5)]
               for k in range(sheets)}
    content["blank"] = []
    for name in files:
        with open(f"{folder}/{name}.xlsx", "wb") as f:
            f.write(_xlsx(content))


def test_types_of_all_sheets_in_one_job(spark, tmp_path):
    found = {}
    for n in (2, 20):
        folder = tmp_path / str(n)
        folder.mkdir()
        workbooks(folder, n)
        frames, found[n] = jobs_of(spark, lambda: read_all_sheets(spark, str(folder)))  # noqa: B023
        assert len(frames) == 2 * (n + 1)
    assert found[2] == found[20]  # adaptive execution counts each shuffle as a job


def test_combine_of_twenty_sheets(spark, tmp_path):
    workbooks(tmp_path, 20, ["one"])
    long = read_workbooks(spark, str(tmp_path))
    whole, each = combine_sheets(long), combine(read_all_sheets(spark, str(tmp_path)))
    assert dict(whole.dtypes) == dict(each.dtypes)
    assert rows(whole, *each.columns) == rows(each)
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1


def test_combine_of_sheets_with_choices(spark, tmp_path):
    workbooks(tmp_path, 3)
    long = read_workbooks(spark, str(tmp_path))
    one = combine_sheets(long, columns=["mix", "id"], dedup=True)
    assert rows(one) == rows(combine(read_all_sheets(spark, str(tmp_path)), columns=["mix", "id"], dedup=True))
    first = combine_sheets(long, dedup=True, dedup_key="id")
    assert rows(first) == rows(combine(read_all_sheets(spark, str(tmp_path)), dedup=True, dedup_key="id"))


def test_sheet_schemas(spark, tmp_path):
    with open(tmp_path / "w.xlsx", "wb") as f:
        f.write(_xlsx({"a": [["n", "f", "t", "b", "none"], [1, 1.5, "x", True, None], [2, 2, 3, False, None]], "blank": [], "head": [["z"]]}))
    long = read_workbooks(spark, str(tmp_path / "w.xlsx"))
    assert [(s.sheet, s.index, s.columns) for s in sheet_schemas(long)] == [
        ("a", 0, {"n": "bigint", "f": "double", "t": "string", "b": "boolean", "none": "string"}), ("blank", 1, {}), ("head", 2, {"z": "string"})]
    table = select_sheet(long, None, "a")
    assert table.columns == ["n", "f", "t", "b", "none"] and table.count() == 2


def tables(spark, n):
    key = F.when(F.col("c_custkey") % (n + 3) == 0, None).otherwise(F.col("c_custkey"))
    customer = spark.read.parquet(f"{SF_SMALL}/customer.parquet").select(key.alias("k"), "c_name")
    return [customer.where(F.col("c_name").substr(-1, 1) != str(i % 10)).withColumn(f"only{i}", F.lit(i)) for i in range(n)]


@pytest.mark.parametrize("n", [2, 20])
def test_one_join_for_many_files(spark, big_b, n):  # noqa: F811
    frames = tables(spark, n)
    one = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select((F.col("o_custkey") * 2).alias("k"), "o_orderkey")
    outputs = [subtract_many(frames, one, "k"), intersect_many(frames, one, "k").data, intersect_many(one, frames, "k", include_not_found=True).not_found,
               intersect_many(frames, one, "k", include_not_found=True).not_found, with_file_sets(one, "k", frames, "k")]
    for df in outputs:
        plan = _final_plan(df)
        plan = plan[:plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
        assert plan.count("Join ") == 1, plan


@pytest.mark.parametrize("n", [2, 70])
def test_file_sets_tell_matches_of_every_file(spark, n):
    frames = tables(spark, n)
    one = spark.createDataFrame([(str(k) if k else None, k) for k in range(0, 160)], "k string, i int").unionAll(spark.createDataFrame([(" 7 ", -7), ("", -1)], "k string, i int"))
    keys = [{"" if r["k"] is None else str(r["k"]) for r in f.collect()} for f in frames]
    for r in with_file_sets(one, "k", frames, "k").collect():
        key = (r["k"] or "").strip()
        assert r["_files"] == [i for i, held in enumerate(keys) if key in held], r


def test_line_offsets_without_a_single_task(spark, scratch, monkeypatch):
    import tabrecon.operators.split as split

    monkeypatch.setattr(split, "LINE_BLOCK", 7)
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    for df in (split_by_lines(orders, 200), split_by_lines(orders.where("o_orderkey % 3 <> 0"), 200), split_by_lines(orders, 200, order=["o_orderkey"])):
        assert "SinglePartition" not in _final_plan(df)
        sizes = [r["count"] for r in df.groupBy("_part").count().orderBy("_part").collect()]
        assert set(sizes[:-1]) == {200} and 0 < sizes[-1] <= 200
