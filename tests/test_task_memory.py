"""Memory of one task that does not grow with the table: line offsets and workbooks."""

import tracemalloc
import zipfile
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import functions as F

from tabrecon import as_workbooks, parse_workbooks, split_by_lines
from tabrecon.sinks.workbook import _workbooks
from tabrecon.sources.workbook import _sheet_rows, _sheet_targets
from tests.conftest import rows
from tests.test_plans import _final_plan, big_b  # noqa: F401


def test_lines_of_a_large_file_are_not_joined_in_one_task(spark, scratch, big_b):  # noqa: F811
    for name, start in (("a", 0), ("b", 1000)):
        spark.range(start, start + 1000, 1, 1).write.mode("append").parquet(f"{scratch}/{name}")
    df = split_by_lines(spark.read.parquet(f"{scratch}/a", f"{scratch}/b"), 300)
    plan = _final_plan(df)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan, plan
    assert df.where(F.col("_part") != F.floor(F.col("id") / 300) + 1).count() == 0 and df.count() == 2000


def test_workbooks_in_parts(spark):
    df = spark.range(0, 5000, 1, 4).select("id", F.when(F.col("id") % 7 > 0, F.col("id") / 2).alias("f"), F.when(F.col("id") % 5 > 0, F.sha2(F.col("id").cast("string"), 256)).alias("t"))
    path = F.when(F.col("id") % 4 > 0, F.concat(F.lit("p"), (F.col("id") % 4).cast("string")))
    sheet = F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), (F.col("id") % 3).cast("string")))
    whole, parts = (as_workbooks(df, path, sheet, order=["id"], part_bytes=n) for n in (None, 4096))
    assert parts.groupBy("path").count().where("count > 5").count() == 4 and whole.count() == 4
    # A table that has been moved comes together again.
    long, again = parse_workbooks(whole), parse_workbooks(parts.repartition(5, "part"))
    assert rows(again.drop("cells")) == rows(long.drop("cells")) and long.where("_row > 0").count() == df.where("id % 3 > 0").count()
    cells = lambda t: rows(t.select("_file", "_sheet", "_row", F.to_json("cells")))
    assert cells(again) == cells(long)
    inner = again.where("_row > 0").select("_file", "_sheet", "_row", F.col("cells.id").cast("long").alias("id")).orderBy("_file", "_sheet", "_row").collect()
    assert all(x["id"] < y["id"] for x, y in pairwise(inner) if tuple(x)[:2] == tuple(y)[:2])


def test_workbook_memory_does_not_grow_with_its_rows():
    """Peak of a task's Python objects while rows are written and read again, for 4 and 16 thousand rows."""
    peaks = {}
    for n in (4, 16):
        batches = lambda: (pa.RecordBatch.from_arrays([pa.array(["p"] * 1000), pa.array(["s"] * 1000),
                                                       pa.array([f"{k}-{i}-{'x' * 300}" for i in range(1000)])], names=list("abc")) for k in range(n))  # noqa: B023
        tracemalloc.start()
        for path, out in _workbooks(batches(), ["t"]):
            with zipfile.ZipFile(out) as zf:
                (_, target), = _sheet_targets(zf)
                assert path == "p" and sum(1 for _ in _sheet_rows(zf, target, [], set())) == 1000 * n + 1
        peaks[n] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert peaks[16] < 1.3 * peaks[4], peaks
