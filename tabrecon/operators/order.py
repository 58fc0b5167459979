"""Row order as data: "first" and "line n" need an explicit, total order (rule D1).

Spark DataFrames are unordered, so the reference's file order becomes a column.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import quote

ROW_ID = "_row_id"


def with_file_order(df: DataFrame, *, position: int = 0, name: str = ROW_ID) -> DataFrame:
    """Tag each row of a file scan with ``struct(position, file path, row index)``.

    ``_metadata.row_index`` exists for parquet scans; it is stable across retries, so
    the order survives lost executors. ``position`` orders several inputs (A before B).
    """
    meta = F.col("_metadata")
    return df.withColumn(
        name,
        F.struct(F.lit(position).alias("pos"), meta.getField("file_path").alias("file"),
                 meta.getField("row_index").alias("row")),
    )


# Plan nodes that keep the rows of their input in place.
_IN_PLACE = frozenset(("Project", "Filter", "SubqueryAlias", "LogicalRelation", "HadoopFsRelation", "DataSourceV2Relation",
                       "DataSourceV2ScanRelation", "Relation", "LocalRelation", "Range", "MapInPandas", "MapInArrow", "View"))


def plan_nodes(df: DataFrame) -> set[str]:
    """Names of the operators in ``df``'s analysed plan (no job runs)."""
    found, open_ = set(), [df._jdf.queryExecution().analyzed()]
    while open_:
        node = open_.pop()
        found.add(str(node.nodeName()).split(" ")[0])
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return found


def source_order(df: DataFrame, name: str) -> DataFrame:
    """Tag each row with its place in file order (D1), for a table read from files.

    A parquet scan knows each row's file and place. Other scans know the file and the split;
    within a split, and in a parsed workbook, rows come in order, so a running number taken in
    the task that reads them completes the order. Filters and projections may follow the read;
    anything that moves rows (join, sort, union, aggregate) needs an order by the caller."""
    def analysed(make) -> DataFrame | None:
        try:
            tagged = make()
            tagged.schema
        except AnalysisException:
            return None
        return tagged

    def place(file: Column, block: Column, row: Column) -> Column:
        return F.struct(file.cast("string").alias("file"), block.cast("long").alias("block"), row.cast("long").alias("row"))

    meta, running = F.col("_metadata"), F.monotonically_increasing_id()
    tagged = analysed(lambda: df.withColumn(name, place(meta.getField("file_path"), F.lit(0), meta.getField("row_index"))))
    if tagged is not None:
        return tagged
    if not plan_nodes(df) <= _IN_PLACE:
        raise ValueError("rows of this table have been moved since it was read; pass an order (such as order_b=[...]) to say which row is first")
    tagged = analysed(lambda: df.withColumn(name, place(meta.getField("file_path"), meta.getField("file_block_start"), running)))
    return tagged if tagged is not None else df.withColumn(name, place(F.lit(""), F.lit(0), running))


def order_columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(quote(c)) if isinstance(c, str) else c for c in order]


def first_per_key(df: DataFrame, key: str | Column, order: Sequence[str | Column]) -> DataFrame:
    """Keep the first row of each key value in ``order`` (null is a key of its own).

    ``row_number() = 1`` plans a partial ``WindowGroupLimit`` before the shuffle, so each
    map task sends at most one row per key: a key that holds a third of the rows costs
    one row per task on the network, not a third of the table. ``dropDuplicates`` is not
    used, since it keeps an arbitrary row.
    """
    if not order:
        raise ValueError("first_per_key needs an order (rule D1: 'first' is by row order)")
    key_col = F.col(quote(key)) if isinstance(key, str) else key
    rn = f"_rn_{uuid.uuid4().hex[:8]}"
    w = Window.partitionBy(key_col).orderBy(*order_columns(order))
    return df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) == 1).drop(rn)
