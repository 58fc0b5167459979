"""Source metadata (R39) and ordered multi-file reads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .csv import file_kinds, header_names, read_csv
from .csv_records import record_counts
from .workbook import is_row, read_all_sheets, read_workbooks, scan_workbook_files, select_sheet


def scan_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(source, row_count, columns)`` per table; ``columns`` is the comma-joined header.

    Row counts are exact (rule D13). Each count is a partial/final aggregate over a
    scan that reads no column (parquet answers it from row-group metadata)."""
    if not tables:
        raise ValueError("no table to scan")
    parts = [df.agg(F.count(F.lit(1)).alias("row_count"))
               .select(F.lit(name).alias("source"), "row_count", F.lit(",".join(df.columns)).alias("columns"))
             for name, df in tables.items()]
    return reduce(DataFrame.unionAll, parts)


def scan_workbooks(long: DataFrame) -> DataFrame:
    """``(source, sheet, row_count, columns)`` per sheet of a workbook long table."""
    return (long.groupBy(F.col("_file").alias("source"), F.col("_sheet").alias("sheet"))
            .agg(F.count(F.when(is_row(), 1)).alias("row_count"),
                 F.array_join(F.map_keys(F.first("cells")), ",").alias("columns")))


def scan_paths(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(source, sheet, row_count, columns)`` of the tables behind paths (R39), nothing loaded or typed.

    Parquet: row groups' counts and the schema from the footers, a row per path. ``.xlsx``: a row per sheet, from
    its XML, all workbooks in one job. ``.csv``: a row per file, its records counted in the pass that tells
    whether quoted fields hold line ends, and if so by the states of its splits (``csv_records``). ``sheet`` is
    null but for workbooks. Counts are exact (D13): no header, no blank lines of a CSV, blank rows of a sheet included."""
    paths = list(dict.fromkeys([paths] if isinstance(paths, str) else paths))
    if not paths:
        raise ValueError("no path to scan")
    by: dict[str, list[str]] = {}
    for p in paths:
        kind = p.lower().rstrip("/").rsplit(".", 1)[-1]
        if kind == "xls":
            raise ValueError("legacy .xls workbooks are not supported; save as .xlsx")
        by.setdefault(kind if kind in ("csv", "xlsx") else "parquet", []).append(p)
    sheet = F.lit(None).cast("string").alias("sheet")
    out = []
    for p in by.get("parquet", []):
        df = spark.read.parquet(p)
        out.append(df.agg(F.count(F.lit(1)).alias("row_count"))
                   .select(F.lit(p).alias("source"), sheet, "row_count", F.lit(",".join(df.columns)).alias("columns")))
    if "xlsx" in by:
        out.append(scan_workbook_files(spark, by["xlsx"]).select("source", "sheet", "row_count", F.array_join("names", ",").alias("columns")))
    if "csv" in by:
        out.append(_scan_csv(spark, by["csv"]))
    return reduce(DataFrame.unionAll, out)


def _scan_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    kinds = file_kinds(spark, paths)
    found = [(k.file, None, max(k.lines - 1, 0), ",".join(header_names(k.header))) for k in kinds if not k.open]
    apart: dict[str, list[str]] = {}
    for k in kinds:
        if k.open:
            apart.setdefault(k.encoding, []).append(k.file)
    for enc, files in apart.items():
        found += [(r["file"], None, r["rows"], ",".join(header_names(r["header"]))) for r in record_counts(spark, files, enc).collect()]
    return spark.createDataFrame(found, "source string, sheet string, row_count long, columns string")


def scan(sources: Mapping[str, DataFrame] | DataFrame | str | Sequence[str], spark: SparkSession | None = None) -> DataFrame:
    """Source metadata (R39): paths are scanned where they lie (:func:`scan_paths`), a workbook long table gives one
    row per sheet (``scan_workbooks``), named tables one row per table (``scan_tables``)."""
    if isinstance(sources, DataFrame):
        if "_sheet" not in sources.columns:
            raise ValueError("scan of one DataFrame needs a workbook long table; pass {name: df} for tables")
        return scan_workbooks(sources)
    if isinstance(sources, Mapping):
        return scan_tables(sources)
    return scan_paths(spark or SparkSession.active(), sources)


def read_table(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """One input by suffix: ``.parquet`` / directory of parquet, ``.csv``, or one sheet of
    an ``.xlsx`` workbook (by name or position, default the first) as a typed table."""
    low = path.lower()
    if low.endswith(".csv"):
        return read_csv(spark, path)
    if low.endswith(".xlsx"):
        return select_sheet(read_workbooks(spark, path), None, sheet)
    if low.endswith(".xls"):
        raise ValueError("legacy .xls workbooks are not supported; save as .xlsx")
    return spark.read.parquet(path)


def read_many(spark: SparkSession, paths: Sequence[str], *, all_sheets: bool = False) -> list[DataFrame]:
    """Inputs in the given order, each path once (first occurrence kept).

    A workbook contributes its first sheet (the many-A / many-B modes), or with
    ``all_sheets`` every sheet in workbook order (combine)."""
    seen = list(dict.fromkeys(paths))
    if not seen:
        raise ValueError("add at least one file")
    out: list[DataFrame] = []
    for p in seen:
        if all_sheets and p.lower().endswith(".xlsx"):
            out.extend(read_all_sheets(spark, p))
        else:
            out.append(read_table(spark, p))
    return out
