"""CSV source (R36): header row, comma, quoted fields, UTF-8 with a Latin-1 fallback per
file, pandas' NA tokens read as null, column types inferred by one aggregate."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Sequence
from functools import reduce
from pathlib import PurePosixPath
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import quote, strip
from .csv_records import ASCII_LIKE, record_table

# The cell texts pandas' ``read_csv`` reads as missing by default.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# The texts pandas reads as booleans.
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")

_INT = r"^[+-]?[0-9]+$"
_TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}( [0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?)?$"
_FLOAT = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))$"


def dedupe_header(names: Sequence[str | None]) -> list[str]:
    """pandas' header names: blank -> ``Unnamed: i``; repeats -> ``a``, ``a.1``, ``a.2``."""
    out: list[str] = []
    used: set[str] = set()
    for i, raw in enumerate(names):
        name = raw if raw not in (None, "") else f"Unnamed: {i}"
        if name in used:
            k = 1
            while f"{name}.{k}" in used:
                k += 1
            name = f"{name}.{k}"
        used.add(name)
        out.append(name)
    return out


def _reader(spark: SparkSession, encoding: str, multi_line: bool):
    return (spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
            .option("encoding", encoding).option("mode", "PERMISSIVE"))


_EXTRA = "_more_fields_than_the_header"


class FileKind(NamedTuple):
    """What one pass over a file's lines tells: its encoding, whether a quoted field may hold a line
    end (some line has an odd number of quotes), its first line, and its lines that are not blank."""

    file: str
    encoding: str
    open: bool
    header: str
    lines: int


def file_kinds(spark: SparkSession, paths: Sequence[str]) -> list[FileKind]:
    """The kind of every file, by path: one distributed pass over the lines, one small row per file
    back to the driver. UTF-8 if every line is valid UTF-8, else Latin-1."""
    first = F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id())
    line = F.col("value")
    rows = (spark.read.text(list(paths))
            .select(F.col("_metadata.file_path").alias("f"), F.is_valid_utf8("value").alias("ok"), line.alias("line"), first.alias("n"),
                    ((F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1).alias("open"))
            .groupBy("f").agg(F.bool_and("ok").alias("ok"), F.bool_or("open").alias("open"),
                              F.min_by("line", "n").alias("header"), F.count_if(F.trim("line") != "").alias("lines")).orderBy("f").collect())
    return [FileKind(r["f"], "UTF-8" if r["ok"] else "ISO-8859-1", r["open"], r["header"] or "", r["lines"]) for r in rows]


def kind_counts(v: Column) -> list[Column]:
    """Aggregates that tell a text column's type: how many values there are, and how many read as an integer,
    a number, a boolean and a timestamp. Counts of parts add up to counts of the whole."""
    return [F.count(v), F.count(F.when(v.rlike(_INT) & v.try_cast("long").isNotNull(), 1)),
            F.count(F.when(v.rlike(_FLOAT) & v.try_cast("double").isNotNull(), 1)),
            F.count(F.when(v.isin(*TRUE_TOKENS, *FALSE_TOKENS), 1)), F.count(F.when(v.rlike(_TIMESTAMP), 1))]


KINDS = ("bigint", "double", "boolean", "timestamp_ntz")


def kind_of(counts: Sequence[int]) -> str:
    """The type that every value reads as, from ``kind_counts``; else (or without a value) ``string``."""
    n, *each = counts
    return next((kind for kind, c in zip(KINDS, each, strict=True) if n and c == n), "string")


def typed(c: Column, kind: str) -> Column:
    """The text column as its type."""
    v = strip(c)
    if kind == "string":
        return c
    if kind == "boolean":
        return F.when(v.isin(*TRUE_TOKENS), True).when(v.isNotNull(), False)
    return v.try_cast(kind)


def infer_types(df: DataFrame) -> DataFrame:
    """Cast text columns to BIGINT, DOUBLE, BOOLEAN or TIMESTAMP when every non-null
    value reads as one (one aggregate job over the table, a single row back to the
    driver). Timestamps are recognised only in the ISO form workbook dates are given in."""
    checks = [c.alias(f"c{j}_{k}") for j, n in enumerate(df.columns) for k, c in enumerate(kind_counts(strip(F.col(quote(n)))))]
    if not checks:
        return df
    stats = df.agg(*checks).first()
    return df.select(*[typed(F.col(quote(n)), kind_of(stats[5 * j:5 * j + 5])).alias(n) for j, n in enumerate(df.columns)])


def read_csv(spark: SparkSession, paths: str | Sequence[str], *, infer: bool = True,
             multi_line: bool | None = None, na_tokens: Sequence[str] = NA_TOKENS,
             encoding: str | None = None) -> DataFrame:
    """Read CSV files (or folders of them) with a header row into one DataFrame.

    Columns are matched by name: files whose header differs in names or order are read by their
    own header, and a column that a file lacks is null there. A row with more fields than its
    header raises when it is read; one with fewer is filled with nulls. Every file is split over
    several tasks. Where a quoted field holds a line end (found in the one pass that also detects the
    encoding), records are first put together over lines and splits (``csv_records``) and written
    once to the shared checkpoint folder. ``encoding``, given, holds for every file, and so does
    ``multi_line``: True reads each file in one task by Spark's own reader, False takes every line for a record."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no CSV path given")
    for p in paths:
        suffix = PurePosixPath(p).suffix.lower()
        if suffix and suffix != ".csv":
            raise ValueError(f"unsupported file type: {p}")
    kinds = file_kinds(spark, paths)
    if not kinds:
        raise ValueError(f"{paths} hold no data")
    plain: dict[tuple[str, bool, str], list[str]] = {}
    apart: dict[str, list[str]] = {}
    for kind in kinds:
        enc = encoding or kind.encoding
        if multi_line is None and kind.open and enc.upper() in ASCII_LIKE:
            apart.setdefault(enc, []).append(kind.file)
        else:
            many = kind.open if multi_line is None else multi_line
            plain.setdefault((enc, many, kind.header), []).append(kind.file)
    na = list(na_tokens)
    frames = [_plain_files(spark, files, enc, many, na) for (enc, many, _), files in plain.items()]
    for enc, files in apart.items():
        frames += _files_of_records(record_table(spark, files, enc), na)
    df = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
    return infer_types(df) if infer else df


def _cells(names: Sequence[str], na: list[str], file: str, of: Callable[[str], Column]) -> list[Column]:
    """The named cells, NA tokens null; a row with one more than that raises."""
    ragged = F.raise_error(F.lit(f"a row has more fields than the header of {file}")).cast("string")
    cells = [F.when(of(n).isin(na), F.lit(None)).otherwise(of(n)) for n in names]
    cells[0] = F.when(of(_EXTRA).isNotNull(), ragged).otherwise(cells[0])
    return [c.alias(n) for c, n in zip(cells, names, strict=True)]


def _text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in [*names, _EXTRA]])


def _plain_files(spark: SparkSession, files: list[str], enc: str, many: bool, na: list[str]) -> DataFrame:
    """Files with one header, by Spark's reader."""
    header = (spark.read.option("header", False).option("multiLine", many).option("escape", '"')
              .option("encoding", enc).csv(files[0]).first())
    names = dedupe_header(list(header))
    df = _reader(spark, enc, many).schema(_text_schema(names)).csv(files)
    return df.select(*_cells(names, na, files[0], lambda n: F.col(quote(n))))


def _files_of_records(records: DataFrame, na: list[str]) -> list[DataFrame]:
    """A table per header of the files behind ``records``."""
    options = {"escape": '"', "mode": "PERMISSIVE"}
    heads = records.where("is_header").groupBy("record").agg(F.sort_array(F.collect_set("file")).alias("files"))
    out = []
    for record, files in sorted(tuple(r) for r in heads.collect()):
        names = header_names(record)
        ddl = ", ".join(f"{quote(f.name)} string" for f in _text_schema(names))
        row = records.where(~F.col("is_header") & F.col("file").isin(files)).select(F.from_csv("record", ddl, options).alias("c"))
        out.append(row.select(*_cells(names, na, files[0], lambda n: F.col("c").getField(n))))
    return out


def header_names(record: str) -> list[str]:
    """The column names of a header record."""
    return dedupe_header(next(csv.reader(io.StringIO(record.lstrip("\ufeff"), newline="")), []))

