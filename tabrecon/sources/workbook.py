"""Workbook (.xlsx) ingest (R37, R38): every sheet of every file as one long table.

``binaryFile`` lists the files and ``mapInPandas`` parses one workbook per task with the
standard library (zip + streamed XML), emitting one row per sheet row:
``(_file, _sheet, _sheet_index, _sheet_count, _row, cells map<string,string>)`` where ``cells`` maps
each header name of the sheet to the cell's text (all header names present, empty
cells and NA tokens null). A column beyond the header is named as pandas names it; a blank
line is a row of nulls; every sheet's header is row 0, so sheets without rows are there too.
Files are parsed in parallel; memory per task is bounded by one workbook's content (given in parts:
by one batch of parts, as they go to a file of the task), its shared-string table and one output batch. A sheet is at
most 1,048,576 rows.
"""

from __future__ import annotations

import datetime
import io
import re
import tempfile
import zipfile
from collections.abc import Iterator, Sequence
from typing import BinaryIO, NamedTuple
from xml.etree.ElementTree import iterparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip, text_form
from ..operators.keys import helper_name
from ..session import ship_package
from .csv import NA_TOKENS, dedupe_header, kind_counts, kind_of, typed

_MISSING = frozenset(NA_TOKENS)

# XML namespaces of the Office Open XML spreadsheet format.
MAIN_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
DOC_REL_NS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PKG_REL_NS = "{http://schemas.openxmlformats.org/package/2006/relationships}"

LONG_SCHEMA = T.StructType([
    T.StructField("_file", T.StringType()),
    T.StructField("_sheet", T.StringType()),
    T.StructField("_sheet_index", T.IntegerType()),
    T.StructField("_sheet_count", T.IntegerType()),
    T.StructField("_row", T.LongType()),
    T.StructField("cells", T.MapType(T.StringType(), T.StringType())),
])
BATCH_ROWS = 10_000
PARTS_AT_ONCE = 8 << 20  # bytes of parts sent to a worker together
_INT_TEXT = re.compile(r"^-?[0-9]+$")
# Built-in spreadsheet number formats that display dates/times, and the
# day the serial date 0 stands for (1900 date system, with its leap-year quirk).
DATE_FORMAT_IDS = frozenset(range(14, 23)) | {45, 46, 47}
EPOCH = datetime.datetime(1899, 12, 30)
_DATE_CODE = re.compile(r"[dmyhs]", re.IGNORECASE)


def _column_index(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + (ord(ch.upper()) - 64)
    return n - 1


def _sheet_targets(zf: zipfile.ZipFile) -> list[tuple[str, str]]:
    rels = {}
    for _, el in iterparse(zf.open("xl/_rels/workbook.xml.rels")):
        if el.tag == PKG_REL_NS + "Relationship":
            target = el.get("Target", "")
            target = target.lstrip("/") if target.startswith("/") else "xl/" + target
            rels[el.get("Id")] = target
    sheets = []
    for _, el in iterparse(zf.open("xl/workbook.xml")):
        if el.tag == MAIN_NS + "sheet":
            sheets.append((el.get("name"), rels.get(el.get(DOC_REL_NS + "id"), "")))
    return sheets


def _shared_strings(zf: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in zf.namelist():
        return []
    out = []
    for _, el in iterparse(zf.open("xl/sharedStrings.xml")):
        if el.tag == MAIN_NS + "si":
            out.append("".join(t.text or "" for t in el.iter(MAIN_NS + "t")))
            el.clear()
    return out


def _date_styles(zf: zipfile.ZipFile) -> set[int]:
    """Indexes of cell styles whose number format shows a date or time."""
    if "xl/styles.xml" not in zf.namelist():
        return set()
    custom: dict[int, str] = {}
    styles: list[int] = []
    in_xfs = False
    for event, el in iterparse(zf.open("xl/styles.xml"), events=("start", "end")):
        if el.tag == MAIN_NS + "numFmt" and event == "end":
            custom[int(el.get("numFmtId", "0"))] = el.get("formatCode", "")
        elif el.tag == MAIN_NS + "cellXfs":
            in_xfs = event == "start"
        elif el.tag == MAIN_NS + "xf" and event == "start" and in_xfs:
            styles.append(int(el.get("numFmtId", "0")))
    dates = set()
    for index, fmt in enumerate(styles):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", custom.get(fmt, ""))  # drop literals, [colors], \x
        if fmt in DATE_FORMAT_IDS or (fmt in custom and _DATE_CODE.search(code)):
            dates.add(index)
    return dates


def _date_text(v: str) -> str:
    """A serial date as pandas prints a timestamp (microseconds only when present)."""
    moment = EPOCH + datetime.timedelta(days=float(v))
    moment = moment.replace(microsecond=round(moment.microsecond / 1000) * 1000 % 1_000_000)
    return moment.isoformat(sep=" ")


def _number_text(v: str) -> str:
    """A numeric cell as pandas prints it: integers as such, other numbers as Python floats."""
    if _INT_TEXT.match(v):
        return v
    try:
        return repr(float(v))
    except ValueError:
        return v


def _cell_text(el, shared: list[str], dates: set[int]) -> str | None:
    kind = el.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in el.iter(MAIN_NS + "t"))
    v = el.find(MAIN_NS + "v")
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "True" if v.text.strip() == "1" else "False"
    if kind == "n":
        if dates and int(el.get("s", "0")) in dates:
            return _date_text(v.text)
        return _number_text(v.text)
    return v.text


def _row_elements(zf: zipfile.ZipFile, target: str) -> Iterator:
    """Every row element of a sheet; the sheet lets go of a row once the next is asked for."""
    data = None
    with zf.open(target) as content:
        for event, el in iterparse(content, events=("start", "end")):
            if event == "end" and el.tag == MAIN_NS + "row":
                yield el
                el.clear()
                if data is not None:
                    data.clear()
            elif event == "start" and el.tag == MAIN_NS + "sheetData":
                data = el


def _sheet_rows(zf: zipfile.ZipFile, target: str, shared: list[str],
                dates: set[int]) -> Iterator[dict[int, str | None]]:
    """Every line of the sheet up to the last one stored, blank ones included."""
    line = 0
    for el in _row_elements(zf, target):
        number = int(el.get("r") or line + 1)
        for _ in range(line + 1, number):
            yield {}
        line = number
        row: dict[int, str | None] = {}
        pos = -1
        for c in el.iter(MAIN_NS + "c"):
            ref = c.get("r")
            pos = _column_index(ref) if ref else pos + 1
            row[pos] = _cell_text(c, shared, dates)
        yield row


def _sheet_width(zf: zipfile.ZipFile, target: str) -> int:
    """Columns up to the last cell with a value in any line."""
    width = 0
    for el in _row_elements(zf, target):
        pos = -1
        for c in el.iter(MAIN_NS + "c"):
            ref = c.get("r")
            pos = _column_index(ref) if ref else pos + 1
            if len(c):
                width = max(width, pos + 1)
    return width


def parse_workbook(path: str, content: bytes | BinaryIO) -> Iterator[pd.DataFrame]:
    """Rows of every sheet of one workbook, in batches of long-table rows."""
    with zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content) as zf:
        shared = _shared_strings(zf)
        dates = _date_styles(zf)
        sheets = _sheet_targets(zf)
        for index, (sheet, target) in enumerate(sheets):
            rows = _sheet_rows(zf, target, shared, dates)
            first = next(rows, {})
            width = _sheet_width(zf, target)
            header = dedupe_header([first.get(i) for i in range(width)])
            batch: list[tuple] = [(path, sheet, index, len(sheets), 0, dict.fromkeys(header))]
            for n, row in enumerate(rows, start=1):
                cells = {header[i]: None if row.get(i) in _MISSING else row.get(i) for i in range(width)}
                batch.append((path, sheet, index, len(sheets), n, cells))
                if len(batch) >= BATCH_ROWS:
                    yield pd.DataFrame(batch, columns=LONG_SCHEMA.fieldNames())
                    batch = []
            if batch:
                yield pd.DataFrame(batch, columns=LONG_SCHEMA.fieldNames())


def _parse_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            yield from parse_workbook(path, bytes(content))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, BinaryIO]]:
    """(path, file with its content) of each workbook in parts sorted by path and part."""
    at, out = None, None
    for batch in batches:
        for path, part, content in zip(*batch.columns, strict=True):
            if part.as_py() == 0:
                if out is not None:
                    yield at, out
                    out.close()
                at, out = path.as_py(), tempfile.TemporaryFile()
            out.write(content.as_buffer())
    if out is not None:
        yield at, out
        out.close()


def _parse_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("_file", pa.string()), ("_sheet", pa.string()), ("_sheet_index", pa.int32()), ("_sheet_count", pa.int32()),
                        ("_row", pa.int64()), ("cells", pa.map_(pa.string(), pa.string()))])
    for path, out in _joined(batches):
        for rows in parse_workbook(path, out):
            cells = pa.array([list(c.items()) for c in rows["cells"]], schema.field("cells").type)
            yield pa.RecordBatch.from_arrays([*[pa.array(rows[f.name], f.type, from_pandas=True) for f in schema][:-1], cells], schema=schema)


def read_workbooks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All sheets of all ``.xlsx`` files under ``paths`` as one long table."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    ship_package(spark)
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(paths)
             .select("path", "content"))
    return parse_workbooks(files)


def parse_workbooks(files: DataFrame) -> DataFrame:
    """The long table of workbooks given as (path, content), such as ``sinks.workbook.as_workbooks`` makes, or as
    (path, part, content), as it makes with ``part_bytes``: a workbook's parts are put together in a file of the task."""
    ship_package(files.sparkSession)
    if "part" in files.columns:
        files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PARTS_AT_ONCE))
        parts = files.select("path", "part", "content").repartition(F.col("path")).sortWithinPartitions("path", "part")
        return parts.mapInArrow(_parse_parts, LONG_SCHEMA)
    return files.select("path", "content").mapInPandas(_parse_files, schema=LONG_SCHEMA)


def _of_file(file: str | None) -> Column:
    return F.lit(True) if file is None else F.col("_file") == file


class Sheet(NamedTuple):
    """A sheet's place and its columns in order with their types."""

    file: str
    sheet: str
    index: int
    columns: dict[str, str]


def sheet_schemas(long: DataFrame) -> list[Sheet]:
    """Every sheet of a long table, files by path and sheets in workbook order, with the names and types of its
    columns: one job over all sheets of all workbooks, in which a column's type is an aggregate of
    counts per (file, sheet, column). One row per column of a sheet reaches the driver."""
    rows = long.select("_file", "_sheet", "_sheet_index", F.posexplode_outer("cells").alias("at", "name", "text"))
    found = (rows.groupBy("_file", "_sheet_index", "_sheet", "name").agg(F.min("at"), *kind_counts(strip(F.col("text"))))
             .collect())
    sheets: dict[tuple, list] = {}
    for r in found:  # a sheet without a header has one row without a name
        sheets.setdefault(tuple(r)[:3], []).extend([] if r[3] is None else [(r[4], r[3], kind_of(tuple(r)[5:]))])
    return [Sheet(file, sheet, index, {n: kind for _, n, kind in sorted(columns)}) for (file, index, sheet), columns in sorted(sheets.items())]


def sheet_columns(long: DataFrame, file: str | None, sheet: str) -> list[str]:
    """Header names of one sheet, in sheet order (one row fetched). ``file=None``: the
    long table holds one workbook."""
    return list(_one_sheet(long, file, sheet).columns)


def _one_sheet(long: DataFrame, file: str | None, sheet: str | int) -> Sheet:
    where = F.col("_sheet_index") == sheet if isinstance(sheet, int) else F.col("_sheet") == sheet
    found = sheet_schemas(long.where(_of_file(file) & where))
    if not found:
        raise ValueError(f"sheet {sheet!r} not found in {file!r}")
    return found[0]


def _table(long: DataFrame, sheet: Sheet, infer: bool = True) -> DataFrame:
    rows = long.where((F.col("_file") == sheet.file) & (F.col("_sheet_index") == sheet.index) & is_row())
    return rows.select(*[typed(F.col("cells").getItem(n), kind if infer else "string").alias(n) for n, kind in sheet.columns.items()])


def select_sheet(long: DataFrame, file: str | None, sheet: str | int = 0, *, infer: bool = True) -> DataFrame:
    """One sheet (by name or position) as an ordinary table with typed columns (R38), after one job
    that tells header and types.

    ``file=None`` when the long table holds one workbook (e.g. ``read_workbooks`` of one
    path): the default, sheet 0, is then what the reference loads for a workbook input."""
    return _table(long, _one_sheet(long, file, sheet), infer)


def is_row() -> Column:
    """True for the rows of a sheet, not for its header (row 0)."""
    return F.coalesce(F.col("_row") > 0, F.lit(True))


def sheet_list(long: DataFrame) -> list[tuple[str, str]]:
    """``(file, sheet)`` of every sheet, files by path and sheets in
    workbook order — one row per sheet reaches the driver (the combine input list, R40)."""
    rows = (long.groupBy("_file", "_sheet", "_sheet_index").agg(F.count(F.lit(1)).alias("n"))
            .orderBy("_file", "_sheet_index").collect())
    return [(r["_file"], r["_sheet"]) for r in rows]


def read_all_sheets(spark: SparkSession, paths: str | list[str]) -> list[DataFrame]:
    """Every sheet of every workbook as its own typed table, in file then sheet order (R40). Names and
    types of all sheets come from one job (:func:`sheet_schemas`)."""
    long = read_workbooks(spark, paths)
    return [_table(long, sheet) for sheet in sheet_schemas(long)]


def combine_sheets(long: DataFrame, *, columns: Sequence[str] | None = None, dedup: bool = False,
                   dedup_key: str | None = None) -> DataFrame:
    """All sheets of all workbooks stacked by column name: what combining :func:`read_all_sheets` gives, from one
    scan of the workbooks whatever their number of sheets. A column has the type that its sheets agree
    on, double for integers and numbers, else the text of each sheet's own type (D5)."""
    from ..operators.stack import _dedup

    sheets = sheet_schemas(long)
    names = list(dict.fromkeys(n for s in sheets for n in s.columns))
    if columns:
        names = [n for n in columns if n in names]
    if not names:
        raise ValueError("nothing to combine")
    spark = long.sparkSession
    schema = "_file string, _sheet_index int, _kinds map<string,string>"
    kinds = spark.createDataFrame([(s.file, s.index, s.columns) for s in sheets], schema)
    rows = long.where(is_row()).join(kinds, ["_file", "_sheet_index"])
    out = []
    for n in names:
        cell, found = F.col("cells").getItem(n), {s.columns[n] for s in sheets if n in s.columns}
        if len(found) == 1:
            value = typed(cell, *found)
        elif found == {"bigint", "double"}:
            value = typed(cell, "double")
        else:
            kind = F.col("_kinds").getItem(n)
            value = F.coalesce(*[F.when(kind == k, text_form(typed(cell, k), T._parse_datatype_string(k))) for k in sorted(found)])
        out.append(value.alias(n))
    if not dedup or dedup_key is None:
        rows = rows.select(*out)
        return rows.distinct() if dedup else rows
    place = helper_name("place")
    rows = rows.select(*out, F.struct("_file", "_sheet_index", "_row").alias(place))
    return _dedup(rows, names, dedup_key, [F.col(place)])


def _scan_sheets(path: str, content: bytes) -> Iterator[tuple]:
    """(file, sheet, position, rows, columns) of each sheet, streaming its XML once; cells are not kept."""
    with zipfile.ZipFile(io.BytesIO(content)) as zf:
        shared, dates = _shared_strings(zf), _date_styles(zf)
        for index, (sheet, target) in enumerate(_sheet_targets(zf)):
            first, n, width = {}, 0, 0
            for n, row in enumerate(_sheet_rows(zf, target, shared, dates), start=1):
                first = row if n == 1 else first
                width = max([width, *[k + 1 for k, v in row.items() if v is not None]])
            yield path, sheet, index, max(n - 1, 0), dedupe_header([first.get(i) for i in range(width)])


def scan_workbook_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source, sheet, position, row_count, names) of every sheet of the ``.xlsx`` files under ``paths``, read
    in parallel without types or a long table."""
    ship_package(spark)
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(paths)
             .select("path", "content"))
    schema = "source string, sheet string, position int, row_count long, names array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [s for path, content in zip(pdf["path"], pdf["content"]) for s in _scan_sheets(path, bytes(content))]
            yield pd.DataFrame(found, columns=["source", "sheet", "position", "row_count", "names"])

    return files.mapInPandas(run, schema)


__all__ = ["read_workbooks", "read_all_sheets", "combine_sheets", "select_sheet", "sheet_columns", "sheet_list", "sheet_schemas",
           "parse_workbook", "parse_workbooks", "scan_workbook_files", "LONG_SCHEMA"]
