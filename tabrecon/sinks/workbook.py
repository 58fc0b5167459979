"""Tables as ``.xlsx`` content: one workbook per group of rows, made in parallel.

``as_workbooks`` gives (path, content) rows, the shape ``binaryFile`` reads and ``parse_workbooks`` takes, or
contents in parts. Rows are sorted by Spark and written as they come to a file of the task; with contents in parts a
task's memory does not grow with its workbooks. A
group must fit a workbook (1,048,576 lines a sheet); rows are dealt to groups by the caller. Values are written as
text, numbers and booleans; dates as text."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from functools import partial
from itertools import groupby
from operator import itemgetter
from typing import BinaryIO
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import quote
from ..operators.keys import helper_name
from ..session import ship_package

MOST_LINES = 1_048_576
ROWS_AT_ONCE = 1000  # rows of a batch made into Python values together
# Namespaces and relationship types of the Office Open XML spreadsheet format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
DOC_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PKG_REL = "http://schemas.openxmlformats.org/package/2006/relationships"
TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml."


def _cell(v) -> str:
    if v is None or v != v:
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) and abs(v) != float("inf"):
        return f"<c><v>{v!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'


def write_workbook(out: BinaryIO, sheets: Iterable[tuple[str, Sequence[str], Iterable[Sequence]]]) -> None:
    """Writes a workbook with the given (name, header, rows) sheets, one row after another."""
    names = []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, (name, header, rows) in enumerate(sheets, start=1):
            names.append(name)
            with z.open(f"xl/worksheets/sheet{k}.xml", "w", force_zip64=True) as sheet:
                sheet.write(f'<worksheet xmlns="{MAIN}"><sheetData>'.encode())
                for n, row in enumerate(_after(header, rows), start=1):
                    if n > MOST_LINES:
                        raise ValueError(f"sheet {name!r} has more than {MOST_LINES} lines; deal its rows to more workbooks")
                    sheet.write(f'<row r="{n}">{"".join(map(_cell, row))}</row>'.encode())
                sheet.write(b"</sheetData></worksheet>")
        parts = range(1, len(names) + 1)
        z.writestr("[Content_Types].xml", f'<Types xmlns="{TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                   f'<Override PartName="/xl/workbook.xml" ContentType="{KIND}sheet.main+xml"/>'
                   + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{KIND}worksheet+xml"/>' for k in parts) + "</Types>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="{PKG_REL}"><Relationship Id="rId1" Type="{DOC_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{DOC_REL}"><sheets>'
                   + "".join(f'<sheet name={quoteattr(name)} sheetId="{k}" r:id="rId{k}"/>' for k, name in zip(parts, names, strict=True)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PKG_REL}">'
                   + "".join(f'<Relationship Id="rId{k}" Type="{DOC_REL}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in parts) + "</Relationships>")


def _after(header: Sequence[str], rows: Iterable[Sequence]) -> Iterator[Sequence]:
    yield header
    yield from rows


def _in_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, str | None, tuple]]:
    """(path, sheet, values) of each row, a few rows made into Python values at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            path, sheet, *columns = (c.to_pylist() for c in batch.slice(at, ROWS_AT_ONCE).columns)
            yield from zip(path, sheet, zip(*columns, strict=True) if columns else [()] * len(path), strict=True)


def _workbooks(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple[str | None, BinaryIO]]:
    """(path, file with its workbook) of each path in rows sorted by path and sheet. Rows without a sheet's name
    are left out, their workbook is not."""
    for path, rows in groupby(_in_rows(batches), key=itemgetter(0)):
        named = ((name, names, (r[2] for r in part)) for name, part in groupby(rows, key=itemgetter(1)) if name is not None)
        with tempfile.TemporaryFile() as out:
            write_workbook(out, named)
            out.seek(0)
            yield path, out


def _sorted_rows(df: DataFrame, path: Column, sheet: Column | str, order: Sequence[str]) -> DataFrame:
    """(path, sheet, values...), each path in one task, by sheet and ``order``."""
    ship_package(df.sparkSession)
    p, s, o = helper_name("path"), helper_name("sheet"), helper_name("order")
    plain = [(c if isinstance(f.dataType, (T.IntegralType, T.FractionalType, T.BooleanType)) and not isinstance(f.dataType, T.DecimalType)
              else c.cast("string")).alias(f"{s}{k}") for k, (f, c) in enumerate((f, F.col(quote(f.name))) for f in df.schema)]
    rows = df.select(path.alias(p), (sheet if isinstance(sheet, Column) else F.lit(sheet)).alias(s), *plain,
                     F.struct(*[F.col(quote(c)) for c in order], F.lit(0)).alias(o))
    return rows.repartition(F.col(p)).sortWithinPartitions(p, s, o).drop(o)


def as_workbooks(df: DataFrame, path: Column, sheet: Column | str, order: Sequence[str] = (), *, part_bytes: int | None = None) -> DataFrame:
    """(path, content): a workbook for each ``path`` with a sheet for each ``sheet`` of its rows, sheets by
    name and rows by ``order``. With ``part_bytes`` (path, part, content): each content in numbered parts of that
    size, for workbooks too large for a row."""
    names = list(df.columns)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, out in _workbooks(batches, names):
            if part_bytes is None:
                yield pa.RecordBatch.from_pydict({"path": pa.array([name], pa.string()), "content": pa.array([out.read()], pa.binary())})
                continue
            for part, content in enumerate(iter(partial(out.read, part_bytes), b"")):
                yield pa.RecordBatch.from_pydict({"path": pa.array([name], pa.string()), "part": pa.array([part], pa.int64()),
                                                  "content": pa.array([content], pa.binary())})

    return _sorted_rows(df, path, sheet, order).mapInArrow(make, "path string, " + ("" if part_bytes is None else "part long, ") + "content binary")
