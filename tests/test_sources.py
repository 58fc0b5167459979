"""Sources: CSV (R36, D13, D19), workbooks (R37, R38), scan (R39), read_many."""

import io
import os
import zipfile

import pytest

from tabrecon import read_csv, read_many, read_workbooks, scan_tables, scan_workbooks, select_sheet
from tabrecon.sources.csv import dedupe_header
from tests.conftest import rows


def _write(path, data: bytes):
    with open(path, "wb") as f:
        f.write(data)
    return path


def test_csv_utf8_quotes_newlines_na(spark, scratch):
    p = _write(f"{scratch}/a.csv", '﻿id,name,n\n1,"x, ""q""",NA\n2,"multi\nline",3\n3,é,NULL'.encode("utf-8"))
    df = read_csv(spark, p)
    assert df.columns == ["id", "name", "n"]
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "n": "bigint"}
    assert rows(df) == [(1, 'x, "q"', None), (2, "multi\nline", 3), (3, "é", None)]


def test_csv_latin1_fallback_and_duplicate_header(spark, scratch):
    p = _write(f"{scratch}/b.csv", "a,a,,b\n1,2,3,caf\xe9\n4,5,6,na\xefve\n".encode("latin-1"))
    df = read_csv(spark, p)
    assert df.columns == ["a", "a.1", "Unnamed: 2", "b"]
    assert rows(df, "b") == [("café",), ("naïve",)]


def test_csv_types_bool_double_text(spark, scratch):
    p = _write(f"{scratch}/c.csv", b"f,b,t\n1.5,True,x\n2,false,1\n,TRUE,2\n")
    df = read_csv(spark, p)
    assert dict(df.dtypes) == {"f": "double", "b": "boolean", "t": "string"}


def test_csv_wrong_suffix(spark):
    with pytest.raises(ValueError):
        read_csv(spark, "/x/y.txt")


def test_dedupe_header():
    assert dedupe_header(["a", "a", "a", "", None]) == ["a", "a.1", "a.2", "Unnamed: 3", "Unnamed: 4"]


def _xlsx(sheets: dict[str, list[list]], date_columns: tuple[int, ...] = ()) -> bytes:
    """A minimal .xlsx with inline strings and numbers (written by hand, no library);
    numbers in ``date_columns`` get a date number format (built-in format 14)."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        entries = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f"<workbook {ns} {rns}><sheets>{entries}</sheets></workbook>")
        rels = "".join(f'<Relationship Id="rId{i + 1}" Type="worksheet" Target="worksheets/sheet{i + 1}.xml"/>'
                       for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels",
                   f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts count="1"><numFmt numFmtId="164" '
                   'formatCode="yyyy\\-mm\\-dd hh:mm"/></numFmts><cellXfs count="3"><xf numFmtId="0"/>'
                   '<xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        for i, data in enumerate(sheets.values()):
            xml_rows = []
            for r, row in enumerate(data, start=1):
                cells = []
                for c, v in enumerate(row):
                    ref = f"{chr(65 + c)}{r}"
                    if v is None:
                        continue
                    if isinstance(v, str):
                        cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>')
                    elif isinstance(v, bool):
                        cells.append(f'<c r="{ref}" t="b"><v>{int(v)}</v></c>')
                    elif c in date_columns and r > 1:
                        cells.append(f'<c r="{ref}" s="{1 if isinstance(v, int) else 2}"><v>{v}</v></c>')
                    else:
                        cells.append(f'<c r="{ref}"><v>{v}</v></c>')
                xml_rows.append(f'<row r="{r}">{"".join(cells)}</row>')
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f"<worksheet {ns}><sheetData>{''.join(xml_rows)}</sheetData></worksheet>")
    return buf.getvalue()


def test_workbooks_long_table_and_select_sheet(spark, scratch):
    os.makedirs(f"{scratch}/wb")
    _write(f"{scratch}/wb/multi.xlsx", _xlsx({"first": [["id", "name", "ok"], [1, "a", True], [2, None, False]],
                                              "second": [["x"], [1.5], [7]]}))
    _write(f"{scratch}/wb/single.xlsx", _xlsx({"only": [["k"], ["v"]]}))
    long = read_workbooks(spark, f"{scratch}/wb")
    assert long.where("_row > 0").count() == 5 and long.where("_row = 0").count() == 3  # rows and headers
    files = sorted({r["_file"] for r in long.select("_file").collect()})
    multi = [f for f in files if f.endswith("multi.xlsx")][0]
    first = select_sheet(long, multi, 0)
    assert first.columns == ["id", "name", "ok"]
    assert rows(first) == [(1, "a", True), (2, None, False)]
    second = select_sheet(long, multi, "second")
    assert dict(second.dtypes) == {"x": "double"}
    meta = {(r["sheet"], r["row_count"], r["columns"]) for r in scan_workbooks(long).collect()}
    assert ("first", 2, "id,name,ok") in meta and ("only", 1, "k") in meta


def test_scan_tables_and_read_many(spark, scratch):
    p = f"{scratch}/t.parquet"
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.parquet(p)
    frames = read_many(spark, [p, p])
    assert len(frames) == 1
    assert rows(scan_tables({"t": frames[0]})) == [("t", 2, "k,v")]
    with pytest.raises(ValueError):
        read_many(spark, [])


def test_csv_declared_encoding_skips_detection(spark, scratch):
    p = _write(f"{scratch}/d.csv", "a\ncaf\xe9\n".encode("latin-1"))
    assert read_csv(spark, p, encoding="ISO-8859-1").first()["a"] == "café"


def test_workbook_dates(spark, scratch):
    os.makedirs(f"{scratch}/wbd")
    _write(f"{scratch}/wbd/d.xlsx", _xlsx({"s": [["when", "n"], [45292, 1], [45292.5, 2]]}, date_columns=(0,)))
    long = read_workbooks(spark, f"{scratch}/wbd")
    f = long.select("_file").first()[0]
    df = select_sheet(long, f, 0)
    assert dict(df.dtypes)["when"] == "timestamp_ntz"
    import datetime as dt
    assert rows(df, "when") == [(dt.datetime(2024, 1, 1, 0, 0),), (dt.datetime(2024, 1, 1, 12, 0),)]


def test_csv_int_beyond_bigint_becomes_double(spark, scratch):
    p = _write(f"{scratch}/big.csv", b"v\n1\n99999999999999999999\n")
    df = read_csv(spark, p)
    assert dict(df.dtypes)["v"] == "double" and df.where("v IS NULL").count() == 0
