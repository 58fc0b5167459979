"""Present tables as sheets of a workbook-shaped long table (the shape ``read_workbooks``
produces), so source-level operations run on any input."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_form


def as_sheets(file: str, sheets: Mapping[str, DataFrame]) -> DataFrame:
    """One long table ``(_file, _sheet, _sheet_index, _sheet_count, _row, cells)`` with every row of every
    given table; ``cells`` maps each column name to the value's text form. ``_row`` is
    left null: no operation on this shape depends on row order."""
    parts = []
    for index, (sheet, df) in enumerate(sheets.items()):
        cells = F.map_from_arrays(
            F.array(*[F.lit(c) for c in df.columns]),
            F.array(*[text_form(c, f.dataType) for c, f in zip(df.columns, df.schema.fields)]),
        )
        parts.append(df.select(F.lit(file).alias("_file"), F.lit(sheet).alias("_sheet"),
                               F.lit(index).alias("_sheet_index"), F.lit(len(sheets)).alias("_sheet_count"),
                               F.lit(None).cast("long").alias("_row"),
                               cells.alias("cells")))
    if not parts:
        raise ValueError("no sheet given")
    return reduce(DataFrame.unionAll, parts)
