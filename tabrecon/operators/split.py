"""Splits: tag every row with the output it belongs to, then write one folder per tag.

A split is a tagged DataFrame (query form) plus a partitioned write (sink form):

* by column values (R31, R32, R35): ``_group`` token; the write asks adaptive execution
  to *rebalance* by ``_group``, which splits a group holding a large share of rows
  over several tasks instead of sending it to one;
* by line count (R33): ``_part`` from a global line number computed without a
  single-partition window (sort, per-partition counts, offsets);
* by source (R34): ``_target`` from the source file name and sheet name.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import quote
from ..functions.tokens import group_token, sanitize_path_token, with_group_token
from ..session import checkpoint_dir
from .keys import helper_name, spreader
from .order import order_columns, plan_nodes, source_order

GROUP = "_group"
PART = "_part"
TARGET = "_target"
SHEET_DIR = "_sheet_dir"
COUNT = "n_rows"


def split_by_columns(df: DataFrame, split_columns: Sequence[str], keep_columns: Sequence[str], *,
                     per_sheet: bool = False) -> DataFrame:
    """Keep columns plus ``_group``, the token of the row's raw split values.

    Split columns the table lacks are ignored; if none is left, or no keep column is
    given, it is an error. ``per_sheet`` (on a table tagged with ``_sheet``) adds
    ``_sheet_dir`` so each sheet is split into its own folder (R35).
    """
    if not split_columns:
        raise ValueError("add at least one split column")
    if not keep_columns:
        raise ValueError("tick at least one column to keep")
    present = [c for c in split_columns if c in df.columns]
    if not present:
        raise ValueError(f"none of the split columns {list(split_columns)} is in the table")
    keep = [c for c in keep_columns if c in df.columns]
    cols: list[Column] = [F.col(quote(c)) for c in keep]
    if per_sheet:
        if "_sheet" not in df.columns:
            raise ValueError("per_sheet needs a table tagged with _sheet (see read_workbooks)")
        cols.append(sanitize_path_token(F.col("_sheet"), 60).alias(SHEET_DIR))
    token = helper_name("group")
    return with_group_token(df, present, token).select(*cols, F.col(token).alias(GROUP))


def manifest(tagged: DataFrame, by: str | Sequence[str] = GROUP) -> DataFrame:
    """One row per output: its tag(s) and row count (partial counts are combined map-side)."""
    keys = [by] if isinstance(by, str) else list(by)
    return tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias(COUNT))


def split_manifest(df: DataFrame, split_columns: Sequence[str]) -> DataFrame:
    """The manifest of ``split_by_columns`` straight from the source table.

    Rows are counted per raw value combination first — a cheap aggregate on the raw
    columns, combined map-side — and the file-name token is built once per group
    instead of once per row. The token is a function of the raw values, so the groups
    are the same as ``manifest(split_by_columns(...))``'s.
    """
    present = [c for c in split_columns if c in df.columns]
    if not present:
        raise ValueError(f"none of the split columns {list(split_columns)} is in the table")
    counts = df.groupBy(*[F.col(quote(c)) for c in present]).agg(F.count(F.lit(1)).alias(COUNT))
    return counts.select(group_token(counts, present).alias(GROUP), COUNT)


def line_numbers(df: DataFrame, order: Sequence[str | Column], name: str = "_line") -> DataFrame:
    """Add a 1-based line number in ``order`` (which must be total for a unique answer).

    ``row_number() OVER (ORDER BY ...)`` would pull every row into one task. Instead:
    range-sort the rows, number them inside each partition with
    ``monotonically_increasing_id`` (partition index in the upper bits, position in the
    lower 33), checkpoint that into the shared checkpoint folder so both the counting
    and the numbering read the same partitions (and survive a lost executor), count
    rows per partition, add the counts up on the driver, and broadcast the offsets — one
    row per partition, a bound the plan itself fixes.
    """
    if not order:
        raise ValueError("line numbering needs an order (rule D1)")
    checkpoint_dir(df.sparkSession)
    m, pid, cnt, off, tie = (helper_name(s) for s in ("m", "pid", "cnt", "off", "tie"))
    # A deterministic per-row spreader breaks ties, so a value shared by many rows is
    # split across range partitions instead of forming one.
    ordered = df.withColumn(tie, spreader(df)).sort(*order_columns(order), F.col(tie)).drop(tie)
    numbered = ordered.withColumn(m, F.monotonically_increasing_id()).checkpoint(eager=True)
    offsets = _starts(numbered, m, F.lit(1)).select(F.col("part").alias(pid), F.col("start").alias(off))
    joined = numbered.join(F.broadcast(offsets), F.shiftright(numbered[m], 33) == offsets[pid])
    local = F.col(m).bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn(name, F.col(off) + local + F.lit(1)).drop(m, pid, off)


def _starts(placed: DataFrame, mark: str, amount: Column) -> DataFrame:
    """(part, start): the sum of ``amount`` over the parts before each part of a checkpointed table that
    ``mark`` numbers (``monotonically_increasing_id``). The parts' sums, as many rows as the table has
    partitions, are added up on the driver, which schedules those partitions anyway."""
    part = F.shiftright(F.col(mark), 33).alias("part")
    sums = sorted(tuple(r) for r in placed.groupBy(part).agg(F.sum(amount)).collect())
    starts = [0, *accumulate(n for _, n in sums)]
    return placed.sparkSession.createDataFrame([(k, n) for (k, _), n in zip(sums, starts, strict=False)], "part long, start long")


def sums_before(counts: DataFrame, key: str, amount: str, name: str) -> DataFrame:
    """(``key``, ``name``): for each row the sum of ``amount`` over the rows with a lesser key, in two levels:
    range-sorted parts are summed up, then each part's rows from its part's start on."""
    checkpoint_dir(counts.sparkSession)
    mark = helper_name("mark")
    placed = counts.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn(mark, F.monotonically_increasing_id())
    placed = placed.checkpoint(eager=True).withColumn("part", F.shiftright(F.col(mark), 33))
    starts = _starts(placed, mark, F.col(amount))
    before = Window.partitionBy("part").orderBy(mark).rowsBetween(Window.unboundedPreceding, -1)
    return (placed.withColumn(name, F.coalesce(F.sum(amount).over(before), F.lit(0))).join(F.broadcast(starts), "part")
            .select(key, (F.col(name) + F.col("start")).alias(name)))


LINE_BLOCK = 1 << 16  # rows of a file numbered together


def file_line_numbers(df: DataFrame, name: str = "_line") -> DataFrame:
    """Add a 1-based line number in file order (files by path, rows as stored) — no sort of the table.

    Of a bare parquet scan each row's file and place in it are known
    (``_metadata.row_index``), so the line is the row count of the preceding files plus that
    place; the rows are not shuffled, as the offsets, a row per file that the driver has listed anyway,
    are broadcast. Of any other table in file order (a filtered scan, a CSV
    file, a sheet) the rows left are counted per block of places, numbered within it, and the
    blocks' counts summed up in two levels, so no task sees all blocks. Offsets (one row per block)
    meet the rows in a plain join.
    """
    order, block, cnt, off, line = (helper_name(s) for s in ("order", "block", "cnt", "off", "line"))
    tagged = source_order(df, order)
    row = F.col(f"{order}.row")
    bare = plan_nodes(df) <= _BARE and analysed_row_index(df)
    # Running numbers hold the task above bit 33, so a block never spans two tasks.
    at = F.lit(0).cast("long") if bare else F.floor(row / F.lit(LINE_BLOCK)).cast("long")
    tagged = tagged.withColumn(block, F.struct(F.col(f"{order}.file").alias("f"), F.col(f"{order}.block").alias("b"), at.alias("n")))
    counts = tagged.groupBy(block).agg(F.count(F.lit(1)).alias(cnt))
    offsets = sums_before(counts, block, cnt, off).withColumnRenamed(block, block + "_o")
    if bare:
        # Joined by file, all rows of a large file would meet in one task.
        numbered, offsets = tagged.withColumn(line, row + 1), F.broadcast(offsets)
    else:
        numbered = tagged.withColumn(line, F.row_number().over(Window.partitionBy(block).orderBy(order)))
    joined = numbered.join(offsets, numbered[block] == offsets[block + "_o"])
    return joined.withColumn(name, F.col(off) + F.col(line)).drop(order, block, line, block + "_o", off)


_BARE = frozenset(("Project", "SubqueryAlias", "LogicalRelation", "Relation"))


def analysed_row_index(df: DataFrame) -> bool:
    """Whether ``df`` knows each row's place in its file (a parquet scan)."""
    try:
        df.select("_metadata.row_index").schema
    except AnalysisException:
        return False
    return True


def split_by_lines(df: DataFrame, lines_per_file: int = 200, *,
                   order: Sequence[str | Column] | None = None) -> DataFrame:
    """Add ``_part``: consecutive chunks of ``lines_per_file`` rows (R33). Every part but
    the last holds exactly ``lines_per_file`` rows.

    Without ``order`` the rows are taken in file order, as the reference does, with no
    sort (``file_line_numbers``); with ``order`` they are numbered in that order."""
    if lines_per_file <= 0:
        raise ValueError("lines per file must be greater than 0")
    line = helper_name("line")
    numbered = file_line_numbers(df, line) if not order else line_numbers(df, order, line)
    part = (F.floor((F.col(line) - 1) / F.lit(lines_per_file)) + 1).cast("long")
    return numbered.withColumn(PART, part).drop(line)


def part_names(tagged: DataFrame, stem: str) -> DataFrame:
    """``{stem}_part{i}`` output names for a line split, cut at 180 characters."""
    return tagged.withColumn(TARGET, sanitize_path_token(F.concat(F.lit(f"{stem}_part"), F.col(PART).cast("string")), 180))


def _file_stem(path: Column) -> Column:
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


# The reference's output-name placeholders for the file stem and the sheet
# name; ``{file}`` and ``{sheet}`` are accepted as well.
FILE_PLACEHOLDERS = ("{fichier}", "{file}")
SHEET_PLACEHOLDERS = ("{onglet}", "{sheet}")


def split_by_source(tagged: DataFrame, pattern: str = "{fichier}_{onglet}") -> DataFrame:
    """Rows of every source with at least two sheets, tagged with ``_target``.

    ``pattern`` may use ``{fichier}``/``{file}`` (source file stem) and
    ``{onglet}``/``{sheet}`` (sheet name);
    ``/`` and ``\\`` become ``_``, cut at 180. The readers put each source's sheet count
    on its rows (``_sheet_count``), so the test is a plain filter; for a long table
    without it, one small aggregate per source (combined map-side) is joined back.
    """
    for need in ("_file", "_sheet"):
        if need not in tagged.columns:
            raise ValueError(f"split by source needs a table tagged with {need}")
    if "_row" in tagged.columns:  # a sheet's header is its row 0
        tagged = tagged.where(F.coalesce(F.col("_row") > 0, F.lit(True)))
    if "_sheet_count" in tagged.columns:
        kept = tagged.where(F.col("_sheet_count") >= 2)
    else:
        multi = helper_name("multi")
        sheets = (tagged.groupBy("_file")
                  .agg((F.min("_sheet") != F.max("_sheet")).alias(multi))
                  .where(F.col(multi)).select("_file"))
        kept = tagged.join(sheets, "_file", "left_semi")
    name = F.lit(pattern)
    for ph in FILE_PLACEHOLDERS:
        name = F.replace(name, F.lit(ph), _file_stem(F.col("_file")))
    for ph in SHEET_PLACEHOLDERS:
        name = F.replace(name, F.lit(ph), F.col("_sheet"))
    return kept.withColumn(TARGET, sanitize_path_token(name, 180))
