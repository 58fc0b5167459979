"""CSV files whose quoted fields hold line ends, read by several tasks.

Where a record starts depends on all quotes before it, so such a file cannot be cut at line ends
blindly. Every line maps the reader's state before it (at a record's start, or inside a quoted field) to the
state after it; two states make four such maps, and maps of lines in a row compose. So:

1. :func:`_lines` reads the splits in parallel and notes for each line the state before and after it for
   *both* states its split may start in (numpy, no loop over lines).
2. :func:`_splits` reduces each split to one row: its map, its last open record and its record count under both
   states. A window over a file's splits (a row per split, not per line) composes the maps and tells in which
   state every split starts.
3. :func:`record_table` then knows each line's state. A record of one line is ready; the lines of the others
   are grouped by the place where their record starts, over splits if need be. Records are written in file
   order to the shared checkpoint folder: a table that any number of tasks reads, with rows in place (D1).

Quotes count as pandas reads them: a field is quoted only if it starts with a quote, a doubled quote is
one quote, and text after the closing quote up to the comma is plain. Blank lines between records are
left out. A quoted field that never closes runs to the file's end.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship_package

# Encodings in which a byte of a quote, comma or line feed is never part of another character.
ASCII_LIKE = frozenset(("UTF-8", "ISO-8859-1", "US-ASCII", "WINDOWS-1252"))

_IN = r'(?:[^"]|"")*'
_REST = r'(?:[^",][^,]*)?'
_FIELD = rf'(?:"{_IN}"{_REST}|[^",][^,]*|)'
# Lines that leave a quoted field open, read from a record's start and from inside a quoted field.
OPENS = rf'\A(?:{_FIELD},)*"{_IN}\z'
STAYS = rf'\A{_IN}(?:\z|"{_REST},(?:{_FIELD},)*"{_IN}\z)'
# A record whose line ends are all inside quotes, or that is cut off in them.
_WHOLE = r'(?:"(?:[^"]++|"")*+"[^,\r]*+|[^",\r][^,\r]*+|)'
WHOLE = rf'\A(?:{_WHOLE},)*+(?:{_WHOLE}|"(?:[^"]++|"")*+)\z'


def line_maps(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether a quoted field is open after each line: if the line starts a record, and if it starts inside one."""
    quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
    opens, stays = np.zeros(len(lines), dtype=bool), np.ones(len(lines), dtype=bool)
    if len(quoted):
        own = lines.take(pa.array(quoted))
        opens[quoted] = pc.match_substring_regex(own, OPENS).to_numpy(zero_copy_only=False)
        stays[quoted] = pc.match_substring_regex(own, STAYS).to_numpy(zero_copy_only=False)
    return opens, stays


def states_after(opens: np.ndarray, stays: np.ndarray, start: bool) -> np.ndarray:
    """The state after each line of a run that starts in ``start``: the last line that ends in one state
    whatever it starts in, and how many lines since then swap the two."""
    places = np.arange(len(opens))
    last = np.maximum.accumulate(np.where(opens == stays, places, -1))
    swaps = np.cumsum(opens & ~stays)
    since = swaps - np.where(last >= 0, swaps[last], 0)
    return np.where(last >= 0, opens[last], start) ^ (since % 2 == 1)


_LINES = "file string, block long, n long, line string, before_s boolean, after_s boolean, before_q boolean, after_q boolean"


def _lines(spark: SparkSession, files: Sequence[str], encoding: str) -> DataFrame:
    """The lines of each split in order, numbered, with the state around each for both first states."""
    ship_package(spark)
    text = F.decode(F.col("value").cast("binary"), encoding)
    raw = (spark.read.option("lineSep", "\n").text(list(files))
           .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), text.alias("line")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, state = None, 0, [False, True]
        for batch in batches:
            if not batch.num_rows:
                continue
            file, block = pc.dictionary_encode(batch.column(0)), np.asarray(batch.column(1))
            index = np.asarray(file.indices)
            new = np.flatnonzero((np.diff(index, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
            opens, stays = line_maps(batch.column(2))
            number, around = np.zeros(batch.num_rows, np.int64), [np.zeros(batch.num_rows, dtype=bool) for _ in range(4)]
            for a, b in zip(new.tolist(), [*new[1:].tolist(), batch.num_rows], strict=True):
                here = file.dictionary[int(index[a])].as_py(), int(block[a])
                if here != at:
                    at, n, state = here, 0, [False, True]
                number[a:b] = np.arange(n, n + b - a)
                n += b - a
                for k in range(2):
                    after = states_after(opens[a:b], stays[a:b], state[k])
                    around[2 * k][a:b] = np.concatenate([[state[k]], after[:-1]])
                    around[2 * k + 1][a:b] = after
                    state[k] = bool(after[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(number), batch.column(2), *map(pa.array, around)],
                                             names=["file", "block", "n", "line", "before_s", "after_s", "before_q", "after_q"])

    return raw.mapInArrow(run, _LINES)


def _filled() -> Column:
    return F.trim(F.regexp_replace("line", "[\r\t]", "")) != ""


def _splits(lines: DataFrame) -> DataFrame:
    """One row per split of a file: the state it starts in (``carry``: inside a quoted field), the place of the
    record that is open then, the file's first record, and the number of records that start in it."""
    start = {k: ~F.col(f"before_{k}") & _filled() for k in "sq"}
    totals = lines.groupBy("file", "block").agg(
        *[F.max_by(f"after_{k}", "n").alias(f"end_{k}") for k in "sq"],
        *[F.max(F.when(start[k] & F.col(f"after_{k}"), F.col("n"))).alias(f"open_{k}") for k in "sq"],
        *[F.count_if(start[k]).alias(f"records_{k}") for k in "sq"],
        F.min(F.when(start["s"], F.col("n"))).alias("first"))
    whole = Window.partitionBy("file")
    past = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    const, swap = F.col("end_s") == F.col("end_q"), (F.col("end_s") & ~F.col("end_q")).cast("long")
    totals = totals.withColumn("swaps", F.sum(swap).over(whole.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
    since = F.coalesce(F.last("swaps").over(past), F.lit(0)) - F.coalesce(F.last(F.when(const, F.col("swaps")), True).over(past), F.lit(0))
    ended = F.coalesce(F.last(F.when(const, F.col("end_s")), True).over(past), F.lit(False))
    totals = totals.withColumn("carry", ended != (since % 2 == 1))
    opened = F.when(F.col("carry"), F.col("open_q")).otherwise(F.col("open_s"))
    return totals.select(
        "file", "block", "carry",
        F.last(F.when(opened.isNotNull(), F.struct("block", opened.alias("n"))), True).over(past).alias("opened"),
        F.min(F.when(F.col("first").isNotNull(), F.struct("block", F.col("first").alias("n")))).over(whole).alias("head"),
        F.when(F.col("carry"), F.col("records_q")).otherwise(F.col("records_s")).alias("records"))


def _known(spark: SparkSession, files: Sequence[str], encoding: str) -> DataFrame:
    """Every line with its state before and after it."""
    lines = _lines(spark, files, encoding)
    known = lines.join(_splits(lines).drop("records"), ["file", "block"])
    state = {w: F.when(F.col("carry"), F.col(f"{w}_q")).otherwise(F.col(f"{w}_s")).alias(w) for w in ("before", "after")}
    return known.select("file", "block", "n", "line", "opened", "head", *state.values())


def _assembled(known: DataFrame, only_heads: bool = False) -> DataFrame:
    """(file, block, n, head, line): the records, or each file's first only."""
    starts = ~F.col("before") & _filled()
    at_head = F.struct("block", "n") == F.col("head") if only_heads else F.lit(True)
    single = known.where(starts & ~F.col("after") & at_head).select("file", "block", "n", "head", "line")
    # The other records' lines go to the place where their record starts, in this split or before it.
    more = known.where(F.col("before") | (starts & F.col("after")))
    own = F.last(F.when(starts, F.struct("block", "n")), True).over(
        Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    more = more.withColumn("place", F.coalesce(own, "opened"))
    if only_heads:
        more = more.where(F.col("place") == F.col("head"))
    parts = F.sort_array(F.collect_list(F.struct("block", "n", "line")))
    several = more.groupBy("file", "place", "head").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("line"))
    return single.unionByName(several.select("file", "place.block", "place.n", "head", "line"))


def record_counts(spark: SparkSession, files: Sequence[str], encoding: str) -> DataFrame:
    """(file, rows, header): records of each file after its header, and the header as text."""
    counts = (_splits(_lines(spark, files, encoding)).groupBy("file")
              .agg(F.greatest(F.sum("records") - 1, F.lit(0)).cast("long").alias("rows")))
    heads = _assembled(_known(spark, files, encoding), only_heads=True).select("file", F.regexp_replace("line", "\r$", "").alias("header"))
    return counts.join(heads, "file", "left")


def record_table(spark: SparkSession, files: Sequence[str], encoding: str) -> DataFrame:
    """(file, is_header, record): every record of every file, in file order, as a written table."""
    out = _assembled(_known(spark, files, encoding))
    is_header = (F.col("block") == F.col("head.block")) & (F.col("n") == F.col("head.n"))
    record = F.regexp_replace("line", "\r$", "")
    # A carriage return outside quotes that ends a line on its own would end the record for other readers.
    bare = record.contains("\r") & ~record.rlike(WHOLE)
    stop = F.raise_error(F.concat(F.lit("a carriage return without a line feed ends a line; read this file with multi_line=True: "), "file"))
    out = out.select("file", "block", "n", is_header.alias("is_header"), F.when(bare, stop.cast("string")).otherwise(record).alias("record"))
    path = f"{checkpoint_dir(spark)}/csv-records-{uuid.uuid4().hex}"
    place = ["file", "block", "n"]
    out.repartitionByRange(*place).sortWithinPartitions(*place).drop("block", "n").write.parquet(path)
    return spark.read.parquet(path)
