"""Join keys shared by every two-table operation, and the blank-aware key join.

Keys are compared as stripped text with null equal to blank (R1). When both key columns are
integral, that is exactly a comparison of the values with null equal to null (an integer never
prints blank), so the join runs on raw longs.

The join is one true semi / anti / left / inner join, with B planned once, so filters and column
choices on the result reach A's scan. B is reduced to one row per key first. Hot keys (every blank
key is one value, and any other key may hold a large share of A) are left to adaptive execution,
which splits a skewed partition of A by its map tasks and reads B's partition once per split. It
can do so only where both sides of the join are plain shuffles: therefore B is reduced under a
*wrapped* key (:func:`wrapped`), whose partitioning the join cannot reuse, and B's reduced rows, at
most one per key, are shuffled once more. No job, sample or size test runs while a plan is built.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import INTEGRAL_TYPES, column_type, normalize_key, quote


def spreader(df: DataFrame) -> Column:
    """A per-row long that spreads rows over partitions and is the same when a lost task is
    recomputed: a hash of the input partition index and of the columns that can be hashed (all
    but those holding maps or variants). Copies of one row spread across input partitions."""
    def hashable(t: T.DataType) -> bool:
        if isinstance(t, T.ArrayType):
            return hashable(t.elementType)
        if isinstance(t, T.StructType):
            return all(hashable(f.dataType) for f in t.fields)
        return not isinstance(t, (T.MapType, T.VariantType))

    return F.xxhash64(F.spark_partition_id(), *[F.col(quote(f.name)) for f in df.schema if hashable(f.dataType)])


def helper_name(stem: str) -> str:
    """A helper column name that cannot clash with a user column (rule D18)."""
    return f"_{stem}_{uuid.uuid4().hex[:8]}"


def split_on(on: str | tuple[str, str] | list[str]) -> tuple[str, str]:
    if isinstance(on, str):
        return on, on
    col_a, col_b = on
    return col_a, col_b


@dataclass(frozen=True)
class KeyRule:
    """How keys of two sides are built and compared."""

    raw_integral: bool
    null_text: str = ""

    def key(self, df: DataFrame, column: str) -> Column:
        if self.raw_integral:
            return F.col(quote(column)).cast("long")
        return normalize_key(column, column_type(df, column), null_text=self.null_text)

    def is_blank(self, k: Column) -> Column:
        return k.isNull() if self.raw_integral else (k == F.lit(self.null_text))


def key_rule(frames_and_columns: list[tuple[DataFrame, str]], *, null_text: str = "") -> KeyRule:
    """Raw integral comparison iff every key column involved is integral."""
    types = [column_type(df, c) for df, c in frames_and_columns]
    return KeyRule(all(isinstance(t, INTEGRAL_TYPES) for t in types), null_text)


def with_key(df: DataFrame, column: str, rule: KeyRule, name: str) -> DataFrame:
    return df.withColumn(name, rule.key(df, column))


def wrapped(key: Column) -> Column:
    """The key as a value of its own kind: grouping by it is grouping by the key, but a join on
    the key does not take its partitioning for its own."""
    return F.struct(key.alias("k"))


def key_set(df: DataFrame, column: str, rule: KeyRule, name: str) -> DataFrame:
    """Distinct keys of one table: partial aggregation collapses repeated keys map-side."""
    return distinct_keys(df.select(rule.key(df, column).alias(name)), name)


def distinct_keys(keys: DataFrame, name: str) -> DataFrame:
    box = helper_name("box")
    return keys.select(wrapped(F.col(name)).alias(box)).distinct().select(F.col(f"{box}.k").alias(name))


def blank_aware_join(left: DataFrame, left_key: str, right: DataFrame, right_key: str, rule: KeyRule,
                     how: str, *, payload: list[str] | None = None, blanks: bool = True) -> DataFrame:
    """Join ``left`` to ``right`` (at most one row per ``right_key``) on keys compared by ``rule``.

    ``how``: ``semi`` / ``anti`` keep ``left``'s rows (and columns) that have / lack a
    match; ``left`` / ``inner`` also bring ``payload`` columns of the matching row.
    Blank keys match blank keys unless ``blanks`` is off (both sides already have none).
    ``left_key`` is dropped from the output.
    """
    if how not in ("semi", "anti", "left", "inner"):
        raise ValueError(f"unknown join {how!r}")
    attached = [F.col(quote(c)) for c in (payload or [])] if how in ("left", "inner") else []
    right = right.select(F.col(quote(right_key)), *attached)
    lk, rk = left[quote(left_key)], right[quote(right_key)]
    # A text key is never null; an integral one is null where it is blank.
    on = lk.eqNullSafe(rk) if rule.raw_integral and blanks else lk == rk
    joined = left.join(right, on, {"semi": "left_semi", "anti": "left_anti"}.get(how, how))
    return joined.select(*[F.col(quote(c)) for c in left.columns if c != left_key], *attached)
