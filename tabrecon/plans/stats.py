"""Run statistics (R44) and previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keys import helper_name
from ..operators.order import order_columns, source_order


def _count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def run_stats(spark: SparkSession, *, a: DataFrame | None = None, b: DataFrame | None = None,
              result: DataFrame, not_found: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """One row of row counts: A, B, result, not-found, found (whichever are given).

    Each count is a scalar subquery, planned as its own aggregate; on a write path
    ``export`` gathers the same numbers with ``observe`` instead."""
    cols = [(n, d) for n, d in (("a_rows", a), ("b_rows", b), ("result_rows", result),
                                ("not_found_rows", not_found), ("found_rows", found)) if d is not None]
    return spark.range(1).select(*[_count(d).alias(n) for n, d in cols])


def membership_stats(a: DataFrame, b: DataFrame, on: str | tuple[str, str], *, null_text: str = "") -> DataFrame:
    """All row counts of a membership run between ``a`` and ``b`` from one join.

    Each side is first reduced to ``(key, rows)`` — a count per key, combined map-side,
    so a key holding a third of a table costs one row per task — and the two count
    tables meet in one full outer join on the key, compared as the operations compare
    it (null ≡ blank, rule R1). One row: ``a_rows``, ``b_rows``, ``a_in_b_rows`` (the
    intersect result), ``a_not_in_b_rows`` (the subtract result), ``b_in_a_rows`` and
    ``b_not_in_a_rows`` (the not-found output).
    """
    from ..operators.keys import helper_name, key_rule, split_on

    col_a, col_b = split_on(on)
    rule = key_rule([(a, col_a), (b, col_b)], null_text=null_text)
    na, nb = helper_name("na"), helper_name("nb")

    def parts(df: DataFrame, column: str, side: str) -> list[Column]:
        # Never-null key parts, grouped on and joined on alike, so the join reuses the
        # aggregation's partitioning: text keys are never null; an integral key becomes
        # (is null, value or 0), which is null-safe equality.
        k = rule.key(df, column)
        if not rule.raw_integral:
            return [k.alias(f"_{side}0")]
        return [k.isNull().alias(f"_{side}0"), F.coalesce(k, F.lit(0).cast("long")).alias(f"_{side}1")]

    pa, pb = parts(a, col_a, "pa"), parts(b, col_b, "pb")
    ca = a.groupBy(*pa).agg(F.count(F.lit(1)).alias(na))
    cb = b.groupBy(*pb).agg(F.count(F.lit(1)).alias(nb))
    names_a, names_b = ca.columns[:-1], cb.columns[:-1]
    on_keys = [ca[x] == cb[y] for x, y in zip(names_a, names_b)]
    j = ca.join(cb, on_keys, "full")
    n_a, n_b = F.col(na), F.col(nb)

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    return j.agg(total(n_a).alias("a_rows"), total(n_b).alias("b_rows"),
                 total(F.when(n_b.isNotNull(), n_a)).alias("a_in_b_rows"),
                 total(F.when(n_b.isNull(), n_a)).alias("a_not_in_b_rows"),
                 total(F.when(n_a.isNotNull(), n_b)).alias("b_in_a_rows"),
                 total(F.when(n_a.isNull(), n_b)).alias("b_not_in_a_rows"))


def preview(df: DataFrame, n: int = 100, *, order: Sequence[str | Column] | None = None) -> DataFrame:
    """The first ``n`` rows in ``order`` (planned as ``TakeOrderedAndProject``: each task
    keeps its top ``n``, so only ``n`` rows per task move). Without ``order``, in file order; a table whose
    rows have been moved needs one."""
    if order:
        return df.orderBy(*order_columns(order)).limit(n)
    place = helper_name("place")
    return source_order(df, place).orderBy(place).limit(n).drop(place)
