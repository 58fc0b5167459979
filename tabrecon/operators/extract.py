"""Extract: keep the rows of a table that satisfy a condition."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.predicates import predicate


def extract(df: DataFrame, column: str, condition: str, value: str | None = None, *,
            case_sensitive: bool = False, null_text: str | None = None) -> DataFrame:
    """A filter on one column; Catalyst pushes it into the scan where it can (e.g. ``gt``
    on a numeric column becomes a parquet ``PushedFilters`` entry)."""
    return df.where(predicate(df, column, condition, value, case_sensitive=case_sensitive, null_text=null_text,
                              never_null=False))
