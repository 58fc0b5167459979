"""Row conditions of the extract operation (R22–R30, R49) as composable Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import column_type, is_blank, quote, strip, text_form, to_number

TEXT_CONDITIONS = ("eq", "ne", "contains", "starts", "ends")
NUMBER_CONDITIONS = ("gt", "lt")
EMPTY_CONDITIONS = ("empty", "not_empty")
CONDITIONS = TEXT_CONDITIONS + NUMBER_CONDITIONS + EMPTY_CONDITIONS

# The reference's condition names (as its profiles store them), in its
# order, with the condition each one is.
CONDITION_NAMES = {
    "égal à": "eq", "différent de": "ne", "contient": "contains",
    "commence par": "starts", "se termine par": "ends",
    "supérieur à": "gt", "inférieur à": "lt",
    "est vide": "empty", "n'est pas vide": "not_empty",
}


def condition_code(condition: str) -> str:
    """``condition`` as one of ``CONDITIONS``; the reference's names are accepted too."""
    return CONDITION_NAMES.get(condition.strip(), condition) if isinstance(condition, str) else condition


def predicate(df: DataFrame, column: str, condition: str, value: str | None = None, *,
              case_sensitive: bool = False, null_text: str | None = None, never_null: bool = True) -> Column:
    """Condition on one column, as a boolean Column.

    With ``never_null`` (default) the Column is never null, so it can be negated or
    combined freely. A filter treats null as false anyway, so ``extract`` passes
    ``never_null=False``: the bare comparison can then be pushed into a parquet scan.

    Text conditions compare the stripped text of the cell with ``value`` as given (the
    probe is not stripped); without ``case_sensitive`` both are lower-cased. A null cell
    satisfies no positive text condition and always satisfies ``ne`` (rule D8);
    ``null_text="nan"`` instead compares nulls as that text. ``gt``/``lt`` compare the
    cell read as a number; unreadable cells and NaN never match (D6, D7).
    """
    condition = condition_code(condition)
    dtype = column_type(df, column)
    c = F.col(quote(column))
    if condition in TEXT_CONDITIONS:
        if value is None:
            raise ValueError(f"condition {condition!r} needs a value")
        cell = strip(text_form(c, dtype))
        if null_text is not None:
            cell = F.coalesce(cell, F.lit(null_text))
        probe = value
        if not case_sensitive:
            cell, probe = F.lower(cell), value.lower()
        if condition == "eq":
            cond = cell == F.lit(probe)
        elif condition == "ne":
            cond = cell.isNull() | (cell != F.lit(probe))
        elif condition == "contains":
            cond = cell.contains(F.lit(probe))
        elif condition == "starts":
            cond = cell.startswith(F.lit(probe))
        else:
            cond = cell.endswith(F.lit(probe))
        return F.coalesce(cond, F.lit(False)) if never_null else cond
    if condition in NUMBER_CONDITIONS:
        try:
            threshold = float(value)  # type: ignore[arg-type]
        except (TypeError, ValueError) as exc:
            raise ValueError(f"condition {condition!r} needs a numeric value, got {value!r}") from exc
        if math.isnan(threshold):
            return F.lit(False)
        n = to_number(c, dtype)
        cond = (n > F.lit(threshold)) & ~F.isnan(n) if condition == "gt" else (n < F.lit(threshold))
        return F.coalesce(cond, F.lit(False)) if never_null else cond
    if condition in EMPTY_CONDITIONS:
        blank = is_blank(c, dtype)
        return blank if condition == "empty" else ~blank
    raise ValueError(f"unknown condition {condition!r}; expected one of {CONDITIONS}")
