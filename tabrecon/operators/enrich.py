"""Enrich A with columns of the first matching B row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_form
from .attach import attach_first_match
from .keys import key_rule, split_on
from .membership import Result


def fill_nulls(df: DataFrame, value: str) -> DataFrame:
    """Replace every null of every column by ``value``.

    Columns become text, as a pandas ``fillna("")`` turns a numeric column holding a
    gap into text; ``DataFrame.fillna`` would skip non-string columns.
    """
    return df.select(*[
        F.coalesce(text_form(c, f.dataType), F.lit(value)).alias(c)
        for c, f in zip(df.columns, df.schema.fields)
    ])


def enrich(a: DataFrame, b: DataFrame, on: str | tuple[str, str], *, select_b: Sequence[str],
           suffix: str = " (B)", how: str = "left", skip_empty: bool = True, fill: str | None = None,
           order_b: Sequence[str | Column] | None = None, null_text: str = "") -> Result:
    """Every A row (``how="left"``) or only matched rows (``how="inner"``), plus the
    selected B columns and B's key column from the first B row per key.

    ``skip_empty`` drops blank-key rows from both sides first, A's included (R19);
    ``fill`` replaces every null of the result, A's own included (R20). ``found`` holds
    the matched rows before the fill (R21), from the same join via a match flag.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    if not select_b:
        raise ValueError("select at least one B column to add")
    col_a, col_b = split_on(on)
    rule = key_rule([(a, col_a), (b, col_b)], null_text=null_text)
    res = attach_first_match(a, col_a, b, col_b, rule, select_a=[], select_b=select_b, principal="A",
                             suffix=suffix, order_b=order_b, how=how, skip_empty=skip_empty,
                             match_flag=True, all_a=True)
    views = dict(res.views)
    if fill is not None:
        views["result"] = lambda df: fill_nulls(res.views["result"](df), fill)
    return Result(views["result"](res.joined), found=res.found, source=res.joined, views=views)

