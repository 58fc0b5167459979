"""Attach columns of the first matching B row to A rows (shared by intersect R5 and enrich R17).

B is reduced to its first row per key (in ``order_b``) *before* the join, so the join's
build side holds one row per key; name clashes are resolved explicitly (D9–D11).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quote
from .keys import KeyRule, blank_aware_join, helper_name, with_key, wrapped
from .order import first_per_key, order_columns, source_order


def default_order(df: DataFrame, name: str) -> tuple[DataFrame, list[Column]]:
    """File order of a table read from files (D1); other inputs must name their order."""
    return source_order(df, name), [F.col(name)]


def check_case_clashes(df: DataFrame, label: str) -> None:
    """Spark resolves names case-insensitively, so a table whose names differ only in
    case cannot be used safely (D11)."""
    seen: dict[str, str] = {}
    for c in df.columns:
        low = c.lower()
        if low in seen and seen[low] != c:
            raise ValueError(
                f"{label} has columns {seen[low]!r} and {c!r} differing only in case; "
                "rename one or set spark.sql.caseSensitive=true"
            )
        seen[low] = c


def unique(names: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(names))


class NamePlan:
    """Final names of A's and B's columns after clash renaming with ``suffix``."""

    def __init__(self, a_cols: Sequence[str], b_cols: Sequence[str], *, principal: str, suffix: str):
        if principal not in ("A", "B"):
            raise ValueError("principal must be 'A' or 'B'")
        a_low = {c.lower() for c in a_cols}
        b_low = {c.lower() for c in b_cols}
        clash = a_low & b_low
        self.a = {c: (c + suffix if principal == "B" and c.lower() in clash else c) for c in a_cols}
        self.b = {c: (c + suffix if principal == "A" and c.lower() in clash else c) for c in b_cols}
        seen: dict[str, str] = {}
        for side, mapping in (("A", self.a), ("B", self.b)):
            for src, out in mapping.items():
                low = out.lower()
                if low in seen:
                    raise ValueError(
                        f"column name {out!r} (from {side}.{src}) collides with {seen[low]}; choose another suffix"
                    )
                seen[low] = f"{side}.{src}"


def attach_first_match(a: DataFrame, col_a: str, b: DataFrame, col_b: str, rule: KeyRule, *,
                       select_a: Sequence[str], select_b: Sequence[str], principal: str, suffix: str,
                       order_b: Sequence[str | Column] | None, how: str, skip_empty: bool = False,
                       match_flag: bool = False,
                       all_a: bool = False) -> "AttachResult":
    """Join A to the first B row per key and select the output columns.

    ``all_a`` outputs every A column then the attached B columns (enrich); otherwise the
    output is ``select_a`` then ``select_b`` with clash renaming (intersect, R5).
    """
    check_case_clashes(a, "A")
    check_case_clashes(b, "B")
    missing = [c for c in select_b if c not in b.columns]
    if missing:
        raise ValueError(f"columns {missing} not found in B")
    right_cols = unique(list(select_b) + [col_b])
    names = NamePlan(a.columns, right_cols, principal=principal, suffix=suffix)

    ka, kb = helper_name("ka"), helper_name("kb")
    left = with_key(a, col_a, rule, ka)
    if order_b:
        right_src, order = b, order_columns(order_b)
    else:
        right_src, order = default_order(b, helper_name("order"))
    tmp = {c: helper_name("b") for c in right_cols}
    flag = helper_name("matched")
    right = right_src.withColumn(kb, rule.key(right_src, col_b))
    if skip_empty:
        left = left.where(~rule.is_blank(F.col(ka)))
        right = right.where(~rule.is_blank(F.col(kb)))
    right = first_per_key(right, wrapped(F.col(kb)), order)
    right = right.select(F.col(kb), *[F.col(quote(c)).alias(tmp[c]) for c in right_cols],
                         F.lit(True).alias(flag))
    joined = blank_aware_join(left, ka, right, kb, rule, how, payload=[*tmp.values(), flag], blanks=not skip_empty)

    a_out = [F.col(quote(c)).alias(names.a[c]) for c in a.columns]
    b_out = [F.col(tmp[c]).alias(names.b[c]) for c in right_cols]
    if all_a:
        cols = a_out + b_out
    else:
        keep_a = [F.col(quote(c)).alias(names.a[c]) for c in unique(select_a) if c in a.columns]
        keep_b = [F.col(tmp[c]).alias(names.b[c]) for c in unique(select_b)]
        cols = keep_a + keep_b or (a_out + b_out)
    views = {"result": lambda df: df.select(*cols)}
    if match_flag:
        views["found"] = lambda df: df.where(F.col(flag).isNotNull()).select(*cols)
    return AttachResult(joined, views)


class AttachResult:
    """The join and how its outputs are read from it."""

    def __init__(self, joined: DataFrame, views: dict[str, Callable[[DataFrame], DataFrame]]):
        self.joined, self.views = joined, views
        self.data = views["result"](joined)
        self.found = views["found"](joined) if "found" in views else None
