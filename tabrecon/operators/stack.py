"""Stack tables by column name, with keep-first deduplication.

Stacking is a narrow ``unionByName`` (no shuffle). Deduplication is one shuffle: full
rows through ``distinct`` (partial aggregation map-side), or keep-first per key through
``first_per_key`` (partial ``WindowGroupLimit`` map-side).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import NUMERIC_TYPES, quote, text_form
from .keys import helper_name
from .order import first_per_key, order_columns, source_order


def _is_numeric(t: T.DataType) -> bool:
    return isinstance(t, NUMERIC_TYPES)


def reconcile_types(frames: Sequence[DataFrame]) -> list[DataFrame]:
    """Make same-named columns stackable (rule D5).

    Equal types stay; numeric types widen as Spark widens them; any other mix becomes
    the text form of each side, like pandas' mixed object column. Spark's own coercion
    would turn int + string into BIGINT and fail at run time on the first word.
    """
    seen: dict[str, list[T.DataType]] = {}
    for df in frames:
        for f in df.schema.fields:
            if not isinstance(f.dataType, T.NullType):
                seen.setdefault(f.name.lower(), []).append(f.dataType)
    to_text = set()
    for name, types in seen.items():
        distinct = {t.simpleString() for t in types}
        if len(distinct) > 1 and not all(_is_numeric(t) for t in types):
            to_text.add(name)
    if not to_text:
        return list(frames)
    out = []
    for df in frames:
        cols = []
        for f in df.schema.fields:
            c = F.col(quote(f.name))
            if f.name.lower() in to_text and not isinstance(f.dataType, T.StringType):
                c = text_form(c, f.dataType) if not isinstance(f.dataType, T.NullType) else c.cast("string")
            cols.append(c.alias(f.name))
        out.append(df.select(*cols))
    return out


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    frames = reconcile_types(frames)
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def _dedup(stacked: DataFrame, user_cols: list[str], dedup_key: str | None, order: list[Column]) -> DataFrame:
    if dedup_key is None:
        return stacked.select(*[F.col(quote(c)) for c in user_cols]).distinct()
    if dedup_key not in user_cols:
        raise ValueError(f"dedup key {dedup_key!r} is not a column of the stacked table")
    kept = first_per_key(stacked, dedup_key, order)
    return kept.select(*[F.col(quote(c)) for c in user_cols])


def combine(frames: Sequence[DataFrame], *, columns: Sequence[str] | None = None, dedup: bool = False,
            dedup_key: str | None = None, orders: Sequence[Sequence[str | Column]] | None = None) -> DataFrame:
    """Stack any number of tables by column name, first-seen column order.

    ``columns`` keeps, from each input, those of the listed columns it has, in list
    order; an input with none of them contributes all-null rows (R15). ``dedup`` drops
    repeated rows (``dedup_key=None``) or keeps the first row per raw key value, inputs
    in the given order and rows in ``orders[i]`` within input ``i`` (R16, D1); without an
    order, in file order.
    """
    frames = list(frames)
    if not frames:
        raise ValueError("nothing to combine")
    whole = list(frames)
    if columns:
        frames = [df.select(*[F.col(quote(c)) for c in columns if c in df.columns]) for df in frames]
    if not dedup or dedup_key is None:
        stacked = _union(frames)
        return _dedup(stacked, stacked.columns, None, []) if dedup else stacked
    if any(df.isStreaming for df in frames):
        raise ValueError("keep-first by key on a stream is first-arrival: stack the streams, then use "
                         "tabrecon.streaming.reconcile.stream_dedup(stacked, key)")
    places: set[str] = set()
    if orders is not None and len(orders) != len(frames):
        raise ValueError("keep-first dedup takes one order per input (rule D1)")
    if orders is None or any(not o for o in orders):
        # File order, where the caller gives none (before a choice of columns: see ``whole``).
        orders = list(orders or [None] * len(frames))
        for i, order in enumerate(orders):
            if not order:
                place = helper_name("place")
                tagged = source_order(whole[i], place)
                frames[i] = tagged.select(*[F.col(quote(c)) for c in frames[i].columns], place)
                orders[i] = [place]
                places.add(place)
    src = helper_name("src")
    width = max(len(o) for o in orders)
    ord_names = [helper_name("ord") for _ in range(width)]
    tagged = []
    for i, (df, order) in enumerate(zip(frames, orders)):
        cols = order_columns(order)
        extra = [F.lit(i).alias(src)] + [
            (cols[j] if j < len(cols) else F.lit(None)).alias(ord_names[j]) for j in range(width)
        ]
        tagged.append(df.select("*", *extra))
    stacked = _union(tagged)
    user_cols = [c for c in stacked.columns if c not in {src, *ord_names, *places}]
    return _dedup(stacked, user_cols, dedup_key, [F.col(src)] + [F.col(n) for n in ord_names])


def stack(a: DataFrame, b: DataFrame, *, dedup: bool = False, dedup_key: str | None = None,
          order_a: Sequence[str | Column] | None = None, order_b: Sequence[str | Column] | None = None) -> DataFrame:
    """A over B by column name (R11); optional dedup of rows (R12) or by key, A first."""
    orders = None if order_a is None and order_b is None else [order_a, order_b]
    return combine([a, b], dedup=dedup, dedup_key=dedup_key, orders=orders)
