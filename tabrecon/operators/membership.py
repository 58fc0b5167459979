"""Key membership: subtract (A − B), intersect (A ∩ B) and their not-found outputs.

"Subtract" and "intersect" keep A's rows and multiplicity; they are semi/anti joins on
the normalised key, not SQL EXCEPT/INTERSECT. The build side is always the *distinct*
key set, so repeated keys in B are collapsed before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attach import attach_first_match
from .keys import KeyRule, blank_aware_join, distinct_keys, helper_name, key_rule, key_set, split_on, with_key, wrapped


@dataclass
class Result:
    """Main output plus the optional side outputs; each is a lazy DataFrame (rule D12)."""

    data: DataFrame
    not_found: DataFrame | None = None
    found: DataFrame | None = None
    source: DataFrame | None = None  # one join that holds the rows of all outputs, and
    views: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)  # how to read each from it


def _filter(a: DataFrame, col_a: str, keys: DataFrame, kname: str, rule: KeyRule, minus: bool) -> DataFrame:
    ka = helper_name("k")
    tagged = with_key(a, col_a, rule, ka)
    return blank_aware_join(tagged, ka, keys, kname, rule, "anti" if minus else "semi")


def subtract(a: DataFrame, b: DataFrame, on: str | tuple[str, str], *, null_text: str = "") -> DataFrame:
    """Rows of ``a`` whose key is not in ``b`` (R2). Blank A keys survive iff B has none."""
    col_a, col_b = split_on(on)
    rule = key_rule([(a, col_a), (b, col_b)], null_text=null_text)
    kb = helper_name("kb")
    return _filter(a, col_a, key_set(b, col_b, rule, kb), kb, rule, True)


def not_found(a: DataFrame, b: DataFrame, on: str | tuple[str, str], *, null_text: str = "") -> DataFrame:
    """Rows of ``b`` whose key is not in ``a``."""
    col_a, col_b = split_on(on)
    return subtract(b, a, (col_b, col_a), null_text=null_text)


def intersect(a: DataFrame, b: DataFrame, on: str | tuple[str, str], *,
              select_a: Sequence[str] | None = None, select_b: Sequence[str] | None = None,
              principal: str = "A", suffix: str = " (B)", order_b: Sequence[str | Column] | None = None,
              include_not_found: bool = False, null_text: str = "") -> Result:
    """Rows of ``a`` whose key is in ``b``.

    ``select_a`` keeps only those columns of A (unknown names ignored; none left = all,
    R4). ``select_b`` attaches those columns from the *first* B row of each key in
    ``order_b`` (R5); ``principal`` says which side keeps bare names on a clash.
    ``include_not_found`` adds B's rows whose key is in no A row (R6).
    """
    col_a, col_b = split_on(on)
    rule = key_rule([(a, col_a), (b, col_b)], null_text=null_text)
    select_a = list(select_a or [])
    select_b = list(select_b or [])
    if select_b:
        # Every A row kept by the membership test has exactly one first-match in B,
        # so attaching by an inner join on the first-per-key side is the whole job.
        data = attach_first_match(a, col_a, b, col_b, rule, select_a=select_a, select_b=select_b,
                                  principal=principal, suffix=suffix, order_b=order_b, how="inner").data
    else:
        kb = helper_name("kb")
        data = _keep(_filter(a, col_a, key_set(b, col_b, rule, kb), kb, rule, False), select_a)
    if not include_not_found:
        return Result(data)
    nf = not_found(a, b, (col_a, col_b), null_text=null_text)
    if select_b:
        return Result(data, not_found=nf)
    source, views = _both_sides(a, col_a, b, col_b, rule, select_a)
    return Result(data, not_found=nf, source=source, views=views)


def _both_sides(a: DataFrame, col_a: str, b: DataFrame, col_b: str, rule: KeyRule,
                select_a: Sequence[str]) -> tuple[DataFrame, dict[str, Callable[[DataFrame], DataFrame]]]:
    """A's matched rows and B's unmatched ones in one table, tagged with their output: each key's set of sides
    (one aggregate of both key columns) meets the rows of both sides in one join."""
    key, set_key, bits, tag, row_a, row_b = (helper_name(s) for s in ("k", "ks", "bits", "output", "a", "b"))
    kept = _keep(a, select_a)
    left = a.select(rule.key(a, col_a).alias(key), F.lit("result").alias(tag), F.struct(*[a[f"`{c}`"] for c in kept.columns]).alias(row_a),
                    F.lit(None).cast(b.schema).alias(row_b))
    right = b.select(rule.key(b, col_b).alias(key), F.lit("not_found").alias(tag), F.lit(None).cast(kept.schema).alias(row_a),
                     F.struct(*[b[f"`{c}`"] for c in b.columns]).alias(row_b))
    sides = file_sets([a.select(F.col(f"`{col_a}`").alias(set_key)), b.select(F.col(f"`{col_b}`").alias(set_key))], set_key, rule, set_key, bits)
    joined = blank_aware_join(left.unionAll(right), key, sides, set_key, rule, "inner", payload=[bits])
    source = joined.where(((F.col(tag) == "result") & in_file(bits, 1)) | ((F.col(tag) == "not_found") & ~in_file(bits, 0))).drop(bits)

    def view(name: str, row: str) -> Callable[[DataFrame], DataFrame]:
        return lambda df: df.where(F.col(tag) == name).select(f"{row}.*")

    return source, {"result": view("result", row_a), "not_found": view("not_found", row_b)}


def _union_keys(frames: Sequence[DataFrame], column: str, rule: KeyRule, name: str) -> DataFrame:
    parts = [df.select(rule.key(df, column).alias(name)) for df in frames]
    return distinct_keys(reduce(DataFrame.unionAll, parts), name)


WORD_BITS = 63  # files per long of a key's file set


def file_sets(frames: Sequence[DataFrame], column: str, rule: KeyRule, name: str, bits: str) -> DataFrame:
    """(``name``, ``bits``): each key of several files once, with the set of files that hold it as a bitset
    (an array of longs, file i at bit i % 63 of word i / 63). One aggregate, combined map-side: a key
    costs one row per task, however many rows and files hold it."""
    words = -(-len(frames) // WORD_BITS)
    parts = []
    for i, df in enumerate(frames):
        own = [F.lit(1 << i % WORD_BITS if w == i // WORD_BITS else 0).cast("long").alias(f"w{w}") for w in range(words)]
        parts.append(df.select(wrapped(rule.key(df, column)).alias("box"), *own))
    sets = reduce(DataFrame.unionAll, parts).groupBy("box").agg(F.array(*[F.bit_or(f"w{w}") for w in range(words)]).alias(bits))
    return sets.select(F.col("box.k").alias(name), bits)


def in_file(bits: str | Column, i: int) -> Column:
    """Whether file ``i`` is in a file set; a null set holds none."""
    word = F.get(F.col(bits) if isinstance(bits, str) else bits, i // WORD_BITS)
    return F.coalesce(word.bitwiseAND(F.lit(1 << i % WORD_BITS).cast("long")) != 0, F.lit(False))


def with_file_sets(df: DataFrame, column: str, frames: Sequence[DataFrame], file_column: str, *, name: str = "_files",
                   null_text: str = "") -> DataFrame:
    """``df`` plus ``name``: the positions (array of int) of the files of ``frames`` that hold the row's key. From
    this one join come the matches and the rows not found of every single file (R7–R10)."""
    rule = key_rule([(df, column)] + [(f, file_column) for f in frames], null_text=null_text)
    kd, kf, bits = helper_name("kd"), helper_name("kf"), helper_name("bits")
    joined = blank_aware_join(with_key(df, column, rule, kd), kd, file_sets(frames, file_column, rule, kf, bits), kf, rule, "left", payload=[bits])
    held = F.filter(F.array(*[F.when(in_file(bits, i), F.lit(i)) for i in range(len(frames))]), lambda x: x.isNotNull())
    return joined.withColumn(name, held).drop(bits)


def _held(stacked: DataFrame, key: str, sets: DataFrame, set_key: str, bits: str, rule: KeyRule, minus: bool) -> DataFrame:
    """Stacked rows whose key is in some file set (or in none). The set is a payload of the join: a semi or anti
    join would be pushed below the stack, one join per stacked file."""
    joined = blank_aware_join(stacked, key, sets, set_key, rule, "left", payload=[bits])
    return joined.where(F.col(bits).isNull() if minus else F.col(bits).isNotNull()).drop(bits)


def _keep(df: DataFrame, select_a: Sequence[str] | None) -> DataFrame:
    """Only the selected columns that exist; none left = all (R4, in every mode: D20)."""
    keep = [c for c in (select_a or []) if c in df.columns]
    return df.select(*[df[f"`{c}`"] for c in keep]) if keep else df


def membership_many_b(a: DataFrame, bs: Sequence[DataFrame], col_a: str, col_b: str, *, minus: bool,
                      include_not_found: bool = False, select_a: Sequence[str] | None = None,
                      null_text: str = "") -> Result:
    """One A against the union of the keys of several B tables (R7); not-found: the B
    rows whose key is in no A row, stacked by column name (R8).

    For the not-found the key is computed on each B before the stack (rule D5 may change
    a column's type there); the stacked B then meets A's key set in one join, whatever the
    number of Bs (see :func:`_held`)."""
    from .stack import combine

    if not bs:
        raise ValueError("add at least one B table")
    rule = key_rule([(a, col_a)] + [(b, col_b) for b in bs], null_text=null_text)
    kb = helper_name("kb")
    data = _keep(_filter(a, col_a, _union_keys(bs, col_b, rule, kb), kb, rule, minus), select_a)
    nf = None
    if include_not_found and not minus:
        ka, kbs, bits = helper_name("ka"), helper_name("kbs"), helper_name("bits")
        stacked = combine([with_key(b, col_b, rule, kbs) for b in bs])
        nf = _held(stacked, kbs, file_sets([a], col_a, rule, ka, bits), ka, bits, rule, True)
    return Result(data, not_found=nf)


def membership_many_a(as_: Sequence[DataFrame], b: DataFrame, col_a: str, col_b: str, *, minus: bool,
                      include_not_found: bool = False, select_a: Sequence[str] | None = None,
                      null_text: str = "") -> Result:
    """Several A tables filtered against one B and stacked by name (R9); not-found holds
    B's rows whose key is in no A table (R10).

    The key is computed on each A *before* the stack, because stacking may change a
    column's type (rule D5). The stacked table meets B's keys in one join, whatever the number of As
    (see :func:`_held`).
    """
    from .stack import combine

    if not as_:
        raise ValueError("add at least one A table")
    rule = key_rule([(a, col_a) for a in as_] + [(b, col_b)], null_text=null_text)
    ka, kb, bits = helper_name("ka"), helper_name("kb"), helper_name("bits")
    stacked = combine([with_key(a, col_a, rule, ka) for a in as_])
    data = _keep(_held(stacked, ka, file_sets([b], col_b, rule, kb, bits), kb, bits, rule, minus), select_a)
    nf = None
    if include_not_found and not minus:
        nf = _filter(b, col_b, _union_keys(as_, col_a, rule, ka), ka, rule, True)
    return Result(data, not_found=nf)


def _many(as_: DataFrame | Sequence[DataFrame], bs: DataFrame | Sequence[DataFrame], on: str | tuple[str, str],
          minus: bool, **kw) -> Result:
    as_ = [as_] if isinstance(as_, DataFrame) else list(as_)
    bs = [bs] if isinstance(bs, DataFrame) else list(bs)
    if not as_ or not bs:
        raise ValueError("add at least one A table and one B table")
    if len(as_) > 1 and len(bs) > 1:
        raise ValueError("several A tables and several B tables at once are not supported")
    col_a, col_b = split_on(on)
    if len(bs) == 1:
        return membership_many_a(as_, bs[0], col_a, col_b, minus=minus, **kw)
    return membership_many_b(as_[0], bs, col_a, col_b, minus=minus, **kw)


def subtract_many(as_: DataFrame | Sequence[DataFrame], bs: DataFrame | Sequence[DataFrame],
                  on: str | tuple[str, str], *, select_a: Sequence[str] | None = None, null_text: str = "") -> DataFrame:
    """Subtract with several A tables (each filtered, then stacked by name: R9) or several
    B tables (A against the union of their keys: R7)."""
    return _many(as_, bs, on, True, select_a=select_a, null_text=null_text).data


def intersect_many(as_: DataFrame | Sequence[DataFrame], bs: DataFrame | Sequence[DataFrame],
                   on: str | tuple[str, str], *, select_a: Sequence[str] | None = None,
                   include_not_found: bool = False, null_text: str = "") -> Result:
    """Intersect with several A tables (R9) or several B tables (R7); ``include_not_found``
    adds the B rows whose key is in no A row (R8, R10)."""
    return _many(as_, bs, on, False, select_a=select_a, include_not_found=include_not_found,
                 null_text=null_text)
