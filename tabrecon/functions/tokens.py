"""File-name tokens for split outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import column_type, quote, strip, text_form

# Fixed values (must equal the reference's for the same file names): the characters
# replaced by "_" in a group file name, the name length limit, and the name of an
# all-blank group. NULL_GROUP is ours (the reference prints a null as "nan").
FORBIDDEN = '/\\:*?"<>|'
GROUP_MAX = 200
BLANK_GROUP = "(vide)"
NULL_GROUP = "(null)"


def _hash_hex(parts: Sequence[tuple[Column, Column]]) -> Column:
    """16 hex digits of xxhash64 over (is-null flag, text) of each raw value."""
    args: list[Column] = []
    for raw, text in parts:
        args += [raw.isNull(), F.coalesce(text, F.lit(""))]
    return F.lpad(F.lower(F.hex(F.xxhash64(*args))), 16, "0")


def _token(raws: Sequence[Column], texts: Sequence[Column], cleaned: Sequence[Column]) -> Column:
    shown = [F.coalesce(c, F.lit(NULL_GROUP)) for c in cleaned]
    all_blank = F.lit(True)
    lossy = F.lit(False)
    for t, cl in zip(texts, cleaned):
        all_blank = all_blank & F.coalesce(cl == "", F.lit(False))
        lossy = lossy | t.isNull() | (t != cl)
        if len(cleaned) > 1:
            lossy = lossy | F.coalesce(cl.contains("_"), F.lit(False))
    base = F.when(all_blank, F.lit(BLANK_GROUP)).otherwise(F.concat_ws("_", *shown))
    lossy = lossy | all_blank | (F.length(base) > GROUP_MAX)
    tagged = F.concat(F.substring(base, 1, GROUP_MAX - 17), F.lit("~"), _hash_hex(list(zip(raws, texts))))
    return F.when(lossy, tagged).otherwise(base)


def _clean(text: Column) -> Column:
    return F.translate(strip(text), FORBIDDEN, "_" * len(FORBIDDEN))


def with_group_token(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """``df`` plus the ``group_token`` column ``name``, with each value's text and cleaned
    text computed once per row in a first projection (the token refers to them several
    times; the optimizer keeps such a projection rather than inline it)."""
    texts = [text_form(c, column_type(df, c)) for c in columns]
    t_names = [f"_tok_t{i}_{name}" for i in range(len(columns))]
    c_names = [f"_tok_c{i}_{name}" for i in range(len(columns))]
    staged = df.select("*", *[t.alias(n) for t, n in zip(texts, t_names)],
                       *[_clean(F.col(n)).alias(c) for n, c in zip(t_names, c_names)])
    token = _token([F.col(quote(c)) for c in columns], [F.col(n) for n in t_names], [F.col(c) for c in c_names])
    return staged.withColumn(name, token).drop(*t_names, *c_names)


def group_token(df: DataFrame, columns: Sequence[str]) -> Column:
    """Name of the output a row goes to when splitting by ``columns``.

    Each value is stripped and ``/\\:*?"<>|`` become ``_``; values join with ``_``; an
    all-blank group is ``(vide)``; the name is cut at 200 characters. When that loses
    information (a null, a changed or blank value, ``_`` inside a value of a multi-column
    split, or the cut) 16 hex digits of a hash of the raw values are appended, so two
    raw groups never share a file (rule D15). The rule needs no other row: no extra job.
    """
    texts = [text_form(c, column_type(df, c)) for c in columns]
    return _token([F.col(quote(c)) for c in columns], texts, [_clean(t) for t in texts])


def sanitize_path_token(c: Column, max_length: int) -> Column:
    """``/`` and ``\\`` to ``_``, cut at ``max_length`` (sheet and source names)."""
    return F.substring(F.translate(c, "/\\", "__"), 1, max_length)
