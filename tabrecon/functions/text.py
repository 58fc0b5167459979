"""Scalar text functions: the text form of a value, key normalisation, numeric coercion.

Everything here returns a ``Column`` built from built-in Spark functions, so it stays
inside whole-stage codegen and is pushed through projections by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The code points Python's ``str.isspace`` treats as whitespace, i.e. the
# characters ``str.strip()`` removes. U+0009..U+000D, U+001C..U+0020, U+0085, U+00A0,
# U+1680, U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000 (29 code points).
PY_WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d"
    "\u001c\u001d\u001e\u001f\u0020"
    "\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL_TYPES = (T.FloatType, T.DoubleType)
NUMERIC_TYPES = INTEGRAL_TYPES + FRACTIONAL_TYPES + (T.DecimalType,)
TIMESTAMP_TYPES = (T.TimestampType, T.TimestampNTZType)

# A number as Python's ``float()`` / pandas ``to_numeric`` reads it: optional sign,
# digits with an optional point, optional exponent, or inf/infinity/nan. Spark's cast
# also accepts ``1d``, ``1f`` and hexadecimal forms, which Python rejects.
_PY_NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"


def _col(c: str | Column) -> Column:
    return F.col(quote(c)) if isinstance(c, str) else c


def quote(name: str) -> str:
    """Backtick-quote a column name so dots, spaces and brackets are taken literally."""
    return "`" + name.replace("`", "``") + "`"


def strip(c: Column) -> Column:
    """Python ``str.strip()``: remove the 29 Unicode whitespace code points at both ends."""
    return F.btrim(c, F.lit(PY_WHITESPACE))


def _float_text(c: Column) -> Column:
    """Python ``str(float)``: the shortest digits that read back as the same double.

    Java's ``Double.toString`` gives those digits too, except that JDKs before 19 can
    emit too many digits (18 significant); then the value is re-rendered with the fewest
    of 15, 16 or 17 significant digits that reads back equal. (A tie in that 18th digit
    can still round the 17th digit differently from Python; JDK 19+ has no such case.) The layout then follows
    Python: plain notation for 1e-4 <= |x| < 1e16, else ``1.5e-05`` / ``1e+16``.
    """
    java = c.cast("string")
    digits = F.regexp_replace(F.regexp_extract(java, r"^-?([0-9.]+)", 1), r"\.", "")
    significant = F.length(F.regexp_replace(digits, r"^0+|0+$", ""))
    d15, d16 = F.format_string("%.14e", c), F.format_string("%.15e", c)
    shortest = (F.when(d15.cast("double") == c, d15).when(d16.cast("double") == c, d16)
                .otherwise(F.format_string("%.16e", c)))
    rendered = F.when(significant >= 17, shortest).otherwise(java)
    pattern = r"^(-?)([0-9])\.([0-9]+)[eE]\+?(-?[0-9]+)$"
    sign = F.regexp_extract(rendered, pattern, 1)
    lead = F.regexp_extract(rendered, pattern, 2)
    frac = F.regexp_replace(F.regexp_extract(rendered, pattern, 3), "0+$", "")
    exp = F.regexp_extract(rendered, pattern, 4).cast("int")
    mantissa = F.concat(lead, frac)
    n_int = exp + 1  # integer digits in plain notation
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exp - 1), mantissa)
    large = F.when(
        F.length(mantissa) <= n_int,
        F.concat(sign, mantissa, F.repeat(F.lit("0"), n_int - F.length(mantissa)), F.lit(".0")),
    ).otherwise(F.concat(sign, F.substr(mantissa, F.lit(1), n_int), F.lit("."), F.substr(mantissa, n_int + 1)))
    abs_exp = F.abs(exp).cast("string")
    scientific = F.concat(
        sign,
        lead,
        F.when(frac == "", F.lit("")).otherwise(F.concat(F.lit("."), frac)),
        F.lit("e"),
        F.when(exp < 0, F.lit("-")).otherwise(F.lit("+")),
        F.when(F.abs(exp) < 10, F.concat(F.lit("0"), abs_exp)).otherwise(abs_exp),
    )
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(c), F.lit("nan"))
        .when(java == "Infinity", F.lit("inf"))
        .when(java == "-Infinity", F.lit("-inf"))
        .when(~rendered.rlike("[eE]"), rendered)
        .when((exp >= -4) & (exp < 0), small)
        .when((exp >= 0) & (exp < 16), large)
        .otherwise(scientific)
    )


def _timestamp_text(c: Column) -> Column:
    """pandas ``str(Timestamp)``: seconds always, six fractional digits when non-zero."""
    micros = F.date_format(c, "SSSSSS")
    return F.concat(
        F.date_format(c, "yyyy-MM-dd HH:mm:ss"),
        F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)),
    )


def text_form(c: str | Column, dtype: T.DataType) -> Column:
    """The text a pandas cell of this type prints as (``str(value)``); null stays null."""
    col = _col(c)
    if isinstance(dtype, T.StringType):
        return col
    if isinstance(dtype, INTEGRAL_TYPES) or isinstance(dtype, T.DecimalType):
        return col.cast("string")
    if isinstance(dtype, FRACTIONAL_TYPES):
        return _float_text(col)
    if isinstance(dtype, T.BooleanType):
        return F.when(col.isNull(), F.lit(None).cast("string")).when(col, F.lit("True")).otherwise(F.lit("False"))
    if isinstance(dtype, T.DateType):
        return F.date_format(col, "yyyy-MM-dd")
    if isinstance(dtype, TIMESTAMP_TYPES):
        return _timestamp_text(col)
    return col.cast("string")


def column_type(df: DataFrame, name: str) -> T.DataType:
    """Type of a named column; raises ``ValueError`` naming the column if it is absent."""
    for field in df.schema.fields:
        if field.name == name:
            return field.dataType
    raise ValueError(f"column {name!r} not found; available: {df.columns}")


def normalize_key(c: str | Column, dtype: T.DataType, *, null_text: str = "") -> Column:
    """Key as compared by every two-table operation: text form, stripped, null -> ``null_text``.

    Case is kept. Integral values never carry whitespace, so they skip the strip.
    """
    text = text_form(c, dtype)
    if not isinstance(dtype, INTEGRAL_TYPES):
        text = strip(text)
    return F.coalesce(text, F.lit(null_text))


def key_of(df: DataFrame, column: str, *, null_text: str = "") -> Column:
    """``normalize_key`` of a named column of ``df`` (type looked up from the schema)."""
    return normalize_key(column, column_type(df, column), null_text=null_text)


def to_number(c: str | Column, dtype: T.DataType) -> Column:
    """``pd.to_numeric(errors="coerce")`` as a DOUBLE column: unparsable -> null.

    Text is stripped and must look like a Python float literal; booleans give 1/0.
    Dates and timestamps are refused, since the reference compares them only by accident.
    """
    col = _col(c)
    if isinstance(dtype, NUMERIC_TYPES):
        return col.cast("double")
    if isinstance(dtype, T.BooleanType):
        return col.cast("int").cast("double")
    if isinstance(dtype, (T.DateType,) + TIMESTAMP_TYPES):
        raise ValueError("numeric comparison on a date/time column is not supported")
    text = strip(text_form(col, dtype))
    return F.when(text.rlike(_PY_NUMBER), text.try_cast("double"))


def is_blank(c: str | Column, dtype: T.DataType) -> Column:
    """Null, NaN, or empty after strip (``isna() | astype(str).strip() == ''``)."""
    col = _col(c)
    cond = col.isNull()
    if isinstance(dtype, FRACTIONAL_TYPES):
        cond = cond | F.isnan(col)
    if isinstance(dtype, T.StringType):
        cond = cond | (strip(col) == "")
    return F.coalesce(cond, F.lit(True))
