"""Column expressions (JVM-side, codegen-friendly) for the scalar operators.

Every function takes and returns ``pyspark.sql.Column`` objects so callers can
combine them in one ``select``/``withColumns``; none of them triggers a job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must equal the reference's behaviour.
# Boolean-like spellings accepted for a boolean template column.
BOOLEAN_TOKENS = ["true", "false", "0", "1"]
# Marker prepended by tail truncation: "[...{k} chars truncated...]\n".
TRUNCATION_PREFIX = "[..."
TRUNCATION_SUFFIX = " chars truncated...]\n"
# A warning block: a line "/path:N: ...Warning: ..." plus the indented lines after it.
WARNING_BLOCK_PATTERN = r"(?m)^/.+?:\d+:.*?Warning:.*?$\n(?:^\s+.*?$\n)*"
# Token pattern equal to a Unicode "\b\w\w+\b": runs of 2+ letters, digits or "_".
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
# Layouts tried after the ISO forms a plain cast accepts
# (yyyy-MM-dd, yyyy-MM-dd HH:mm:ss[.ffffff], with a space or "T").
DATETIME_FORMATS = [
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy",
    "yyyy/MM/dd",
]

def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_missing(col: str | Column, dtype: T.DataType | None = None) -> Column:
    """pandas-style NA test: NULL, and NaN for floating columns."""
    c = _c(col)
    if dtype is not None and is_floating(dtype):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def missing_indicator(col: str | Column, dtype: T.DataType | None = None) -> Column:
    """0/1 integer flag."""
    return is_missing(col, dtype).cast("int")


def lenient_timestamp(col: str | Column, dtype: T.DataType | None = None) -> Column:
    """parse a value as a timestamp; anything unparseable becomes NULL."""
    c = _c(col)
    if dtype is not None and isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp_ntz")
    if dtype is not None and isinstance(dtype, T.DateType):
        return c.cast("timestamp_ntz")
    s = F.btrim(c.cast("string"))
    tries = [s.try_cast("timestamp_ntz")]
    tries += [F.try_to_timestamp(s, F.lit(f)).cast("timestamp_ntz") for f in DATETIME_FORMATS]
    return F.coalesce(*tries)


def date_parts(col: str | Column, name: str, dtype: T.DataType | None = None) -> dict[str, Column]:
    """``c__year``, ``c__month``, ``c__day`` from a lenient parse (NULL stays NULL)."""
    ts = lenient_timestamp(col, dtype)
    return {
        f"{name}__year": F.year(ts).cast("double"),
        f"{name}__month": F.month(ts).cast("double"),
        f"{name}__day": F.dayofmonth(ts).cast("double"),
    }


def lenient_double(col: str | Column, dtype: T.DataType | None = None) -> Column:
    """numeric parse, bad values become NULL; NaN normalised to NULL."""
    c = _c(col)
    if dtype is not None and isinstance(dtype, T.BooleanType):
        d = c.cast("double")
    elif dtype is not None and isinstance(dtype, T.NumericType):
        d = c.cast("double")
    else:
        d = F.btrim(c.cast("string")).try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def log1p_clipped(col: str | Column) -> Column:
    """log1p(max(x, 0)); NULL stays NULL (Spark's greatest would skip it)."""
    c = _c(col)
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))


def string_form(col: str | Column, dtype: T.DataType | None = None) -> Column:
    """value as text for encoding; missing becomes the literal ``nan``."""
    c = _c(col)
    if dtype is not None and is_floating(dtype):
        s = F.when(F.isnan(c), F.lit(None)).otherwise(c.cast("string"))
    else:
        s = c.cast("string")
    return F.coalesce(s, F.lit("nan"))


def boolean_like(col: str | Column) -> Column:
    """true when the value (non-null) spells a boolean."""
    return F.lower(_c(col).cast("string")).isin(BOOLEAN_TOKENS)


def integer_like(col: str | Column) -> Column:
    """F8: a non-null number with no fractional part (inf and NaN fail)."""
    c = _c(col).cast("double")
    return c.isNotNull() & ~F.isnan(c) & ((c % F.lit(1.0)) == F.lit(0.0))


def threshold_label(probability: str | Column, threshold: float = 0.5) -> Column:
    """positive label when P(class 1) >= threshold (inclusive, unlike Spark ML's ``>``)."""
    return (_c(probability) >= F.lit(threshold)).cast("int")


def strip_warnings(col: str | Column) -> Column:
    """drop warning blocks, then strip surrounding whitespace."""
    return F.btrim(F.regexp_replace(_c(col), WARNING_BLOCK_PATTERN, ""), F.lit(" \t\r\n"))


def truncate_tail(col: str | Column, max_chars: int) -> Column:
    """keep the last ``max_chars - 80`` characters behind a marker."""
    c = _c(col)
    keep = max_chars - 80
    n = F.char_length(c)
    marker = F.concat(F.lit(TRUNCATION_PREFIX), (n - F.lit(keep)).cast("string"), F.lit(TRUNCATION_SUFFIX))
    return F.when(n <= F.lit(max_chars), c).otherwise(F.concat(marker, F.substring(c, -keep, keep) if keep > 0 else F.lit("")))


def clamp(col: str | Column, low: int | float, high: int | float) -> Column:
    """F17."""
    return F.greatest(F.lit(low), F.least(_c(col), F.lit(high)))


def clamp_int(value: int, low: int, high: int) -> int:
    return max(low, min(value, high))


def first_line(col: str | Column, width: int = 100) -> Column:
    """first line of the stripped text, at most ``width`` characters."""
    stripped = F.btrim(_c(col), F.lit(" \t\r\n"))
    return F.substring(F.split(stripped, "\n").getItem(0), 1, width)


def base64_text(col: str | Column) -> Column:
    """base64 of the UTF-8 bytes, on one line (Spark wraps at 76 chars)."""
    return F.regexp_replace(F.base64(F.encode(_c(col), "UTF-8")), r"[\r\n]", "")


def unbase64_text(col: str | Column) -> Column:
    return F.decode(F.unbase64(_c(col)), "UTF-8")


def json_object_or_null(col: str | Column, schema: str | T.DataType) -> Column:
    """decode a JSON object; malformed or non-object input gives NULL."""
    c = F.btrim(_c(col))
    return F.when(c.startswith("{"), F.from_json(c, schema, {"mode": "PERMISSIVE"}))


def variant_object_or_null(col: str | Column) -> Column:
    """F14 without a schema given beforehand: a JSON object as a variant; malformed or non-object input gives NULL."""
    v = F.try_parse_json(_c(col))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def compact_json(col: str | Column) -> Column:
    """compact JSON encoding of a struct/map/array column."""
    return F.to_json(_c(col))
