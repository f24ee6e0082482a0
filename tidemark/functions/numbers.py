"""Number rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import clean

# Digits may be joined by single underscores (1_000).
_DIGITS = r"\d+(?:_\d+)*"
_NUMBER = rf"(?i)^[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf|infinity|nan)$"


def is_finite(c: Column) -> Column:
    return ~(F.isnan(c) | (F.abs(c) == float("inf")))


def parsed(text: Column) -> Column:
    """Cleaned text to a double; NaN and infinities pass, what is no number is null.

    The pattern comes first: Spark's own cast would also take 1.0d and hexadecimal floats.
    """
    number = F.get(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0)), F.lit(0))
    return F.replace(number, F.lit("_"), F.lit("")).try_cast("double")


def strict_text(text: Column) -> Column:
    """Cleaned text without thousands separators."""
    return F.replace(text, F.lit(","), F.lit(""))


def finite(value: Column) -> Column:
    return F.when(is_finite(value), value)


def parse_error(text: Column, value: Column, field: str) -> Column:
    """Message for cleaned ``text`` whose parsed ``value`` is no finite number; null for blank text."""
    return F.when(text.isNotNull() & value.isNull(), F.lit(f"{field} must be numeric.")).when(
        ~is_finite(value), F.lit(f"{field} must be finite."))


def strict_number(c: Column) -> Column:
    """Commas dropped, blank is null; text that is no finite number is null (see the error)."""
    return finite(parsed(strict_text(clean(c))))


def strict_number_error(c: Column, field: str) -> Column:
    return parse_error(clean(c), parsed(strict_text(clean(c))), field)


def lenient_number(c: Column) -> Column:
    """Anything unparseable is null; NaN and infinities pass."""
    return parsed(clean(c))


def numeric_error(c: Column, field: str) -> Column:
    """For columns that are doubles already."""
    return F.when(~is_finite(c), F.lit(f"{field} must be finite."))


def pct_return(start: Column, end: Column) -> Column:
    """``(end/start - 1) * 100``; null unless both are positive."""
    return F.when((start > 0) & (end > 0), (end / start - 1.0) * 100.0)


def fraction_return(start: Column, end: Column) -> Column:
    return F.when((start > 0) & (end > 0), end / start - 1.0)


def fraction_return_10dp(start: Column, end: Column) -> Column:
    return F.bround(fraction_return(start, end), 10)
