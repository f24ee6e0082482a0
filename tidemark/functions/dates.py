"""Date and quarter rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import clean


_ISO = r"^\d{4}-\d{2}-\d{2}$"


def iso_day(text: Column) -> Column:
    """Cleaned text in strict ``YYYY-MM-DD`` that exists in the calendar, else null."""
    return F.when(text.rlike(_ISO), text.try_cast("date"))


def iso_day_error(text: Column, day: Column, field: str) -> Column:
    """Message for cleaned ``text`` whose :func:`iso_day` is ``day``."""
    return (
        F.when(day.isNotNull(), F.lit(None).cast("string"))
        .when(text.isNull(), F.lit(f"{field} is required."))
        .when(text.rlike(_ISO), F.lit(f"{field} is an invalid calendar date."))
        .otherwise(F.lit(f"{field} must be in YYYY-MM-DD ISO format."))
    )


def iso_date(c: Column) -> Column:
    return iso_day(clean(c))


def iso_date_error(c: Column, field: str) -> Column:
    return iso_day_error(clean(c), iso_date(c), field)


_LENIENT = r"^\d{4}-\d{1,2}-\d{1,2}$"


def lenient_iso_day(text: Column) -> Column:
    """Cleaned ``YYYY-MM-DD`` where month and day may have one digit."""
    return F.when(text.rlike(_LENIENT), text.try_cast("date"))


def lenient_iso_date(c: Column) -> Column:
    return lenient_iso_day(clean(c))


def filing_day(text: Column) -> Column:
    """Cleaned text in one of the four accepted layouts: 31-MAR-2023, 2023-03-31, 20230331, 31-MAR-23."""
    short = F.try_to_date(text, "d-MMM-yy")
    # Two-digit years from 69 on belong to the 1900s.
    short = F.when(F.year(short) > 2068, F.add_months(short, -1200)).otherwise(short)
    # Only a text with letters can name a month; trying the others costs an exception each.
    return F.when(text.rlike("[A-Za-z]"), F.coalesce(F.try_to_date(text, "d-MMM-yyyy"), short)).when(
        text.rlike(_LENIENT), text.try_cast("date")).when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))


def filing_date(c: Column) -> Column:
    return filing_day(clean(c))


def filing_day_text(text: Column) -> Column:
    """ISO text of :func:`filing_day`; text in no known layout is kept as it is."""
    return F.coalesce(F.date_format(filing_day(text), "yyyy-MM-dd"), text)


def filing_date_text(c: Column) -> Column:
    return filing_day_text(clean(c))


def normalize_period(c: Column) -> Column:
    """``2006Q1`` to ``2006-Q1``."""
    text = F.regexp_replace(F.upper(clean(c)), " ", "")
    dashed = F.concat(F.substring_index(text, "Q", 1), F.lit("-Q"), F.regexp_replace(text, "^[^Q]*Q", ""))
    return F.when(text.contains("Q") & ~text.contains("-"), dashed).otherwise(text)


def period_of(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


def period_index(period: Column) -> Column:
    """Quarters since year zero, from normalized ``YYYY-Qn`` text."""
    return F.substring(period, 1, 4).cast("int") * 4 + F.substring(period, -1, 1).cast("int") - 1


def period_from_index(index: Column) -> Column:
    return F.concat(F.floor(index / 4).cast("string"), F.lit("-Q"), (index % 4 + 1).cast("string"))


def period_first_day(period: Column) -> Column:
    return F.make_date(
        F.substring(period, 1, 4).cast("int"), F.substring(period, -1, 1).cast("int") * 3 - 2, F.lit(1)
    )


def period_last_day(period: Column) -> Column:
    return F.last_day(F.add_months(period_first_day(period), 2))


def within_retention(period: Column, reference: Column, years: int) -> Column:
    """Inside the ``years`` that end with the reference quarter; later quarters are outside."""
    if years <= 0:
        return F.lit(False)
    gap = period_index(reference) - period_index(period)
    return (gap >= 0) & (gap < years * 4)
