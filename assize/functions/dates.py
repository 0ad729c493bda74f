"""Dates, times and amounts as they come in files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date formats in order of trial, with the shape that admits each.
DATE_FORMATS = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"),
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
    (r"^\d{2}-\d{2}-\d{4}$", "dd-MM-yyyy"),
    (r"^\d{8}$", "yyyyMMdd"),
)


def any_date(c: Column) -> Column:
    """The date of a text in the first format that fits; impossible dates are null."""
    text = F.trim(c)
    return F.coalesce(*[F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(fmt)).cast("date")) for shape, fmt in DATE_FORMATS])


def reordered_date(c: Column) -> Column:
    """``dd/mm/yyyy`` written as ``yyyy-mm-dd`` without a look at the calendar."""
    return F.regexp_replace(F.trim(c), r"^(\d{2})/(\d{2})/(\d{4})$", "$3-$2-$1")


def iso_prefix_date(c: Column) -> Column:
    return F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def month_start(c: Column) -> Column:
    return F.trunc(c, "MM")


def month_key(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def non_negative_days(later: Column, earlier: Column) -> Column:
    days = F.datediff(later, earlier)
    return F.when(days >= 0, days)


def business_days(first: Column) -> Column:
    """Mondays to Fridays in the month that starts at ``first``."""
    return F.size(F.filter(F.sequence(first, F.last_day(first)), lambda d: F.weekday(d) < 5))


def clock(c: Column) -> Column:
    """``10h30``, ``10h`` or ``10:30`` as HH:MM."""
    hour, minute = F.regexp_extract(c, r"(\d{1,2})\s*[h:]\s*(\d{2})?", 1), F.regexp_extract(c, r"(\d{1,2})\s*[h:]\s*(\d{2})?", 2)
    return F.when((hour != "") & (hour.cast("int") < 24), F.concat_ws(":", F.lpad(hour, 2, "0"), F.when(minute == "", "00").otherwise(minute)))


def year(c: Column) -> Column:
    value = F.nullif(F.regexp_extract(c.cast("string"), r"^\s*(\d{4})(?:\.0)?\s*$", 1), F.lit("")).cast("int")
    return F.when(value.between(1900, 2100), value)


def amount(c: Column) -> Column:
    """``1.234,56`` as a number."""
    text = F.regexp_replace(F.regexp_replace(F.trim(c), r"\.", ""), ",", ".")
    return F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text.cast("double"))
