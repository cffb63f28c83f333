"""Times and dates: lenient parsing, calendar arithmetic, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_time(c: Column) -> Column:
    """An ISO time in text, with ``Z`` or an offset or none, as UTC without a zone; what can't be read is NULL."""
    return F.to_utc_timestamp(c.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")


def any_date(c: Column) -> Column:
    """``2024-1-2`` or ``1/2/2024`` (month first) as a date; anything else is NULL."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-M-d")), F.try_to_timestamp(c, F.lit("M/d/yyyy"))).cast("date")


def clock_seconds(c: Column) -> Column:
    """Seconds of ``H:MM:SS`` or ``MM:SS``; anything else is NULL."""
    p = F.transform(F.split(c, ":"), lambda x: x.try_cast("int"))
    at = lambda i: F.get(p, F.lit(i))
    return F.when(F.size(p) == 3, at(0) * 3600 + at(1) * 60 + at(2)).when(F.size(p) == 2, at(0) * 60 + at(1))


def compact_date(c: Column) -> Column:
    """``YYYYMMDD`` as ``YYYY-MM-DD``; other lengths are NULL."""
    return F.when(F.length(c) == 8, F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2)))


def month_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def month_start(c: Column) -> Column:
    """First day of the month (``date_trunc`` alone would give a time with a zone)."""
    return F.trunc(c.cast("date"), "month")


def months_back(day: Column, n: int) -> Column:
    """First day of the month ``n`` months before."""
    return F.add_months(month_start(day), -n)


def age_months(since: Column, as_of: Column) -> Column:
    """Age in months of 30.4375 days, to one place."""
    return F.round((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / F.lit(2629800e6), 1)


def days_since(since: Column, as_of: Column) -> Column:
    """Whole days from ``since`` to ``as_of``, towards minus infinity; -1 if it never was."""
    us = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))
    return F.coalesce(F.floor(us / F.lit(86_400_000_000)).cast("int"), F.lit(-1))


def local_day(c: Column, zone: str) -> Column:
    """Date in a time zone of a UTC time without a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), c.cast("timestamp_ntz")).cast("date")


def era(month: Column, switch: str) -> Column:
    """``before`` or ``after``; the month of the switch is after."""
    return F.when(month < F.lit(switch), "before").otherwise("after")
