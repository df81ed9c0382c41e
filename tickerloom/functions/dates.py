"""Date parsing and calendars."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tickerloom.functions.numbers import col


def to_date(c: Column | str, day_first: bool = False) -> Column:
    """ISO dates, or day-first dates such as 31/12/2020; unreadable text becomes NULL."""
    text = F.trim(col(c).cast("string"))
    return F.try_to_date(text, "dd/MM/yyyy" if day_first else "yyyy-MM-dd")


def date_part(c: Column | str) -> Column:
    """The date in front of the first blank of a 'date time zone' string."""
    return F.try_to_date(F.get(F.split(col(c), " ", 2), F.lit(0)), "yyyy-MM-dd")


def time_part(c: Column | str) -> Column:
    return F.get(F.split(col(c), " ", 2), F.lit(1))


def iso_day(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def iso_stamp(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss")


def year_start(c: Column | str) -> Column:
    return F.trunc(col(c), "year")


def next_business_days(c: Column | str, n: int = 5) -> Column:
    """Array of the n weekdays after a date."""
    horizon = n + 2 * (n // 5 + 2)
    days = F.sequence(F.date_add(col(c), 1), F.date_add(col(c), horizon))
    return F.slice(F.filter(days, lambda d: ~F.dayofweek(d).isin(1, 7)), 1, n)
