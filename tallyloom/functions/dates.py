"""Calendar arithmetic of billing schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_number(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d)


def calendar_months(start: Column, when: Column) -> Column:
    """Difference of calendar months; the day does not count."""
    return month_number(when) - month_number(start)


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def month_window(d: Column, days: int = 15) -> tuple[Column, Column]:
    """First day of the month less ``days`` to its last day plus ``days``."""
    return F.date_sub(F.trunc(d, "month").cast("date"), days), F.date_add(F.last_day(d), days)


def parse_dates(raw: Column, month_first_fails: Column) -> Column:
    """Month-first, or day-first for a file whose month-first reading fails too often."""
    def tried(*formats: str) -> Column:
        shapes = ("yyyy-M-d", "yyyy/M/d", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", *formats, "d MMM yyyy", "MMM d, yyyy", "d-MMM-yyyy", "d MMMM yyyy", "MMMM d, yyyy")
        return F.coalesce(*[F.try_to_timestamp(F.trim(raw), F.lit(f)) for f in shapes]).cast("date")

    day_first = tried("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d/M/yy")
    return F.when(month_first_fails, day_first).otherwise(tried("M/d/yyyy", "M-d-yyyy", "M.d.yyyy", "M/d/yy"))


def month_name(d: Column) -> Column:
    return F.date_format(d, "MMMM yyyy")


def day_month(d: Column) -> Column:
    return F.date_format(d, "dd MMM")
