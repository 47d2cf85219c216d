"""Calendar-month arithmetic on DATE columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_date(value: Column | dt.date | str) -> Column:
    """A DATE column from a Column, a date or an ISO text."""
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def month_start(day: Column | str) -> Column:
    """First day of the month of a date."""
    return F.trunc(day, "MM").cast("date")


def shift_month(day: Column | str, months: Column | int) -> Column:
    """First day of the month that lies `months` after the month of `day`."""
    return F.add_months(month_start(day), months)


def month_index(day: Column | str) -> Column:
    """Consecutive number of a calendar month, for RANGE frames and month distances."""
    return F.year(day) * 12 + F.month(day)


def in_last_months(day: Column, reference: Column | dt.date | str, months: int) -> Column:
    """Preset period: from the first day `months - 1` months back to the end of the reference month."""
    end = as_date(reference)
    return day.between(shift_month(end, 1 - months), F.last_day(end))


def in_month_range(
    month: Column, start: Column | dt.date | str | None, end: Column | dt.date | str | None
) -> Column:
    """Inclusive range in which either bound may be missing."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (month >= as_date(start))
    if end is not None:
        keep = keep & (month <= as_date(end))
    return keep
