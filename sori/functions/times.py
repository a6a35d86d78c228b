"""Dates and months, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: ordinal of 1970-01-01 when 0001-01-01 is day 1.
EPOCH_ORDINAL = 719163
LOCAL_ZONE = "Asia/Seoul"


def local_time(utc: Column) -> Column:
    """Local wall-clock time of a UTC time without a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_ZONE), utc.cast("timestamp_ntz"))


def ordinal(day: Column) -> Column:
    return F.unix_date(day) + EPOCH_ORDINAL


def from_ordinal(n: Column) -> Column:
    return F.date_from_unix_date((n - EPOCH_ORDINAL).cast("int"))


def day_number(day: Column, last_day: str, last_number: int = 60) -> Column:
    """Number of a day if ``last_day`` has ``last_number``."""
    return F.lit(last_number) - F.datediff(F.lit(last_day).cast("date"), day)


def weekend(day: Column) -> Column:
    return F.weekday(day) >= 5


def month_bounds(day: Column) -> tuple[Column, Column, Column]:
    """First and last day of a day's month, first day of the month before."""
    first = F.trunc(day, "month").cast("date")
    return first, F.last_day(day), F.add_months(first, -1)
