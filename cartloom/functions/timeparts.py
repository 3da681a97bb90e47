"""Date and time parts. Epoch values assume a UTC session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400


def seconds(c: Column) -> Column:
    """Timestamp -> whole epoch seconds."""
    return F.unix_seconds(c.cast("timestamp"))


def micros(c: Column) -> Column:
    """Timestamp -> epoch microseconds."""
    return F.unix_micros(c.cast("timestamp"))


def from_seconds(c: Column) -> Column:
    return F.timestamp_seconds(c)


def from_millis(c: Column) -> Column:
    return F.timestamp_millis(c)


def parts(c: Column) -> dict[str, Column]:
    """Calendar parts of a timestamp; weekday counts from Monday = 0."""
    return {
        "day": F.dayofmonth(c),
        "dow": F.weekday(c),
        "hour": F.hour(c),
        "minute": F.minute(c),
        "second": F.second(c),
    }


def minute_of_day(c: Column) -> Column:
    return F.hour(c) * 60 + F.minute(c)


def wrapped_day(c: Column, below: int = 4, add: int = 28) -> Column:
    """Day of month where the first days continue the month before."""
    day = F.dayofmonth(c)
    return F.when(day < below, day + add).otherwise(day)


def months_between_days(later: Column, earlier: Column) -> Column:
    """Age in 30-day months."""
    return F.datediff(later, earlier) / 30


def cyclic(c: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a cyclical value, shifted by 1e-6."""
    angle = 2 * F.pi() * (c + 1e-6) / period
    return F.sin(angle), F.cos(angle)


def age_days(at: Column, first: Column) -> Column:
    """Whole elapsed days since first seen, never below zero."""
    gap = F.floor((micros(at) - micros(first)) / (DAY * 1000000))
    return F.greatest(gap, F.lit(0))


def days_before_end(at: Column, end: Column) -> Column:
    """1 on the last day, growing backwards; whole elapsed days."""
    return F.floor((micros(end) - micros(at)) / (DAY * 1000000)) + 1


def is_weekend(c: Column) -> Column:
    return (F.weekday(c) >= 5).cast("int")


def season(c: Column) -> Column:
    return F.floor((F.month(c) - 1) / 3).cast("int")


def stay(checkin: Column, checkout: Column) -> Column:
    return F.datediff(checkout, checkin)


def year_week(c: Column) -> Column:
    """Calendar year paired with the ISO week, as the profile reports it."""
    return F.concat_ws("-", F.year(c), F.lpad(F.weekofyear(c).cast("string"), 2, "0"))


def year_month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def late_decline(c: Column, days: list[int], noon: int = 720) -> Column:
    """Minutes past noon on the given closing days, else 0."""
    minute = minute_of_day(c)
    hit = F.dayofmonth(c).isin(days) & (minute > noon)
    return F.when(hit, minute - noon).otherwise(0)
