"""Calendar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def add_months_overflow(ts: Column, months: Column) -> Column:
    """``months`` later, where days that the month lacks run over into the next one."""
    start = F.date_trunc("month", ts)
    return F.timestamp_add("MONTH", months, start) + (ts - start)


def months_between_days(base: Column, now: Column) -> Column:
    """Whole months since ``base``: one less before its day of the month; not below 0."""
    m = (F.year(now) - F.year(base)) * 12 + F.month(now) - F.month(base)
    return F.greatest(m - F.when(F.dayofmonth(now) < F.dayofmonth(base), 1).otherwise(0), F.lit(0))


def billing_window(base: Column, now: Column) -> tuple[Column, Column]:
    """Start and end of the billing month that holds ``now``."""
    start = add_months_overflow(base, months_between_days(base, now))
    return start, add_months_overflow(start, F.lit(1))


def week_start(ts: Column) -> Column:
    """Midnight of the Sunday on or before."""
    day = F.date_trunc("day", ts)
    return day - F.make_dt_interval(F.dayofweek(ts) - 1)


def hms(seconds: Column) -> Column:
    """HH:MM:SS; hours have no bound."""
    s = F.greatest(seconds, F.lit(0))
    hours = F.floor(s / 3600).cast("string")
    return F.concat_ws(":", F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), F.lpad(F.floor(s % 3600 / 60).cast("string"), 2, "0"), F.lpad((s % 60).cast("string"), 2, "0"))


def spoken(seconds: Column) -> Column:
    """``1h 2m 3s``; a dash if it is missing."""
    s = F.greatest(seconds, F.lit(0))
    text = F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), F.floor(s % 3600 / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))
    return F.when(seconds.isNull(), "-").otherwise(text)


def within_hours(ts: Column, hours: dict[str, tuple[bool, str, str]], enabled: bool = True) -> Column:
    """Whether a time lies in its weekday's hours, given as open, from and to (HH:MM); always if they are not in use."""
    if not enabled:
        return F.lit(True)
    day, time = F.date_format(ts, "EEEE"), F.date_format(ts, "HH:mm")
    found = F.lit(False)
    for name, (on, start, end) in hours.items():
        found = F.when(day == name, F.lit(on) & (time >= start) & (time <= end)).otherwise(found)
    return found
