"""Times: milliseconds since the epoch, UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DAY_MS


def parse_ms(c: Column) -> Column:
    """Milliseconds of an ISO-8601 text; null if it can't be read."""
    return F.unix_millis(F.try_to_timestamp(c))


def ms_of(c: Column) -> Column:
    """Milliseconds of a timestamp with or without zone (session zone: UTC)."""
    return F.unix_millis(c.cast("timestamp"))


def timestamp(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def week_start(ms: Column) -> Column:
    """Sunday 00:00 UTC of the week, also before 1970."""
    return ms - F.pmod(ms + F.lit(4 * DAY_MS), F.lit(7 * DAY_MS))


def month_key(ms: Column) -> Column:
    return F.date_format(timestamp(ms), "yyyy-MM")


def month_label(ms: Column) -> Column:
    return F.upper(F.date_format(timestamp(ms), "MMM"))


def days_since(now: int, ms: Column) -> Column:
    return F.floor((F.lit(now) - ms) / float(DAY_MS)).cast("long")


def relative(now: int, ms: Column) -> Column:
    """'5m ago', '3h ago', '2d ago'; a date beyond three days or in the future; a dash for nothing."""
    age = F.lit(now) - ms
    unit = lambda size, mark, least=0: F.concat(F.greatest(F.floor(age / float(size)), F.lit(least)).cast("string"), F.lit(f"{mark} ago"))
    hour = 3_600_000
    return (
        F.when(ms.isNull() | (ms <= 0), "—").when((age < 0) | (age >= 3 * DAY_MS), F.date_format(timestamp(ms), "yyyy-MM-dd"))
        .when(age < hour, unit(60_000, "m", 1)).when(age < 2 * DAY_MS, unit(hour, "h")).otherwise(unit(DAY_MS, "d"))
    )
