"""Time buckets: when a moment's period begins, or where it lies in a recurring one. All in epoch seconds."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import QueryError

MINUTE, HOUR, DAY, WEEK = 60, 3600, 86400, 604800
#: 1970-01-01 was a Thursday; weeks begin on Mondays.
MONDAY = 4 * DAY
OF_DAY = (2, 3, 5, 6, 10, 15, 30)


def local_seconds(seconds: Column, zone: str | Column | None) -> Column:
    """Seconds whose UTC calendar is the given zone's. Fixed offsets are added; zone rules are applied row by row."""
    if zone is None:
        return seconds
    if isinstance(zone, str):
        if m := re.fullmatch(r"([+-])(\d{1,2})(?::?(\d{2}))?", zone.strip()):
            shift = (int(m[2]) * HOUR + int(m[3] or 0) * MINUTE) * (-1 if m[1] == "-" else 1)
            return seconds + F.lit(shift)
        if zone.upper() in ("UTC", "GMT", ""):
            return seconds
        zone = F.lit(zone)
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(seconds), zone))


def utc_seconds(local: Column, zone: str | Column | None) -> Column:
    """The moment at which a zone's clock shows the local seconds."""
    if isinstance(zone, Column):
        return F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local), zone))
    if zone is None or zone.upper() in ("UTC", "GMT", ""):
        return local
    if m := re.fullmatch(r"([+-])(\d{1,2})(?::?(\d{2}))?", zone.strip()):
        return local - F.lit((int(m[2]) * HOUR + int(m[3] or 0) * MINUTE) * (-1 if m[1] == "-" else 1))
    return F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local), F.lit(zone)))


def size_of(bucket: str) -> int | None:
    """Seconds of a regular bucket: N minutes that divide an hour, N hours that divide a day, or a day."""
    text = bucket.strip()
    named = {"minute": MINUTE, "minutes": MINUTE, "m": MINUTE, "hour": HOUR, "hours": HOUR, "h": HOUR, "day": DAY, "d": DAY, "quarter-hour": 900}
    if text in named:
        return named[text]
    if m := re.fullmatch(r"(\d+)\s*(m|minutes?|h|hours?)", text):
        n, unit = int(m[1]), MINUTE if m[2][0] == "m" else HOUR
        whole = 60 if unit == MINUTE else 24
        if n == 0 or whole % n:
            raise QueryError(f"{n} doesn't divide {whole}: {bucket!r}")
        return n * unit
    return None


def bucket_column(seconds: Column, bucket: str) -> Column:
    """The bucket of local seconds: a long."""
    name = bucket.strip().lower()
    if (n := size_of(name)) is not None:
        return seconds - F.pmod(seconds, F.lit(n))
    if name in ("week", "w"):
        start = seconds - F.pmod(seconds - MONDAY, F.lit(WEEK))
        return F.when(seconds < MONDAY, F.lit(0)).otherwise(start)
    if name in ("month", "quarter", "year"):
        # a date holds no zone, so the session's can't shift it
        day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / DAY).cast("int"))
        return F.unix_date(F.trunc(day, name)).cast("long") * DAY
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / DAY).cast("int"))
    parts = {"day of month": F.dayofmonth, "day of year": F.dayofyear, "month of year": F.month, "quarter of year": F.quarter}
    if name in parts:
        return (parts[name](day) - 1).cast("long")
    if name == "time of day":
        # by whole minutes, as it is shown
        return F.pmod(seconds, F.lit(DAY))
    if name == "hour of day":
        within = F.pmod(seconds, F.lit(DAY))
        return within - F.pmod(within, F.lit(HOUR))
    if name in ("hour of week", "day of week"):
        within = F.pmod(seconds - MONDAY, F.lit(WEEK))
        return within - F.pmod(within, F.lit(HOUR)) if name == "hour of week" else F.floor(within / DAY)
    if m := re.fullmatch(r"(\d+) minutes? of day", name):
        if int(m[1]) not in OF_DAY:
            raise QueryError(f"minutes of day must be one of {OF_DAY}: {bucket!r}")
        within = F.pmod(seconds, F.lit(DAY))
        return within - F.pmod(within, F.lit(int(m[1]) * MINUTE))
    raise QueryError(f"unknown time bucket {bucket!r}")


def in_unit(local: Column, unit: str, zone: str | Column | None) -> Column:
    """A bucket's start as a number of units since the epoch, in UTC, whether the zone is one for all rows or each row's."""
    sizes = {"day": DAY, "hour": HOUR, "minute": MINUTE, "second": 1}
    at = utc_seconds(local, zone)
    if unit == "millisecond":
        return at * 1000
    if unit not in sizes:
        raise QueryError(f"unknown time unit {unit!r}")
    return F.floor(at / sizes[unit]).cast("long")


def shown(bucket_value: Column, bucket: str) -> Column:
    """A bucket as text, by its kind; kinds without a form of their own show the number."""
    name = bucket.strip().lower()
    clock = lambda s: F.concat(F.lpad(F.floor(F.pmod(s, F.lit(DAY)) / HOUR).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(F.pmod(s, F.lit(HOUR)) / MINUTE).cast("string"), 2, "0"))
    date = lambda s: F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(s / DAY).cast("int")), "yyyy-MM-dd")
    days = F.array(*map(F.lit, ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")))
    if name == "time of day":
        return clock(bucket_value)
    if name == "hour of day":
        return clock(bucket_value - F.pmod(bucket_value, F.lit(HOUR)))
    if name == "hour of week":
        return F.concat(F.get(days, F.floor(F.pmod(bucket_value, F.lit(WEEK)) / DAY).cast("int")), F.lit(" "), clock(bucket_value))
    if name == "day of week":
        return F.get(days, F.pmod(bucket_value, F.lit(7)).cast("int"))
    try:
        n = size_of(name)
    except QueryError:
        n = None
    if n is None:
        return bucket_value.cast("string")
    if n >= DAY:
        return date(bucket_value)
    at = bucket_value - F.pmod(bucket_value, F.lit(HOUR)) if n >= HOUR else bucket_value
    return F.concat(date(at), F.lit(" "), clock(at))
