"""Calendar time ranges written in words: each bound names a unit of the calendar, and both are inclusive."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone, tzinfo
from zoneinfo import ZoneInfo

from tidemark.errors import QueryError

#: The units and their short letters.
UNITS = {"year": "y", "quarter": "q", "month": "M", "week": "w", "day": "d", "hour": "h", "quarter-hour": "15m", "minute": "m"}
LETTERS = set("yqMwdhm")
SECONDS = {"h": 3600, "15m": 900, "m": 60}


def zone(name: str | None) -> tzinfo:
    """UTC, a fixed offset such as -8:00, or a named zone."""
    if not name:
        return timezone.utc
    if m := re.fullmatch(r"([+-])(\d{1,2})(?::?(\d{2}))?", name.strip()):
        shift = timedelta(hours=int(m[2]), minutes=int(m[3] or 0))
        return timezone(-shift if m[1] == "-" else shift)
    try:
        return ZoneInfo(name.strip())
    except (KeyError, ValueError, OSError) as e:
        raise QueryError(f"unknown time zone {name!r}") from e


def _midnight(year: int, month: int, day: int, tz: tzinfo) -> datetime:
    """The first moment of a day; in zones that skip midnight that is later than 0:00."""
    naive = datetime(year, month, day)
    at = naive.replace(tzinfo=tz)
    back = at.astimezone(timezone.utc).astimezone(tz)
    return at if back.replace(tzinfo=None) == naive else back


def _floor(t: datetime, unit: str) -> datetime:
    if unit in SECONDS:
        # by the clock of the zone: offsets of whole quarter hours leave the minutes alone
        local = t.astimezone(timezone.utc) + t.utcoffset()
        behind = (local.minute * 60 + local.second) % SECONDS[unit] if unit != "h" else local.minute * 60 + local.second
        return (t.astimezone(timezone.utc) - timedelta(seconds=behind, microseconds=local.microsecond)).astimezone(t.tzinfo)
    year, month, day = t.year, t.month, t.day
    if unit == "w":
        monday = datetime(year, month, day) - timedelta(days=t.weekday())
        return _midnight(monday.year, monday.month, monday.day, t.tzinfo)
    month = {"y": 1, "q": (month - 1) // 3 * 3 + 1}.get(unit, month)
    return _midnight(year, month, day if unit == "d" else 1, t.tzinfo)


def _shift(t: datetime, n: int, unit: str) -> datetime:
    """``n`` units on from the start of a unit."""
    if unit in SECONDS:
        return (t.astimezone(timezone.utc) + timedelta(seconds=n * SECONDS[unit])).astimezone(t.tzinfo)
    if unit in ("d", "w"):
        day = datetime(t.year, t.month, t.day) + timedelta(days=n * (7 if unit == "w" else 1))
        return _midnight(day.year, day.month, day.day, t.tzinfo)
    months = t.year * 12 + t.month - 1 + n * {"y": 12, "q": 3, "M": 1}[unit]
    return _midnight(months // 12, months % 12 + 1, 1, t.tzinfo)


def moment(text: str, now: datetime) -> tuple[datetime, str]:
    """Start and unit of what an expression names, in the zone of ``now``."""
    tz, said = now.tzinfo, text.strip()
    words = said.lower()
    if words == "now":
        return now.replace(microsecond=0), "s"
    if words in ("today", "yesterday"):
        return _shift(_floor(now, "d"), -(words == "yesterday"), "d"), "d"
    if m := re.fullmatch(r"(this|last) ([a-z-]+)", words):
        if m[2] in UNITS:
            unit = UNITS[m[2]]
            return _shift(_floor(now, unit), -(m[1] == "last"), unit), unit
    if m := re.fullmatch(r"(\d+) ([a-z-]+?)s? ago", words):
        if m[2] in UNITS:
            unit = UNITS[m[2]]
            return _shift(_floor(now, unit), -int(m[1]), unit), unit
    if (m := re.fullmatch(r"([+-]?\d+)([A-Za-z])", said)) and m[2] in LETTERS:
        return _shift(_floor(now, m[2]), int(m[1]), m[2]), m[2]
    if re.fullmatch(r"\d{8,}", said):
        seconds = int(said) / (1000 if int(said) > 99_999_999_999 else 1)
        return datetime.fromtimestamp(int(seconds), tz), "s"
    if m := re.fullmatch(r"(\d{4})(?:-[qQ]([1-4])|-(\d{1,2})(?:-(\d{1,2})(?: (\d{1,2})(?::(\d{2}))?)?)?)?", said):
        year, quarter, month, day, hour, minute = (int(x) if x else None for x in m.groups())
        try:
            if quarter:
                return _midnight(year, quarter * 3 - 2, 1, tz), "q"
            if hour is None:
                return _midnight(year, month or 1, day or 1, tz), "d" if day else "M" if month else "y"
            at = datetime(year, month, day, hour, minute or 0, tzinfo=tz)
            if at.astimezone(timezone.utc).astimezone(tz).replace(tzinfo=None) != at.replace(tzinfo=None):
                at = at.replace(fold=1)  # the clock skips it: read with the offset that follows
        except ValueError as e:
            raise QueryError(f"no such time: {text!r}") from e
        at = at.astimezone(timezone.utc).astimezone(tz)
        return at, "h" if minute is None else "15m" if minute % 15 == 0 else "m"
    raise QueryError(f"can't read the time {text!r}")


def time_range(start: str | None, end: str | None, tz: str | None = None, now: int | None = None) -> tuple[int | None, int]:
    """Epoch seconds [lo, hi) from the start of the first unit to the end of the last; no end is now."""
    at = datetime.now(zone(tz)) if now is None else datetime.fromtimestamp(now, zone(tz))
    lo = int(moment(start, at)[0].timestamp()) if start else None
    until, unit = moment(end, at) if end else (at, "s")
    return lo, int((_shift(until, 1, unit) if unit != "s" else until).timestamp())
