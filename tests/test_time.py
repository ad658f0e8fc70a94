from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.errors import QueryError
from tidemark.functions.time_buckets import bucket_column, local_seconds, shown
from tidemark.plans.time_filter import time_range

#: A Wednesday, four days before the clocks of Berlin go back.
NOW = int(datetime.fromisoformat("2019-10-23T15:47:09+02:00").timestamp())


@pytest.mark.parametrize(
    "text,lo,hi",
    [
        ("now", "2019-10-23T15:47:09+02:00", "2019-10-23T15:47:09+02:00"),
        ("this month", "2019-10-01T00:00:00+02:00", "2019-11-01T00:00:00+01:00"),
        ("last year", "2018-01-01T00:00:00+01:00", "2019-01-01T00:00:00+01:00"),
        ("2 weeks ago", "2019-10-07T00:00:00+02:00", "2019-10-14T00:00:00+02:00"),
        ("-3d", "2019-10-20T00:00:00+02:00", "2019-10-21T00:00:00+02:00"),
        ("-2q", "2019-04-01T00:00:00+02:00", "2019-07-01T00:00:00+02:00"),
        ("7 months ago", "2019-03-01T00:00:00+01:00", "2019-04-01T00:00:00+02:00"),
        ("this quarter-hour", "2019-10-23T15:45:00+02:00", "2019-10-23T16:00:00+02:00"),
        ("25 minutes ago", "2019-10-23T15:22:00+02:00", "2019-10-23T15:23:00+02:00"),
        ("2017-Q4", "2017-10-01T00:00:00+02:00", "2018-01-01T00:00:00+01:00"),
        ("2019-10-27", "2019-10-27T00:00:00+02:00", "2019-10-28T00:00:00+01:00"),
        ("2019-03-31 02", "2019-03-31T01:00:00+01:00", "2019-03-31T03:00:00+02:00"),  # an hour that the clock skips
        ("2019-10-27 02", "2019-10-27T02:00:00+02:00", "2019-10-27T02:00:00+01:00"),  # an hour that comes twice
        ("2019-10-27 03:20", "2019-10-27T03:20:00+01:00", "2019-10-27T03:21:00+01:00"),
        ("1571000000", "2019-10-13T20:53:20+00:00", "2019-10-13T20:53:20+00:00"),
    ],
)
def test_ranges(text, lo, hi):
    seconds = lambda t: int(datetime.fromisoformat(t).timestamp())
    assert time_range(text, text, "Europe/Berlin", NOW) == (seconds(lo), seconds(hi))


@pytest.mark.parametrize("text", ["soon", "3 seconds ago", "2016-13", "2016-02-30", "1x", "last", "last moon"])
def test_refused_times(text):
    with pytest.raises(QueryError):
        time_range(text, None, None, NOW)


def test_zones():
    assert time_range("2018-05-01", "2018-05-01", "+5:30", NOW)[0] == int(datetime.fromisoformat("2018-05-01T00:00:00+05:30").timestamp())
    with pytest.raises(QueryError):
        time_range("today", None, "Nowhere/Town", NOW)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("day,monday", [("1970-01-02", "1970-01-01"), ("1970-01-05", "1970-01-05"), ("1970-01-11", "1970-01-05"), ("2000-03-01", "2000-02-28"), ("2019-10-23", "2019-10-21")])
def test_weeks(spark, day, monday):
    """Weeks begin on Mondays; the days before the first one count as one week that begins at 0."""
    at = lambda t: int(datetime.fromisoformat(t).replace(tzinfo=timezone.utc).timestamp())
    assert one(spark, bucket_column(F.lit(at(day) + 4321), "week")) == at(monday)


@pytest.mark.parametrize("day,parts", [("1970-01-01", (0, 0, 0, 0)), ("2000-02-29", (59, 28, 1, 0)), ("2001-03-01", (59, 0, 2, 0)), ("2019-12-31", (364, 30, 11, 3))])
def test_parts_count_from_zero(spark, day, parts):
    at = int(datetime.fromisoformat(day).replace(tzinfo=timezone.utc).timestamp())
    names = ("day of year", "day of month", "month of year", "quarter of year")
    assert tuple(one(spark, bucket_column(F.lit(at), n)) for n in names) == parts


@pytest.mark.parametrize("bucket,text", [("hour", "1970-01-02 02:00"), ("minute", "1970-01-02 02:03"), ("time of day", "02:03"), ("hour of day", "02:00"), ("hour of week", "Tuesday 02:03"), ("month of year", "93784"), ("day", "1970-01-02")])
def test_shown(spark, bucket, text):
    assert one(spark, shown(F.lit(93784), bucket)) == text


@pytest.mark.parametrize("bucket", ["7 minutes", "5 hours", "2 days", "4 minutes of day", "fortnight", "0 minutes"])
def test_refused_buckets(spark, bucket):
    with pytest.raises(QueryError):
        one(spark, bucket_column(F.lit(1), bucket))


def test_clock_changes(spark):
    at = lambda t: int(datetime.fromisoformat(t).timestamp())
    for t, offset in (("2019-10-27T00:59:59+00:00", 7200), ("2019-10-27T01:00:00+00:00", 3600)):
        assert one(spark, local_seconds(F.lit(at(t)), "Europe/Berlin")) == at(t) + offset
