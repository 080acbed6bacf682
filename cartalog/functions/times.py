"""Times of day as seconds, days and calendars as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def seconds_of_day(text: Column) -> Column:
    """h:m or h:m:s as seconds; hours beyond 23 are of the next day, as timetables have them; null for what is no time."""
    part = lambda k: F.regexp_extract(text, "^\\s*([0-9]{1,3}):([0-5]?[0-9])(?::([0-5]?[0-9]))?\\s*$", k)
    return part(1).try_cast("int") * 3600 + part(2).try_cast("int") * 60 + F.coalesce(part(3).try_cast("int"), F.lit(0))


def time_text(seconds: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600).cast("int"), F.floor(seconds % 3600 / 60).cast("int"), (seconds % 60).cast("int"))


def add_seconds(seconds: Column, more: Column) -> tuple[Column, Column]:
    """(time of day, days carried)."""
    total = seconds + more
    return F.pmod(total, F.lit(DAY)).cast("int"), F.floor(total / DAY).cast("int")


def parse_moment(text: Column, end_of_day: bool = False) -> Column:
    """YYYYMMDD, at the start or end of the day, or ISO date and time; null for anything else."""
    day = F.try_to_timestamp(F.regexp_extract(text, "^[0-9]{8}$", 0), F.lit("yyyyMMdd"))
    day = day + F.expr("interval 86399 seconds") if end_of_day else day
    return F.coalesce(day, F.try_to_timestamp(F.regexp_extract(text, "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}$", 0), F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def valid_date(year: Column, month: Column, day: Column) -> Column:
    inside = month.between(1, 12) & day.between(1, 31)
    last = F.dayofmonth(F.last_day(F.make_date(year, F.greatest(F.lit(1), F.least(F.lit(12), month)), F.lit(1))))
    return F.coalesce(inside & (day <= last), F.lit(False))


def is_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def weekday(day: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(day)


def plus_seconds(moment: Column, seconds: Column) -> Column:
    return moment + F.make_dt_interval(secs=seconds)
