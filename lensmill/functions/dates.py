"""Date functions over epoch milliseconds and timestamps, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the days, Sunday first, and the labels of the two latest days; fixed values.
WEEKDAYS = ("星期日", "星期一", "星期二", "星期三", "星期四", "星期五", "星期六")
TODAY, YESTERDAY = "今天", "昨天"


def instant(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def local(ts: Column, tz: str) -> Column:
    """Wall-clock time in a zone; the session's zone is UTC."""
    return F.from_utc_timestamp(ts, tz)


def utc_year(ms: Column) -> Column:
    return F.year(instant(ms))


def month0(ts: Column) -> Column:
    """Month from 0 to 11."""
    return F.month(ts) - 1


def day_label(day: Column, today: Column) -> Column:
    """Label of a date: today, yesterday, or month and day with the weekday's name."""
    ago = F.datediff(today, day)
    name = F.element_at(F.array(*[F.lit(w) for w in WEEKDAYS]), F.dayofweek(day))
    return F.when(ago == 0, TODAY).when(ago == 1, YESTERDAY).otherwise(F.concat(F.month(day).cast("string"), F.lit("月"), F.dayofmonth(day).cast("string"), F.lit("日 "), name))


def is_weekend(ts: Column) -> Column:
    return F.dayofweek(ts).isin(1, 7)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def whole_hours(start: Column, end: Column) -> Column:
    """Hours between, cut towards zero."""
    return F.floor((micros(end) - micros(start)) / 3_600_000_000)


def whole_days(start: Column, end: Column) -> Column:
    return F.floor((micros(end) - micros(start)) / 86_400_000_000)


def day_bounds_ms(start: Column, end: Column, tz: str) -> tuple[Column, Column]:
    """First and last millisecond of a range of dates in a zone, both included."""
    low = F.unix_millis(F.to_utc_timestamp(start.cast("timestamp"), tz))
    high = F.unix_millis(F.to_utc_timestamp(F.date_add(end, 1).cast("timestamp"), tz)) - 1
    return low, high


def exif_instant(text: Column, tz: str = "UTC") -> Column:
    """``yyyy:MM:dd HH:mm:ss`` in a zone as a timestamp; null where it is anything else."""
    shaped = F.regexp_extract(text, r"^\s*(\d{4}):(\d{2}):(\d{2}) (\d{2}:\d{2}:\d{2})\s*$", 0)
    iso = F.regexp_replace(F.trim(F.nullif(shaped, F.lit(""))), r"^(\d{4}):(\d{2}):(\d{2})", "$1-$2-$3")
    return F.to_utc_timestamp(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd HH:mm:ss")), tz)


def captured_at(*candidates: Column, mtime: Column, tz: str = "UTC") -> Column:
    """The first readable EXIF time, else the time of modification."""
    return F.coalesce(*(exif_instant(c, tz) for c in candidates), mtime)
