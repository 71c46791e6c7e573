"""Timestamp parsing. A log time is kept twice: as the wall clock that was logged
(TIMESTAMP_NTZ) and as an instant (TIMESTAMP, naive times counting as UTC)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlog.functions.text import capture, case, strip

MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
# an offset only counts behind a time of day, so the day of 2026-03-11 is not one
ZONED = (
    r"(?d)^(.*(?::\d{2}(?:[.,]\d{1,9})?|T\d{4}(?:\d{2})?))\s*"
    r"(Z|z|UTC|GMT|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)$"
)
OFFSET = r"^([+-])(\d{2})(?::?([0-5]\d)(?::?([0-5]\d))?)?$"
ZERO_OFFSETS = ["+0000", "+00:00", "-0000", "Z", "z", "UTC", "GMT"]
ACCESS_STAMP = r"(?dU)^(\d{1,2})/(\w{3})/(\d{4}):(\d{1,2}):(\d{1,2}):(\d{1,2})(?:\s+(.*))?$"
WEEKDAY = r"^(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+"


def month_number(name):
    """1..12 for a three-letter English month name in any case, else null."""
    at = F.position(F.lower(name), F.lit(MONTHS))
    return F.when((F.length(name) == 3) & (at % 3 == 1), (at + 2) / 3).cast("int")


def clock(year, month, day, hour, minute, second):
    """TIMESTAMP_NTZ from text parts; null when they name no real time."""
    sec = second.try_cast("int")
    made = F.try_make_timestamp_ntz(
        year.try_cast("int"), month.try_cast("int"), day.try_cast("int"),
        hour.try_cast("int"), minute.try_cast("int"), sec,
    )
    return F.when(sec < 60, made)


def syslog_clock(parts, assume_year, first=0):
    """Wall clock from captured month, day, hour, minute, second; the year is a number or a column."""
    at = [F.get(parts, F.lit(first + i)) for i in range(5)]
    year = assume_year if isinstance(assume_year, Column) else F.lit(assume_year)
    return clock(year.cast("string"), month_number(at[0]), *at[1:])


def as_instant(wall, offset_seconds=None):
    """The instant of a wall clock time, less its offset from UTC; the session's zone plays no part."""
    instant = F.concat(wall.cast("string"), F.lit("Z")).cast("timestamp")
    if offset_seconds is None:
        return instant
    shifted = F.timestamp_micros(F.unix_micros(instant) - offset_seconds.cast("bigint") * 1000000)
    return F.when(offset_seconds.isNull(), instant).otherwise(shifted)


def offset_seconds(zone):
    """Seconds east of UTC for Z, UTC, GMT, +hh, +hhmm, +hh:mm; null for anything else."""
    part = F.split(F.regexp_replace(zone, OFFSET, "$1\n$2\n$3\n$4"), "\n", -1)
    value = lambda i: F.coalesce(F.get(part, F.lit(i)).try_cast("int"), F.lit(0))
    size = value(1) * 3600 + value(2) * 60 + value(3)
    return case(
        [
            (zone.isin(ZERO_OFFSETS), F.lit(0)),
            (zone.rlike(OFFSET), F.when(F.startswith(zone, F.lit("-")), -size).otherwise(size)),
        ]
    )


def access_stamp(stamp):
    """Parts of ``dd/Mon/yyyy:HH:mm:ss`` and what follows it, or null."""
    return capture(stamp, ACCESS_STAMP, 7)


def access_clock(part):
    """Wall clock from the parts of an access-log time."""
    day, month, year, *clock_parts = [F.get(part, F.lit(i)) for i in range(6)]
    return clock(year, month_number(month), day, *clock_parts)


def zone_parts(text):
    """Free-form time cut into (time, offset); empty when it ends in no offset."""
    return capture(text, ZONED, 2)


def without_zone(text):
    return strip(F.coalesce(F.get(zone_parts(text), F.lit(0)), text))


def without_weekday(text):
    return F.regexp_replace(text, WEEKDAY, "")


def iso_clock(text):
    """Wall clock of ISO 8601 text without offset."""
    return F.when(text.rlike(r"^\d{4}-\d{1,2}"), F.replace(text, F.lit(","), F.lit(".")).try_cast("timestamp_ntz"))


def micros(col):
    """Microseconds since the epoch of a TIMESTAMP column."""
    return F.unix_micros(col)


def plain_text(wall):
    """``yyyy-MM-dd HH:mm:ss[.ffffff]`` of a wall clock time."""
    fraction = F.date_format(wall, ".SSSSSS")
    return F.concat(
        F.date_format(wall, "yyyy-MM-dd HH:mm:ss"),
        F.when(fraction == ".000000", "").otherwise(fraction),
    )


def logged_text(wall, us):
    """The wall clock as logged, with its offset where that is not zero: ``2026-02-09 02:14:01+02:00``.

    ``us`` is the instant in microseconds; without a wall clock it is printed in UTC.
    """
    minutes = ((F.unix_micros(as_instant(wall)) - us) / 60_000_000).cast("int")
    size = F.abs(minutes)
    offset = F.format_string(
        "%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(size / 60).cast("int"), size % 60
    )
    return F.coalesce(
        F.concat(plain_text(wall), F.when(minutes != 0, offset).otherwise("")),
        plain_text(F.timestamp_micros(us)),
    )
