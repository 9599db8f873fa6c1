"""Times without zone (DAT01-DAT06). All parsing is by pattern, so no session zone can move a time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, strip, unquote

EVENT = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})\s+([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})(?:\.([0-9]{1,6}))?$"
AMERICAN = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}),\s+([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})(?:\.([0-9]{1,6}))?\s+([AaPp][Mm])$"
GERMAN = r"^([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4}),\s+([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})(?:\.([0-9]{1,6}))?$"


def _made(s: Column, pattern: str, year: int, month: int, day: int, half: bool = False) -> Column:
    part = lambda i: F.regexp_extract(s, pattern, i)
    whole = lambda i: part(i).try_cast("int")
    hour = whole(4)
    if half:
        hour = F.when(hour.between(1, 12), hour % 12 + F.when(F.lower(part(8)) == "pm", 12).otherwise(0))
    seconds = F.concat(part(6), F.lit("."), F.rpad(part(7), 6, "0")).try_cast("decimal(16,6)")
    fits = whole(6) < 60
    return F.when(F.regexp_like(s, F.lit(pattern)) & fits, F.try_make_timestamp_ntz(whole(year), whole(month), whole(day), hour, whole(5), seconds))


def event_time(x: Column | str) -> Column:
    return _made(strip(x), EVENT, 1, 2, 3)


def track_time(x: Column | str) -> Column:
    """Month first with AM or PM, or day first with 24 hours; fraction of a second optional."""
    s = unquote(x)
    return F.coalesce(_made(s, AMERICAN, 3, 1, 2, half=True), _made(s, GERMAN, 3, 2, 1))


def iso_millis(t: Column | str) -> Column:
    s = _c(t).cast("string")  # formatting functions would go through the session's zone
    return F.concat(F.left(s, F.lit(10)), F.lit("T"), F.substring(s, 12, 8), F.lit("."), F.rpad(F.substring(s, 21, 3), 3, "0"))


def shifted(t: Column | str, seconds: Column | float) -> Column:
    """``t`` moved by (fractional) seconds."""
    amount = F.lit(seconds) if isinstance(seconds, (int, float)) else seconds
    return _c(t) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round(amount, 6).cast("decimal(18,6)"))


def micros(t: Column | str) -> Column:
    """Microseconds since 1970, whatever the session zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _c(t))


def clock_minute(x: Column | str) -> Column:
    """Minute of a clock time somewhere in a text."""
    return F.regexp_extract(_c(x), r"([0-9]{1,2}):([0-9]{2}):([0-9]{2})", 2).try_cast("int")


def folder_stamp(t: Column) -> Column:
    return F.date_format(t, "dd_MM_yyyy_HH_mm")
