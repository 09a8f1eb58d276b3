"""Cue times: whole milliseconds, and their subtitle form HH:MM:SS,mmm."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIME = r"^\d{2}:\d{2}:\d{2}[,.]\d{3}"


def parse_time(text: Column) -> Column:
    """Milliseconds; null if the text doesn't begin with a time."""
    part = lambda at, n: F.substring(text, at, n).cast("long")  # noqa: E731 - the pattern's parts have fixed places
    return F.when(text.rlike(TIME), ((part(1, 2) * 60 + part(4, 2)) * 60 + part(7, 2)) * 1000 + part(10, 3))


def _whole(ms: Column, unit: int) -> Column:
    return F.floor(ms / F.lit(unit)).cast("long")


def format_time(ms: Column) -> Column:
    return F.format_string("%02d:%02d:%02d,%03d", hours(ms), minutes(ms), seconds(ms), milliseconds(ms))


def hours(ms: Column) -> Column:
    return _whole(ms, 3_600_000)


def minutes(ms: Column) -> Column:
    return F.pmod(_whole(ms, 60_000), F.lit(60))


def seconds(ms: Column) -> Column:
    return F.pmod(_whole(ms, 1000), F.lit(60))


def milliseconds(ms: Column) -> Column:
    return F.pmod(ms, F.lit(1000)).cast("long")


def with_parts(ms: Column, h=None, m=None, s=None, ms_part=None) -> Column:
    """The time with some of its parts set anew; None leaves a part as it is."""
    for part, value, unit in ((hours, h, 3_600_000), (minutes, m, 60_000), (seconds, s, 1000), (milliseconds, ms_part, 1)):
        if value is not None:
            ms = ms + (F.lit(value) - part(ms)) * unit
    return ms.cast("long")


def parts(ms: Column) -> Column:
    """Hours, minutes, seconds and milliseconds in order, as an array."""
    return F.array(hours(ms), minutes(ms), seconds(ms), milliseconds(ms))


def of_time(at: Column) -> Column:
    """The milliseconds since midnight of a timestamp's time of day."""
    whole = (F.hour(at) * 60 + F.minute(at)) * 60 + F.second(at)
    return (whole.cast("long") * 1000 + F.pmod(F.floor(F.extract(F.lit("SECOND"), at) * 1000).cast("long"), F.lit(1000))).cast("long")


def to_time(ms: Column, day: Column | None = None) -> Column:
    """The time of day on a day (the epoch's first without one); null where a day has no such time."""
    day = F.lit("1970-01-01").cast("date") if day is None else day
    inside = (ms >= 0) & (ms < 86_400_000)
    zero = F.lit(0)
    return F.when(inside, day.cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, (ms / 1000).cast("decimal(18,6)")))


def of_parts(h: int = 0, m: int = 0, s: int = 0, ms: int = 0) -> int:
    return ((h * 60 + m) * 60 + s) * 1000 + ms


def shifted(ms: Column, ratio: float = 1.0, by: int = 0) -> Column:
    """Scaled first (halves round away from zero), then moved."""
    return ((F.round(ms * F.lit(ratio)).cast("long") if ratio != 1.0 else ms) + F.lit(by)).cast("long")
