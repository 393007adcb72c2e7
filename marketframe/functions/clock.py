"""Wall-clock predicates on UTC timestamps; daylight saving comes from the zone rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EASTERN = "America/New_York"
CENTRAL = "America/Chicago"
LONDON = "Europe/London"


def wall_clock(ts: Column, zone: str = EASTERN) -> Column:
    """Wall-clock reading of a UTC instant, as a timestamp."""
    return F.from_utc_timestamp(ts, zone)


def wall_time(ts: Column, zone: str = EASTERN) -> Column:
    """Time of day as HH:mm:ss text (sorts like the time itself)."""
    return F.date_format(wall_clock(ts, zone), "HH:mm:ss")


def session_date(ts: Column, zone: str = EASTERN) -> Column:
    return F.to_date(wall_clock(ts, zone))


def in_window(ts: Column, start: str, end: str, zone: str = EASTERN) -> Column:
    """Half-open daily window [start, end); a start after the end wraps midnight."""
    t = wall_time(ts, zone)
    if start <= end:
        return (t >= start) & (t < end)
    return (t >= start) | (t < end)


def is_regular_hours(ts: Column) -> Column:
    return in_window(ts, "09:30:00", "16:00:00")


def local_to_utc(day: Column, time_of_day: Column | str, zone: str = EASTERN) -> Column:
    """UTC instant of a local date plus a HH:mm:ss time."""
    tod = F.lit(time_of_day) if isinstance(time_of_day, str) else time_of_day
    return F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", day.cast("string"), tod)), zone)
