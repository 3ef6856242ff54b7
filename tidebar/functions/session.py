"""Exchange-session time: 09:30-11:30 and 13:00-15:00, 240 minutes a day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Minutes of a bar by frequency; a daily bar spans the day.
MINUTES = {"1m": 1, "5m": 5, "30m": 30, "60m": 60, "1d": 240}
SLOTS = {f: 240 // m for f, m in MINUTES.items()}
ORDER = {"5m": 1, "30m": 2, "60m": 4, "1d": 8}


def session_minute(time: Column) -> Column:
    """0 to 239; a tick at 11:30 or 15:00 sharp belongs to the last minute, one outside the session to none."""
    second = F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)
    whole = lambda start: F.least(F.floor((second - start) / 60), F.lit(119)).cast("int")
    return F.when(second.between(34200, 41400), whole(34200)).when(second.between(46800, 54000), whole(46800) + 120)


def clock(date: Column, minute: Column, end: bool = False) -> Column:
    """Wall-clock time of a session minute; with end, the moment a bar that closes there ends (11:30 rather than 13:00)."""
    morning = minute <= 120 if end else minute < 120
    return F.timestamp_add("MINUTE", F.when(morning, minute + 570).otherwise(minute + 660), date.cast("timestamp_ntz"))


def slot_of(minute: Column, frequency: str) -> Column:
    return F.floor(minute / MINUTES[frequency]).cast("int")


def slot_begin(date: Column, slot: Column, frequency: str) -> Column:
    return clock(date, slot * MINUTES[frequency])


def slot_end(date: Column, slot: Column, frequency: str) -> Column:
    return clock(date, (slot + 1) * MINUTES[frequency], end=True)


def normal_frequency(name: Column) -> Column:
    """Canonical frequency of the aliases in use."""
    low = F.lower(F.trim(name))
    return F.when(low == "300s", "5m").when(low == "1800s", "30m").when(low == "3600s", "60m").when(low.isin("day", "d"), "1d").otherwise(low)


def status(time: Column, trading_day: Column) -> Column:
    """PRE_OPEN, MORNING, LUNCH, AFTERNOON or CLOSED."""
    second = F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)
    return (
        F.when(~trading_day, "CLOSED").when(second < 34200, "PRE_OPEN").when(second < 41400, "MORNING")
        .when(second < 46800, "LUNCH").when(second < 54000, "AFTERNOON").otherwise("CLOSED")
    )
