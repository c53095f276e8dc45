"""Time floors, epochs and local-time text, all on UTC instants."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from drivetrace.config import LOCAL_TZ

SECOND_US = 1_000_000
GRAIN_US = {
    "second": SECOND_US,
    "minute": 60 * SECOND_US,
    "hour": 3_600 * SECOND_US,
    "day": 86_400 * SECOND_US,
}


def grain_us(grain: str | int | float) -> int:
    """Width in microseconds of a named grain or of a number of seconds."""
    return GRAIN_US[grain] if isinstance(grain, str) else int(grain * SECOND_US)


def whole_div(c: Column, by: int) -> Column:
    """Integer quotient rounded down, without going through double."""
    n = F.lit(by).cast("long")
    return F.call_function("div", c - F.pmod(c, n), n)


def micros(ts: str | Column) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def floor_micros(us: Column, width: int) -> Column:
    """Largest multiple of ``width`` not above ``us``, in exact integer arithmetic."""
    return us - F.pmod(us, F.lit(int(width)))


def floor_time(ts: str | Column, grain: str | int | float) -> Column:
    """Floor an instant to a second, minute, … or to n seconds."""
    return F.timestamp_micros(floor_micros(micros(ts), grain_us(grain)))


def plus_seconds(ts: str | Column, seconds: float) -> Column:
    return F.timestamp_micros(micros(ts) + F.lit(int(seconds * SECOND_US)))


def to_local(ts: str | Column, tz: str = LOCAL_TZ) -> Column:
    """Wall-clock time of an instant, without zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.from_utc_timestamp(c.cast("timestamp"), tz).cast("timestamp_ntz")


def from_local(wall: str | Column, tz: str = LOCAL_TZ) -> Column:
    """Instant of a wall-clock time in a zone."""
    c = F.col(wall) if isinstance(wall, str) else wall
    return F.to_utc_timestamp(c.cast("timestamp"), tz)


def local_text(ts: str | Column, tz: str = LOCAL_TZ, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(to_local(ts, tz), pattern)


def local_day_start(ts: str | Column, tz: str = LOCAL_TZ) -> Column:
    return from_local(F.date_trunc("day", to_local(ts, tz)), tz)


def next_local_day(ts: str | Column, tz: str = LOCAL_TZ) -> Column:
    return from_local(F.date_trunc("day", to_local(ts, tz)) + F.expr("INTERVAL 1 DAY"), tz)


def instant(t: datetime) -> Column:
    """An instant as a literal; without zone it is in UTC."""
    aware = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit(round(aware.timestamp() * 1_000_000)))


def within(ts: str | Column, start: datetime | None, end: datetime | None) -> Column:
    """``start <= ts < end``; a bound left out is open."""
    c = F.col(ts) if isinstance(ts, str) else ts
    inside = F.lit(True) if start is None else c >= instant(start)
    return inside if end is None else inside & (c < instant(end))
