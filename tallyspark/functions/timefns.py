"""Instants, local dates and zoned times as Columns. Timestamps come as ISO-8601 text with an offset or 'Z'."""

from __future__ import annotations

from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS


def valid_zone(tz: str) -> bool:
    """Whether tz names an IANA time zone."""
    try:
        ZoneInfo(tz)
    except Exception:
        return False
    return True


def instant(text: Column) -> Column:
    """A timestamp, null where the text is none."""
    return F.try_to_timestamp(text)


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def from_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def iso(ms: Column) -> Column:
    """Epoch milliseconds as UTC text, YYYY-MM-DDTHH:MM:SS.mmmZ, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(from_ms(ms), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def local_date(ts: Column, tz: str) -> Column:
    """YYYY-MM-DD in a zone. The session's zone must be UTC, as everywhere in this library."""
    return F.date_format(F.from_utc_timestamp(ts, tz), "yyyy-MM-dd")


def local_ymd(ts: Column, tz: str) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, tz), "yyyyMMdd")


def ms_since_midnight(ts: Column, tz: str) -> Column:
    """Whole seconds of the local clock, in milliseconds."""
    at = F.from_utc_timestamp(ts, tz)
    return ((F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)) * 1000).cast("long")


def offset_ms(ms: Column, tz: str) -> Column:
    """The zone's offset from UTC at an instant."""
    whole = F.floor(ms / 1000) * 1000
    return epoch_ms(F.from_utc_timestamp(from_ms(whole.cast("long")), tz)) - whole


def zoned_instant(day: Column, ms: Column, tz: str) -> Column:
    """The instant of a wall-clock time: guess it as UTC, correct by the offset there, then once by the offset found.
    Unlike to_utc_timestamp this maps a skipped time forward by the offset before the change."""
    wall = epoch_ms(day.cast("timestamp")) + ms
    first = offset_ms(wall, tz)
    guess = wall - first
    second = offset_ms(guess, tz)
    return F.when(second != first, wall - second).otherwise(guess).cast("long")


#: Days without activity after which a project is stale.
STALE_DAYS = 90


def days_since(day: Column, today: str) -> Column:
    """Whole days from a date to today, 0 at least."""
    return F.greatest(F.lit(0), F.datediff(F.to_date(F.lit(today)), F.to_date(day)))


def floor_hour(ms: Column) -> Column:
    return ms - F.pmod(ms, F.lit(HOUR_MS))


def round_minute(ms: Column) -> Column:
    return (F.floor(ms / 60_000 + 0.5) * 60_000).cast("long")


def half_up(x: Column) -> Column:
    """Rounds .5 up, also below zero."""
    return F.floor(x + 0.5)
