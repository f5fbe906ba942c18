"""Request parameters: validation, date presets, chart windows."""

from __future__ import annotations

import datetime as dt

from ..functions.pricing import MODES
from ..functions.timefns import valid_zone
from ..operators.events import Query

#: Calendar days that a preset spans, today included.
PRESETS = {"24h": 2, "7d": 7, "30d": 30, "90d": 90}


def valid_ymd(text: str) -> bool:
    try:
        return len(text) == 8 and dt.datetime.strptime(text, "%Y%m%d").strftime("%Y%m%d") == text
    except ValueError:
        return False


def common(mode: str = "auto", tz: str = "UTC", since: str | None = None, until: str | None = None, **axes: list[str]) -> tuple[str, Query]:
    """Checked (mode, query); ValueError says what is wrong."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if not valid_zone(tz):
        raise ValueError(f"unknown time zone {tz!r}")
    for day in (since, until):
        if day is not None and not valid_ymd(day):
            raise ValueError(f"{day!r} is not a calendar date YYYYMMDD")
    if since and until and until < since:
        raise ValueError("until is before since")
    return mode, Query(since=since, until=until, tz=tz, **axes)


def preset(name: str, today: dt.date) -> tuple[str | None, str | None]:
    """since and until, YYYYMMDD; 'all' has no bounds."""
    if name == "all":
        return None, None
    return (today - dt.timedelta(PRESETS[name] - 1)).strftime("%Y%m%d"), today.strftime("%Y%m%d")


def chart_windows(since: dt.date, until: dt.date) -> tuple[tuple[dt.date, dt.date], tuple[dt.date, dt.date]]:
    """The window and the equally long one before it."""
    days = (until - since).days + 1
    return (since, until), (since - dt.timedelta(days), since - dt.timedelta(1))


def source(span: str, line: bool, axes: list[str]) -> str:
    """Which report a chart reads: intraday for short spans and lines, else days, by project or machine if asked."""
    if span in ("1h", "5h", "today", "block") or line:
        return "intraday"
    return "daily-machine" if "machine" in axes else "daily-project" if "project" in axes else "daily-flat"
