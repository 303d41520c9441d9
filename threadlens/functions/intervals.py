"""Lengths of time, and points in time given as arguments."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

_UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "sec": 1_000_000, "second": 1_000_000, "min": 60_000_000, "t": 60_000_000, "minute": 60_000_000, "h": 3_600_000_000, "hour": 3_600_000_000, "d": 86_400_000_000, "day": 86_400_000_000, "w": 604_800_000_000, "week": 604_800_000_000}
_PART = re.compile(r"\s*(\d+(?:\.\d+)?)?\s*([a-zA-Z]+)\s*")


def micros(length: str | int | timedelta) -> int:
    """Microseconds of ``10min``, ``2H``, ``1D``, ``1h30min``, ``90 seconds``, a timedelta, or a number of minutes; above zero."""
    if isinstance(length, timedelta):
        total = length // timedelta(microseconds=1)
    elif isinstance(length, (int, float)):
        total = round(length * 60_000_000)
    else:
        total, at = 0, 0
        while at < len(length):
            found = _PART.match(length, at)
            unit = found[2].lower() if found else ""
            scale = _UNITS.get(unit) or _UNITS.get(unit.removesuffix("s"))
            if not found or not scale:
                raise ValueError(f"not a length of time: {length!r}")
            total += round(float(found[1] or 1) * scale)
            at = found.end()
    if total <= 0:
        raise ValueError(f"a length of time must be above zero: {length!r}")
    return total


def local(moment: str | datetime, zone: str) -> datetime:
    """A moment in a zone's local time: one that names a zone is converted, one that does not is taken as local."""
    try:
        found = moment if isinstance(moment, datetime) else datetime.fromisoformat(str(moment).strip())
    except ValueError as error:
        raise ValueError(f"not a point in time: {moment!r}") from error
    return found if found.tzinfo is None else found.astimezone(ZoneInfo(zone)).replace(tzinfo=None)


def span(start: str | datetime, end: str | datetime, zone: str) -> tuple[str, str]:
    """Both ends as local time; ValueError if the first lies after the second."""
    a, b = local(start, zone), local(end, zone)
    if a > b:
        raise ValueError(f"the start {start!r} lies after the end {end!r}")
    return str(a), str(b)
