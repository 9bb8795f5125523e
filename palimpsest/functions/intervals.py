"""Calendar intervals such as ``30 days`` or ``6 months``."""

from __future__ import annotations

import calendar
import re
from datetime import datetime, timedelta

_INTERVAL = re.compile(r"\s*(\d+)\s+(day|week|month|year)s?\s*", re.IGNORECASE)


def parse_interval(text: str) -> tuple[int, str]:
    found = _INTERVAL.fullmatch(text or "")
    if not found:
        raise ValueError(f"not an interval: {text!r}; use for instance '30 days' or '6 months'")
    return int(found[1]), found[2].lower()


def cutoff(now: datetime, older_than: str) -> datetime:
    """``now`` less the interval; months and years keep the day, or take the month's last."""
    n, unit = parse_interval(older_than)
    if unit in ("day", "week"):
        return now - timedelta(days=n * (7 if unit == "week" else 1))
    months = now.year * 12 + now.month - 1 - n * (12 if unit == "year" else 1)
    year, month = divmod(months, 12)
    return now.replace(year=year, month=month + 1, day=min(now.day, calendar.monthrange(year, month + 1)[1]))


def month_bounds(start: datetime, months: int) -> list[tuple[str, datetime, datetime]]:
    """Name, first moment and end of so many months from the month of ``start``."""
    out = []
    for k in range(months):
        first = cutoff_forward(start, k)
        out.append((first.strftime("%Y-%m"), first, cutoff_forward(start, k + 1)))
    return out


def cutoff_forward(start: datetime, months: int) -> datetime:
    year, month = divmod(start.year * 12 + start.month - 1 + months, 12)
    return start.replace(year=year, month=month + 1, day=1, hour=0, minute=0, second=0, microsecond=0)
