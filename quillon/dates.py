"""Date ranges by phrase, relative to an injected day."""

from __future__ import annotations

import re
from datetime import date, timedelta

from quillon.errors import QueryError


def _month(day: date, back: int) -> date:
    """The first of the month `back` months before."""
    n = day.year * 12 + day.month - 1 - back
    return date(n // 12, n % 12 + 1, 1)


def _clamped(first: date, day: int) -> date:
    return first.replace(day=min(day, 28))


def phrase(text: str, today: date) -> tuple[date, date]:
    """First and last day of a phrase, both in the range."""
    words, one = " ".join(text.lower().split()), timedelta(days=1)
    monday = today - timedelta(days=today.weekday())
    month = _month(today, 0)
    quarter = _month(today, (today.month - 1) % 3)
    year = date(today.year, 1, 1)
    fixed = {
        "today": (today, today),
        "yesterday": (today - one, today - one),
        "this week": (monday, monday + 6 * one),
        "this month": (month, _month(month, -1) - one),
        "this quarter": (quarter, _month(quarter, -3) - one),
        "this year": (year, date(today.year, 12, 31)),
        "last week": (monday - 7 * one, monday - one),
        "last month": (_month(month, 1), month - one),
        "last quarter": (_month(quarter, 3), quarter - one),
        "last year": (date(today.year - 1, 1, 1), year - one),
    }
    if words in fixed:
        return fixed[words]
    got = re.fullmatch(r"last (\d+) (day|week|month|year)s?", words)
    if not got:
        raise QueryError(f"'{text}' is not a date range; give two dates or a phrase such as 'last 7 days'")
    n, unit = int(got[1]), got[2]
    start = {
        "day": lambda: today - n * one,
        "week": lambda: today - 7 * n * one,
        "month": lambda: _clamped(_month(month, n), today.day),
        "year": lambda: _clamped(date(today.year - n, today.month, 1), today.day),
    }[unit]()
    return start, today - one


def resolve(date_range: list[str] | str | None, today: date | None) -> tuple[str, str] | None:
    """Two bounds as text, or None without a range."""
    if not date_range:
        return None
    parts = [date_range] if isinstance(date_range, str) else list(date_range)
    if len(parts) == 2:
        return str(parts[0]), str(parts[1])
    if len(parts) != 1:
        raise QueryError(f"a date range has one phrase or two dates, not {len(parts)} values")
    a, b = phrase(str(parts[0]), today or date.today())
    return a.isoformat(), b.isoformat()
