"""Date ranges in English text, half-open and relative to a given day."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, timedelta

# Month names.
MONTHS = "january february march april may june july august september october november december".split()
_DAY = rf"(?:\d{{4}}-\d{{2}}-\d{{2}}|(?:{'|'.join(MONTHS)})\s+\d{{1,2}}(?:\s+\d{{4}})?)"


@dataclass(frozen=True)
class FoundRange:
    """start <= day < end, the rule that found it, and where in the text."""

    start: date
    end: date
    rule: str
    span: tuple[int, int]


def parse_day(text: str, today: date) -> date | None:
    """``march 1 2013``, ``march 1`` (this year) or an ISO date; None for days that don't exist."""
    words = text.split()
    try:
        if len(words) == 1:
            return date.fromisoformat(words[0])
        return date(int(words[2]) if len(words) > 2 else today.year, MONTHS.index(words[0]) + 1, int(words[1]))
    except (ValueError, IndexError):
        return None


def _months(day: date, by: int) -> date:
    month = day.year * 12 + day.month - 1 + by
    return date(month // 12, month % 12 + 1, 1)


def _period(unit: str, back: int, today: date) -> tuple[date, date]:
    if unit == "week":
        monday = today - timedelta(days=today.weekday() + 7 * back)
        return monday, monday + timedelta(days=7)
    if unit == "month":
        return _months(today, -back), _months(today, 1 - back)
    return date(today.year - back, 1, 1), date(today.year - back + 1, 1, 1)


def find_ranges(text: str, today: date) -> list[FoundRange]:
    """All ranges of a normalised text in order; each word belongs to one at most."""
    taken: list[tuple[int, int]] = []
    return sorted((r for r in _all(text, today) if _free(taken, r.span)), key=lambda r: r.span)


def _free(taken: list[tuple[int, int]], span: tuple[int, int]) -> bool:
    if any(span[0] < b and a < span[1] for a, b in taken):
        return False
    taken.append(span)
    return True


def _all(text: str, today: date) -> Iterator[FoundRange]:
    one = timedelta(days=1)
    for m in re.finditer(rf"\b(?:between|from)\s+({_DAY})\s+(?:and|to|until)\s+({_DAY})\b", text):
        first, last = parse_day(m[1], today), parse_day(m[2], today)
        if first and last:
            yield FoundRange(first, last + one, "BETWEEN", m.span())
    for m in re.finditer(rf"\b(after|before|since|until|on)\s+({_DAY})\b", text):
        day = parse_day(m[2], today)
        if day:
            ends = {"after": (day + one, date.max), "before": (date.min, day), "since": (day, date.max), "until": (date.min, day + one), "on": (day, day + one)}[m[1]]
            yield FoundRange(*ends, m[1].upper(), m.span())
    for m in re.finditer(r"\b(?:last|past|previous)\s+(\d+)\s+days?\b", text):
        yield FoundRange(today - timedelta(days=int(m[1]) - 1), today + one, "LAST_DAYS", m.span())
    for m in re.finditer(r"\b(this|last|previous)\s+(week|month|year)\b", text):
        back = 0 if m[1] == "this" else 1
        yield FoundRange(*_period(m[2], back, today), f"{'LAST' if back else 'THIS'}_{m[2].upper()}", m.span())
    for m in re.finditer(r"\b(today|yesterday)\b", text):
        day = today - one * (m[1] == "yesterday")
        yield FoundRange(day, day + one, m[1].upper(), m.span())
