"""Parsers of the date notations that queries use."""

from __future__ import annotations

import calendar
import re
from datetime import date

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def month_of(word: str) -> int | None:
    """The month that a word is the beginning of, if it is of just one."""
    found = [i + 1 for i, m in enumerate(MONTHS) if word and m.startswith(word.lower())]
    return found[0] if len(found) == 1 else None


def full_year(n: int) -> int:
    """Years of two digits above 12 are in the 20th century, others in the 21st."""
    return n if n > 99 else n + (1900 if n > 12 else 2000)


def day_bounds(year: int, month: int | None = None, day: int | None = None) -> tuple[date, date]:
    """First and last day of a year, month or day; a day beyond the month's end is its last."""
    if not month or not 1 <= month <= 12:
        return date(year, 1, 1), date(year, 12, 31)
    last = calendar.monthrange(year, month)[1]
    if not day or not 1 <= day <= 31:
        return date(year, month, 1), date(year, month, last)
    return date(year, month, min(day, last)), date(year, month, min(day, last))


def sloppy_day(spec: str, year: int | None = None) -> tuple[date, date] | None:
    """Bounds of `jan 10 2004`, `10 jan`, `feb`, `2004`; a missing year is the one given."""
    month = day = None
    for word in re.findall(r"[A-Za-z]+|\d+", spec):
        if word.isalpha():
            month = month_of(word) or month
        elif len(word) == 4 or int(word) > 31 or (day is not None and month is not None):
            year = full_year(int(word))
        else:
            day = int(word)
    return day_bounds(year, month, day) if year else None


def sloppy_ranges(spec: str) -> list[tuple[date, date]]:
    """Inclusive day ranges of a specification: alternatives parted by `.`, `,` or `;`, ranges by `-`.

    A start without a year takes that of the end.
    """
    found = []
    for part in filter(str.strip, re.split(r"[.,;]", spec)):
        low, _, high = part.partition("-")
        end = sloppy_day(high or low)
        start = sloppy_day(low, end[1].year if end else None)
        if start and end and start[0] <= end[1]:
            found.append((start[0], end[1]))
    return found


def interval(spec: str, today: date) -> tuple[date, date]:
    """`2004-20060723`: yyyy, yyyymm or yyyymmdd on each side; without a dash it goes on until today."""
    low, dash, high = spec.partition("-")
    part = lambda s: day_bounds(int(s[:4]), int(s[4:6]) if len(s) >= 6 else None, int(s[6:8]) if len(s) >= 8 else None)
    return part(low)[0], part(high)[1] if dash and high else today


def month_starts(start: date, end: date) -> list[date]:
    """The first days of months from start's to the first one at or after end."""
    found, y, m = [], start.year, start.month
    while True:
        found.append(date(y, m, 1))
        if found[-1] >= end:
            return found
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
