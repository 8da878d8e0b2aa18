"""Day numbers of the six CF calendars in numpy, for vectorised (Arrow batch) code.

Day 0 is 0001-01-01 of each calendar; all results are integers. ``standard`` counts in the Julian calendar before
1582-10-15 and in the Gregorian one from then on, so its day numbers are the Gregorian ones, continued backwards.
"""

from __future__ import annotations

import numpy as np

#: Names of calendars, lower case, and the calendar each stands for. Fixed values.
CALENDARS = {
    "": "standard",
    "standard": "standard",
    "gregorian": "standard",
    "proleptic_gregorian": "proleptic_gregorian",
    "julian": "julian",
    "noleap": "noleap",
    "no_leap": "noleap",
    "365_day": "noleap",
    "all_leap": "all_leap",
    "366_day": "all_leap",
    "360_day": "360_day",
}
MONTH_DAYS = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
_BEFORE = np.concatenate([[0], np.cumsum(MONTH_DAYS)])
_BEFORE_LEAP = _BEFORE + (np.arange(13) >= 2)
#: Julian minus Gregorian day number of equal fields at 0001-01-01.
_JULIAN_SHIFT = 2


def calendar_of(name: str | None) -> str | None:
    """The calendar a written name stands for; None if it is unknown. Missing means standard."""
    return CALENDARS.get((name or "").strip().lower())


def is_leap(year: np.ndarray, calendar: str, month: np.ndarray | None = None) -> np.ndarray:
    julian, gregorian = year % 4 == 0, (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    if calendar == "julian":
        return julian
    if calendar == "standard":
        return np.where(year < 1583, julian, gregorian)
    if calendar == "proleptic_gregorian":
        return gregorian
    return np.full(np.shape(year), calendar == "all_leap")


def month_length(year: np.ndarray, month: np.ndarray, calendar: str) -> np.ndarray:
    if calendar == "360_day":
        return np.full(np.shape(year), 30)
    return MONTH_DAYS[month - 1] + ((month == 2) & is_leap(year, calendar))


def _days(year, month, day, leap_days, leap):
    return 365 * (year - 1) + leap_days + np.where(leap, _BEFORE_LEAP[month - 1], _BEFORE[month - 1]) + day - 1


def to_days(year: np.ndarray, month: np.ndarray, day: np.ndarray, calendar: str) -> np.ndarray:
    """Day number of valid fields."""
    if calendar == "360_day":
        return 360 * (year - 1) + 30 * (month - 1) + day - 1
    if calendar == "noleap":
        return _days(year, month, day, 0, False)
    if calendar == "all_leap":
        return _days(year, month, day, year - 1, True)
    y = year - 1
    julian = _days(year, month, day, y // 4, is_leap(year, "julian")) - _JULIAN_SHIFT * (calendar == "standard")
    if calendar == "julian":
        return julian
    gregorian = _days(year, month, day, y // 4 - y // 100 + y // 400, is_leap(year, "proleptic_gregorian"))
    if calendar == "proleptic_gregorian":
        return gregorian
    return np.where(year * 10000 + month * 100 + day < 15821015, julian, gregorian)


def is_valid(year: np.ndarray, month: np.ndarray, day: np.ndarray, calendar: str) -> np.ndarray:
    ok = (month >= 1) & (month <= 12) & (day >= 1)
    ok &= day <= month_length(year, np.where(ok, month, 1), calendar)
    if calendar == "standard":
        key = year * 10000 + month * 100 + day
        ok &= (key < 15821005) | (key > 15821014)
    return ok


def _split(day_in_year, leap):
    month = np.where(leap, np.searchsorted(_BEFORE_LEAP[1:], day_in_year, "right"), np.searchsorted(_BEFORE[1:], day_in_year, "right")) + 1
    return month, day_in_year - np.where(leap, _BEFORE_LEAP[month - 1], _BEFORE[month - 1]) + 1


def _from_julian(n):
    year = 1 + 4 * (n // 1461) + np.minimum(n % 1461 // 365, 3)
    y = year - 1
    return (year, *_split(n - (365 * y + y // 4), year % 4 == 0))


def _from_gregorian(n):
    cycle, rest = n // 146097, n % 146097
    century = np.minimum(rest // 36524, 3)
    rest = rest - century * 36524
    four, rest = rest // 1461, rest % 1461
    single = np.minimum(rest // 365, 3)
    year = 1 + 400 * cycle + 100 * century + 4 * four + single
    return (year, *_split(rest - 365 * single, is_leap(year, "proleptic_gregorian")))


def from_days(n: np.ndarray, calendar: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(year, month, day) of a day number."""
    if calendar == "360_day":
        return n // 360 + 1, n % 360 // 30 + 1, n % 30 + 1
    if calendar in ("noleap", "all_leap"):
        size = 365 + (calendar == "all_leap")
        return (n // size + 1, *_split(n % size, calendar == "all_leap"))
    if calendar == "julian":
        return _from_julian(n)
    if calendar == "proleptic_gregorian":
        return _from_gregorian(n)
    first = int(to_days(np.array(1582), np.array(10), np.array(15), "proleptic_gregorian"))
    old, new = _from_julian(n + _JULIAN_SHIFT), _from_gregorian(n)
    return tuple(np.where(n < first, a, b) for a, b in zip(old, new))
