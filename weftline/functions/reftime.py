"""Written time units ("days since 1-JAN-1850 03:00 CET") to exact time, by shape mask.

The unit and ``since`` are split off; the reference time after them, with blanks collapsed and single digits padded, is tokenised into
a mask of character classes (digit ``9``, letter ``a``, anything else itself). All strings of one mask have their fields at the same
places, so a mask is matched against the grammar once, which gives a parser of fixed positions, and all strings of the mask are
converted together in numpy.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np

from weftline.functions import calendars as cal
from weftline.functions import zones

#: Seconds in a unit, by the unit's lower-case name. Fixed values. Months and years count in calendar months.
UNIT_SECONDS = {
    "microsecond": 1e-6, "microseconds": 1e-6, "microsec": 1e-6, "microsecs": 1e-6, "us": 1e-6,
    "millisecond": 1e-3, "milliseconds": 1e-3, "millisec": 1e-3, "millisecs": 1e-3, "msec": 1e-3, "msecs": 1e-3, "ms": 1e-3,
    "second": 1.0, "seconds": 1.0, "sec": 1.0, "secs": 1.0, "s": 1.0,
    "minute": 60.0, "minutes": 60.0, "min": 60.0, "mins": 60.0,
    "hour": 3600.0, "hours": 3600.0, "hr": 3600.0, "hrs": 3600.0, "h": 3600.0,
    "day": 86400.0, "days": 86400.0, "d": 86400.0,
    "week": 604800.0, "weeks": 604800.0,
}
UNIT_MONTHS = {"month": 1, "months": 1, "mon": 1, "mons": 1, "year": 12, "years": 12, "yr": 12, "yrs": 12}
SINCE = ("since", "from", "after", "ref")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
LONG_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
ABSOLUTE = re.compile(r"\s*days?\s+as\s+%Y%m%d\.%f\s*", re.I)
#: A value from here on is a fill value (1e20 in any precision), not a step.
FILL = 9e19

_CLASSES = {c: "9" for c in range(ord("0"), ord("9") + 1)}
_CLASSES |= {c: "a" for r in ("az", "AZ") for c in range(ord(r[0]), ord(r[1]) + 1)}
_CLASSES |= {c: " " for c in (9, 10, 13, 0xA0)}

_DATE = (
    r"(?:(?P<y1>9{1,4})(?P<s1>[-/.])(?P<m1>9{1,2})(?:(?P=s1)(?P<d1>9{1,2}))?"
    r"|(?P<y2>9{4})(?P<m2>9{2})(?P<d2>9{2})?"
    r"|(?P<d3>9{1,2})[- ](?P<w3>a{3,9})[- ,]+(?P<y3>9{1,4})"
    r"|(?P<w4>a{3,9})\.? (?P<d4>9{1,2}),? (?P<y4>9{1,4})"
    r"|(?P<y5>9{1,4}))"
)
_TIME = (
    r"(?:(?: +|(?P<t>a) ?)(?:(?P<h1>9{1,2}):(?P<n1>9{1,2})(?::(?P<q1>9{1,2})(?:[.,](?P<f1>9+))?)?"
    r"|(?P<h2>9{2})(?P<n2>9{2})(?:(?P<q2>9{2}))?|(?P<h3>9{1,2})))?"
)
_ZONE = r"(?: *(?P<ap>aa)(?= |$|[-+]))? *(?:(?P<zone>a+(?:[/_-]a+)*)?(?P<sign>[-+])(?P<oh>9{1,2})(?::?(?P<on>9{2}))?|(?P<zone2>a+(?:[/_-]a+)*))?"
_SHAPE = re.compile(rf"{_DATE}{_TIME}{_ZONE}")
_HEAD = re.compile(r"\s*([A-Za-z]+)\s+([A-Za-z]+)\s+(\S.*)", re.S)
_LONE = re.compile(r"(?<![0-9])[0-9](?![0-9])")


@dataclass(frozen=True)
class Parser:
    """Where the fields of all strings of one mask are: name -> (start, end)."""

    at: dict

    def number(self, codes: np.ndarray, *names: str, default: int) -> np.ndarray:
        for name in names:
            if name in self.at:
                start, end = self.at[name]
                return (codes[:, start:end].astype(np.int64) - 48) @ (10 ** np.arange(end - start - 1, -1, -1))
        return np.full(len(codes), default, dtype=np.int64)

    def word(self, texts: list[str], *names: str) -> list[str] | None:
        for name in names:
            if name in self.at:
                start, end = self.at[name]
                return [x[start:end] for x in texts]
        return None


def split_units(text: str) -> tuple[str, str, str] | None:
    """(unit, since, reference time), the words in lower case, the time with single blanks and no lone digits; None if there are none."""
    m = _HEAD.fullmatch(text)
    return m and (m.group(1).lower(), m.group(2).lower(), _LONE.sub(r"0\g<0>", " ".join(m.group(3).split())))


def mask_of(text: str) -> str:
    return text.translate(_CLASSES)


@functools.lru_cache(maxsize=65536)
def parser_of(mask: str) -> Parser | None:
    """The parser of a mask, made once; None if no writing of this shape is known."""
    m = _SHAPE.fullmatch(mask)
    return m and Parser({k: m.span(k) for k, v in m.groupdict().items() if v is not None})


def _lookup(words: list[str] | None, table: dict, n: int, default):
    """(values, known) of words."""
    if words is None:
        return np.full(n, default), np.ones(n, bool)
    found = [table.get(x.lower()) for x in words]
    return np.array([default if x is None else x for x in found]), np.array([x is not None for x in found])


_MONTH_NUMBER = {x: i % 12 + 1 for i, x in enumerate(MONTHS + LONG_MONTHS)} | {"sept": 9}


def _zone_seconds(p: Parser, texts, codes, local, labels: dict[str, int], version: str):
    """(offset from UTC in seconds, known) at local clock times."""
    n = len(texts)
    named = p.word(texts, "zone", "zone2")
    signed = np.zeros(n, np.int64)
    if "sign" in p.at:
        start = p.at["sign"][0]
        signed = np.where(codes[:, start] == ord("-"), -1, 1) * (p.number(codes, "oh", default=0) * 3600 + p.number(codes, "on", default=0) * 60)
    if named is None:
        return signed, np.ones(n, bool)
    offset, known = np.zeros(n, np.int64), np.zeros(n, bool)
    for name in set(named):
        rows = np.array([x == name for x in named])
        if (minutes := labels.get(name.upper())) is not None:
            offset[rows], known[rows] = 60 * minutes, True
        elif "/" in name and (found := zones.local_offsets(name, local[rows], version)) is not None:
            offset[rows], known[rows] = found, True
    return offset + signed, known


def reference_time(p: Parser, texts: list[str], calendar: str, labels, version):
    """(year, month, day, second of the day, zone offset in seconds, fraction of a second, usable) of the reference times."""
    n = len(texts)
    codes = np.array(texts).view(np.uint32).reshape(n, -1)
    year, day = p.number(codes, "y1", "y2", "y3", "y4", "y5", default=1), p.number(codes, "d1", "d2", "d3", "d4", default=1)
    words = p.word(texts, "w3", "w4")
    month, ok = _lookup(words, _MONTH_NUMBER, n, 1)
    if words is None:
        month = p.number(codes, "m1", "m2", default=1)
    hour, minute, second = (p.number(codes, *(f"{x}{k}" for k in (1, 2, 3)), default=0) for x in "hnq")
    if (half := p.word(texts, "ap")) is not None:
        late, known = _lookup(half, {"am": 0, "pm": 12}, n, 0)
        ok &= known & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + late
    if (t := p.word(texts, "t")) is not None:
        ok &= np.array([x in "tT" for x in t])
    ok &= (hour <= 24) & (minute <= 59) & (second <= 60) & cal.is_valid(year, np.where((month >= 1) & (month <= 12), month, 1), day, calendar)
    ok &= (month >= 1) & (month <= 12)
    month, day = np.where(ok, month, 1), np.where(ok, day, 1)
    fraction = np.array([float(f"0.{x}") for x in p.word(texts, "f1")]) if "f1" in p.at else np.zeros(n)
    clock = hour * 3600 + minute * 60 + second
    civil = cal.to_days(year, month, np.minimum(day, cal.month_length(year, month, "proleptic_gregorian")), "proleptic_gregorian")
    local = (civil - 719162) * 86400 + clock
    offset, known = _zone_seconds(p, texts, codes, local, labels, version)
    return year, month, day, clock, offset, fraction, ok & known


def _absolute(values: np.ndarray, calendar: str):
    whole = np.floor(values)
    key = whole.astype(np.int64)
    year, month, day = key // 10000, key // 100 % 100, key % 100
    good = (month >= 1) & (month <= 12)
    good &= cal.is_valid(year, np.where(good, month, 1), day, calendar)
    days = cal.to_days(year, np.where(good, month, 1), np.where(good, day, 1), calendar)
    return days * 86400 + np.floor((values - whole) * 86400 + 0.5).astype(np.int64), good


def _relative(p: Parser, heads, values, calendar, labels, version):
    texts = [x[2] for x in heads]
    year, month, day, clock, offset, fraction, ok = reference_time(p, texts, calendar, labels, version)
    n = len(texts)
    unit = [x[0] for x in heads]
    seconds, timed = _lookup(unit, UNIT_SECONDS, n, 1.0)
    months, monthly = _lookup(unit, UNIT_MONTHS, n, 0)
    ok &= (timed | monthly) & np.array([x[1] in SINCE for x in heads])
    steps = np.where(monthly, values * months, 0.0)
    whole = np.floor(steps)
    index = year * 12 + month - 1 + whole.astype(np.int64)
    year, month = index // 12, index % 12 + 1
    length = cal.month_length(year, month, calendar)
    days = cal.to_days(year, month, np.minimum(day, length), calendar)
    # the first of the missing days of October 1582 stands for them all
    rest = np.where(monthly, (steps - whole) * length * 86400, values * seconds) + fraction
    return days * 86400 + clock - offset + np.floor(rest + 0.5).astype(np.int64), ok


def decode(units: list, names: list, values: np.ndarray, labels: dict[str, int], version: str = "") -> dict[str, np.ndarray]:
    """UTC fields of the steps ``values`` under ``units`` and the calendar ``names``; ``ok`` is False where one of them is unusable.

    Result arrays: year, month, day, second (of the day), ok. Values are rounded to the nearest second, halves upward.
    """
    n = len(units)
    version = version or zones.rules_version()
    total, ok = np.zeros(n, np.int64), np.zeros(n, bool)
    values = np.asarray(values, dtype=float)
    usable = np.isfinite(values) & (np.abs(values) < FILL)
    groups: dict[tuple, list[int]] = {}
    heads: list = [None] * n
    for i in np.flatnonzero(usable):
        text, calendar = units[i], cal.calendar_of(names[i])
        if text is None or not calendar:
            continue
        if ABSOLUTE.fullmatch(text):
            groups.setdefault((calendar, "absolute"), []).append(i)
        elif head := split_units(text):
            heads[i] = head
            groups.setdefault((calendar, mask_of(head[2])), []).append(i)
    out = {k: np.zeros(n, np.int64) for k in ("year", "month", "day", "second")}
    of_calendar: dict[str, list[int]] = {}
    for (calendar, mask), rows in groups.items():
        at = np.array(rows)
        if mask == "absolute":
            total[at], ok[at] = _absolute(values[at], calendar)
        elif p := parser_of(mask):
            total[at], ok[at] = _relative(p, [heads[i] for i in rows], values[at], calendar, labels, version)
        of_calendar.setdefault(calendar, []).extend(rows)
    for calendar, rows in of_calendar.items():
        at = np.array(rows)
        out["year"][at], out["month"][at], out["day"][at] = cal.from_days(total[at] // 86400, calendar)
        out["second"][at] = total[at] % 86400
    return out | {"ok": ok}
