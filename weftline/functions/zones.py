"""Zone transition tables: for each area the instants at which its offset from UTC changes, for vectorised conversion.

A table is read from the machine's compiled zone files (RFC 8536): the transitions as they are listed, then 400 years of the rule that
the file ends with, which repeat. The version names the edition of the zone rules: every worker compares it with its own, so that tables
of two editions never mix.
"""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import importlib.resources
import os
import re
import struct
import zoneinfo

import numpy as np

_DAY = 86400
#: Gregorian years repeat after 400 years.
_CYCLE = 146097 * _DAY
#: Areas whose files stand for an edition without a name.
_WITNESSES = ("Europe/London", "America/New_York", "Africa/Casablanca", "Asia/Gaza", "America/Sao_Paulo", "Australia/Sydney")


def _zone_file(area: str) -> bytes | None:
    """The compiled rules of an area; None for an unknown one."""
    if not re.fullmatch(r"[A-Za-z0-9_+-]+(?:/[A-Za-z0-9_+-]+)*", area):
        return None
    for root in zoneinfo.TZPATH:
        try:
            with open(os.path.join(root, area), "rb") as f:
                if (data := f.read())[:4] == b"TZif":
                    return data
        except OSError:
            continue
    try:
        return importlib.resources.files("tzdata").joinpath("zoneinfo", *area.split("/")).read_bytes()
    except (ModuleNotFoundError, OSError):
        return None


@functools.lru_cache(maxsize=1)
def rules_version() -> str:
    """The edition of the zone rules of this machine; of one without a name, a digest of some of its files."""
    for root in zoneinfo.TZPATH:
        for name in ("+VERSION", "tzdata.zi"):
            try:
                with open(os.path.join(root, name)) as f:
                    return f.readline().strip().split()[-1]
            except (OSError, IndexError):
                continue
    return "digest " + hashlib.md5(b"".join(_zone_file(a) or b"-" for a in _WITNESSES)).hexdigest()


def require(version: str) -> None:
    """Raise where this machine's zone rules are of another edition."""
    if version != (own := rules_version()):
        raise RuntimeError(f"zone rules of edition {own} here, {version} elsewhere")


def _block(data: bytes, at: int, wide: bool) -> tuple[list[int], list[int], int]:
    """(transitions, offset from each on with the one before all as first, end) of a data block."""
    utc, std, leap, n, types, chars = struct.unpack(">6I", data[at + 20 : at + 44])
    at, size = at + 44, 8 if wide else 4
    times = struct.unpack(f">{n}{'q' if wide else 'i'}", data[at : at + n * size])
    kinds = data[at + n * size : at + n * (size + 1)]
    at += n * (size + 1)
    offsets = [struct.unpack(">i", data[at + 6 * k : at + 6 * k + 4])[0] for k in range(types)]
    return list(times), [offsets[0], *(offsets[k] for k in kinds)], at + 6 * types + chars + leap * (size + 4) + std + utc


_NAME = r"(?:<[^>]+>|[A-Za-z]{3,})"
_CLOCK = r"[-+]?[0-9]{1,3}(?::[0-9]{2}){0,2}"
_RULE = re.compile(rf"{_NAME}({_CLOCK})(?:{_NAME}({_CLOCK})?,([^,/]+)(?:/({_CLOCK}))?,([^,/]+)(?:/({_CLOCK}))?)?")


def _seconds(clock: str) -> int:
    sign, parts = (-1 if clock[0] == "-" else 1), [int(x) for x in clock.lstrip("+-").split(":")]
    return sign * sum(x * k for x, k in zip(parts, (3600, 60, 1)))


def _day_of(rule: str, year: int) -> int:
    """Days since 1970 of a rule's day (``Mm.w.d``, ``Jn`` or ``n``) in a year."""
    first = dt.date(year, 1, 1).toordinal() - dt.date(1970, 1, 1).toordinal()
    if rule[0] == "M":
        month, week, day = map(int, rule[1:].split("."))
        start = dt.date(year, month, 1)
        at = start + dt.timedelta((day - start.isoweekday()) % 7 + 7 * (week - 1))
        while at.month != month:  # week 5: the last
            at -= dt.timedelta(7)
        return at.toordinal() - dt.date(1970, 1, 1).toordinal()
    if rule[0] == "J":
        leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
        return first + int(rule[1:]) - 1 + (leap and int(rule[1:]) >= 60)
    return first + int(rule)


def _from_rule(rule: str, after: int) -> tuple[list[int], list[int]]:
    """(transitions, offset from each on) of 400 years of a closing rule, from ``after`` on."""
    m = _RULE.fullmatch(rule)
    if not m or not m.group(3):
        return ([after], [-_seconds(m.group(1))]) if m else ([], [])
    standard = -_seconds(m.group(1))
    summer = -_seconds(m.group(2)) if m.group(2) else standard + 3600
    begin, end = ((m.group(k), _seconds(m.group(k + 1) or "2")) for k in (3, 5))
    found, year = [], dt.datetime.fromtimestamp(max(after, -_DAY * 365 * 1900), dt.timezone.utc).year
    for y in range(year, year + 402):
        found.append((_day_of(begin[0], y) * _DAY + begin[1] - standard, summer))
        found.append((_day_of(end[0], y) * _DAY + end[1] - summer, standard))
    found = sorted(x for x in found if x[0] > after)
    return [t for t, _ in found], [o for _, o in found]


@functools.lru_cache(maxsize=1024)
def transitions(area: str, version: str) -> tuple[np.ndarray, np.ndarray, int] | None:
    """(local seconds since 1970 from which an offset holds, offset in seconds, local second from which the last 400 years repeat); None
    for an unknown area.

    A clock time that occurs twice is its first, so a turn back takes effect at the end of the repeated hour; a clock time that
    is skipped is read with the offset before the jump, so a turn forward takes effect where the clock lands.
    """
    require(version)
    data = _zone_file(area)
    if data is None:
        return None
    times, offsets, end = _block(data, 0, False)
    if data[4:5] >= b"2":
        times, offsets, end = _block(data, end, True)
        rule = data[end:].strip(b"\n").decode("ascii")
        later, then = _from_rule(rule, times[-1] if times else -(2**40)) if rule else ([], [])
        times, offsets = times + later, offsets + then
    starts, held = [-(2**62)], [offsets[0]]
    for t, o in zip(times, offsets[1:]):
        if o != held[-1]:
            starts.append(t + max(held[-1], o))
            held.append(o)
    repeats = starts[-1] - _CYCLE if len(starts) > 400 else 2**62
    return np.array(starts), np.array(held), repeats + _CYCLE if repeats < 2**62 else repeats


def local_offsets(area: str, local_seconds: np.ndarray, version: str) -> np.ndarray | None:
    """Offset from UTC in seconds that holds in ``area`` at local clock times; None for an unknown area."""
    found = transitions(area, version)
    if found is None:
        return None
    starts, offsets, last = found
    beyond = np.maximum(0, -(-(local_seconds - last) // _CYCLE)) if last < 2**62 else 0
    return offsets[np.searchsorted(starts, local_seconds - beyond * _CYCLE, "right") - 1]
