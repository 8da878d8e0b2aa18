"""CF calendar arithmetic as Column expressions: they stay in the JVM and in generated code.

Units and calendar are constants here (Python strings). Where they vary by row, use :func:`weftline.operators.timestamps.decode_utc`.
Dates are structs of fields, as some calendars have days that no SQL date has. Results are rounded to the microsecond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import calendars, reftime, zones
from weftline.functions.reftime import UNIT_MONTHS
from weftline.model import FREQUENCY_STEP, FREQUENCY_UNIT
from weftline.session import once

_FIRST_GREGORIAN = 577735
_DAY_US = 86_400_000_000


def _floor_div(a: Column, b: int) -> Column:
    """Whole division towards minus infinity, in integers."""
    a, b = a.cast("long"), F.lit(b).cast("long")
    return F.call_function("div", a - F.pmod(a, b), b)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def leap(year: Column, calendar: str) -> Column:
    gregorian = (F.pmod(year, F.lit(4)) == 0) & ((F.pmod(year, F.lit(100)) != 0) | (F.pmod(year, F.lit(400)) == 0))
    julian = F.pmod(year, F.lit(4)) == 0
    return {"standard": F.when(year < 1583, julian).otherwise(gregorian), "proleptic_gregorian": gregorian, "julian": julian, "all_leap": F.lit(True)}.get(calendar, F.lit(False))


def month_length(year: Column, month: Column, calendar: str) -> Column:
    if calendar == "360_day":
        return F.lit(30)
    return F.when(month == 2, F.when(leap(year, calendar), 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


#: Unix days of the first day of 0001 (as Gregorian), and of years without and with a leap day.
_YEAR_ONE, _COMMON, _LEAP = -719162, 0, 730


def _in_common(month: Column) -> Column:
    """Days of a common year before a month."""
    return F.unix_date(F.make_date(F.lit(1970), month.cast("int"), F.lit(1)))


def _in_leap(month: Column) -> Column:
    return F.unix_date(F.make_date(F.lit(1972), month.cast("int"), F.lit(1))) - _LEAP


def day_number(year: Column, month: Column, day: Column, calendar: str) -> Column:
    """Days since 0001-01-01 of the calendar. SQL dates, which are generated code, do the months; the calendar does the years."""
    y = (year - 1).cast("long")
    if calendar == "360_day":
        return 360 * y + 30 * (month - 1) + day - 1
    if calendar == "noleap":
        return 365 * y + _in_common(month) + day - 1
    if calendar == "all_leap":
        return 366 * y + _in_leap(month) + day - 1
    julian = 365 * y + _floor_div(y, 4) + F.when(leap(year, "julian"), _in_leap(month)).otherwise(_in_common(month)) + day - 1
    if calendar == "julian":
        return julian
    gregorian = F.unix_date(F.make_date(year.cast("int"), month.cast("int"), F.lit(1))).cast("long") - _YEAR_ONE + day - 1
    if calendar == "proleptic_gregorian":
        return gregorian
    return F.when(year * 10000 + month * 100 + day < 15821015, julian - 2).otherwise(gregorian)


def _julian_year(n: Column) -> Column:
    return 1 + 4 * _floor_div(n, 1461) + F.least(_floor_div(F.pmod(n, F.lit(1461).cast("long")), 365), F.lit(3))


def _unix(n: Column) -> Column:
    return F.date_from_unix_date(n.cast("int"))


def date_of(n: Column, calendar: str) -> tuple[Column, Column, Column]:
    """(year, month, day) of days since 0001-01-01."""
    n = n.cast("long")
    if calendar == "360_day":
        return _floor_div(n, 360) + 1, _floor_div(F.pmod(n, F.lit(360).cast("long")), 30) + 1, F.pmod(n, F.lit(30).cast("long")) + 1
    if calendar in ("noleap", "all_leap"):
        size, base = (365, _COMMON) if calendar == "noleap" else (366, _LEAP)
        in_year = _unix(F.pmod(n, F.lit(size).cast("long")) + base)
        return _floor_div(n, size) + 1, F.month(in_year), F.dayofmonth(in_year)
    gregorian = _unix(n + _YEAR_ONE)
    if calendar == "proleptic_gregorian":
        return F.year(gregorian), F.month(gregorian), F.dayofmonth(gregorian)

    def julian(n: Column) -> tuple[Column, Column, Column]:
        year = _julian_year(n)
        in_year = _unix(n - 365 * (year - 1) - _floor_div(year - 1, 4) + F.when(leap(year, "julian"), _LEAP).otherwise(_COMMON))
        return year, F.month(in_year), F.dayofmonth(in_year)

    if calendar == "julian":
        return julian(n)
    new = F.year(gregorian), F.month(gregorian), F.dayofmonth(gregorian)
    return tuple(F.when(n < _FIRST_GREGORIAN, a).otherwise(b) for a, b in zip(julian(n + 2), new))


def fields(total: Column, calendar: str) -> Column:
    """Date struct of microseconds since 0001-01-01."""
    y, m, d = date_of(_floor_div(total, _DAY_US), calendar)
    micros = F.pmod(total, F.lit(_DAY_US))
    s, sixty = _floor_div(micros, 1_000_000), F.lit(60).cast("long")
    names = ("year", y), ("month", m), ("day", d), ("hour", _floor_div(s, 3600)), ("minute", F.pmod(_floor_div(s, 60), sixty)), ("second", F.pmod(s, sixty)), ("microsecond", F.pmod(micros, F.lit(1_000_000).cast("long")))
    return F.struct(*(c.cast("int").alias(n) for n, c in names))


def calendar_of(name: str | None) -> str:
    found = calendars.calendar_of(name)
    if found is None:
        raise ValueError(f"unknown calendar {name!r}")
    return found


def epoch_of(units: str, calendar: str) -> tuple[str, float, int, tuple[int, int, int]]:
    """(unit word, seconds of a unit or 0, microseconds of the epoch, its date) of written units."""
    head = reftime.split_units(units)
    parser = head and reftime.parser_of(reftime.mask_of(head[2]))
    if not parser or head[1] not in reftime.SINCE:
        raise ValueError(f"unusable units {units!r}")
    word = head[0]
    y, m, d, clock, offset, fraction, ok = reftime.reference_time(parser, [head[2]], calendar, {"UTC": 0, "GMT": 0, "Z": 0}, zones.rules_version())
    if not ok[0] or word not in reftime.UNIT_SECONDS and word not in UNIT_MONTHS:
        raise ValueError(f"unusable units {units!r}")
    days = int(calendars.to_days(y, m, d, calendar)[0])
    micros = days * _DAY_US + (int(clock[0]) - int(offset[0])) * 1_000_000 + round(float(fraction[0]) * 1e6)
    return word, reftime.UNIT_SECONDS.get(word, 0), micros, (int(y[0]), int(m[0]), int(d[0]))


def _usable(num: Column) -> Column:
    n = num.cast("double")
    return num.isNotNull() & ~F.isnan(n) & (F.abs(n) < reftime.FILL)


def _total(num: Column, units: str, cal: str) -> Column:
    """Microseconds since 0001-01-01 of usable numbers in relative units."""
    word, seconds, epoch, (y, m, d) = epoch_of(units, cal)
    if seconds:
        return F.round(num.cast("double") * (seconds * 1e6)).cast("long") + F.lit(epoch)
    step = UNIT_MONTHS[word]
    start = lambda k: _month_start((k * step) + F.lit(y * 12 + m - 1).cast("long"), F.lit(d), cal) * _DAY_US
    part = num.cast("double") - F.floor(num.cast("double"))
    ends = let(F.floor(num.cast("double")).cast("long"), lambda k: F.struct(start(k).alias("a"), start(k + 1).alias("b")))
    return let(ends, lambda e: e["a"] + F.round(part * (e["b"] - e["a"])).cast("long") + F.lit(epoch % _DAY_US))


def decode(num: Column, units: str, calendar: str | None = "standard") -> Column:
    """Date struct of ``num`` in ``units`` (relative, month or year units, or ``day as %Y%m%d.%f``). Null and non-finite give null.

    ``days since 0-01-01`` in 365-day years counts from year 0, which that calendar has, so nothing needs shifting here. For whole
    columns of a table :func:`with_decoded` is faster.
    """
    cal = calendar_of(calendar)
    if reftime.ABSOLUTE.fullmatch(units):
        return F.when(_usable(num), decode_absolute(num))
    return F.when(_usable(num), let(_total(num, units, cal), lambda t: fields(t, cal)))


def with_decoded(df: DataFrame, num: str, units: str, calendar: str | None = "standard", name: str = "cf") -> DataFrame:
    """Add the date struct ``name`` of the column ``num``, in stages that stay in generated code."""
    cal, n = calendar_of(calendar), F.col(num)
    if reftime.ABSOLUTE.fullmatch(units):
        return df.withColumn(name, decode(n, units, calendar))
    staged = once(df, _total=F.when(_usable(n), _total(n, units, cal)))
    return staged.withColumn(name, F.when(F.col("_total").isNotNull(), fields(F.col("_total"), cal))).drop("_total")


def _month_start(index: Column, day: Column, calendar: str) -> Column:
    """Day number of a day of the month ``index`` (months since year 0); the day runs over into the next month where it doesn't exist."""
    return let(index, lambda i: day_number(_floor_div(i, 12), F.pmod(i, F.lit(12).cast("long")) + 1, F.lit(1), calendar)) + day - 1


def decode_absolute(num: Column) -> Column:
    """Date struct of ``yyyymmdd.fraction``; hours, minutes and seconds are cut, not rounded, after a guard of half a millisecond."""
    whole = F.floor(num)
    micros = F.least(F.round((num - whole) * 86_400_000).cast("long") * 1000, F.lit(_DAY_US - 1))
    s = _floor_div(micros, 1_000_000)
    key = whole.cast("long")
    parts = ("year", _floor_div(key, 10000)), ("month", F.pmod(_floor_div(key, 100), F.lit(100).cast("long"))), ("day", F.pmod(key, F.lit(100).cast("long")))
    clock = ("hour", _floor_div(s, 3600)), ("minute", F.pmod(_floor_div(s, 60), F.lit(60).cast("long"))), ("second", F.pmod(s, F.lit(60).cast("long"))), ("microsecond", F.lit(0))
    return F.struct(*(c.cast("int").alias(n) for n, c in (*parts, *clock)))


def fields_of_timestamp(ts: Column) -> Column:
    parts = ("year", F.year(ts)), ("month", F.month(ts)), ("day", F.dayofmonth(ts)), ("hour", F.hour(ts)), ("minute", F.minute(ts)), ("second", F.second(ts)), ("microsecond", F.lit(0))
    return F.when(ts.isNotNull(), F.struct(*(c.cast("int").alias(n) for n, c in parts)))


def total_micros(cf: Column, calendar: str) -> Column:
    """Microseconds since 0001-01-01 of a date struct."""
    clock = ((cf["hour"].cast("long") * 60 + cf["minute"]) * 60 + cf["second"]) * 1_000_000 + cf["microsecond"]
    return day_number(cf["year"], cf["month"], cf["day"], calendar) * _DAY_US + clock


def encode(cf: Column, units: str, calendar: str | None = "standard", exact_fraction: bool = False) -> Column:
    """Number in ``units`` of a date struct. Month and year units: whole steps to the anchor at or after the date, less the fraction
    of the interval *after* that anchor (the reference behaviour); ``exact_fraction`` divides by the interval the date lies in."""
    cal = calendar_of(calendar)
    word, seconds, epoch, (y, m, d) = epoch_of(units, cal)
    if seconds:
        return (total_micros(cf, cal) - F.lit(epoch)) / (seconds * 1e6)
    step = UNIT_MONTHS[word]
    anchor = lambda k: _month_start(F.lit(y * 12 + m - 1).cast("long") + k * step, F.lit(d), cal) * _DAY_US + F.lit(epoch % _DAY_US)
    months = cf["year"].cast("long") * 12 + cf["month"] - 1 - (y * 12 + m - 1)

    def following(v: Column) -> Column:
        """The first anchor at or after the date."""
        after = F.when(anchor(v["k"] - 1) >= v["t"], v["k"] - 1).when(anchor(v["k"]) >= v["t"], v["k"]).otherwise(v["k"] + 1)
        return F.struct(after.alias("k"), v["t"].alias("t"))

    def place(v: Column) -> Column:
        span = anchor(v["k"]) - anchor(v["k"] - 1) if exact_fraction else anchor(v["k"] + 1) - anchor(v["k"])
        return v["k"].cast("double") - (anchor(v["k"]) - v["t"]) / span

    return let(let(F.struct(_floor_div(months, step).alias("k"), total_micros(cf, cal).alias("t")), following), place)


def rebase(num: Column, units: str, to: str, calendar: str | None = "standard") -> Column:
    """``num`` of one unit in another. Into time units no date is formed: both count microseconds."""
    if units == to:
        return num
    cal = calendar_of(calendar)
    _, seconds, epoch, _ = epoch_of(to, cal)
    if seconds and not reftime.ABSOLUTE.fullmatch(units):
        return F.when(_usable(num), (_total(num, units, cal) - F.lit(epoch)) / (seconds * 1e6))
    return encode(decode(num, units, calendar), to, calendar)


def date_print(cf: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS``, in generated code; years outside of 0 to 9999 as they are."""
    two = lambda n: F.lpad(cf[n].cast("string"), 2, "0")
    year = F.when(cf["year"].between(0, 9999), F.lpad(cf["year"].cast("string"), 4, "0")).otherwise(cf["year"].cast("string"))
    return F.concat(year, F.lit("-"), two("month"), F.lit("-"), two("day"), F.lit(" "), two("hour"), F.lit(":"), two("minute"), F.lit(":"), two("second"))


def truncate(value: Column, digits: int) -> Column:
    """A decimal cut after ``digits`` places, towards zero: of its decimal text, so that 0.29 stays 0.29. Null, NaN and infinities stay."""
    text = value.cast("double").cast("decimal(38,15)").cast("string")
    cut = F.regexp_extract(text, rf"^-?[0-9]+(?:\.[0-9]{{0,{digits}}})?", 0).cast("double")
    return F.when(F.abs(value) < 1e22, cut).otherwise(value)


def pad_timestamp(text: Column) -> Column:
    """14 digits of a truncated timestamp: years get month and day, months get the day, the rest zeros."""
    day = F.when(F.length(text) == 4, F.concat(text, F.lit("0101"))).when(F.length(text) == 6, F.concat(text, F.lit("01"))).otherwise(text)
    return F.rpad(day, 14, "0")


def fields_of_digits(text: Column) -> Column:
    """Date struct of a (truncated) timestamp of digits."""
    t = pad_timestamp(text)
    at = ("year", 1, 4), ("month", 5, 2), ("day", 7, 2), ("hour", 9, 2), ("minute", 11, 2), ("second", 13, 2)
    return F.struct(*(F.substring(t, i, n).cast("int").alias(k) for k, i, n in at), F.lit(0).alias("microsecond"))


def add_months(cf: Column, months: Column | int) -> Column:
    """A date struct, months later; the day stays as it is, even where the month has no such day."""
    index = cf["year"].cast("long") * 12 + cf["month"] - 1 + months
    return cf.withField("year", _floor_div(index, 12).cast("int")).withField("month", (F.pmod(index, F.lit(12).cast("long")) + 1).cast("int"))


def add_years(cf: Column, years: Column | int) -> Column:
    return cf.withField("year", (cf["year"] + years).cast("int"))


def frequency_step(frequency: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in FREQUENCY_STEP.items() for x in kv)), frequency)


def frequency_units(units: Column, frequency: Column) -> Column:
    """Units with their ``days`` replaced by the unit word of a frequency."""
    return F.replace(units, F.lit("days"), F.element_at(F.create_map(*(F.lit(x) for kv in FREQUENCY_UNIT.items() for x in kv)), frequency))


def control_units(units: Column) -> Column:
    """Units as ``days since Y-M-D``: the time of day is dropped, missing month and day are the first, ``days`` in front."""
    since = F.regexp_extract(units, r"since\s+([0-9]+(?:-[0-9]+){0,2})", 1)
    parts = F.split(since, "-")
    full = F.when(F.size(parts) == 1, F.concat(since, F.lit("-1-1"))).when(F.size(parts) == 2, F.concat(since, F.lit("-1"))).otherwise(since)
    return F.when(since != "", F.concat(F.lit("days since "), full))


def axis_numbers(count: int | Column, frequency: str, first: Column, instant: bool) -> Column:
    """Array of ``count`` axis values from ``first``; averaged axes lie in the middle of their step unless the step is 3 or 6."""
    step = FREQUENCY_STEP[frequency]
    shift = 0.0 if instant or step in (3, 6) else 0.5 * step
    n = F.lit(count) if isinstance(count, int) else count
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: first + i * step + shift)).otherwise(F.array().cast("array<double>"))


def axis_bounds(count: int | Column, frequency: str, first: Column, instant: bool) -> Column:
    """Array of [low, high] of ``count`` steps from ``first``; those of averaged 3- and 6-hour axes begin half a step earlier."""
    step = FREQUENCY_STEP[frequency]
    shift = -0.5 * step if not instant and step in (3, 6) else 0.0
    n = F.lit(count) if isinstance(count, int) else count
    bounds = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(first + i * step + shift, first + (i + 1) * step + shift))
    return F.when(n > 0, bounds).otherwise(F.array().cast("array<array<double>>"))
