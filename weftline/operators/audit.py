"""Audit of time axes: the theoretical axis of a file against the one it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import cftime
from weftline.model import FREQUENCY_STEP, FREQUENCY_UNIT


def instant_axis(variable: Column, frequency: Column, realm: Column, listed: list[tuple[str, str, str]]) -> Column:
    """Whether an axis is instantaneous: its variable, frequency and realm are listed."""
    hit = F.lit(False)
    for v, f, r in listed:
        hit = hit | ((variable == v) & (frequency == f) & (realm == r))
    return hit


def reference_properties(files: DataFrame, keys: list[str], name: str = "file") -> DataFrame:
    """``keys, units, calendar`` of the first file by name; of one model known to mislabel it, a standard calendar is proleptic."""
    first = files.groupBy(*keys).agg(F.min(F.struct(name, "units", "calendar", "model")).alias("f"))
    fixed = F.when((F.col("f.model") == "CMCC-CM") & (F.col("f.calendar") == "standard"), "proleptic_gregorian").otherwise(F.col("f.calendar"))
    return first.select(*keys, cftime.control_units(F.col("f.units")).alias("units"), fixed.alias("calendar"))


def _in_frequency_units(units: str, frequency: str) -> str:
    return units.replace("days", FREQUENCY_UNIT[frequency])


def axis_audit(files: DataFrame, frequency: str, units: str, calendar: str, instant: bool) -> DataFrame:
    """``file, start, end, last, steps, instant, calendar, units, control, bnds, time``: a row for each file.

    ``files``: ``file, begin, until`` (digits of its name), ``units, time`` (array, in order) and ``time_bnds`` (array of [low, high], or
    null if there are none). ``units`` and ``calendar`` are those of the dataset. Codes: 003 the last theoretical date isn't the name's
    end (nothing else is looked at); 004 instant with bounds; 005 averaged without; 000 or 001 the axis is right or wrong; 002 other
    units. ``time`` is the right axis. Each file is a row of its own: no shuffle.
    """
    step, own = FREQUENCY_STEP[frequency], _in_frequency_units(units, frequency)
    start, end = cftime.fields_of_digits(F.col("begin")), cftime.fields_of_digits(F.col("until"))
    n = F.size("time")
    to_units = lambda t: cftime.rebase(t, own, units, calendar)
    at = cftime.encode(start, own, calendar)
    dated = files.withColumns({"start": cftime.date_print(start), "end": cftime.date_print(end), "steps": n.cast("long"), "_start": at})
    low = cftime.truncate(F.col("_start"), 5)
    last = lambda s: cftime.date_print(cftime.decode(s + (n - 1) * step, own, calendar))
    dated = dated.withColumns({"_high": last(F.col("_start")), "_low": last(low), "_units": cftime.control_units(F.col("units"))})
    is_high, is_low = F.col("_high") == F.col("end"), F.col("_low") == F.col("end")
    begin = F.when(is_high, F.col("_start")).when(is_low, low)
    dated = dated.withColumns({"last": F.when(is_high | is_low, F.col("end")), "_begin": begin})
    axis = F.transform(cftime.axis_numbers(n, frequency, F.col("_begin"), instant), to_units)
    bounds = F.transform(cftime.axis_bounds(n, frequency, F.col("_start"), instant), lambda b: F.transform(b, to_units))
    dated = dated.withColumns({"_axis": F.when(F.col("last").isNotNull(), axis), "_bounds": bounds})
    has = F.col("time_bnds").isNotNull()
    codes = F.array(
        F.when(has, F.lit("004")) if instant else F.when(~has, F.lit("005")),
        F.when(F.col("_axis") == F.col("time"), F.lit("000")).otherwise(F.lit("001")),
        F.when(F.col("_units") != units, F.lit("002")),
    )
    control = F.when(F.col("last").isNull(), F.array(F.lit("003"))).otherwise(F.filter(codes, lambda c: c.isNotNull()))
    bnds = F.when(F.col("last").isNotNull() & has, F.col("_bounds") == F.col("time_bnds"))
    return dated.select(
        "file", "start", "end", "last", "steps", F.lit(instant).alias("instant"), F.lit(calendar).alias("calendar"), F.col("_units").alias("units"), control.alias("control"), bnds.alias("bnds"), F.col("_axis").alias("time")
    )


def corrected(files: DataFrame, audited: DataFrame, units: str, force: bool = False) -> DataFrame:
    """``files`` as they are rewritten: the right axis, bounds and units where the audit found code 001 (or, with ``force``, wherever it
    has an axis), and no bounds where it found 004. ``rewritten`` says whether a file's content changed, so that its ``checksum``, null
    then, is to be taken anew."""
    right = audited.select("file", F.col("time").alias("_right"), F.array_contains("control", "001").alias("_wrong"), F.array_contains("control", "004").alias("_instant"))
    joined = files.join(right, "file", "left")
    fix = F.coalesce(F.col("_right").isNotNull() & (F.lit(force) | F.col("_wrong")), F.lit(False))
    drop = F.coalesce(F.col("_instant"), F.lit(False))
    columns = {"time": F.when(fix, F.col("_right")).otherwise(F.col("time")), "units": F.when(fix, F.lit(units)).otherwise(F.col("units"))}
    if "time_bnds" in files.columns:
        columns["time_bnds"] = F.when(~drop, F.col("time_bnds"))
    if "checksum" in files.columns:
        columns["checksum"] = F.when(~(fix | drop), F.col("checksum"))
    return joined.withColumns({"rewritten": fix | drop}).withColumns(columns).select(*files.columns, "rewritten")
