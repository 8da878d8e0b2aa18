"""Mixed timestamp formats and time zones: every axis' time in UTC and in one form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import reftime, zones
from weftline.session import small_rows


def zone_offsets(labels: DataFrame) -> dict[str, int]:
    """Zone labels (fixed table ``label, utc_offset_min``) as a dictionary; its size is checked."""
    return {r["label"].strip().upper(): r["utc_offset_min"] for r in small_rows(labels.select("label", "utc_offset_min")) if r["label"] and r["utc_offset_min"] is not None}


def axis_extent(steps: DataFrame, key: str = "path_id") -> DataFrame:
    """``key, units, calendar, first_num, last_num``: the least and greatest usable step (finite, not a fill value) of every axis.

    One row per axis, as units and calendar are constant on an axis; an axis with several has a row for each. A hash aggregate with
    map-side combine: the steps themselves are never shuffled. Axes without a usable step are left out.
    """
    step = F.col("time_num")
    usable = step.isNotNull() & ~F.isnan(step) & (F.abs(step) < reftime.FILL)
    return steps.where(usable & F.col(key).isNotNull()).groupBy(key, "units", "calendar").agg(F.min(step).alias("first_num"), F.max(step).alias("last_num"))


def decode_utc(df: DataFrame, columns: dict[str, str], labels: dict[str, int], units: str = "units", calendar: str = "calendar", version: str | None = None) -> DataFrame:
    """Add, for each numeric column in ``columns``, a column (its value there) of struct<year, month, day, second> in UTC.

    The struct is null where units, calendar or value are unusable: null, blank or unknown units, an unknown calendar, a date that
    the calendar doesn't have, an unknown zone, or a null, non-finite or fill value. ``version`` names the edition of the zone
    rules (default: the driver's), so that all workers agree on it. Runs on Arrow batches; no shuffle. Columns of ``df`` are kept
    as they are, whatever their names, as long as they are not among the new ones.
    """
    version = version or zones.rules_version()
    form = "year int, month int, day int, second int"
    names = list(columns)

    @F.pandas_udf(", ".join(f"f{i} struct<{form}>" for i in range(len(names))))
    def convert(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for unit, calendar_name, *values in batches:
            clean = [None if x is None or x != x else x for x in unit], [None if x is None or x != x else x for x in calendar_name]
            out = {}
            for i, v in enumerate(values):
                got = reftime.decode(*clean, v.to_numpy(dtype=float, na_value=float("nan")), labels, version)
                rows = zip(*(got[k].tolist() for k in ("year", "month", "day", "second", "ok")))
                out[f"f{i}"] = [{"year": y, "month": m, "day": d, "second": s} if ok else None for y, m, d, s, ok in rows]
            yield pd.DataFrame(out)

    given = df.withColumn("_utc", convert(F.col(units), F.col(calendar), *(F.col(x) for x in names)))
    return given.withColumns({columns[x]: F.col(f"_utc.f{i}") for i, x in enumerate(names)}).drop("_utc")


def iso_text(field: str) -> F.Column:
    """``YYYY-MM-DD HH:MM:SS`` of a struct made by :func:`decode_utc`."""
    at, s = F.col(field), F.col(f"{field}.second")
    parts = at["year"], at["month"], at["day"], F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(at.isNotNull(), F.format_string("%04d-%02d-%02d %02d:%02d:%02d", *(x.cast("int") for x in parts)))


def first_times(steps: DataFrame, labels: DataFrame, key: str = "path_id", version: str | None = None) -> DataFrame:
    """``key, first_utc``: for every axis with usable units and steps its earliest usable step.

    Repeated and late rows don't matter; axes without a usable step or with unusable units have no row; an empty table gives none.
    """
    axes = decode_utc(axis_extent(steps, key), {"first_num": "first_at"}, zone_offsets(labels), version=version)
    return axes.where(F.col("first_at").isNotNull()).groupBy(key).agg(F.min("first_at").alias("first_at")).select(key, iso_text("first_at").alias("first_utc"))
