"""Time selection and other predicates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ranking import positions


def year_ranges(time: str, years: Iterable[int], months: Iterable[int] | None = None) -> Column:
    """Ranges of a timestamp column that absolute years (and months) span: unlike year(time) they reach the scan.

    Neighbouring years and months become one range.
    """
    wanted = sorted({(y, m) for y in years for m in (months or range(1, 13))})
    index = [y * 12 + m - 1 for y, m in wanted]
    condition, start = F.lit(False), None
    for i, k in enumerate(index):
        start = k if start is None else start
        if i + 1 == len(index) or index[i + 1] != k + 1:
            low, high = (F.lit(f"{x // 12:04d}-{x % 12 + 1:02d}-01 00:00:00").cast("timestamp_ntz") for x in (start, k + 1))
            condition = condition | ((F.col(time) >= low) & (F.col(time) < high))
            start = None
    return condition


def time_mask(time: str, years=None, months=None, days=None, hours=None) -> Column:
    """Conjunction of year, month, day-of-month and hour lists; None or empty means all."""
    t, mask = F.col(time), F.lit(True)
    if years:
        mask = mask & year_ranges(time, years, months)
    elif months:
        mask = mask & F.month(t).isin(*months)
    if days:
        mask = mask & F.dayofmonth(t).isin(*days)
    if hours:
        mask = mask & F.hour(t).isin(*hours)
    return mask


def relative_years(df: DataFrame, time: str, years: list[int], min_year: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Rows whose year, counted from the axis' first year on as ``min_year``, is in ``years``.

    With ``min_year`` None the first year counts as 0, as in link creation, where ``years`` below 10 are relative. The first year is an
    aggregate that is joined back (broadcast: one row for each key), not a window over the axis.
    """
    first = df.groupBy(*(keys or [])).agg(F.min(F.year(time)).alias("_first"))
    joined = df.join(F.broadcast(first)) if not keys else df.join(first, keys)
    return joined.where((F.year(time) - F.col("_first") + (min_year or 0)).isin(*years)).drop("_first")


def created_years(df: DataFrame, time: str, years: list[int], months: list[int] | None = None) -> DataFrame:
    """Year and month filter of link creation: years are relative to the first year if the first of the list is below 10."""
    out = relative_years(df, time, years) if years and years[0] < 10 else df.where(time_mask(time, years, months))
    return out.where(time_mask(time, months=months))


def previous_next(axis: DataFrame, time: str, mask: Column, previous: int = 0, following: int = 0, keys: list[str] | None = None) -> DataFrame:
    """The axis' distinct steps that ``mask`` keeps, and ``previous`` steps before and ``following`` after each of them.

    Steps are numbered over the sorted axis in two levels (by year), the numbers of kept steps are spread to their neighbours and
    joined back, so that an axis of any length needs no window over all of it.
    """
    keys = keys or []
    steps = axis.select(*keys, time, mask.alias("_kept")).groupBy(*keys, time).agg(F.max("_kept").alias("_kept"))
    steps = steps.where(F.col(time).isNotNull())
    if not previous and not following:
        return steps.where("_kept").drop("_kept")
    placed = positions(steps, [time], F.year(time).cast("long"), keys, "_pos")
    near = placed.where("_kept").select(*keys, F.explode(F.sequence(F.col("_pos") - previous, F.col("_pos") + following)).alias("_pos")).distinct()
    return placed.join(near, [*keys, "_pos"], "left_semi").drop("_pos", "_kept")


def previous_next_window(axis: DataFrame, time: str, mask: Column, previous: int, following: int, keys: list[str]) -> DataFrame:
    """As :func:`previous_next`, by one bounded frame for each key: cheaper where every key's axis is short."""
    frame = Window.partitionBy(*keys).orderBy(time).rowsBetween(-following, previous)
    steps = axis.select(*keys, time, mask.cast("int").alias("_kept")).groupBy(*keys, time).agg(F.max("_kept").alias("_kept"))
    return steps.withColumn("_near", F.max("_kept").over(frame)).where("_near = 1").drop("_kept", "_near")


def explicit_mask(axis: DataFrame, mask: DataFrame, position: str = "pos", keep: str = "keep") -> DataFrame:
    """Steps that an explicit mask (``pos, keep``) keeps, if it is as long as the axis; a mask of another length is ignored."""
    sizes = axis.agg(F.count("*").alias("_axis")).join(mask.agg(F.count("*").alias("_mask")))
    joined = axis.join(mask.select(position, F.col(keep).alias("_keep")), position, "left").join(F.broadcast(sizes))
    return joined.where((F.col("_axis") != F.col("_mask")) | F.col("_keep")).drop("_keep", "_axis", "_mask")


def included(level: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """In the include list (empty or None: all) and not in the exclude list."""
    return (level.isin(*include) if include else F.lit(True)) & (~level.isin(*exclude) if exclude else F.lit(True))


def finite_or_null(value: Column) -> Column:
    """NaN and infinities as missing."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def retrieval_gate(links: DataFrame, kind: str, download_all: bool = False) -> DataFrame:
    """Files that a retrieval type takes: ``links`` has ``file_type`` and, of the best other replica available, ``better_type``.

    ``download_files``: FTP, HTTP and GridFTP, skipped where OPeNDAP or local data exist; ``download_opendap``: OPeNDAP, skipped where
    local or embedded data exist; ``load``: local and embedded. ``download_all`` skips nothing.
    """
    local, here = ("local_file", "soft_links_container"), F.col("file_type")
    better = F.coalesce(F.col("better_type"), F.lit(""))
    if kind == "download_files":
        return links.where(here.isin("FTPServer", "HTTPServer", "GridFTP") & (F.lit(download_all) | ~better.isin("OPENDAP", *local)))
    if kind == "download_opendap":
        return links.where((here == "OPENDAP") & (F.lit(download_all) | ~better.isin(*local)))
    if kind in ("load", "assign"):
        return links.where(here.isin(*local, *(["OPENDAP"] if kind == "assign" else [])))
    raise ValueError(f"unknown retrieval type {kind!r}")
