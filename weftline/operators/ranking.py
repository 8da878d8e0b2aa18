"""Positions and running totals in a global order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[str | Column], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows before, by ``bucket`` and then ``order``, within ``keys``.

    In two levels: no window holds more than the rows of one bucket, or one row for each bucket. ``bucket`` must not decrease in the
    order; it decides only how the work is spread.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys or [F.lit(0)]).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    within = F.sum(value).over(Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.join(before, [*keys, bucket]).withColumn(name, (F.col("_before") + F.coalesce(within, F.lit(0))).cast("long")).drop("_before")


def positions(df: DataFrame, order: list[str | Column], bucket: Column, keys: list[str] | None = None, name: str = "pos") -> DataFrame:
    """Add ``name``: 0-based position in the order ``order`` (total) within ``keys``. ``bucket``: a whole number that grows with the order."""
    with_bucket = df.withColumns({"_bucket": bucket, "_one": F.lit(1)})
    return running_total(with_bucket, keys or [], "_bucket", order, "_one", name).drop("_bucket", "_one")
