"""Overlapping and gapped intervals: continuous covered periods and the gaps between them.

Two levels, for entities of any size. Intervals are clipped into shards of the time line and merged there; then only what touches
a shard's edge is stitched across shards. No task holds more of one entity than the distinct starts within one shard (level 1) or
one row per shard (level 2), however many rows the entity has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_S, _E, _K, _ISLAND = "_start", "_end", "_shard", "_island"


def _islands(df: DataFrame, keys: list[str], start: str, end: str, join: int) -> DataFrame:
    """Merge intervals within each group of ``keys``; ``join`` is the greatest distance that still joins."""
    order = Window.partitionBy(*keys).orderBy(start)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = (before.isNull() | (F.col(start) > before + join)).cast("int")
    marked = df.withColumn("_begins", begins).withColumn(_ISLAND, F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, _ISLAND).agg(F.min(start).alias(start), F.max(end).alias(end)).drop(_ISLAND)


def _local(df: DataFrame, keys: list[str], start: str, end: str, width: int, join: int) -> DataFrame:
    """Level 1: keys, _shard and the merged pieces of every shard."""
    clean = df.select(*keys, F.col(start).cast("long").alias(_S), F.col(end).cast("long").alias(_E)).where((F.col(_S) <= F.col(_E)) & _known(keys))
    # equal starts first, on the map side: this takes out copies, and all rows but one for each start of a hot entity
    clean = clean.groupBy(*keys, _S).agg(F.max(_E).alias(_E))
    low, high = F.floor(F.col(_S) / width), F.floor(F.col(_E) / width)
    pieces = clean.withColumn(_K, F.explode(F.sequence(low, high))).select(
        *keys, _K, F.greatest(_S, F.col(_K) * width).alias(_S), F.least(_E, F.col(_K) * width + width - 1).alias(_E)
    )
    pieces = pieces.groupBy(*keys, _K, _S).agg(F.max(_E).alias(_E))
    return _islands(pieces, [*keys, _K], _S, _E, join)


def _known(keys: list[str]):
    known = F.lit(True)
    for k in keys:
        known &= F.col(k).isNotNull()
    return known


def periods(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: int = 1200, join: int = 1) -> DataFrame:
    """``keys, start, end``: the continuous covered periods of every entity.

    ``start`` and ``end`` are whole numbers, both inclusive; periods at most ``join`` apart become one (1: neighbours touch).
    ``width`` is the length of a shard, in the same unit. Rows with a null key or bound, or that end before they start, cover
    nothing; repeated rows count once; other columns are ignored.
    """
    if join > width:
        raise ValueError("join must not exceed width")
    local = _local(df, keys, start, end, width, join)
    low, high = F.col(_K) * width, F.col(_K) * width + width - 1
    edge = (F.col(_S) - low < join) | (high - F.col(_E) < join)
    per_shard = local.withColumn("_edge", edge)
    inner = per_shard.where(~F.col("_edge")).select(*keys, F.col(_S).alias(start), F.col(_E).alias(end))
    # level 2: at most 2 * join rows of each shard
    outer = _islands(per_shard.where("_edge").select(*keys, _S, _E), keys, _S, _E, join).select(*keys, F.col(_S).alias(start), F.col(_E).alias(end))
    return inner.unionByName(outer)


def gaps(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: int = 1200, join: int = 1) -> DataFrame:
    """``keys, start, end``: every maximal uncovered run between two covered periods of an entity; arguments as in :func:`periods`.

    Gaps inside a shard come from level 1; those over shard edges from one row per shard, its first and last covered value.
    """
    local = _local(df, keys, start, end, width, join)
    within = Window.partitionBy(*keys, _K).orderBy(_S)
    inside = local.withColumn("_next", F.lead(_S).over(within))
    shards = inside.groupBy(*keys, _K).agg(F.min(_S).alias(_S), F.max(_E).alias(_E))
    across = shards.withColumn("_next", F.lead(_S).over(Window.partitionBy(*keys).orderBy(_K)))
    found = inside.select(*keys, _E, "_next").unionByName(across.select(*keys, _E, "_next"))
    return found.where(F.col("_next") > F.col(_E) + join).select(*keys, (F.col(_E) + 1).alias(start), (F.col("_next") - 1).alias(end))
