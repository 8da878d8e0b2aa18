"""Merges on coordinates: append with overwrite, catalogs, attributes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import cftime


def append(base: DataFrame, new: DataFrame, on: list[str], values: list[str], pos: str = "pos", check_empty: bool = False, granularity: str = "block", skip: tuple[str, ...] = ()) -> DataFrame:
    """``on, pos, values``: coordinates of ``new`` that ``base`` has are overwritten in place, others come at the end, in their order.

    ``pos``: 0-based order, in both tables. ``check_empty``: a block that is missing everywhere overwrites nothing; a partly missing one
    does, with its missing cells. ``granularity`` ``row`` looks at each row instead. ``skip``: values of ``new`` that aren't
    compatible and are passed over.
    """
    fresh = new.select(*on, F.col(pos).alias("_new_pos"), *(F.col(v).alias(f"_{v}") for v in values), F.lit(True).alias("_there"))
    joined = base.join(fresh, on, "full")
    taken = F.col("_there").isNotNull()
    empty = reduce(lambda a, b: a & b, (F.col(f"_{v}").isNull() for v in values))
    if check_empty and granularity == "row":
        taken = taken & ~empty
    elif check_empty:
        block = new.agg(F.coalesce(F.bool_and(reduce(lambda a, b: a & b, (F.col(v).isNull() for v in values))), F.lit(False)).alias("_block_empty"))
        joined = joined.join(F.broadcast(block))
        taken = taken & ~F.col("_block_empty")
    last = base.agg((F.coalesce(F.max(pos), F.lit(-1)) + 1).alias("_size"))
    # places at the end: by the rank of the new coordinates among the new ones only
    added = new.join(base.select(*on), on, "left_anti")
    from weftline.operators.ranking import positions

    ranks = positions(added.select(*on, F.col(pos).alias("_p")), ["_p"], F.floor(F.col("_p") / 1_000_000), name="_rank").drop("_p")
    joined = joined.join(ranks, on, "left").join(F.broadcast(last))
    place = F.when(F.col(pos).isNotNull(), F.col(pos)).otherwise(F.col("_size") + F.col("_rank")).cast("long")
    value = lambda v: F.col(v) if v in skip else F.when(taken, F.col(f"_{v}")).otherwise(F.col(v))
    return joined.select(*on, place.alias(pos), *(value(v).alias(v) for v in values))


def append_times(base: DataFrame, new: DataFrame, time: str, values: list[str], units: str, new_units: str, calendar: str | None = "standard", **options) -> DataFrame:
    """:func:`append` on a time axis: the times of ``new`` are converted from their own units into the base's before they are matched."""
    converted = new.withColumn(time, cftime.rebase(F.col(time), new_units, units, calendar).cast(base.schema[time].dataType))
    return append(base, converted, [time], values, **options)


def concatenate(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables; columns that one of them lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def common(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column that both tables have; nulls are none."""
    one = lambda df: df.where(F.col(column).isNotNull()).select(column)
    return one(a).intersect(one(b))


def append_catalog(base: DataFrame, new: DataFrame, on: str = "path") -> DataFrame:
    """Union of two catalogs by path: rows of ``new`` replace those of ``base``."""
    return base.join(new.select(on), on, "left_anti").unionByName(new, allowMissingColumns=True)


def attributes_union(base: DataFrame, new: DataFrame, on: list[str], attributes: str = "attributes", skip: str = "") -> DataFrame:
    """Attribute maps of both tables; the base's value wins; ``skip`` names a temporary attribute that is left out."""
    n = new.select(*on, F.col(attributes).alias("_new"))
    joined = base.join(n, on, "full")
    none = F.create_map().cast("map<string,string>")
    mine, theirs = F.coalesce(attributes, none), F.map_filter(F.coalesce("_new", none), lambda k, v: k != skip)
    fresh = F.map_filter(theirs, lambda k, v: ~F.map_contains_key(mine, k))
    return joined.select(*on, F.map_concat(mine, fresh).alias(attributes))


def variable_attributes(attributes: Column) -> Column:
    """Attributes of a variable that are copied: those whose name doesn't begin with ``_``."""
    return F.map_filter(attributes, lambda k, v: ~k.startswith("_"))


def flatten_attributes(nested: Column) -> Column:
    """``map<string, map<string, string>>`` as ``map<string, string>`` with dotted names."""
    entries = F.transform(F.map_entries(nested), lambda e: F.transform(F.map_entries(e["value"]), lambda f: F.struct(F.concat_ws(".", e["key"], f["key"]).alias("key"), f["value"].alias("value"))))
    return F.map_from_entries(F.flatten(entries))


def incompatible_dimensions(source: DataFrame, destination: DataFrame, keys: list[str], idx: str = "idx", value: str = "value") -> DataFrame:
    """``keys``: dimensions whose length or coordinates differ between source and destination (a missing one differs)."""
    both = source.select(*keys, idx, F.col(value).alias("_a"), F.lit(1).alias("_l")).join(destination.select(*keys, idx, F.col(value).alias("_b"), F.lit(1).alias("_r")), [*keys, idx], "full")
    return both.where(F.col("_l").isNull() | F.col("_r").isNull() | ~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys).distinct()


def dimension_type(dimensions: Column) -> Column:
    """Fingerprint of an ordered array of struct<name, length>: its JSON without time."""
    return F.to_json(F.filter(dimensions, lambda d: F.lower(d["name"]) != "time"))
