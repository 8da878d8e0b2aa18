"""Groups of tables: the dataset tree, its dimensions and variables, and what is copied from one to another."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import cftime
from weftline.model import FREQUENCY_STEP


@dataclass
class Dataset:
    """Tables by group path, ``/`` for the root; attributes by group path."""

    tables: dict[str, DataFrame]
    attributes: dict[str, dict[str, str]] = field(default_factory=dict)

    def map(self, transform: Callable[[DataFrame], DataFrame] | None = None, slices: Column | Callable[[DataFrame], Column] | None = None, check_empty: list[str] | None = None) -> Dataset:
        """A copy of the whole tree: each table cut by ``slices`` (a predicate, or a function of the table that gives one), then
        transformed. ``check_empty``: values; a table in which all of them are missing everywhere is left out on read."""

        def one(df: DataFrame) -> DataFrame:
            cut = df if slices is None else df.where(slices(df) if callable(slices) else slices)
            done = cut if transform is None else cut.transform(transform)
            return not_all_missing(done, check_empty) if check_empty else done

        return Dataset({path: one(df) for path, df in self.tables.items()}, {k: dict(v) for k, v in self.attributes.items()})

    def group(self, path: str) -> Dataset:
        """The tree below a group."""
        root = path.rstrip("/")
        below = lambda d: {k[len(root) :] or "/": v for k, v in d.items() if k == root or k.startswith(root + "/")}
        return Dataset(below(self.tables), below(self.attributes))

    def merge_attributes(self, other: Dataset, skip: str = "") -> Dataset:
        """Attributes of both; this one's win. ``skip``: the name of a temporary attribute that is left out."""
        merged = {g: {k: v for k, v in other.attributes.get(g, {}).items() if k != skip} | self.attributes.get(g, {}) for g in {*self.attributes, *other.attributes}}
        return Dataset(self.tables, merged)

    def save(self, folder: str) -> None:
        for path, df in self.tables.items():
            df.write.mode("errorifexists").parquet(f"{folder}/{path.strip('/') or '_root'}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, groups: list[str]) -> Dataset:
        return cls({g: spark.read.parquet(f"{folder}/{g.strip('/') or '_root'}") for g in groups})


def not_all_missing(df: DataFrame, values: list[str]) -> DataFrame:
    """The table, or nothing of it if all its values are missing: a whole block is written or skipped. The flag is a scalar."""
    empty = reduce(lambda a, b: a & b, (F.col(v).isNull() for v in values))
    return df.join(F.broadcast(df.agg(F.coalesce(F.bool_and(empty), F.lit(True)).alias("_empty"))).where("not _empty")).drop("_empty")


def find_time(names: list[str], time: str = "time") -> str | None:
    """The first name that is the time's in any case."""
    return next((n for n in names if n.lower() == time.lower()), None)


def variables(dimensions: dict[str, list[str]], with_time: bool | None = None, time: str = "time") -> list[str]:
    """Names of variables, of all or of those with (without) the time dimension; dimensions' own variables are left out."""
    has = {v: find_time(d, time) is not None for v, d in dimensions.items() if v not in {x for ds in dimensions.values() for x in ds}}
    return [v for v, t in has.items() if with_time is None or t == with_time]


def fixed_or_time(frequency: str) -> str:
    return "fixed" if frequency in ("fx", "clim") else "time"


def coordinates(spark: SparkSession, dims: dict[str, int], known: dict[str, list[float]] | None = None) -> DataFrame:
    """``dim, idx, value``: a row for each place of each dimension; one without coordinates counts from 0."""
    parts = []
    for d, n in dims.items():
        values = (known or {}).get(d)
        idx = spark.range(n).select(F.lit(d).alias("dim"), F.col("id").alias("idx"))
        value = F.col("idx").cast("double") if values is None else F.element_at(F.array(*map(F.lit, map(float, values))), (F.col("idx") + 1).cast("int"))
        parts.append(idx.withColumn("value", value))
    return reduce(DataFrame.unionByName, parts)


def time_axis(df: DataFrame, time: str, units: str, calendar: str = "standard", name: str = "time_num") -> DataFrame:
    """A timestamp column as a numeric axis in ``units``."""
    return df.withColumn(name, cftime.encode(cftime.fields_of_timestamp(F.col(time)), units, calendar))


def read_or_default(value: Column, queryable: Column, default) -> Column:
    """Metadata of a file, or the default where its type can't be asked."""
    return F.when(queryable, value).otherwise(F.lit(default))


def dates_by_pattern(name: Column, pattern: str) -> tuple[Column, Column]:
    """Date structs of the last two groups of a file-name pattern."""
    import re

    groups = re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", pattern)).groups
    if groups < 2:
        raise ValueError("the pattern needs two date groups")
    return tuple(cftime.fields_of_digits(F.regexp_extract(name, pattern, g)) for g in (groups - 1, groups))


def axis_from_name(begin: Column, until: Column, frequency: str, units: str, calendar: str, instant: bool) -> Column:
    """Array of the numeric axis that a file's name stands for, when the file itself can't be asked: from its first date until a step
    reaches its last one. The number of steps is computed, not searched."""
    from weftline.operators.audit import _in_frequency_units

    own, step = _in_frequency_units(units, frequency), FREQUENCY_STEP[frequency]
    first, last = (cftime.encode(cftime.fields_of_digits(x), own, calendar) for x in (begin, until))
    count = lambda v: (F.ceil((v["l"] - v["f"]) / step) + 1).cast("int")
    numbers = cftime.let(F.struct(first.alias("f"), last.alias("l")), lambda v: cftime.axis_numbers(count(v), frequency, v["f"], instant))
    return F.transform(numbers, lambda t: cftime.rebase(t, own, units, calendar))


def largest_hyperslab(slices: Column) -> Column:
    """Elements of the largest request: ``slices``, for each dimension an array of struct<start, stop, step>; the product of the
    longest of each."""
    length = lambda s: F.greatest(F.lit(0), F.ceil((s["stop"] - s["start"]) / s["step"]))
    return F.aggregate(F.transform(slices, lambda d: F.array_max(F.transform(d, length))), F.lit(1).cast("long"), lambda a, n: a * n)


def by_host(work: DataFrame, tasks: int, host: str = "data_node", order: str = "path") -> DataFrame:
    """Work spread over at most ``tasks`` tasks a run, each host's in one of them: no host is asked by two tasks at once."""
    return work.repartition(tasks, host).sortWithinPartitions(host, order)
