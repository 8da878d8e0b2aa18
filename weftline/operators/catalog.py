"""Replica catalogs: ranking, best replica, equivalents, fail-over, unification of units and calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import paths
from weftline.operators.ranking import positions


def unpack(paths_df: DataFrame) -> DataFrame:
    """Packed ``path|checksum_type|checksum|tracking_id`` into columns; unpacked rows keep theirs."""
    p = F.col("path")
    columns = {c: paths.unpacked(p, i, F.col(c)) for i, c in enumerate(("checksum_type", "checksum", "tracking_id"), 1)}
    return paths_df.withColumns(columns | {"path": paths.packed_part(p, 0)})


def version_number(version: Column) -> Column:
    """The number after the first character; null if there is none."""
    return F.substring(version, 2, 20).try_cast("bigint")


def list_position(value: Column, preferred: list[str], strict: bool = True) -> Column:
    """Position in a preference list, best first; a value that isn't listed raises, or is null if not ``strict``."""
    at = F.array_position(F.array(*map(F.lit, preferred)), value)
    found = F.when(at > 0, at.cast("int"))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("not in the preference list: "), value)).cast("int")) if strict else found


def rank(catalog: DataFrame, keys: list[str], order: list[Column], name: str = "pref_rank", bucket: Column | None = None) -> DataFrame:
    """Add the preference rank within ``keys``, 1 for the best: newest version, then file type, then data node, then path.

    ``bucket``: a whole number, not null, that doesn't decrease in the order (of versions, their negative): with it, ranks are found in two
    levels, so that no task holds more of a key than one bucket.
    """
    if bucket is not None:
        return positions(catalog, order, bucket, keys, name).withColumn(name, (F.col(name) + 1).cast("int"))
    return catalog.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def preference(types: list[str], nodes: list[str], strict: bool = True) -> list[Column]:
    """The order of replicas by constant preference lists; ties by path."""
    return [F.col("version").desc(), list_position(F.col("file_type"), types, strict), list_position(F.col("data_node"), nodes, strict), F.col("path")]


def latest(catalog: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """Rows of the newest version of each key: an aggregate joined back, so that a hot key isn't sorted."""
    newest = catalog.groupBy(*keys).agg(F.max(version).alias(version))
    return catalog.join(newest, [*keys, version], "left_semi")


def majority_rank(catalog: DataFrame, kind: str, name: str = "dimension_type_id") -> DataFrame:
    """Add the rank of a dimension type by its number of files, 1 for the most common; ties by name."""
    counts = catalog.groupBy(kind).agg(F.count("*").alias("_n"))
    ranked = counts.withColumn(name, F.row_number().over(Window.orderBy(F.desc("_n"), kind))).drop("_n")  # a row per type
    return catalog.join(ranked, kind)


def best_per_time(file_times: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The best file's row for each time: first by ``order``, which must be total."""
    return file_times.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def useful(file_times: DataFrame, keys: list[str], file: str, rank_column: str) -> DataFrame:
    """Files that are best for at least one time."""
    return file_times.groupBy(*keys).agg(F.min_by(file, F.struct(rank_column, file)).alias(file)).select(file).distinct()


def usable_checksum(checksum: Column, strict: bool) -> Column:
    """Checksums that may identify a replica: any but null or, if strict, only real ones, no blanks, cut ones or placeholders."""
    return paths.usable_checksum(checksum).isNotNull() if strict else checksum.isNotNull()


def equivalents(catalog: DataFrame, used: DataFrame, path: str = "path", checksum: str = "checksum", strict: bool = True) -> DataFrame:
    """Catalog rows that are used or have the file name and the checksum of a used file. ``used``: paths."""
    named = catalog.withColumn("_name", F.element_at(F.split(path, "/"), -1))
    is_used = named.join(used.select(path).distinct(), path, "left_semi")
    marks = is_used.where(usable_checksum(F.col(checksum), strict)).select("_name", checksum).distinct()
    others = named.join(used.select(path).distinct(), path, "left_anti").join(marks, ["_name", checksum], "left_semi")
    return is_used.unionByName(others).drop("_name")


def fail_over(catalog: DataFrame, acceptable: list[str], allowed: Column, key: str, order: list[str], checksum: str = "checksum", strict: bool = True) -> DataFrame:
    """``key, served_by``: each row's own file if it is of an acceptable type, on an allowed node and available, else the first replica
    with the same checksum, by ``order``, that is; null if there is none. ``catalog`` has ``available``.

    One aggregate by checksum gives the best replica of all its copies, so that no pair of copies is formed: the best acceptable
    replica differs from the row itself wherever the row isn't acceptable. Rows that serve themselves, and those whose checksum
    identifies nothing, however many, are not joined.
    """
    fit = F.col("file_type").isin(*acceptable) & allowed & F.coalesce(F.col("available"), F.lit(False))
    marked = catalog.withColumn("_fit", F.coalesce(fit, F.lit(False)))
    best = marked.where(F.col("_fit") & usable_checksum(F.col(checksum), strict)).groupBy(checksum).agg(F.min(F.struct(*order, F.col(key).alias("_served"))).alias("_best"))
    needs = ~F.col("_fit") & usable_checksum(F.col(checksum), strict)
    served = marked.where(needs).join(best, checksum, "left").select(key, F.col("_best._served").alias("served_by"))
    return marked.where(~needs).select(key, F.when(F.col("_fit"), F.col(key)).alias("served_by")).unionByName(served)


def better_type(catalog: DataFrame, allowed: Column, key: str, checksum: str = "checksum") -> DataFrame:
    """``key, better_type``: the best type, local before embedded before OPeNDAP, of the row's replicas of the same checksum on allowed
    nodes that are available; null if there is none. The row itself counts. ``catalog`` has ``available``; one aggregate by checksum."""
    fit = F.col("file_type").isin("local_file", "soft_links_container", "OPENDAP") & allowed & F.coalesce(F.col("available"), F.lit(False)) & usable_checksum(F.col(checksum), True)
    place = list_position(F.col("file_type"), ["local_file", "soft_links_container", "OPENDAP"], strict=False)
    best = catalog.where(fit).groupBy(checksum).agg(F.min_by("file_type", place).alias("better_type"))
    usable = F.coalesce(usable_checksum(F.col(checksum), True), F.lit(False))
    found = catalog.where(usable).select(key, checksum).join(best, checksum, "left").select(key, "better_type")
    return found.unionByName(catalog.where(~usable).select(key, F.lit(None).cast("string").alias("better_type")))


def unify_units(units: DataFrame, keys: list[str], column: str = "units") -> DataFrame:
    """``keys, units``: the one unit of a group; of several, that with the lexically smallest text after ``since``; null if none."""
    text = F.trim(F.regexp_extract(column, r"since(.*)$", 1))
    return units.groupBy(*keys).agg(F.min_by(F.col(column), F.struct(text, F.col(column))).alias("units"))


def unify_calendar(axes: DataFrame, keys: list[str], order: list[str], column: str = "calendar") -> DataFrame:
    """``keys, calendar``: the calendar of the first file in preference order. ``calendars``: how many there are."""
    return axes.groupBy(*keys).agg(F.min_by(F.col(column), F.struct(*order, F.col(column))).alias("calendar"), F.count_distinct(column).cast("long").alias("calendars"))


def download_status(exists: Column, expected: Column, actual: Column) -> Column:
    """What a download does: ``skip`` (there, and the checksum holds), ``verify``-ed, ``delete`` on a mismatch, ``download``."""
    known = expected.isNotNull() & (expected != "")
    return F.when(~exists, F.lit("download")).when(~known, F.lit("skip")).when(F.lower(expected) == F.lower(actual), F.lit("skip")).otherwise(F.lit("delete"))


def destination(folder: str, tree: Column, var: Column, version: Column, path: Column) -> Column:
    """Where a downloaded file goes: ``{tree}``, ``{var}`` and ``{version}`` of the folder's template, then the file's name."""
    out = F.lit(folder)
    for name, value in (("{tree}", tree), ("{var}", var), ("{version}", version)):
        out = F.replace(out, F.lit(name), value)
    return F.concat_ws("/", out, F.element_at(F.split(path, "/"), -1))


def variables_by_size(shapes: DataFrame, name: str = "var", shape: str = "shape") -> DataFrame:
    """``var, elements``, largest first: the product of the non-zero entries of a shape."""
    size = F.aggregate(F.filter(shape, lambda x: x != 0), F.lit(1).cast("long"), lambda a, x: a * x)
    return shapes.select(name, size.alias("elements")).orderBy(F.desc("elements"), name)
