"""Column expressions on replica paths: packed fields, data node, file name, series and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import once

#: A period ends a file name: one or two dates of 4 to 14 digits, and a mark for climatologies.
PERIOD = r"_([0-9]{4,14})(?:[-_]([0-9]{4,14}))?(?:[-_]clim)?$"


def packed_part(path: Column, i: int) -> Column:
    """Part ``i`` of ``path|checksum_type|checksum|tracking_id``; null if there is none."""
    return F.get(F.split(path, r"\|"), F.lit(i))


def unpacked(path: Column, i: int, column: Column) -> Column:
    """The field of a packed path, else the column of its own."""
    return F.when(path.contains("|"), packed_part(path, i)).otherwise(column)


def stem(path: Column) -> Column:
    """File name of a path without its suffixes, with ``%5F`` written as ``_``; null for a null path."""
    plain = F.regexp_replace(F.trim(packed_part(path, 0)), r"[?#].*$", "")
    last = F.substring_index(F.regexp_replace(plain, r"/+$", ""), "/", -1)
    return F.regexp_replace(F.regexp_replace(last, "(?i)%5f", "_"), r"(?i)\.nc[0-9]?(?:\.[a-z0-9]+)*\s*$", "")


def series(file_name: Column) -> Column:
    return F.regexp_replace(file_name, PERIOD, "")


def _month(text: Column, without: int) -> Column:
    """Months since year 0 of a date's digits; a date without a month counts as month ``without``. Null if there is no such month."""
    month = F.when(F.length(text) >= 6, F.substring(text, 5, 2).cast("int")).otherwise(without)
    return F.when((F.length(text) >= 4) & month.between(1, 12), F.substring(text, 1, 4).cast("int") * 12 + month - 1)


def with_period(files: DataFrame, file_name: str = "name") -> DataFrame:
    """Add ``series``, ``dated``, and the first and last month of the file name's period, ``start`` and ``end``, in months since year 0.

    In steps, so that each pattern is matched once for a row.
    """
    name = F.col(file_name)
    dates = F.struct(F.regexp_extract(name, PERIOD, 1).alias("begin"), F.regexp_extract(name, PERIOD, 2).alias("until"))
    out = once(files.withColumn("series", series(name)), _dates=dates)
    out = out.withColumns({"dated": F.col("_dates.begin") != "", "_end": F.when(F.col("_dates.until") == "", F.col("_dates.begin")).otherwise(F.col("_dates.until"))})
    return out.withColumns({"start": _month(F.col("_dates.begin"), 1), "end": _month(F.col("_end"), 12)}).drop("_dates", "_end")


def month_text(month: Column) -> Column:
    """``YYYYMM`` of months since year 0."""
    return F.format_string("%04d%02d", F.floor(month / 12).cast("int"), F.pmod(month, F.lit(12)).cast("int") + 1)


def node_key(node: Column) -> Column:
    """One spelling of a data node: lower case, no default port, no closing slash; null for null and blank."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.trim(node)), r"/+$", ""), r"^([a-z]+://[^/]*?):(?:80|443|21|2811)$", "$1")
    return F.when(clean != "", clean)


def type_key(kind: Column) -> Column:
    """One spelling of a file type; null for null and blank."""
    return F.nullif(F.lower(F.trim(kind)), F.lit(""))


def data_node(path: Column, file_type: Column) -> Column:
    """Data node by file type: remote types keep scheme and host, local files host and first folder, containers their constant."""
    parts = F.split(path, "/")
    first = lambda n: F.array_join(F.slice(parts, 1, n), "/")
    return (
        F.when(file_type.isin("HTTPServer", "OPENDAP", "FTPServer", "GridFTP"), first(3))
        .when(file_type == "local_file", first(2))
        .when(file_type == "soft_links_container", F.lit("soft_links_container"))
        .otherwise(F.lit(""))
    )


def version_day(version: Column, recorded_at: Column) -> Column:
    """The day a version names, as a date: ``v`` and eight digits, in any spelling; null if it isn't a real day or is after ``recorded_at``'s."""
    text = F.regexp_extract(F.trim(version), r"^[vV]?\s*([0-9]{4})[-./]?([0-9]{2})[-./]?([0-9]{2})$", 0)
    digits = F.regexp_replace(text, "[^0-9]", "")
    day = F.when(F.length(digits) == 8, F.try_to_timestamp(F.concat(digits, F.lit("000000")), F.lit("yyyyMMddHHmmss")).cast("date"))
    return F.when(day <= recorded_at.cast("date"), day)


def usable_checksum(checksum: Column) -> Column:
    """Lower-case checksum of 32 or 64 hexadecimal digits that are not all the same, else null."""
    clean = F.lower(F.trim(checksum))
    return F.when(clean.rlike(r"^(?:[0-9a-f]{32}|[0-9a-f]{64})$") & ~clean.rlike(r"^(.)\1*$"), clean)
