"""Directory scans and checksums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, folder: str, pattern: str | None = None, glob: str = "*") -> DataFrame:
    """``path, name, length, modified``: files below a folder whose name matches ``pattern``, by path; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    named = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))
    return (named.where(F.col("name").rlike(pattern)) if pattern else named).orderBy("path")


#: Bytes of a block that is hashed at once.
BLOCK = 1 << 20


def checksums(spark: SparkSession, folder: str, kind: str = "MD5", glob: str = "*") -> DataFrame:
    """``path, checksum`` of the files below a folder, of any length: each is read in its task, a block at a time."""
    name = _hash_name(kind)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums = []
            for path in batch["path"]:
                fs, place = pyarrow.fs.FileSystem.from_uri(path)
                h = hashlib.new(name)
                with fs.open_input_stream(place) as f:
                    while block := f.read(BLOCK):
                        h.update(block)
                sums.append(h.hexdigest())
            yield pd.DataFrame({"path": batch["path"], "checksum": sums})

    return scan(spark, folder, glob=glob).select("path").mapInPandas(run, "path string, checksum string")


def _hash_name(kind: str) -> str:
    name = kind.upper().replace("-", "")
    if name not in ("MD5", "SHA1", "SHA224", "SHA256", "SHA384", "SHA512"):
        raise ValueError(f"unknown checksum {kind!r}")
    return name


def digest(content, kind: str):
    """Checksum of bytes or text: MD5, SHA1 or SHA224 to SHA512."""
    name = _hash_name(kind)
    if name == "MD5":
        return F.md5(content)
    if name == "SHA1":
        return F.sha1(content)
    return F.sha2(content, int(name[3:]))
