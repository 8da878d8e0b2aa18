"""Functions run on files: with trials, by file type, and whether a file can be opened at all."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.model import CONTAINER

#: Types that are taken for available without a look.
UNPROBED = ("FTPServer", CONTAINER)


class HandlingError(RuntimeError):
    """A file that could not be handled in any trial."""


def tried(function: Callable[[str], object], path: str, trials: int, backoff: float) -> tuple[object, int, str | None]:
    """(result, trials used, last error or None): after each failure but the last it waits ``backoff`` times the number of trials so far."""
    error = None
    for trial in range(1, trials + 1):
        try:
            return function(path), trial, None
        except Exception as e:  # whatever a reader raises counts as a failed trial
            error = f"{type(e).__name__}: {e}"
            if trial < trials:
                time.sleep(backoff * trial)
    return None, trials, error


def handle(files: DataFrame, function: Callable[[str], pd.DataFrame], schema: str, path: str = "path", trials: int = 4, backoff: float = 3.0, mode: str = "requeue") -> DataFrame:
    """Run ``function`` on every path; its rows (columns of ``schema``), after ``path, trials, error``.

    ``mode``: ``requeue``: a file that fails in all trials is one row of nulls with its last error; ``raise``: it fails the job;
    ``failfast``: it fails at the first error, without another trial. Null paths are left out; repeated paths are handled as often
    as they come; a function may give no rows. Each file is one call in one task.
    """
    if mode not in ("requeue", "raise", "failfast"):
        raise ValueError(f"unknown mode {mode!r}")
    tries = 1 if mode == "failfast" else trials
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch["path"]:
                rows, used, error = tried(function, p, tries, backoff)
                if error and mode != "requeue":
                    raise HandlingError(f"{p}: {error}")
                out = pd.DataFrame({n: [None] for n in names}) if error else rows[names].copy()
                out.insert(0, "path", p)
                out.insert(1, "trials", used)
                out.insert(2, "error", error)
                yield out

    return files.where(F.col(path).isNotNull()).select(F.col(path).alias("path")).mapInPandas(run, f"path string, trials int, error string, {schema}")


def probe(catalog: DataFrame, opens: Callable[[str], object], path: str = "path", file_type: str = "file_type", trials: int = 5, backoff: float = 3.0) -> DataFrame:
    """Add ``available``: whether ``opens`` succeeds on the path within the trials; files of :data:`UNPROBED` types are, null paths aren't."""

    @F.pandas_udf("boolean")
    def check(paths: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([p is not None and (k in UNPROBED or tried(opens, p, trials, backoff)[2] is None) for p, k in zip(paths, kinds)], dtype=bool)

    return catalog.withColumn("available", check(F.col(path), F.col(file_type)))


def dispatch(catalog: DataFrame, handlers: dict[str, Callable[[str], pd.DataFrame]], schema: str, file_type: str = "file_type", **options) -> DataFrame:
    """:func:`handle` by file type: each type's files go to its handler; types without one are left out."""
    parts = [handle(catalog.where(F.col(file_type) == kind), function, schema, **options) for kind, function in handlers.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
