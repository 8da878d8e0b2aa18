"""Soft links: which file and which place in it serves each time step; building, retrieving, embedding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.model import CONTAINER
from weftline.operators import catalog as cat
from weftline.session import small_rows


def build_links(file_times: DataFrame, catalog: DataFrame, keys: list[str], time: str, on: str, order: list[str], idx: str = "idx") -> DataFrame:
    """``keys, time, on, idx``: for every distinct time the best file by ``order`` and the first place in it.

    ``catalog`` has the columns of ``order``. A time without a file raises when the result is read.
    """
    joined = file_times.join(catalog.select(on, *[c for c in order if c not in file_times.columns]), on, "left")
    best = cat.best_per_time(joined, [*keys, time], [*order, idx])
    return best.withColumn(on, F.when(F.col(on).isNotNull(), F.col(on)).otherwise(F.raise_error(F.lit("a time step has no file")))).select(*keys, time, on, idx)


def retrieve(links: DataFrame, kept: DataFrame, values: DataFrame, keys: list[str], time: str, on: list[str]) -> DataFrame:
    """Values of the links' kept times, each from the linked file and place; order by time is the caller's."""
    return links.join(kept.select(*keys, time), [*keys, time], "left_semi").join(values, on)


def reject_unlinked(links: DataFrame, columns: list[str]) -> DataFrame:
    """The links, raising on read if a link is null."""
    checks = {c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"null link: {c}"))) for c in columns}
    return links.withColumns(checks)


def add_path(catalog: DataFrame, new: DataFrame, links: DataFrame, moved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add paths that the catalog doesn't have, and re-point links to them.

    ``new``: catalog rows; ``moved``: ``old_id, path``. Returns (catalog, links); a path that exists keeps its id, which links then use.
    """
    added = catalog.unionByName(new.join(catalog.select("path"), "path", "left_anti"), allowMissingColumns=True)
    ids = moved.join(added.select("path", F.col("path_id").alias("_new")), "path").select(F.col("old_id").alias("path_id"), "_new")
    pointed = links.join(ids, "path_id", "left").withColumn("path_id", F.coalesce("_new", "path_id")).drop("_new")
    return added, pointed.select(*links.columns)


def container_path(path: Column) -> Column:
    """Path of a file's data embedded in the link container."""
    return F.concat(F.lit(f"{CONTAINER}/"), F.element_at(F.split(path, "/"), -1))


def prefer_embedded(values: DataFrame, embedded: DataFrame, on: list[str], column: str = "value") -> DataFrame:
    """Values, from the embedded table where it has them."""
    return values.join(embedded.select(*on, F.col(column).alias("_here")), on, "left").withColumn(column, F.coalesce("_here", column)).drop("_here")


def fixed_replica(catalog: DataFrame, keys: list[str], order: list[str], acceptable: list[str]) -> DataFrame:
    """For fixed variables: of the newest version the first available replica of an acceptable type; a key without one has no row."""
    fit = cat.latest(catalog, keys).where(F.col("file_type").isin(*acceptable) & F.col("available"))
    return cat.best_per_time(fit, keys, order)


@dataclass
class SoftLinks:
    """A catalog and its links, lazily: a folder with two Parquet tables, or DataFrames."""

    catalog: DataFrame
    links: DataFrame

    @classmethod
    def load(cls, spark, folder: str) -> SoftLinks:
        return cls(spark.read.parquet(f"{folder}/catalog"), spark.read.parquet(f"{folder}/links"))

    def save(self, folder: str) -> None:
        """Write both tables; a null link fails the write."""
        self.catalog.write.mode("errorifexists").parquet(f"{folder}/catalog")
        reject_unlinked(self.links, ["path_id", "idx"]).write.mode("errorifexists").partitionBy("var").parquet(f"{folder}/links")

    def data_nodes(self) -> DataFrame:
        return self.catalog.select("data_node").distinct()

    def variables(self, root: list[str], time: str = "time") -> list[str]:
        """Variables of the root that have links, without time; all of the root if there are no links."""
        linked = {r["var"] for r in small_rows(self.links.select("var").distinct(), 100_000)}
        named = [v for v in root if v.lower() != time]
        return [v for v in named if v in linked] if linked else named

    def with_paths(self) -> DataFrame:
        """Links with their catalog rows; a link to an id that the catalog lacks raises on read."""
        joined = self.links.join(self.catalog, "path_id", "left")
        return joined.withColumn("path", F.when(F.col("path").isNotNull(), F.col("path")).otherwise(F.raise_error(F.lit("unknown path_id"))))

    def __enter__(self) -> SoftLinks:
        self.catalog, self.links = self.catalog.cache(), self.links.cache()
        self.catalog.createOrReplaceTempView("soft_link_catalog")
        self.links.createOrReplaceTempView("soft_link_links")
        return self

    def __exit__(self, *_) -> None:
        self.catalog.unpersist()
        self.links.unpersist()
