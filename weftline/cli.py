"""Command line: links and retrieval over Parquet tables.

Inputs and outputs are folders. ``catalog`` has the columns of ``weftline.model.CATALOG``, ``times`` those of ``FILE_TIMES`` with the
variable ``var`` and a timestamp ``at``; ``values``: ``path_id, idx`` and any others.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import paths
from weftline.operators import catalog as cat
from weftline.operators import geo, links, select

RETRIEVALS = ("download_files", "download_opendap", "load")


def numbers(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x]


def names(text: str) -> list[str]:
    return [x for x in text.split(",") if x]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftline", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)

    def add(name: str, summary: str, *inputs: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=summary)
        for i in inputs:
            c.add_argument(i)
        return c

    def time_options(c: argparse.ArgumentParser) -> None:
        for name in ("year", "month", "day", "hour"):
            c.add_argument(f"--{name}", type=numbers, default=[])
        for name in ("previous", "next"):
            c.add_argument(f"--{name}", action="count", default=0, help="one more step; may be repeated")
        c.add_argument("--min_year", type=int)

    v = add("validate", "build links: for every time step the best file", "catalog", "times", "out")
    v.add_argument("--file_type", type=names, default=["local_file", "OPENDAP", "HTTPServer", "GridFTP", "FTPServer", "soft_links_container"])
    v.add_argument("--var", type=names, default=[])
    time_options(v)
    for command in RETRIEVALS:
        r = add(command, "values that the links lead to", "links", "values", "out")
        r.add_argument("--data_node", type=names, default=[])
        r.add_argument("--Xdata_node", type=names, default=[])
        r.add_argument("--download_all", action="store_true")
        time_options(r)
    s = add("subset", "cut a grid to a box", "grid", "out")
    s.add_argument("--lonlatbox", nargs=4, type=float, required=True, metavar=("LO", "HI", "LA0", "LA1"))
    s.add_argument("--lat_var", default="lat")
    s.add_argument("--lon_var", default="lon")
    return p


def kept_times(axis: DataFrame, o: argparse.Namespace, time: str = "at") -> DataFrame:
    """Distinct steps of each variable that the time options keep, with their neighbours."""
    mask = select.time_mask(time, None if o.min_year is not None else o.year, o.month, o.day, o.hour)
    if o.min_year is not None and o.year:
        first = axis.groupBy("var").agg(F.min(F.year(time)).alias("_first"))
        axis = axis.join(first, "var")
        mask = mask & (F.year(time) - F.col("_first") + o.min_year).isin(*o.year)
    return select.previous_next(axis, time, mask, o.previous, o.next, ["var"])


def run(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    read = spark.read.parquet
    if o.command == "validate":
        times = read(o.times)
        times = times.where(F.col("var").isin(*o.var)) if o.var else times
        catalog = read(o.catalog).where(F.col("file_type").isin(*o.file_type))
        ranked = catalog.select("path_id", (-F.col("version")).alias("_age"), cat.list_position(F.col("file_type"), o.file_type).alias("_type"), F.col("data_node").alias("_node"))
        kept = kept_times(times, o)
        candidates = times.join(kept, ["var", "at"], "left_semi").join(ranked.select("path_id"), "path_id", "left_semi")
        return links.reject_unlinked(links.build_links(candidates, ranked, ["var"], "at", "path_id", ["_age", "_type", "_node", "path_id"]), ["path_id", "idx"])
    if o.command in RETRIEVALS:
        made = links.SoftLinks.load(spark, o.links)
        own = made.catalog if "checksum" in made.catalog.columns else made.catalog.withColumn("checksum", F.lit(None).cast("string"))
        own = own.withColumn("checksum", paths.unpacked(F.col("path"), 2, F.col("checksum")))
        own = own if "available" in own.columns else own.withColumn("available", F.lit(True))
        better = cat.better_type(own, select.included(F.col("data_node"), o.data_node, o.Xdata_node), "path_id")
        rows = made.with_paths().join(better, "path_id", "left").where(select.included(F.col("data_node"), o.data_node, o.Xdata_node))
        rows = select.retrieval_gate(rows, o.command, o.download_all)
        return links.retrieve(rows.select("var", "at", "path_id", "idx"), kept_times(rows, o), read(o.values), ["var"], "at", ["path_id", "idx"])
    grid = read(o.grid)
    return geo.outer_product_subset(grid, geo.in_box(F.col(o.lat_var), F.col(o.lon_var), tuple(o.lonlatbox)), ["grid_id"] if "grid_id" in grid.columns else None)


def main(argv: list[str] | None = None) -> None:
    o = parser().parse_args(argv)
    spark = SparkSession.builder.appName("weftline").getOrCreate()
    run(spark, o).write.mode("errorifexists").parquet(o.out)


if __name__ == "__main__":
    main()
