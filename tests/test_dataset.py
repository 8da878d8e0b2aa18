"""Dataset trees and metadata."""

from pyspark.sql import functions as F
from weftline.operators import dataset


def test_tree(spark, tmp_path):
    t = spark.createDataFrame([(0, 1.0), (1, None)], "time int, v double")
    d = dataset.Dataset({"/": t, "/a": t.withColumn("v", F.lit(None).cast("double")), "/a/b": t}, {"/": {"x": "1"}, "/a": {"y": "2"}})
    cut = d.map(lambda df: df.withColumn("w", F.lit(1)), lambda df: F.col("time") >= 1)
    assert {k: df.count() for k, df in cut.tables.items()} == {"/": 1, "/a": 1, "/a/b": 1} and "w" in cut.tables["/"].columns
    assert {k: df.count() for k, df in d.map(check_empty=["v"]).tables.items()} == {"/": 2, "/a": 0, "/a/b": 2}
    assert set(d.group("/a").tables) == {"/", "/b"} and d.group("/a").attributes == {"/": {"y": "2"}}
    merged = d.merge_attributes(dataset.Dataset({}, {"/": {"x": "9", "z": "3", "temporary": "t"}}), "temporary")
    assert merged.attributes["/"] == {"x": "1", "z": "3"}
    d.save(f"{tmp_path}/d")
    assert dataset.Dataset.load(spark, f"{tmp_path}/d", ["/", "/a/b"]).tables["/a/b"].count() == 2


def test_metadata(spark):
    dims = {"Time": ["Time"], "lat": ["lat"], "tas": ["Time", "lat"], "area": ["lat"]}
    assert dataset.find_time(["lat", "Time", "TIME"]) == "Time" and dataset.find_time(["lat"]) is None
    assert dataset.variables(dims) == ["tas", "area"] and dataset.variables(dims, True) == ["tas"] and dataset.variables(dims, False) == ["area"]
    got = [tuple(r) for r in dataset.coordinates(spark, {"lat": 2, "n": 3}, {"lat": [5, 6]}).orderBy("dim", "idx").collect()]
    assert got == [("lat", 0, 5.0), ("lat", 1, 6.0), ("n", 0, 0.0), ("n", 1, 1.0), ("n", 2, 2.0)]
    first, last = dataset.dates_by_pattern(F.lit("tas_x_185003-185112.nc"), r"^.*_([0-9]+)-([0-9]+)\.nc$")
    row = spark.range(1).select(first.alias("a"), last.alias("b")).first()
    assert (row["a"]["year"], row["a"]["month"], row["b"]["month"]) == (1850, 3, 12)
    assert spark.range(1).select(dataset.read_or_default(F.lit(3), F.lit(False), 7)).first()[0] == 7
    hosts = dataset.by_host(spark.range(40).select((F.col("id") % 5).alias("data_node"), F.col("id").alias("path")), 4)
    placed = hosts.withColumn("task", F.spark_partition_id()).select("data_node", "task").distinct()
    assert placed.groupBy("data_node").count().where("count > 1").count() == 0
