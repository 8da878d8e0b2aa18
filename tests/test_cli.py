"""The command line over small Parquet folders."""

import datetime as dt

from weftline import cli


def test_validate_load_subset(spark, tmp_path):
    at = lambda d: dt.datetime(2000, 1, d)
    folder = str(tmp_path)
    spark.createDataFrame(
        [("p1", 1, 20100101, "local_file", "n"), ("p2", 2, 20110101, "OPENDAP", "m"), ("p3", 3, 20110101, "local_file", "m")], "path string, path_id long, version long, file_type string, data_node string"
    ).write.parquet(f"{folder}/s/catalog")
    times = [("tas", at(d), i, idx) for i, days in ((1, (1, 2, 3)), (2, (2, 3)), (3, (3, 4))) for idx, d in enumerate(days)]
    spark.createDataFrame(times, "var string, at timestamp_ntz, path_id long, idx long").write.parquet(f"{folder}/times")
    cli.main(["validate", f"{folder}/s/catalog", f"{folder}/times", f"{folder}/all"])
    got = [(r["at"].day, r["path_id"], r["idx"]) for r in spark.read.parquet(f"{folder}/all").orderBy("at").collect()]
    assert got == [(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 3, 1)]
    cli.main(["validate", f"{folder}/s/catalog", f"{folder}/times", f"{folder}/s/links", "--day", "2", "--next", "--file_type", "OPENDAP,local_file"])
    assert [r["at"].day for r in spark.read.parquet(f"{folder}/s/links").orderBy("at").collect()] == [2, 3]
    spark.createDataFrame([(2, 0, 5.0), (3, 0, 6.0)], "path_id long, idx long, value double").write.parquet(f"{folder}/values")
    cli.main(["load", f"{folder}/s", f"{folder}/values", f"{folder}/loaded"])
    assert [r["value"] for r in spark.read.parquet(f"{folder}/loaded").collect()] == []
    cli.main(["download_opendap", f"{folder}/s", f"{folder}/values", f"{folder}/got", "--Xdata_node", "n"])
    assert [r["value"] for r in spark.read.parquet(f"{folder}/got").collect()] == [5.0]
    spark.createDataFrame([(i, j, float(i), float(j)) for i in range(4) for j in range(4)], "i int, j int, lat double, lon double").write.parquet(f"{folder}/grid")
    cli.main(["subset", f"{folder}/grid", f"{folder}/cut", "--lonlatbox", "1", "2", "0", "1"])
    assert spark.read.parquet(f"{folder}/cut").count() == 4


def test_downloads_skip_what_a_better_replica_has(spark, tmp_path):
    folder, at = str(tmp_path), dt.datetime(2000, 1, 1)
    rows = [(1, "HTTPServer", "n", "a"), (2, "OPENDAP", "n", "a"), (3, "HTTPServer", "n", "b"), (4, "OPENDAP", "x", "b"), (5, "HTTPServer", "n", ""), (6, "OPENDAP", "n", ""), (7, "OPENDAP", "n", "c"), (8, "local_file", "n", "c")]
    rows = [(*r, c and c * 16 + "0" * 16) for *r, c in rows]
    spark.createDataFrame([(f"p{i}", i, 1, *r) for i, *r in rows], "path string, path_id long, version long, file_type string, data_node string, checksum string").write.parquet(f"{folder}/s/catalog")
    spark.createDataFrame([("tas", at, i, 0) for i, *_ in rows], "var string, at timestamp_ntz, path_id long, idx long").write.parquet(f"{folder}/s/links")
    spark.createDataFrame([(i, 0, float(i)) for i, *_ in rows], "path_id long, idx long, value double").write.parquet(f"{folder}/values")

    def got(command, *options):
        out = f"{folder}/{command}{len(options)}"
        cli.main([command, f"{folder}/s", f"{folder}/values", out, "--Xdata_node", "x", *options])
        return sorted(r["value"] for r in spark.read.parquet(out).collect())

    assert got("download_files") == [3.0, 5.0] and got("download_files", "--download_all") == [1.0, 3.0, 5.0]
    assert got("download_opendap") == [2.0, 6.0]
