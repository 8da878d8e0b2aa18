"""Classic CDF files, directory scans, streaming appends."""

import numpy as np
from weftline.sources import cdf, files
from weftline.streaming.append import append_stream, snapshot


def test_cdf_round_trip(spark, tmp_path):
    spark.dataSource.register(cdf.CdfDataSource)
    tas = np.arange(24, dtype=float).reshape(4, 2, 3)
    tas[1, 0, 1] = 1e20
    for k in (1, 2):
        variables = {"time": (["time"], np.arange(4.0) + k, {"units": "days since 1850-01-01"}), "lat": (["lat"], np.array([1.0, 2.0]), {}), "tas": (["time", "lat", "lon"], tas * k if k == 1 else tas, {"_FillValue": 1e20})}
        cdf.write(f"{tmp_path}/f{k}.nc", {"time": None, "lat": 2, "lon": 3}, variables, {"title": "t"}, record_count=4)
    header = cdf.Header(f"{tmp_path}/f1.nc")
    assert header.shape("tas") == [4, 2, 3] and header.attributes == {"title": "t"} and header.variables["time"]["attributes"]["units"] == "days since 1850-01-01"
    for limit in (6, 10_000):
        got = spark.read.format("cdf").option("path", str(tmp_path)).option("var", "tas").option("maxelements", limit).load().orderBy("path", "idx").collect()
        assert len(got) == 8 and got[0]["shape"] == [2, 3] and got[1]["value"] == [6.0, None, 8.0, 9.0, 10.0, 11.0]
    assert [r["value"] for r in spark.read.format("cdf").option("path", f"{tmp_path}/f2.nc").option("var", "lat").load().orderBy("idx").collect()] == [[1.0], [2.0]]


def test_scan_and_checksums(spark, tmp_path):
    import hashlib

    (tmp_path / "a.nc").write_bytes(b"hello")
    (tmp_path / "b.txt").write_bytes(b"other")
    assert [r["name"] for r in files.scan(spark, str(tmp_path)).collect()] == ["a.nc", "b.txt"]
    assert [r["name"] for r in files.scan(spark, str(tmp_path), r"\.nc$").collect()] == ["a.nc"]
    for kind, h in (("MD5", hashlib.md5), ("SHA256", hashlib.sha256), ("sha1", hashlib.sha1)):
        assert files.checksums(spark, str(tmp_path), kind, "*.nc").first()["checksum"] == h(b"hello").hexdigest()


def test_streaming_append(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for batch in ([(0, 1, "a"), (1, 2, "b")], [(2, 2, "x"), (3, 5, "y"), (4, 2, "z")]):
        spark.createDataFrame(batch, "seq long, t int, v string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("seq long, t int, v string").parquet(source)
        append_stream(stream, out, ["t"], ["v"], "seq", f"{tmp_path}/checkpoint").awaitTermination(120)
    assert sorted((r["t"], r["v"]) for r in snapshot(spark, out).collect()) == [(1, "a"), (2, "z"), (5, "y")]


def test_lost_snapshots_raise(spark, tmp_path):
    import shutil

    import pytest

    source, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def run(rows, checkpoint):
        spark.createDataFrame(rows, "seq long, t int, v string").coalesce(1).write.mode("append").parquet(source)
        append_stream(spark.readStream.schema("seq long, t int, v string").parquet(source), out, ["t"], ["v"], "seq", f"{tmp_path}/{checkpoint}").awaitTermination(120)

    run([(0, 1, "a")], "one")
    run([(1, 2, "b")], "one")
    with pytest.raises(Exception, match="rows would be lost"):
        run([(2, 3, "c")], "another")
    shutil.rmtree(f"{out}/batch=00000001")
    shutil.rmtree(f"{out}/batch=00000000")
    with pytest.raises(Exception, match="rows would be lost"):
        run([(3, 4, "d")], "one")


def test_files_are_handled_with_trials(spark):
    import pytest
    from weftline.sources import handling

    def rows(path):
        import pandas as pd

        if "bad" in path:
            raise OSError("not there")
        return pd.DataFrame({"n": [len(path)], "kind": ["x"]})

    df = spark.createDataFrame([("/a", "local_file"), ("/bad", "HTTPServer"), ("/bad", "FTPServer"), (None, "OPENDAP"), ("/ccc", "OPENDAP")], "path string, file_type string")
    got = {(r["path"], r["trials"], r["error"], r["n"]) for r in handling.handle(df, rows, "n int, kind string", trials=3, backoff=0).collect()}
    assert got == {("/a", 1, None, 2), ("/bad", 3, "OSError: not there", None), ("/ccc", 1, None, 4)}
    for mode in ("raise", "failfast"):
        with pytest.raises(Exception, match="not there"):
            handling.handle(df, rows, "n int, kind string", trials=2, backoff=0, mode=mode).collect()
    found = handling.probe(df, rows, trials=2, backoff=0).collect()
    assert [r["available"] for r in found] == [True, False, True, False, True]
    sent = handling.dispatch(df, {"local_file": rows, "OPENDAP": rows}, "n int, kind string", trials=1)
    assert {(r["path"], r["n"]) for r in sent.collect()} == {("/a", 2), ("/ccc", 4)}


def test_damaged_cdf_file_fails(spark, tmp_path):
    import pytest

    spark.dataSource.register(cdf.CdfDataSource)
    (tmp_path / "x.nc").write_bytes(b"no such thing")
    for options in ({"mode": "failfast"}, {"trials": 2, "backoff": 0}):
        with pytest.raises(Exception, match="no classic CDF file"):
            spark.read.format("cdf").options(path=str(tmp_path), var="tas", **options).load().collect()
