"""Fields of paths and catalogs in one form."""

import datetime as dt

from pyspark.sql import functions as F
from weftline.functions import paths


def test_versions_and_checksums(spark):
    at = dt.datetime(2015, 6, 1, 3)
    versions = {"v20150601": "2015-06-01", "v20150602": None, "20110101": "2011-01-01", "V20110101": "2011-01-01", "v2011-01-01": "2011-01-01", "v20110230": None, "v1": None, "latest": None, "": None, "v20101": None}
    df = spark.createDataFrame([(v, at) for v in versions] + [(None, at), ("v20110101", None)], "v string, at timestamp_ntz")
    got = [str(r[0]) if r[0] else None for r in df.select(paths.version_day(F.col("v"), F.col("at"))).collect()]
    assert got == [*versions.values(), None, None]
    sums = {" " + "AB" * 16: "ab" * 16, "0" * 64: None, "f" * 32: None, "ab" * 15: None, "xy" * 16: None, "0" * 63 + "1": "0" * 63 + "1", "": None, None: None}
    df = spark.createDataFrame([(s,) for s in sums], "s string")
    assert [r[0] for r in df.select(paths.usable_checksum(F.col("s"))).collect()] == list(sums.values())
