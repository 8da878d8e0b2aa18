"""Covered periods and gaps."""

import random

from weftline.functions import paths
from weftline.operators import intervals
from pyspark.sql import functions as F


def brute(rows, join=1):
    out, gaps = [], []
    for k in {r[0] for r in rows if r[0] is not None}:
        spans = sorted((s, e) for x, s, e in rows if x == k and s is not None and e is not None and s <= e)
        merged = []
        for s, e in spans:
            if merged and s <= merged[-1][1] + join:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(k, s, e) for s, e in merged]
        gaps += [(k, a[1] + 1, b[0] - 1) for a, b in zip(merged, merged[1:])]
    return sorted(out), sorted(gaps)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        s = rng.randrange(-300, 3000)
        rows.append((f"e{min(rng.randrange(40), rng.randrange(40))}", s, s + rng.choice([0, 1, 2, 5, 30, 400])))
    rows += rows[:200] + [("e1", 5, 3), (None, 1, 2), ("e1", None, 4), ("e1", 4, None), ("lone", 10, 10)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "k string, start long, end long, _start string, _shard int")
    for width, join in ((50, 1), (7, 1), (10_000, 1), (50, 4)):
        want, holes = brute(rows, join)
        assert sorted(tuple(r) for r in intervals.periods(df, ["k"], width=width, join=join).collect()) == want
        got = sorted(tuple(r) for r in intervals.gaps(df, ["k"], width=width, join=join).collect())
        assert got == holes


def test_empty(spark):
    df = spark.createDataFrame([], "k string, start long, end long")
    assert intervals.periods(df, ["k"]).count() == 0 and intervals.gaps(df, ["k"]).count() == 0


def test_hot_entity_meets_as_distinct_starts(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), (F.col("id") % 50 * 3).alias("start"), (F.col("id") % 50 * 3 + 1).alias("end"))
    assert intervals.gaps(df, ["k"], width=30).count() == 49


def test_file_names(spark):
    rows = {
        "http://h/a/tas_Amon_M_exp_r1i1p1_185001-185012.nc": ("tas_Amon_M_exp_r1i1p1", 1850 * 12, 1850 * 12 + 11),
        "calc1:/data/x//tas%5FAmon%5FM%5Fexp%5Fr1i1p1%5F1850-1851.nc4 |MD5|abc|t": ("tas_Amon_M_exp_r1i1p1", 1850 * 12, 1851 * 12 + 11),
        "http://h/a/tas_day_M-1-0_exp_r1i1p1_18500115_18500302.NC?time[0:1:11]": ("tas_day_M-1-0_exp_r1i1p1", 1850 * 12, 1850 * 12 + 2),
        "http://h/a/tas_Amon_M_exp_r1i1p1_185001-185912-clim.nc.html": ("tas_Amon_M_exp_r1i1p1", 1850 * 12, 1859 * 12 + 11),
        "http://h/a/tas_Oyr_M_exp_r1i1p1_1850.nc#mode=bytes": ("tas_Oyr_M_exp_r1i1p1", 1850 * 12, 1850 * 12 + 11),
        "http://h/a/tas_fx_M_exp_r0i0p0.nc": ("tas_fx_M_exp_r0i0p0", None, None),
        "http://h/a/tas_Amon_M_exp_r1i1p1_185013-185014.nc": ("tas_Amon_M_exp_r1i1p1", None, None),
    }
    df = spark.createDataFrame([(p,) for p in rows], "path string").select("path", paths.stem(F.col("path")).alias("name"))
    got = {r["path"]: (r["series"], r["start"], r["end"]) for r in paths.with_period(df).collect()}
    assert got == rows


def test_node_and_type_spellings(spark):
    df = spark.createDataFrame([("HTTP://A.B:80/", " OpenDAP "), ("ftp://a/", ""), (None, None), ("  ", "x")], "n string, t string")
    got = [tuple(r) for r in df.select(paths.node_key(F.col("n")), paths.type_key(F.col("t"))).collect()]
    assert got == [("http://a.b", "opendap"), ("ftp://a", None), (None, None), (None, "x")]
