"""Literal fixtures of the link, calendar, merge and grid operators."""

import random

import pytest
from pyspark.sql import functions as F
from weftline.functions import calendars as cal
from weftline.functions import cftime
from weftline.operators import align, audit, catalog, geo, links, merge, select


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_rank(spark):
    types, nodes = ["local_file", "OPENDAP", "HTTPServer"], ["n2", "n1"]
    data = [(v, t, n, f"p{v}{t}{n}") for v in (1, 2) for t in types for n in ("n1", "n2")]
    df = spark.createDataFrame([("g", *r) for r in data], "g string, version long, file_type string, data_node string, path string")
    got = rows(catalog.rank(df, ["g"], catalog.preference(types, nodes)).select("version", "file_type", "data_node", "pref_rank"), "pref_rank")
    assert got[0][:3] == (2, "local_file", "n2") and got[1][:3] == (2, "local_file", "n1") and got[2][:3] == (2, "OPENDAP", "n2") and got[6][0] == 1
    with pytest.raises(Exception, match="not in the preference list"):
        catalog.rank(df, ["g"], catalog.preference(types[:1], nodes)).collect()


def test_links(spark):
    times = spark.createDataFrame([(f, t, i) for f, start in (("A", 0), ("B", 2)) for i, t in enumerate(range(start, start + 4))], "file string, t int, idx int")
    files = spark.createDataFrame([("A", 2), ("B", 1)], "file string, pref int")
    made = links.build_links(times, files, [], "t", "file", ["pref"])
    assert rows(made, "t") == [(0, "A", 0), (1, "A", 1), (2, "B", 0), (3, "B", 1), (4, "B", 2), (5, "B", 3)]
    with pytest.raises(Exception, match="null link"):
        links.reject_unlinked(made.withColumn("idx", F.lit(None).cast("int")), ["idx"]).collect()


def test_soft_links_round_trip(spark, tmp_path):
    c = spark.createDataFrame([("p1", 1, "n"), ("p2", 2, "m")], "path string, path_id long, data_node string")
    ln = spark.createDataFrame([("tas", 0.5, 1, 0), ("tas", 1.5, 2, 3)], "var string, time_num double, path_id long, idx long")
    links.SoftLinks(c, ln).save(f"{tmp_path}/s")
    with links.SoftLinks.load(spark, f"{tmp_path}/s") as s:
        assert s.variables(["tas", "pr", "time"]) == ["tas"] and s.data_nodes().count() == 2
        assert sorted(r["path"] for r in s.with_paths().collect()) == ["p1", "p2"]
    with pytest.raises(Exception, match="unknown path_id"):
        links.SoftLinks(c.where("path_id = 1"), ln).with_paths().collect()


def test_equivalents_and_fail_over(spark):
    md5 = "0123456789abcdef" * 2  # placeholders and blanks identify nothing
    df = spark.createDataFrame(
        [("/a/f.nc", 1, md5, "OPENDAP", False), ("/b/f.nc", 2, md5, "OPENDAP", True), ("/c/f.nc", 3, "other", "OPENDAP", True), ("/d/g.nc", 4, "", "HTTPServer", True), ("/e/h.nc", 5, "", "OPENDAP", True), ("/x/f.nc", 6, md5, "OPENDAP", True), ("/n", 7, None, "HTTPServer", None), ("/o", 8, "f" * 32, "HTTPServer", True), ("/p", 9, "f" * 32, "OPENDAP", True)],
        "path string, id int, checksum string, file_type string, available boolean",
    )
    used = spark.createDataFrame([("/a/f.nc",)], "path string")
    assert [r["id"] for r in catalog.equivalents(df, used).orderBy("id").collect()] == [1, 2, 6]
    allowed = F.col("path") != "/b/f.nc"
    strict = dict(rows(catalog.fail_over(df, ["OPENDAP"], allowed, "id", ["id"])))
    assert strict == {1: 6, 2: 6, 3: 3, 4: None, 5: 5, 6: 6, 7: None, 8: None, 9: 9}
    assert dict(rows(catalog.fail_over(df, ["OPENDAP"], allowed, "id", ["id"], strict=False)))[4] == 5


def test_previous_next(spark):
    for keys in ([], ["k"]):
        df = spark.sql("SELECT 'a' AS k, timestamp_ntz'2000-12-29 00:00:00' + make_dt_interval(id) AS t FROM range(6)")
        got = select.previous_next(df, "t", F.dayofmonth("t") == 31, 1, 2, keys)
        assert [r["t"].day for r in got.orderBy("t").collect()] == [30, 31, 1, 2]
    rng = random.Random(10)
    days = sorted(rng.sample(range(2000), 200))
    df = spark.createDataFrame([(d,) for d in days], "d int").selectExpr("timestamp_ntz'2000-01-01 00:00:00' + make_dt_interval(d) AS t")
    kept = select.previous_next(df, "t", F.dayofmonth("t") == 3, 2, 3).count()
    import datetime as dt

    mask = [(dt.datetime(2000, 1, 1) + dt.timedelta(d)).day == 3 for d in days]
    assert kept == sum(any(mask[max(0, i - 3) : i + 3]) for i in range(len(mask)))


def test_relative_years(spark):
    df = spark.sql("SELECT make_timestamp_ntz(1850 + id, 6, 1, 0, 0, 0) AS t FROM range(3)")
    assert [r["t"].year for r in select.relative_years(df, "t", [1], 1).collect()] == [1850]
    assert [r["t"].year for r in select.created_years(df, "t", [0, 1]).orderBy("t").collect()] == [1850, 1851]


def test_match(spark):
    source = spark.createDataFrame([(0, 10.0), (1, 20.0), (2, 30.0), (3, 20.0)], "idx long, value double")
    ask = lambda *v: spark.createDataFrame(list(enumerate(map(float, v))), "pos long, value double")
    assert rows(align.match(source, ask(20, 10)), "pos") == [(0, 1), (1, 0)]
    assert rows(align.match(source, ask(20, 10.00001)), "pos") == [(0, 1), (1, 0)]
    with pytest.raises(Exception, match="no match"):
        align.match(source, ask(99, 10)).collect()
    assert rows(align.match(source.where("idx = 2"), ask(77)), "pos") == [(0, 2)]


def test_slices(spark):
    one = spark.createDataFrame([(i,) for i in (0, 1, 2, 5, 6, 9)], "idx long")
    for bucket in (2, 3, 1000):
        assert rows(align.to_slices(one, bucket=bucket), "start") == [(0, 3, 1), (5, 7, 1), (9, 10, 1)]
    three = spark.createDataFrame([(i,) for i in (0, 3, 6, 9)], "idx long")
    assert rows(align.optimal_step(three)) == [(3, 1)]
    assert rows(align.to_slices(three, step=3)) == [(0, 10, 3)]
    s = spark.sql("SELECT struct(2 AS start, 20 AS stop, 3 AS step) AS a, struct(1 AS start, 9 AS stop, 2 AS step) AS b")
    assert s.select(align.slice_indices(align.slice_a_slice(F.col("a"), F.col("b")))).first()[0] == list(range(2, 20, 3))[1:9:2]


def test_take_and_dense(spark):
    df = spark.sql("SELECT 1 AS k, array(1.0D, 2.0D) AS v, array() AS e")
    assert df.select(align.take(F.col("v"), F.array(F.lit(1), F.lit(5)))).first()[0] == [2.0, None]
    assert rows(align.to_dense(align.to_long(df, ["k"], "v"), ["k"])) == [(1, [1.0, 2.0])]


def test_append(spark):
    base = spark.createDataFrame([(0, 1, "a"), (1, 2, "b"), (2, 3, "c")], "pos long, t int, v string")
    new = spark.createDataFrame([(0, 3, "x"), (1, 4, "y"), (2, 0, "z")], "pos long, t int, v string")
    assert rows(merge.append(base, new, ["t"], ["v"]), "pos") == [(1, 0, "a"), (2, 1, "b"), (3, 2, "x"), (4, 3, "y"), (0, 4, "z")]
    none = new.where("t = 3").withColumn("v", F.lit(None).cast("string"))
    assert rows(merge.append(base, none, ["t"], ["v"], check_empty=True), "pos")[2] == (3, 2, "c")
    mixed = spark.createDataFrame([(0, 3, None), (1, 4, "y")], "pos long, t int, v string")
    assert rows(merge.append(base, mixed, ["t"], ["v"], check_empty=True), "pos")[2] == (3, 2, None)
    assert rows(merge.append(base, mixed, ["t"], ["v"], check_empty=True, granularity="row"), "pos")[2] == (3, 2, "c")


@pytest.mark.parametrize("calendar", ["standard", "proleptic_gregorian", "julian", "noleap", "all_leap", "360_day"])
def test_column_calendars_like_numpy(spark, calendar):
    import numpy as np

    n = list(range(-700, 1_200_000, 1733)) + [577733, 577734, 577735, 577736]
    got = spark.createDataFrame([(x,) for x in n], "n long")
    got = got.withColumn("d", F.struct(*(c.cast("int").alias(k) for k, c in zip("ymd", cftime.date_of(F.col("n"), calendar)))))
    got = got.withColumn("back", cftime.day_number(F.col("d.y"), F.col("d.m"), F.col("d.d"), calendar)).orderBy("n").collect()
    y, m, d = cal.from_days(np.array(sorted(n)), calendar)
    assert [(r["d"]["y"], r["d"]["m"], r["d"]["d"]) for r in got] == list(zip(y.tolist(), m.tolist(), d.tolist()))
    assert [r["back"] for r in got] == sorted(n)


def test_times(spark):
    one = spark.range(1)
    first = lambda c: one.select(c).first()[0]
    show = lambda *a: first(cftime.date_print(cftime.decode(*a)))
    assert show(F.lit(59.0), "days since 2001-01-01", "360_day") == "2001-02-30 00:00:00"
    assert show(F.lit(1.0), "days since 1582-10-04", "standard") == "1582-10-15 00:00:00"
    assert show(F.lit(365.0), "days since 0-01-01", "365_day") == "0001-01-01 00:00:00"
    assert show(F.lit(1.5), "months since 2001-02-01", "noleap") == "2001-03-16 12:00:00"
    assert show(F.lit(18500115.5), "day as %Y%m%d.%f") == "1850-01-15 12:00:00"
    assert [first(cftime.pad_timestamp(F.lit(x))) for x in ("1850", "185003", "18500316")] == ["18500101000000", "18500301000000", "18500316000000"]
    assert first(cftime.truncate(F.lit(-1.23456), 2)) == -1.23
    assert first(cftime.control_units(F.lit("hours since 1850-1 00:00"))) == "days since 1850-1-1"
    assert first(cftime.add_months(cftime.fields_of_digits(F.lit("20010131")), 1))["day"] == 31
    half = cftime.encode(cftime.fields_of_digits(F.lit("20010116")), "months since 2001-01-01", "noleap")
    assert first(half) == pytest.approx(1 - 16 / 28) and first(cftime.encode(cftime.fields_of_digits(F.lit("20010116")), "months since 2001-01-01", "noleap", exact_fraction=True)) == pytest.approx(15 / 31)


def test_audit_codes(spark):
    start, n = 0.0, 12
    axis = [15.5, 45.0, 74.5, 105.0, 135.5, 166.0, 196.5, 227.5, 258.0, 288.5, 319.0, 349.5]
    ends = [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334, 365]
    bounds = [[float(a), float(b)] for a, b in zip(ends, ends[1:])]
    good = ("ok", "185001", "185012", "days since 1850-1-1", axis, bounds)
    wrong = ("001", "185001", "185012", "days since 1850-1-1", [start, *axis[1:]], bounds)
    cases = [good, wrong, ("003", "185001", "185011", "days since 1850-1-1", axis, bounds), ("005", "185001", "185012", "days since 1900-1-1", axis, None)]
    df = spark.createDataFrame(cases, "file string, begin string, until string, units string, time array<double>, time_bnds array<array<double>>")
    done = audit.axis_audit(df, "mon", "days since 1850-1-1", "noleap", False)
    got = {r["file"]: (r["control"], r["bnds"], r["steps"]) for r in done.collect()}
    assert got == {"ok": (["000"], True, n), "001": (["001"], True, n), "003": (["003"], None, n), "005": (["005", "000", "002"], None, n)}
    fixed = {r["file"]: r["time"] for r in audit.corrected(df, done, "days since 1850-1-1").collect()}
    assert fixed["001"] == axis and fixed["003"] == axis
    instant = audit.axis_audit(df.where("file = 'ok'"), "mon", "days since 1850-1-1", "noleap", True).first()
    assert instant["control"] == ["004", "001"]


def test_boxes(spark):
    df = spark.createDataFrame([(350.0,), (0.0,), (10.0,), (180.0,)], "lon double").withColumn("lat", F.lit(1.0))
    inside = lambda box: [r["lon"] for r in df.where(geo.in_box(F.col("lat"), F.col("lon"), box)).collect()]
    assert inside((-20, 15, 0, 2)) == [350.0, 0.0, 10.0] and inside((-180, 180, 0, 2)) == [350.0, 0.0, 10.0] and inside((0, 10, 0, 1)) == [0.0, 10.0]
    grid = spark.createDataFrame([(i, j, i == j and i < 2) for i in range(3) for j in range(3)], "i int, j int, hit boolean")
    assert rows(geo.outer_product_subset(grid, F.col("hit")).select("i", "j"), "i", "j") == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert geo.outer_product_subset(grid, F.lit(False)).count() == 9 and geo.outer_product_subset(grid, F.lit(False), empty="none").count() == 0


def test_vertices(spark):
    square = [(0.0, 0.0), (1.0, 1.0), (0.0, 1.0), (1.0, 0.0)]
    df = spark.createDataFrame([([{"lat": a, "lon": b} for a, b in square],)], "v array<struct<lat: double, lon: double>>")
    assert [tuple(v) for v in df.select(geo.counter_clockwise(F.col("v"))).first()[0]] == [(1.0, 1.0), (1.0, 0.0), (0.0, 0.0), (0.0, 1.0)]
    assert geo.vertex_source(["lat_bnds", "lon_bnds"]) == "bounds"
    with pytest.raises(NotImplementedError):
        geo.vertex_source(["rlat_bnds", "rlon_bnds"])
