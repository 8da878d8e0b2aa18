"""Queries over whole tables, against brute force."""

import datetime as dt

from weftline.plans import reference

SOFT_LINKS = "path_id long, path string, version string, file_type string, data_node string, checksum_type string, checksum string, tracking_id string, recorded_at timestamp_ntz"


def soft_links(spark, folder, rows):
    """rows: path_id, path, version, file_type, data_node, checksum."""
    at = dt.datetime(2015, 6, 1)
    spark.createDataFrame([(*r[:5], "md5", r[5], None, at) for r in rows], SOFT_LINKS).write.parquet(f"{folder}/soft_links.parquet")
    return str(folder)


def test_rank_replicas(spark, tmp_path):
    rows = [
        (1, "/a/f", "v1", "HTTPServer", "n", None), (2, "/b/f", "v2", "HTTPSERVER", "n", None), (3, "/c/f", "v2", " OPeNDAP", "n", None), (4, "/d/f", "v2", None, "n", None),
        (5, "/e/f", "latest", "local_file", "n", None), (6, "/g/f", "v2", "HTTPServer", None, None), (7, "/h/f", "v2", "tape", "m", None), (8, "/i/g", None, None, None, None), (9, None, "v1", "OPENDAP", "n", None),
        (10, "/j/f", "v2", "httpserver ", "m", None), (10, "/j/f", "v2", "HTTPServer", "m", None),
    ]
    got = [(r["name"], r["path_id"], r["pref_rank"]) for r in reference.rank_replicas(spark, soft_links(spark, tmp_path, rows)).collect()]
    assert sorted(got, key=lambda r: (r[0], r[2])) == [("f", i, n) for n, i in enumerate((3, 10, 2, 6, 7, 4, 1, 5), 1)] + [("g", 8, 1)]


def test_rank_replicas_ranks_every_path(spark, data):
    paths = spark.read.parquet(f"{data}/soft_links.parquet").where("path is not null").selectExpr("path_id", "split_part(path, '|', 1) as p").distinct().count()
    assert reference.rank_replicas(spark, data).count() == paths


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_chunks_and_slices_of_all_rows(spark, data):
    parts = spark.read.parquet(f"{data}/part.parquet").select("p_partkey", "p_size").collect()
    want = [(k, a, min(a + 1000 // n, 100)) for k, n in parts for a in range(0, 100, max(1, 1000 // n))]
    assert rows_of(reference.request_chunks(spark, data).select("p_partkey", "start", "stop")) == sorted(want)
    orders = spark.read.parquet(f"{data}/orders.parquet").select("o_orderkey", "o_custkey").collect()
    got = rows_of(reference.slice_of_slice(spark, data).select("o_orderkey", "start", "stop", "step"))
    places = lambda c: range(100, 200, 2)[c % 5 * (1 + c % 3) : 30 : 1 + c % 3]
    assert [(k, list(range(a, b, step))) for k, a, b, step in got] == sorted((k, list(places(c))) for k, c in orders)


def test_matches_of_all_rows(spark, data):
    rows = spark.read.parquet(f"{data}/supplier.parquet").select("s_suppkey", "s_acctbal").collect()
    exact = sorted((k, min(i for i, a in rows if a == b)) for k, b in rows)
    assert rows_of(reference.match_exact(spark, data).select("pos", "idx")) == exact
    fuzzy = sorted((k, min(i for i, a in rows if abs(a - b - 1e-6) <= 1e-5 + 1e-5 * abs(b + 1e-6))) for k, b in rows)
    assert rows_of(reference.match_fuzzy(spark, data).select("pos", "idx")) == fuzzy
