"""Queries of the link, retrieval, calendar, grid and audit operators over the test tables, each beside the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import cftime, paths
from weftline.operators import align, audit, catalog, dataset, geo, links, merge, select
from weftline.session import table
from weftline.sources.files import digest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _day(x) -> F.Column:
    return F.date_format(x, "yyyy-MM-dd")


def _ts(x) -> F.Column:
    return F.date_format(x, "yyyy-MM-dd HH:mm:ss")


# ---------------------------------------------------------------- time selection


@query("SELECT o_orderkey, strftime(o_orderdate,'%Y-%m-%d') AS day FROM orders WHERE year(o_orderdate) IN (1996,1997,1999) AND month(o_orderdate) IN (1,2,11)")
def filter_year_month(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where(select.time_mask("o_orderdate", [1996, 1997, 1999], [1, 2, 11])).select("o_orderkey", _day("o_orderdate").alias("day"))


@query("SELECT o_orderkey, strftime(o_orderdate,'%Y-%m-%d') AS day FROM orders WHERE year(o_orderdate) - (SELECT min(year(o_orderdate)) FROM orders) + 1 IN (1,3)")
def filter_relative_years(spark, sf):
    return select.relative_years(table(spark, sf, "orders"), "o_orderdate", [1, 3], 1).select("o_orderkey", _day("o_orderdate").alias("day"))


@query("SELECT o_orderkey, strftime(o_orderdate,'%Y-%m-%d') AS day FROM orders WHERE year(o_orderdate) - (SELECT min(year(o_orderdate)) FROM orders) IN (0,2) AND month(o_orderdate) IN (6,7)")
def filter_created_years(spark, sf):
    return select.created_years(table(spark, sf, "orders"), "o_orderdate", [0, 2], [6, 7]).select("o_orderkey", _day("o_orderdate").alias("day"))


@query("SELECT event_id, strftime(ts,'%Y-%m-%d %H:%M:%S') AS at FROM events WHERE day(ts) IN (1,15) AND hour(ts) IN (6,7,8,9,10,11)")
def filter_day_hour(spark, sf):
    return table(spark, sf, "events").where(select.time_mask("ts", days=[1, 15], hours=[6, 7, 8, 9, 10, 11])).select("event_id", _ts("ts").alias("at"))


@query("""WITH d AS (SELECT DISTINCT o_orderdate AS t FROM orders), m AS (SELECT t, max(CASE WHEN day(t) = 15 AND month(t) IN (2,7) THEN 1 ELSE 0 END)
OVER (ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS keep FROM d) SELECT strftime(t,'%Y-%m-%d') AS day FROM m WHERE keep = 1""")
def previous_next(spark, sf):
    kept = select.previous_next(table(spark, sf, "orders"), "o_orderdate", select.time_mask("o_orderdate", months=[2, 7], days=[15]), 1, 2)
    return kept.select(_day("o_orderdate").alias("day"))


@query("""WITH a AS (SELECT event_type, date_trunc('hour', ts) AS t FROM events GROUP BY 1, 2), m AS (SELECT *, max(CASE WHEN hour(t) = 6 THEN 1 ELSE 0 END)
OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS keep FROM a) SELECT event_type, strftime(t,'%Y-%m-%d %H:%M:%S') AS at FROM m WHERE keep = 1""")
def previous_next_by_series(spark, sf):
    axis = table(spark, sf, "events").select("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t"))
    return select.previous_next_window(axis, "t", F.hour("t") == 6, 2, 1, ["event_type"]).select("event_type", _ts("t").alias("at"))


@query("""WITH a AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events) SELECT event_id, pos FROM a WHERE pos % 3 = 0""")
def explicit_mask(spark, sf):
    from weftline.operators.ranking import positions

    axis = positions(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"], F.unix_date(F.to_date("ts")).cast("long"))
    mask = table(spark, sf, "events").select("event_id").withColumn("_one", F.lit(1))
    mask = positions(mask.select("event_id"), ["event_id"], F.floor(F.col("event_id") / 100_000)).select("pos", (F.col("pos") % 3 == 0).alias("keep"))
    return select.explicit_mask(axis.select("event_id", "pos"), mask).select("event_id", "pos")


@query("SELECT event_id, CASE WHEN value > 50 THEN NULL ELSE value END AS value FROM events")
def nan_to_missing(spark, sf):
    spoiled = table(spark, sf, "events").select("event_id", F.when(F.col("value") > 50, float("nan")).otherwise(F.col("value")).alias("value"))
    return spoiled.select("event_id", select.finite_or_null(F.col("value")).alias("value"))


# ---------------------------------------------------------------- catalogs

_TYPES = ["local_file", "OPENDAP", "HTTPServer", "GridFTP", "FTPServer", "soft_links_container"]
#: soft_links with one row for each path_id, unpacked; the version as a number.
_CATALOG = """c AS (SELECT path_id, split_part(path,'|',1) AS path, min(version) AS version, min(file_type) AS file_type, min(data_node) AS data_node,
min(CASE WHEN contains(path,'|') THEN split_part(path,'|',3) ELSE checksum END) AS checksum FROM soft_links WHERE path IS NOT NULL GROUP BY path_id, path),
k AS (SELECT *, TRY_CAST(substr(version,2) AS BIGINT) AS v, regexp_extract(path,'[^/]*$') AS name,
CASE file_type WHEN 'local_file' THEN 1 WHEN 'OPENDAP' THEN 2 WHEN 'HTTPServer' THEN 3 WHEN 'GridFTP' THEN 4 WHEN 'FTPServer' THEN 5 WHEN 'soft_links_container' THEN 6 END AS t FROM c)"""

#: A checksum that identifies a file.
_REAL = "regexp_matches(lower(trim(checksum)), '^([0-9a-f]{32}|[0-9a-f]{64})$') AND replace(lower(trim(checksum)), lower(trim(checksum))[1], '') <> ''"


def _catalog(spark, sf) -> DataFrame:
    raw = catalog.unpack(table(spark, sf, "soft_links").where("path is not null"))
    one = raw.groupBy("path_id", "path").agg(*(F.min(c).alias(c) for c in ("version", "file_type", "data_node", "checksum")))
    return one.withColumns({"version": catalog.version_number(F.col("version")), "name": F.element_at(F.split("path", "/"), -1)})


@query("""WITH c AS (SELECT path_id, split_part(path,'|',1) AS path, min(TRY_CAST(substr(trim(version),2) AS BIGINT)) AS v, min(nullif(lower(trim(file_type)),'')) AS kind,
min(nullif(regexp_replace(regexp_replace(lower(trim(data_node)),'/+$',''),'^([a-z]+://[^/]*?):(80|443|21|2811)$','\\1'),'')) AS node FROM soft_links WHERE path IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, regexp_extract(path,'[^/]*$') AS name, list_position(['local_file','opendap','httpserver','gridftp','ftpserver','soft_links_container'], kind) AS t FROM c)
SELECT path_id, name, row_number() OVER (PARTITION BY name ORDER BY v DESC NULLS LAST, nullif(t, 0) NULLS LAST, node NULLS LAST, path, path_id) AS pref_rank FROM k""")
def rank_replicas(spark, sf):
    """Every path record: types and nodes in one spelling, what is missing or not listed last."""
    raw = catalog.unpack(table(spark, sf, "soft_links").where("path is not null"))
    columns = {"version": catalog.version_number(F.trim("version")), "file_type": paths.type_key(F.col("file_type")), "data_node": paths.node_key(F.col("data_node"))}
    one = raw.withColumns(columns).groupBy("path_id", "path").agg(*(F.min(c).alias(c) for c in columns)).withColumn("name", F.element_at(F.split("path", "/"), -1))
    kind = catalog.list_position(F.col("file_type"), [t.lower() for t in _TYPES], strict=False)
    order = [F.col("version").desc_nulls_last(), kind.asc_nulls_last(), F.col("data_node").asc_nulls_last(), F.col("path"), F.col("path_id")]
    ranked = catalog.rank(one, ["name"], order, bucket=F.coalesce(-F.col("version"), F.lit(2**62)))
    return ranked.select("path_id", "name", F.col("pref_rank").cast("long").alias("pref_rank"))


@query(f"WITH {_CATALOG} SELECT path_id, name, v AS version FROM k WHERE v = (SELECT max(v) FROM k q WHERE q.name = k.name)")
def latest_version(spark, sf):
    return catalog.latest(_catalog(spark, sf), ["name"]).select("path_id", "name", "version")


@query("""WITH p AS (SELECT DISTINCT split_part(path,'|',1) AS path, file_type FROM soft_links WHERE path IS NOT NULL AND file_type IS NOT NULL)
SELECT path, file_type, CASE WHEN file_type IN ('HTTPServer','OPENDAP','FTPServer','GridFTP') THEN array_to_string(string_split(path,'/')[1:3],'/')
WHEN file_type = 'local_file' THEN array_to_string(string_split(path,'/')[1:2],'/') WHEN file_type = 'soft_links_container' THEN 'soft_links_container' ELSE '' END AS node,
string_split(path,'/')[-1] AS name FROM p""")
def data_node(spark, sf):
    p = table(spark, sf, "soft_links").where("path is not null and file_type is not null").select(paths.packed_part(F.col("path"), 0).alias("path"), "file_type").distinct()
    return p.select("path", "file_type", paths.data_node(F.col("path"), F.col("file_type")).alias("node"), F.element_at(F.split("path", "/"), -1).alias("name"))


@query("""SELECT path_id, data_node, recorded_at::VARCHAR AS at FROM soft_links WHERE data_node IN ('http://dap.quartz.example','calc1:/data','http://dn1.cobalt.example')
AND NOT data_node IN ('http://dn1.cobalt.example')""")
def include_exclude_node(spark, sf):
    kept = table(spark, sf, "soft_links").where(select.included(F.col("data_node"), ["http://dap.quartz.example", "calc1:/data", "http://dn1.cobalt.example"], ["http://dn1.cobalt.example"]))
    return kept.select("path_id", "data_node", F.date_format("recorded_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT DISTINCT data_node FROM soft_links WHERE data_node IS NOT NULL")
def data_nodes(spark, sf):
    return table(spark, sf, "soft_links").where("data_node is not null").select("data_node").distinct()


@query(f"""WITH {_CATALOG}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY v DESC NULLS LAST, path_id) AS n FROM k), u AS (SELECT DISTINCT path FROM r WHERE n = 1),
m AS (SELECT DISTINCT name, checksum FROM k WHERE path IN (SELECT path FROM u) AND {_REAL})
SELECT k.path_id, k.name FROM k WHERE k.path IN (SELECT path FROM u) OR EXISTS (SELECT 1 FROM m WHERE m.name = k.name AND m.checksum = k.checksum)""")
def reduce_catalog(spark, sf):
    rows = _catalog(spark, sf)
    used = catalog.best_per_time(rows, ["name"], [F.col("version").desc_nulls_last(), F.col("path_id")]).select("path")
    return catalog.equivalents(rows, used).select("path_id", "name")


_FAILOVER = """WITH {catalog}, f AS (SELECT *, file_type IN ('OPENDAP','local_file') AND data_node <> 'http://esgn01.polaris.example' AND path_id % 3 <> 0 AS fit FROM k),
b AS (SELECT checksum, path_id, row_number() OVER (PARTITION BY checksum ORDER BY path_id) AS n FROM f WHERE fit AND checksum IS NOT NULL {strict})
SELECT f.path_id, CASE WHEN coalesce(f.fit, false) THEN f.path_id ELSE b.path_id END AS served_by FROM f LEFT JOIN b ON f.checksum = b.checksum AND b.n = 1"""


def _fail_over(spark, sf, strict: bool) -> DataFrame:
    rows = _catalog(spark, sf).withColumn("available", F.col("path_id") % 3 != 0)
    return catalog.fail_over(rows, ["OPENDAP", "local_file"], F.coalesce(F.col("data_node") != "http://esgn01.polaris.example", F.lit(False)), "path_id", ["path_id"], strict=strict)


@query(_FAILOVER.format(catalog=_CATALOG, strict=f"AND {_REAL}"))
def failover(spark, sf):
    return _fail_over(spark, sf, True)


@query(_FAILOVER.format(catalog=_CATALOG, strict=""))
def failover_loose_checksum(spark, sf):
    return _fail_over(spark, sf, False)


@query("""WITH a AS (SELECT data_node, units, regexp_extract(units,'since(.*)$',1) AS s FROM time_axis WHERE units IS NOT NULL AND data_node IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY data_node ORDER BY trim(s), units) AS n FROM a) SELECT data_node, units FROM r WHERE n = 1""")
def unify_units(spark, sf):
    return catalog.unify_units(table(spark, sf, "time_axis").where("units is not null and data_node is not null").select("data_node", "units"), ["data_node"])


@query("""WITH r AS (SELECT data_node, calendar, row_number() OVER (PARTITION BY data_node ORDER BY path_id, calendar) AS n, count(DISTINCT calendar) OVER (PARTITION BY data_node) AS calendars
FROM time_axis WHERE calendar IS NOT NULL AND data_node IS NOT NULL) SELECT data_node, calendar, calendars FROM r WHERE n = 1""")
def unify_calendar(spark, sf):
    return catalog.unify_calendar(table(spark, sf, "time_axis").where("calendar is not null and data_node is not null"), ["data_node"], ["path_id"])


@query("""WITH n AS (SELECT event_type, count(*) AS c FROM events GROUP BY 1), r AS (SELECT event_type, row_number() OVER (ORDER BY c DESC, event_type) AS id FROM n)
SELECT event_id, id AS dimension_type_id FROM events JOIN r USING (event_type)""")
def majority_dimension_type(spark, sf):
    return catalog.majority_rank(table(spark, sf, "events"), "event_type").select("event_id", F.col("dimension_type_id").cast("long").alias("dimension_type_id"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'download' WHEN doc_id % 4 = 1 THEN 'skip' WHEN doc_id % 4 = 2 THEN 'skip' ELSE 'delete' END AS status FROM documents WHERE text IS NOT NULL""")
def download_status(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    kind, real = F.col("doc_id") % 4, F.md5("text")
    expected = F.when(kind == 1, F.lit("")).when(kind == 2, F.upper(real)).otherwise(F.lit("0"))
    return d.select("doc_id", catalog.download_status(kind != 0, expected, real).alias("status"))


@query("SELECT path_id, '/out/CMIP/' || coalesce(version, 'none') || '/' || string_split(split_part(path,'|',1),'/')[-1] AS target FROM soft_links WHERE path IS NOT NULL")
def download_destination(spark, sf):
    p = table(spark, sf, "soft_links").where("path is not null")
    target = catalog.destination("/out/{tree}/{version}", F.lit("CMIP"), F.lit("tas"), F.coalesce("version", F.lit("none")), paths.packed_part(F.col("path"), 0))
    return p.select("path_id", target.alias("target"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def checksum(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", digest(F.col("text"), "MD5").alias("md5"), digest(F.col("text"), "SHA256").alias("sha256"))


@query("""SELECT 'part' || p_size AS var, CAST(CASE WHEN p_size = 0 THEN 1 ELSE p_size END * 3 AS BIGINT) AS elements FROM (SELECT DISTINCT p_size FROM part)""")
def variables_by_size(spark, sf):
    shapes = table(spark, sf, "part").select("p_size").distinct().select(F.concat(F.lit("part"), F.col("p_size")).alias("var"), F.array(F.col("p_size"), F.lit(3), F.lit(0)).alias("shape"))
    return catalog.variables_by_size(shapes)


# ---------------------------------------------------------------- links and retrieval

_PREF = {"purchase": 1, "signup": 2, "view": 3, "click": 4}
_LINKS = """ft AS (SELECT event_type AS file, date_trunc('hour', ts) AS t, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx,
CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 WHEN 'click' THEN 4 ELSE 5 END AS pref FROM events),
links AS (SELECT t, file, idx, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY pref, idx) AS rn FROM ft) r WHERE rn = 1)"""


def _file_times(spark, sf) -> tuple[DataFrame, DataFrame]:
    from weftline.operators.ranking import positions

    events = table(spark, sf, "events")
    placed = positions(events, ["ts", "event_id"], F.unix_date(F.to_date("ts")).cast("long"), ["event_type"], "idx")
    times = placed.select(F.col("event_type").alias("file"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t"), "idx", "event_id", "value")
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in _PREF.items() for x in kv)), F.col("file")), F.lit(5))
    return times, events.select(F.col("event_type").alias("file")).distinct().withColumn("pref", rank)


@query(f"WITH {_LINKS} SELECT strftime(t,'%Y-%m-%d %H:%M:%S') AS at, file, idx FROM links")
def build_links(spark, sf):
    times, files = _file_times(spark, sf)
    return links.build_links(times, files, [], "t", "file", ["pref"]).select(_ts("t").alias("at"), "file", "idx")


@query(f"WITH {_LINKS} SELECT strftime(t,'%Y-%m-%d %H:%M:%S') AS at, file, event_id FROM links")
def best_replica_per_time(spark, sf):
    times, files = _file_times(spark, sf)
    return catalog.best_per_time(times.join(files, "file"), ["t"], ["pref", "idx"]).select(_ts("t").alias("at"), "file", "event_id")


@query(f"WITH {_LINKS} SELECT DISTINCT file FROM links")
def useful_files(spark, sf):
    times, files = _file_times(spark, sf)
    return catalog.useful(times.join(files, "file"), ["t"], "file", "pref")


@query(f"""WITH {_LINKS}, mask AS (SELECT t, max(CASE WHEN hour(t) BETWEEN 6 AND 11 THEN 1 ELSE 0 END) OVER (ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS keep FROM links)
SELECT strftime(l.t,'%Y-%m-%d %H:%M:%S') AS at, l.file, l.idx, l.event_id, l.value FROM links l JOIN mask m ON l.t = m.t WHERE m.keep = 1""")
def retrieve_window(spark, sf):
    times, files = _file_times(spark, sf)
    made = links.build_links(times, files, [], "t", "file", ["pref"])
    kept = select.previous_next(made.select("t"), "t", select.time_mask("t", hours=[6, 7, 8, 9, 10, 11]), 1, 1)
    got = links.retrieve(made, kept, times.select("file", "idx", "event_id", "value"), [], "t", ["file", "idx"])
    return got.select(_ts("t").alias("at"), "file", "idx", "event_id", "value")


@query(f"""WITH {_CATALOG}, b AS (SELECT checksum, arg_min(file_type, CASE file_type WHEN 'local_file' THEN 1 WHEN 'soft_links_container' THEN 2 ELSE 3 END) AS better FROM k
WHERE file_type IN ('local_file','soft_links_container','OPENDAP') AND {_REAL} GROUP BY 1), j AS (SELECT k.path_id, k.file_type, b.better FROM k LEFT JOIN b ON b.checksum = k.checksum)
SELECT path_id, 'download_files' AS kind FROM j WHERE file_type IN ('FTPServer','HTTPServer','GridFTP') AND coalesce(better,'') NOT IN ('OPENDAP','local_file','soft_links_container')
UNION ALL SELECT path_id, 'download_opendap' FROM j WHERE file_type = 'OPENDAP' AND coalesce(better,'') NOT IN ('local_file','soft_links_container')
UNION ALL SELECT path_id, 'load' FROM j WHERE file_type IN ('local_file','soft_links_container')""")
def retrieval_types(spark, sf):
    """The better type is that of the row's best available replica, by checksum, as in the download commands."""
    rows = _catalog(spark, sf).withColumns({"row": F.struct("path_id", "path"), "available": F.lit(True)})
    gated = rows.select("row", "path_id", "file_type").join(catalog.better_type(rows, F.lit(True), "row"), "row")
    parts = [select.retrieval_gate(gated, k).select("path_id", F.lit(k).alias("kind")) for k in ("download_files", "download_opendap", "load")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {_CATALOG}, l AS (SELECT *, max(v) OVER (PARTITION BY name) AS top FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY t, path_id) AS n FROM l
WHERE v = top AND t IN (1,2,6) AND path_id % 5 <> 0) SELECT name, path_id FROM r WHERE n = 1""")
def fixed_replica(spark, sf):
    rows = _catalog(spark, sf).withColumn("available", F.col("path_id") % 5 != 0)
    order = [catalog.list_position(F.col("file_type"), _TYPES, strict=False), F.col("path_id")]
    return links.fixed_replica(rows, ["name"], order, ["OPENDAP", "local_file", "soft_links_container"]).select("name", "path_id")


# ---------------------------------------------------------------- coordinates and slices


def _match(spark, sf, shift: float) -> DataFrame:
    s = table(spark, sf, "supplier")
    source, wanted = s.select(F.col("s_suppkey").alias("idx"), F.col("s_acctbal").alias("value")), s.select(F.col("s_suppkey").alias("pos"), (F.col("s_acctbal") + shift).alias("value"))
    return align.match(source, wanted)


@query("""WITH s AS (SELECT s_acctbal AS v, min(s_suppkey) AS idx FROM supplier GROUP BY 1) SELECT r.s_suppkey AS pos, s.idx FROM supplier r JOIN s ON r.s_acctbal = s.v""")
def match_exact(spark, sf):
    return _match(spark, sf, 0.0)


@query("""WITH s AS (SELECT s_suppkey AS idx, s_acctbal AS a FROM supplier), r AS (SELECT s_suppkey AS pos, s_acctbal + 1e-6 AS b FROM supplier),
p AS (SELECT * FROM s JOIN r ON a BETWEEN b - 1e-3 - 1e-4*abs(b) AND b + 1e-3 + 1e-4*abs(b)), c AS (SELECT DISTINCT idx FROM p WHERE abs(a-b) <= 1e-5 + 1e-5*abs(a))
SELECT pos, min(idx) AS idx FROM p WHERE abs(a-b) <= 1e-5 + 1e-5*abs(b) AND idx IN (SELECT idx FROM c) GROUP BY pos""")
def match_fuzzy(spark, sf):
    return _match(spark, sf, 1e-6)


_INDICES = "i AS (SELECT DISTINCT o_custkey AS i FROM orders WHERE o_custkey % 5 <> 0)"


def _indices(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").where("o_custkey % 5 <> 0").select(F.col("o_custkey").alias("idx")).distinct()


@query(f"WITH {_INDICES}, g AS (SELECT i, i - row_number() OVER (ORDER BY i) AS g FROM i) SELECT min(i) AS start, max(i) + 1 AS stop, CAST(1 AS BIGINT) AS step FROM g GROUP BY g")
def to_slices(spark, sf):
    return align.to_slices(_indices(spark, sf))


#: As consecutive indices of one value of index - step * place.
_RUNS = "p AS (SELECT i, i - {step} * row_number() OVER (ORDER BY i) AS k FROM i), g AS (SELECT i, k, CASE WHEN k = lag(k) OVER (ORDER BY i) THEN 0 ELSE 1 END AS b FROM p)"


@query(f"WITH {_INDICES}, {_RUNS.format(step=2)}, r AS (SELECT i, sum(b) OVER (ORDER BY i) AS run FROM g) SELECT min(i) AS start, max(i) + 1 AS stop, CAST(2 AS BIGINT) AS step FROM r GROUP BY run")
def to_slices_step(spark, sf):
    return align.to_slices(_indices(spark, sf), step=2)


@query(f"""WITH {_INDICES}, d AS (SELECT DISTINCT greatest(1, i - lag(i) OVER (ORDER BY i)) AS step FROM i), n AS (SELECT i, row_number() OVER (ORDER BY i) AS p FROM i),
k AS (SELECT step, i, i - step * p AS k FROM n, d WHERE step IS NOT NULL), b AS (SELECT step, CASE WHEN k = lag(k) OVER (PARTITION BY step ORDER BY i) THEN 0 ELSE 1 END AS b FROM k)
SELECT step, CAST(sum(b) AS BIGINT) AS slices FROM b GROUP BY step ORDER BY slices, step LIMIT 1""")
def optimal_step(spark, sf):
    return align.optimal_step(_indices(spark, sf))


@query(f"WITH {_INDICES}, w AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_custkey % 5 <> 0) SELECT c AS pos, row_number() OVER (ORDER BY c) - 1 AS place FROM w")
def prepare_indices(spark, sf):
    wanted = _indices(spark, sf)
    return align.prepare_indices(wanted.withColumn("pos", F.col("idx")))[1]


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place FROM orders")
def inverse_permutation(spark, sf):
    return align.inverse_permutation(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], F.floor(F.col("o_totalprice") / 1000)).select("o_orderkey", "place")


@query("SELECT vec_id, CAST(embedding[4] AS DOUBLE) AS a, CAST(embedding[64] AS DOUBLE) AS b, CAST(NULL AS DOUBLE) AS c FROM embeddings")
def take_masked(spark, sf):
    got = align.take(F.col("embedding"), F.array(F.lit(3), F.lit(63), F.lit(64)))
    return table(spark, sf, "embeddings").select("vec_id", *(got[i].cast("double").alias(n) for i, n in enumerate("abc")))


@query("""SELECT vec_id, r * 10 + c AS cell, CAST(embedding[r * 8 + c + 1] AS DOUBLE) AS value FROM embeddings, (SELECT unnest([1,3,6]) AS r), (SELECT unnest([0,7]) AS c)""")
def hyperslab(spark, sf):
    rows, columns = F.array(F.lit(1), F.lit(3), F.lit(6)), F.array(F.lit(0), F.lit(7))
    slab = table(spark, sf, "embeddings").select("vec_id", align.hyperslab(F.col("embedding"), 8, rows, columns).alias("value"))
    cell = F.element_at(F.array(*(F.lit(r * 10 + c) for r in (1, 3, 6) for c in (0, 7))), F.col("cell") + 1)
    return align.to_long(slab, ["vec_id"]).select("vec_id", cell.cast("long").alias("cell"), F.col("value").cast("double").alias("value"))


@query("""SELECT o_orderkey, 100 + (o_custkey % 5) * 2 * (1 + o_custkey % 3) AS start, CAST(160 AS BIGINT) AS stop, 2 * (1 + o_custkey % 3) AS step FROM orders""")
def slice_of_slice(spark, sf):
    first = F.struct(F.lit(100).cast("long").alias("start"), F.lit(200).cast("long").alias("stop"), F.lit(2).cast("long").alias("step"))
    k = 1 + F.col("o_custkey") % 3
    second = F.struct((F.col("o_custkey") % 5 * k).alias("start"), F.lit(30).cast("long").alias("stop"), k.alias("step"))
    return table(spark, sf, "orders").select("o_orderkey", align.slice_a_slice(first, second).alias("s")).select("o_orderkey", "s.start", "s.stop", "s.step")


@query("""SELECT o_orderkey, range(100, 200, 1 + o_custkey % 7)[1 + o_custkey % 40] AS at, range(100, 200, 1 + o_custkey % 7)[-1 - o_custkey % 40] AS back,
CAST(list_sum([10, 20, 30, 40, 50, 60][1 + o_custkey % 3 : : 2]) AS BIGINT) AS of_index FROM orders""")
def index_and_slice(spark, sf):
    """The index at a place of a slice, from its start and from its end, and what a slice takes of given indices."""
    one = lambda a, b, s: F.struct(a.cast("long").alias("start"), b.cast("long").alias("stop"), s.cast("long").alias("step"))
    c = F.col("o_custkey")
    s = one(F.lit(100), F.lit(200), 1 + c % 7)
    taken = align.slice_of_index(F.array(*(F.lit(x) for x in (10, 20, 30, 40, 50, 60))), one(c % 3, F.lit(6), F.lit(2)))
    total = F.aggregate(taken, F.lit(0).cast("long"), lambda a, x: a + x)
    return table(spark, sf, "orders").select("o_orderkey", align.index_of_slice(s, c % 40).alias("at"), align.index_of_slice(s, -1 - c % 40).alias("back"), total.alias("of_index"))


@query("""SELECT vec_id, 100 * a + 10 * b + c AS cell, CAST(embedding[a * 16 + b * 4 + c + 1] AS DOUBLE) AS value FROM embeddings, (SELECT unnest([3, 0]) AS a), (SELECT unnest([1, 2]) AS b), (SELECT unnest([0, 3]) AS c)""")
def gather_cells(spark, sf):
    """Embeddings as 4 x 4 x 4 cells."""
    places = (3, 0), (1, 2), (0, 3)
    got = align.gather(F.col("embedding"), [4, 4, 4], [F.array(*map(F.lit, p)) for p in places])
    names = F.array(*(F.lit(100 * a + 10 * b + c) for a in places[0] for b in places[1] for c in places[2]))
    cells = align.to_long(table(spark, sf, "embeddings").select("vec_id", got.alias("value")), ["vec_id"])
    return cells.select("vec_id", F.element_at(names, F.col("cell") + 1).cast("long").alias("cell"), F.col("value").cast("double").alias("value"))


@query("""SELECT grid_id, n AS i, j, point_id FROM subset_points JOIN (SELECT unnest([7, 2, 4]) AS i, unnest([0, 1, 2]) AS n) w USING (i)""")
def gather_rows(spark, sf):
    """Rows of every grid, by their place in it, in the order asked for."""
    cells = table(spark, sf, "subset_points").select("grid_id", "i", "j", "point_id")
    wanted = spark.createDataFrame([(0, 7), (1, 2), (2, 4)], "pos long, idx int")
    return align.gather_long(cells, ["grid_id", "i", "j"], {"i": wanted})


@query("""SELECT p_partkey, a AS start, least(a + greatest(1, 1000 // p_size), 100) AS stop FROM (SELECT p_partkey, p_size, unnest(range(0, 100, greatest(1, 1000 // p_size))) AS a FROM part)""")
def request_chunks(spark, sf):
    cuts = align.request_chunks(F.lit(100), F.col("p_size"), 1000)
    return table(spark, sf, "part").select("p_partkey", F.explode(cuts).alias("c")).select("p_partkey", "c.start", F.col("c.stop").cast("long").alias("stop"))


# ---------------------------------------------------------------- merges

_BASE = "b AS (SELECT o_orderkey AS k, o_totalprice AS v, o_orderkey AS pos FROM orders WHERE o_custkey % 3 <> 0)"


def _halves(spark, sf, value: F.Column) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders")
    base = o.where("o_custkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("pos"))
    return base, o.where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("k"), value.alias("v"), F.col("o_orderkey").alias("pos"))


def _append_sql(value: str, guard: str) -> str:
    return f"""WITH {_BASE}, n AS (SELECT o_orderkey AS k, {value} AS v, o_orderkey AS pos FROM orders WHERE o_custkey % 2 = 0), e AS (SELECT bool_and(v IS NULL) AS block_empty FROM n)
SELECT coalesce(b.k, n.k) AS k, CASE WHEN b.k IS NOT NULL THEN b.pos ELSE (SELECT max(pos) FROM b) + row_number() OVER (PARTITION BY b.k IS NULL ORDER BY n.pos) END AS pos,
CASE WHEN n.k IS NOT NULL AND {guard} THEN n.v ELSE b.v END AS v FROM b FULL JOIN n ON b.k = n.k, e"""


@query(_append_sql("o_totalprice * 2", "true"))
def append_upsert(spark, sf):
    return merge.append(*_halves(spark, sf, F.col("o_totalprice") * 2), ["k"], ["v"])


@query(_append_sql("CAST(NULL AS DOUBLE)", "NOT block_empty"))
def append_check_empty(spark, sf):
    return merge.append(*_halves(spark, sf, F.lit(None).cast("double")), ["k"], ["v"], check_empty=True)


@query(_append_sql("CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice END", "NOT block_empty"))
def append_check_mixed(spark, sf):
    return merge.append(*_halves(spark, sf, F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice"))), ["k"], ["v"], check_empty=True)


@query(_append_sql("CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice END", "n.v IS NOT NULL"))
def append_check_rows(spark, sf):
    return merge.append(*_halves(spark, sf, F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice"))), ["k"], ["v"], check_empty=True, granularity="row")


@query(f"""WITH {_CATALOG}, b AS (SELECT path, min(path_id) AS path_id, 'old' AS side FROM k WHERE path_id % 3 <> 0 GROUP BY path), n AS (SELECT path, min(path_id) AS path_id, 'new' AS side FROM k WHERE path_id % 2 = 0 GROUP BY path)
SELECT * FROM n UNION ALL SELECT * FROM b WHERE path NOT IN (SELECT path FROM n)""")
def append_catalog(spark, sf):
    rows = _catalog(spark, sf)
    half = lambda where, side: rows.where(where).groupBy("path").agg(F.min("path_id").alias("path_id")).withColumn("side", F.lit(side))
    return merge.append_catalog(half("path_id % 3 <> 0", "old"), half("path_id % 2 = 0", "new"))


@query(f"""WITH {_CATALOG}, b AS (SELECT path, min(path_id) AS path_id FROM k WHERE path_id % 3 <> 0 GROUP BY path), n AS (SELECT path, min(path_id) + 1000000000 AS path_id FROM k WHERE path_id % 2 = 0 GROUP BY path)
SELECT path, path_id FROM b UNION ALL SELECT path, path_id FROM n WHERE path NOT IN (SELECT path FROM b)""")
def add_path_if_absent(spark, sf):
    rows = _catalog(spark, sf)
    base = rows.where("path_id % 3 <> 0").groupBy("path").agg(F.min("path_id").alias("path_id"))
    new = rows.where("path_id % 2 = 0").groupBy("path").agg((F.min("path_id") + 1_000_000_000).alias("path_id"))
    none = spark.createDataFrame([], "path_id long, idx long")
    return links.add_path(base, new, none, spark.createDataFrame([], "old_id long, path string"))[0].select("path", "path_id")


@query("""SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'base' ELSE 'new' END AS units, CASE WHEN n_nationkey % 3 = 0 THEN 'extra' END AS extra FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0""")
def attrs_union(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    base = n.where("k % 2 = 0").withColumn("attributes", F.create_map(F.lit("units"), F.lit("base")))
    new = n.where("k % 3 = 0").withColumn("attributes", F.create_map(F.lit("units"), F.lit("new"), F.lit("extra"), F.lit("extra"), F.lit("temporary"), F.lit("x")))
    a = merge.attributes_union(base, new, ["k"], skip="temporary")
    return a.select("k", F.try_element_at("attributes", F.lit("units")).alias("units"), F.try_element_at("attributes", F.lit("extra")).alias("extra"))


@query("SELECT DISTINCT n_regionkey AS dim FROM nation WHERE n_nationkey % 10 = 3")
def dimension_compatibility(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("dim"), F.col("n_nationkey").alias("idx"), F.col("n_nationkey").cast("double").alias("value"))
    return merge.incompatible_dimensions(n, n.withColumn("value", F.when(F.col("idx") % 10 == 3, F.col("value") + 1).otherwise(F.col("value"))), ["dim"])


@query("""WITH b AS (SELECT o_orderkey % 400 AS d, max(o_totalprice) AS v FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1), n AS (SELECT o_orderkey % 500 AS d, min(o_totalprice) AS v FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1)
SELECT CAST(coalesce(b.d, n.d) AS DOUBLE) AS t, coalesce(n.v, b.v) AS v, CASE WHEN b.d IS NOT NULL THEN b.d ELSE (SELECT max(d) FROM b) + row_number() OVER (PARTITION BY b.d IS NULL ORDER BY n.d) END AS pos FROM b FULL JOIN n ON b.d = n.d""")
def append_times(spark, sf):
    """A base in days; what is appended counts hours from another day."""
    o = table(spark, sf, "orders")
    base = o.where("o_custkey % 3 <> 0").groupBy((F.col("o_orderkey") % 400).alias("pos")).agg(F.max("o_totalprice").alias("v")).withColumn("t", F.col("pos").cast("double"))
    new = o.where("o_custkey % 2 = 0").groupBy((F.col("o_orderkey") % 500).alias("pos")).agg(F.min("o_totalprice").alias("v")).withColumn("t", (F.col("pos") - 10).cast("double") * 24)
    return merge.append_times(base, new, "t", ["v"], "days since 1850-01-01", "hours since 1850-01-11").select("t", "v", "pos")


@query("""SELECT o_orderkey AS k, o_totalprice AS v, NULL AS side FROM orders WHERE o_custkey % 3 = 0 UNION ALL SELECT o_orderkey, NULL, 'new' FROM orders WHERE o_custkey % 2 = 0""")
def concatenate(spark, sf):
    o = table(spark, sf, "orders")
    a = o.where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return merge.concatenate([a, o.where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.lit("new").alias("side"))])


@query("""SELECT DISTINCT file_type FROM soft_links WHERE data_node LIKE '%quartz%' AND file_type IN (SELECT file_type FROM soft_links WHERE data_node LIKE '%cobalt%')""")
def common_types(spark, sf):
    links_ = table(spark, sf, "soft_links")
    return merge.common(links_.where("data_node like '%quartz%'"), links_.where("data_node like '%cobalt%'"), "file_type")


@query("""SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS place FROM orders""")
def unique_with_inverse(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return align.unique_with_inverse(o, "o_custkey", F.floor(F.col("o_custkey") / 1000))[1].select("o_orderkey", "place")


# ---------------------------------------------------------------- calendars


@query("SELECT l_orderkey, l_linenumber, strftime(l_shipdate,'%Y-%m-%d %H:%M:%S') AS at FROM lineitem")
def decode_days(spark, sf):
    items = table(spark, sf, "lineitem").withColumn("n", F.datediff("l_shipdate", F.lit("1850-01-01").cast("date")).cast("double"))
    return cftime.with_decoded(items, "n", "days since 1850-01-01").select("l_orderkey", "l_linenumber", cftime.date_print(F.col("cf")).alias("at"))


_NUMBERS = "n AS (SELECT DISTINCT o_custkey * 37 AS n FROM orders)"


def _numbers(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select((F.col("o_custkey") * 37).alias("n")).distinct()


@query(f"""WITH {_NUMBERS}, d AS (SELECT n, 2001 + n // 365 AS y, n % 365 AS d FROM n) SELECT n, y * 10000 + month(DATE '2001-01-01' + CAST(d AS INTEGER)) * 100 + day(DATE '2001-01-01' + CAST(d AS INTEGER)) AS ymd FROM d""")
def decode_noleap(spark, sf):
    return cftime.with_decoded(_numbers(spark, sf), "n", "days since 2001-01-01", "noleap").select("n", _ymd(F.col("cf")).alias("ymd"))


@query(f"""WITH {_NUMBERS}, d AS (SELECT n, 2000 + n // 366 AS y, n % 366 AS d FROM n) SELECT n, y * 10000 + month(DATE '2000-01-01' + CAST(d AS INTEGER)) * 100 + day(DATE '2000-01-01' + CAST(d AS INTEGER)) AS ymd FROM d""")
def decode_all_leap(spark, sf):
    return cftime.with_decoded(_numbers(spark, sf), "n", "days since 2000-01-01", "all_leap").select("n", _ymd(F.col("cf")).alias("ymd"))


@query(f"WITH {_NUMBERS} SELECT n, (1850 + n // 360) * 10000 + (n % 360 // 30 + 1) * 100 + n % 30 + 1 AS ymd FROM n")
def decode_360(spark, sf):
    return cftime.with_decoded(_numbers(spark, sf), "n", "days since 1850-01-01", "360_day").select("n", _ymd(F.col("cf")).alias("ymd"))


@query(f"""WITH {_NUMBERS}, d AS (SELECT n, n // 1461 AS c, n % 1461 AS r FROM n), e AS (SELECT n, c, least(r // 365, 3) AS y, r - 365 * least(r // 365, 3) AS d FROM d)
SELECT n, (1 + 4 * c + y) * 10000 + month(b + CAST(d AS INTEGER)) * 100 + day(b + CAST(d AS INTEGER)) AS ymd FROM (SELECT *, CASE WHEN y = 3 THEN DATE '2004-01-01' ELSE DATE '2001-01-01' END AS b FROM e)""")
def decode_julian(spark, sf):
    return cftime.with_decoded(_numbers(spark, sf), "n", "days since 0001-01-01", "julian").select("n", _ymd(F.col("cf")).alias("ymd"))


def _ymd(cf: F.Column) -> F.Column:
    return (cf["year"] * 10000 + cf["month"] * 100 + cf["day"]).cast("long")


@query("SELECT o_orderkey, CAST(date_diff('day', TIMESTAMP '1970-01-01', o_orderdate) AS DOUBLE) AS n FROM orders")
def encode_days(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", cftime.encode(cftime.fields_of_timestamp(F.col("o_orderdate")), "days since 1970-01-01", "proleptic_gregorian").alias("n"))


@query("""SELECT o_orderkey, strftime(TIMESTAMP '1990-01-01' + to_months(CAST(o_custkey % 500 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS at FROM orders""")
def months_since(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 500).cast("double").alias("n"))
    return cftime.with_decoded(o, "n", "months since 1990-01-01").select("o_orderkey", cftime.date_print(F.col("cf")).alias("at"))


@query("""WITH a AS (SELECT o_orderkey, o_orderdate AS t, CASE WHEN day(o_orderdate) = 1 THEN date_trunc('month', o_orderdate) ELSE date_trunc('month', o_orderdate) + INTERVAL 1 MONTH END AS nx FROM orders)
SELECT o_orderkey, round(date_diff('month', TIMESTAMP '1990-01-01', nx) - date_diff('day', t, nx) / CAST(date_diff('day', nx, nx + INTERVAL 1 MONTH) AS DOUBLE), 9) AS n FROM a""")
def encode_months(spark, sf):
    n = cftime.encode(cftime.fields_of_timestamp(F.col("o_orderdate")), "months since 1990-01-01", "standard")
    return table(spark, sf, "orders").select("o_orderkey", F.round(n, 9).alias("n"))


@query("SELECT l_orderkey, l_linenumber, strftime(l_shipdate + INTERVAL 12 HOUR,'%Y-%m-%d %H:%M:%S') AS at FROM lineitem")
def absolute_time(spark, sf):
    d = F.col("l_shipdate")
    items = table(spark, sf, "lineitem").withColumn("n", (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("double") + 0.5)
    return items.select("l_orderkey", "l_linenumber", cftime.date_print(cftime.decode(F.col("n"), "day as %Y%m%d.%f")).alias("at"))


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate,'%Y') WHEN 1 THEN strftime(o_orderdate,'%Y%m') ELSE strftime(o_orderdate,'%Y%m%d') END AS s FROM orders)
SELECT o_orderkey, rpad(CASE length(s) WHEN 4 THEN s || '0101' WHEN 6 THEN s || '01' ELSE s END, 14, '0') AS padded FROM t""")
def pad_timestamp(spark, sf):
    k, d = F.col("o_orderkey") % 3, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(d, "yyyy")).when(k == 1, F.date_format(d, "yyyyMM")).otherwise(F.date_format(d, "yyyyMMdd"))
    return table(spark, sf, "orders").select("o_orderkey", cftime.pad_timestamp(text).alias("padded"))


@query("""WITH n AS (SELECT DISTINCT regexp_extract(replace(regexp_replace(regexp_extract(trim(regexp_replace(split_part(path,'|',1),'[?#].*$','')),'[^/]*$'),'\\.nc.*$','','i'),'%5F','_'),'_([0-9]{4,14})[-_]([0-9]{4,14})(-clim)?$',1) AS b FROM soft_links WHERE path IS NOT NULL)
SELECT b AS begin, rpad(CASE length(b) WHEN 4 THEN b || '0101' WHEN 6 THEN b || '01' ELSE b END, 14, '0') AS padded FROM n WHERE b <> ''""")
def dates_from_filename(spark, sf):
    begin = F.regexp_extract(paths.stem(F.col("path")), paths.PERIOD, 1)
    return table(spark, sf, "soft_links").where("path is not null").select(begin.alias("begin")).distinct().where("begin <> ''").select("begin", cftime.pad_timestamp(F.col("begin")).alias("padded"))


@query(r"SELECT event_id, CAST(regexp_extract(CAST(value AS VARCHAR), '^-?[0-9]+(\.[0-9]{0,3})?') AS DOUBLE) AS cut FROM events WHERE value IS NOT NULL")
def truncate_decimals(spark, sf):
    return table(spark, sf, "events").where("value is not null").select("event_id", cftime.truncate(F.col("value"), 3).alias("cut"))


@query("""WITH n AS (SELECT path_id, count(*) AS n FROM time_axis WHERE path_id IS NOT NULL GROUP BY 1) SELECT path_id, i, i + 0.5::DOUBLE AS day, i * 6::DOUBLE AS six FROM (SELECT path_id, unnest(range(n)) AS i FROM n)""")
def rebuild_axis(spark, sf):
    """An axis of as many steps as each path has."""
    n = table(spark, sf, "time_axis").where("path_id is not null").groupBy("path_id").agg(F.count("*").cast("int").alias("n"))
    made = n.select("path_id", cftime.axis_numbers(F.col("n"), "day", F.lit(0.0), False).alias("a"), cftime.axis_numbers(F.col("n"), "6hr", F.lit(0.0), False).alias("b"))
    zipped = made.select("path_id", F.posexplode(F.arrays_zip("a", "b")).alias("i", "z"))
    return zipped.select("path_id", F.col("i").cast("long").alias("i"), F.col("z.a").alias("day"), F.col("z.b").alias("six"))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), k AS (SELECT d, date_diff('day', DATE '1900-01-01', d) % 4 AS k FROM d)
SELECT strftime(d, '%Y%m%d') AS file, CASE k WHEN 0 THEN '000' WHEN 1 THEN '003' WHEN 2 THEN '001' ELSE '005,000,002' END AS control, strftime(d, '%Y-%m-%d') || ' 00:00:00' AS start,
CAST(10 AS BIGINT) AS steps, CASE WHEN k IN (0, 2) THEN true END AS bnds FROM k""")
def axis_audit(spark, sf):
    """Daily axes of ten days, one from each day with an order, with a fault by its number modulo 4."""
    d = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    n, k = F.datediff("d", F.lit("1850-01-01").cast("date")).cast("double"), F.datediff("d", F.lit("1900-01-01").cast("date")) % 4
    steps = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: n + i + F.when((k == 2) & (i == 4), 0.75).otherwise(0.5))
    bounds = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.array(n + i, n + i + 1))
    files = d.select(
        F.date_format("d", "yyyyMMdd").alias("file"), F.date_format("d", "yyyyMMdd").alias("begin"), F.date_format(F.date_add("d", F.when(k == 1, 10).otherwise(9)), "yyyyMMdd").alias("until"),
        F.when(k == 3, "days since 1900-1-1").otherwise("days since 1850-01-01").alias("units"), steps.alias("time"), F.when(k != 3, bounds).alias("time_bnds"),
    )
    done = audit.axis_audit(files, "day", "days since 1850-01-01", "proleptic_gregorian", False)
    return done.select("file", F.array_join("control", ",").alias("control"), "start", "steps", "bnds")


# ---------------------------------------------------------------- grids

_POINTS = "p AS (SELECT c_custkey AS k, CAST(c_custkey % 181 - 90 AS DOUBLE) AS lat, CAST(c_custkey * 7 % 720 - 180 AS DOUBLE) AS lon FROM customer)"


def _points(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("k"), (k % 181 - 90).cast("double").alias("lat"), (k * 7 % 720 - 180).cast("double").alias("lon"))


_MOD = "((lon % 360) + 360) % 360"


@query(f"WITH {_POINTS} SELECT k FROM p WHERE {_MOD} >= 20 AND {_MOD} <= 100 AND lat >= -30 AND lat <= 45")
def box_mask(spark, sf):
    return _points(spark, sf).where(geo.in_box(F.col("lat"), F.col("lon"), (20, 100, -30, 45))).select("k")


@query(f"WITH {_POINTS} SELECT k FROM p WHERE NOT ({_MOD} >= 15 AND {_MOD} <= 340) AND lat >= -30 AND lat <= 45")
def box_wrapped(spark, sf):
    return _points(spark, sf).where(geo.in_box(F.col("lat"), F.col("lon"), (-20, 15, -30, 45))).select("k")


@query(f"WITH {_POINTS} SELECT k FROM p WHERE NOT ({_MOD} >= 179.999999 AND {_MOD} <= 180) AND lat >= 0 AND lat <= 10")
def box_circle(spark, sf):
    return _points(spark, sf).where(geo.in_box(F.col("lat"), F.col("lon"), (-180, 180, 0, 10))).select("k")


_GRID = "g AS (SELECT grid_id, i, j, lat, lon FROM subset_points WHERE lat BETWEEN -90 AND 90 AND lon < 1e19 AND NOT isnan(lat) AND NOT isnan(lon))"


def _grid(spark, sf) -> DataFrame:
    return table(spark, sf, "subset_points").where("lat between -90 and 90 and lon < 1e19 and not isnan(lat) and not isnan(lon)").select("grid_id", "i", "j", "lat", "lon")


@query(f"""WITH {_GRID}, h AS (SELECT * FROM g WHERE {_MOD} >= 30 AND {_MOD} <= 60 AND lat >= 10 AND lat <= 12), a AS (SELECT DISTINCT grid_id FROM h)
SELECT grid_id, i, j FROM g WHERE (grid_id, i) IN (SELECT grid_id, i FROM h) AND (grid_id, j) IN (SELECT grid_id, j FROM h) OR grid_id NOT IN (SELECT grid_id FROM a)""")
def outer_product_subset(spark, sf):
    grid = _grid(spark, sf)
    return geo.outer_product_subset(grid, geo.in_box(F.col("lat"), F.col("lon"), (30, 60, 10, 12)), ["grid_id"]).select("grid_id", "i", "j")


@query("""SELECT n_nationkey AS k, c AS corner, CAST(n_nationkey * 3 - 36 + CASE WHEN c IN (1,3) THEN 3 ELSE 0 END AS DOUBLE) AS lat, CAST((n_nationkey * 14 + CASE WHEN c >= 2 THEN 14 ELSE 0 END) % 360 AS DOUBLE) AS lon FROM nation, range(0, 4) g(c)""")
def vertices_from_bounds(spark, sf):
    k = F.col("n_nationkey")
    lat, lon = F.array(k * 3.0 - 36, k * 3.0 - 33), F.array(k * 14.0, k * 14.0 + 14)
    corners = table(spark, sf, "nation").select(k.alias("k"), F.posexplode(geo.bounds_vertices(lat, lon)).alias("corner", "v"))
    return corners.select("k", F.col("corner").cast("long").alias("corner"), "v.lat", "v.lon")


@query(f"WITH {_POINTS} SELECT k, round(cos(radians(lat)) * cos(radians(lon)), 6) + 0.0 AS x, round(cos(radians(lat)) * sin(radians(lon)), 6) + 0.0 AS y, round(sin(radians(lat)), 6) + 0.0 AS z, round(lat, 6) AS lat_back FROM p")
def spherical(spark, sf):
    p = _points(spark, sf).withColumn("v", geo.to_cartesian(F.col("lat"), F.col("lon")))
    rounded = lambda x: F.round(x, 6) + 0.0
    return p.select("k", rounded(F.col("v.x")).alias("x"), rounded(F.col("v.y")).alias("y"), rounded(F.col("v.z")).alias("z"), F.round(geo.to_spherical(F.col("v"))["lat"], 6).alias("lat_back"))


@query("""WITH p AS (SELECT c_custkey AS k, c_custkey % 160 - 80 AS a, c_custkey * 7 % 350 AS o FROM customer) SELECT k, c AS place, CAST(CASE WHEN c IN (1,2) THEN a + 1 ELSE a END AS DOUBLE) AS lat, CAST(CASE WHEN c IN (0,1) THEN o + 2 ELSE o END AS DOUBLE) AS lon FROM p, range(0, 4) g(c)""")
def ccw_sort(spark, sf):
    """Corners of a cell, crossed over (low low, high high, low high, high low), come out counter-clockwise from the south-east."""
    k = F.col("c_custkey")
    corner = lambda a, b: F.struct((k % 160 - 80 + a).cast("double").alias("lat"), (k * 7 % 350 + b).cast("double").alias("lon"))
    crossed = F.array(corner(0, 2), corner(1, 0), corner(1, 2), corner(0, 0))
    out = table(spark, sf, "customer").select(k.alias("k"), F.posexplode(geo.counter_clockwise(crossed)).alias("place", "v"))
    return out.select("k", F.col("place").cast("long").alias("place"), "v.lat", "v.lon")


@query(f"""WITH {_POINTS}, m AS (SELECT k % 20 AS region, avg(cos(radians(lat))*cos(radians(lon))) AS x, avg(cos(radians(lat))*sin(radians(lon))) AS y, avg(sin(radians(lat))) AS z FROM p GROUP BY 1)
SELECT region, round(degrees(asin(z / sqrt(x*x+y*y+z*z))), 6) AS lat FROM m""")
def centroids(spark, sf):
    p = _points(spark, sf).withColumn("region", F.col("k") % 20)
    return geo.centroids(p, ["region"]).select("region", F.round("lat", 6).alias("lat"))


@query("""SELECT a.n_nationkey AS i, b.r_regionkey AS j FROM nation a, region b""")
def mesh(spark, sf):
    return geo.mesh(table(spark, sf, "nation").select(F.col("n_nationkey").alias("i")), table(spark, sf, "region").select(F.col("r_regionkey").alias("j")))


@query("""SELECT r_regionkey AS k, CAST(0 - d AS DOUBLE) AS low, CAST(w + d AS DOUBLE) AS high FROM (SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN 350 ELSE 300 END AS w, CASE WHEN r_regionkey % 2 = 0 THEN 5 ELSE 0 END AS d FROM region)""")
def widened_bounds(spark, sf):
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("k"))
    n = F.when(F.col("k") % 2 == 0, 35).otherwise(30)
    bounds = r.select("k", F.explode(F.sequence(F.lit(0), n - 1)).alias("c")).select("k", (F.col("c") * 10.0).alias("low"), (F.col("c") * 10.0 + 10).alias("high"))
    return geo.widened_bounds(bounds, ["k"])


# ---------------------------------------------------------------- datasets


@query("""WITH n AS (SELECT DISTINCT n_nationkey AS k FROM nation) SELECT k, i, CAST(d AS DOUBLE) AS t FROM (SELECT k, unnest(range(12)) AS i, unnest([15.5,45.0,74.5,105.0,135.5,166.0,196.5,227.5,258.0,288.5,319.0,349.5]) + 365 * k AS d FROM n)""")
def axis_from_name(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).distinct()
    begin, until = (F.concat((F.col("k") + 1850).cast("string"), F.lit(m)) for m in ("01", "12"))
    made = n.select("k", F.posexplode(dataset.axis_from_name(begin, until, "mon", "days since 1850-01-01", "noleap", False)).alias("i", "t"))
    return made.select("k", F.col("i").cast("long").alias("i"), "t")


@query("SELECT p_partkey, CAST(greatest(p_size, 3) * ((p_size + 1) // 2) AS BIGINT) AS elements FROM part")
def largest_hyperslab(spark, sf):
    n = F.col("p_size").cast("long")
    piece = lambda a, b, s: F.struct(a.alias("start"), b.alias("stop"), s.alias("step"))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    slices = F.array(F.array(piece(zero, n, one), piece(one, one + 3, one)), F.array(piece(zero, n, F.lit(2).cast("long"))))
    return table(spark, sf, "part").select("p_partkey", dataset.largest_hyperslab(slices).alias("elements"))


@query("SELECT s_suppkey, '[{\"name\":\"lat\",\"length\":' || s_nationkey || '},{\"name\":\"lon\",\"length\":4}]' AS kind FROM supplier")
def dimension_fingerprint(spark, sf):
    d = lambda n, k: F.struct(F.lit(n).alias("name"), k.cast("int").alias("length"))
    return table(spark, sf, "supplier").select("s_suppkey", merge.dimension_type(F.array(d("Time", F.lit(9)), d("lat", F.col("s_nationkey")), d("lon", F.lit(4)))).alias("kind"))


@query("SELECT o_orderkey, CAST(date_diff('day', TIMESTAMP '1850-01-01', o_orderdate) AS DOUBLE) * 24 AS hours FROM orders")
def rebase_units(spark, sf):
    made = dataset.time_axis(table(spark, sf, "orders"), "o_orderdate", "days since 1850-01-01")
    return cftime.with_decoded(made, "time_num", "days since 1850-01-01").select("o_orderkey", cftime.encode(F.col("cf"), "hours since 1850-01-01").alias("hours"))
