"""Queries of the general large-data problems over the test tables: operators with production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import paths
from weftline.operators import drift, intervals, proximity, timestamps
from weftline.session import once, table

#: A century of months.
SHARD_MONTHS = 1200


def _covered_months(spark: SparkSession, sf: str) -> DataFrame:
    """``series, start, end``: the months that each file covers, by its name or else by the steps of its axis."""
    files = once(table(spark, sf, "soft_links").select("path_id", "path"), name=paths.stem(F.col("path")))
    files = paths.with_period(files.where(F.col("name").isNotNull()))
    by_name = files.where("dated").select("series", "start", "end")
    labels = timestamps.zone_offsets(table(spark, sf, "zone_labels"))
    undated = files.where("not dated").select("path_id", "series").distinct()
    extent = timestamps.axis_extent(table(spark, sf, "time_axis")).join(undated, "path_id")
    month = lambda x: F.col(f"{x}.year") * 12 + F.col(f"{x}.month") - 1
    by_axis = timestamps.decode_utc(extent, {"first_num": "first_at", "last_num": "last_at"}, labels).select("series", month("first_at").alias("start"), month("last_at").alias("end"))
    return by_name.unionByName(by_axis)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    found = intervals.gaps(_covered_months(spark, sf), ["series"], width=SHARD_MONTHS)
    return found.select("series", paths.month_text(F.col("start")).alias("gap_from"), paths.month_text(F.col("end")).alias("gap_to"))


def p1_periods(spark: SparkSession, sf: str) -> DataFrame:
    found = intervals.periods(_covered_months(spark, sf), ["series"], width=SHARD_MONTHS)
    return found.select("series", paths.month_text(F.col("start")).alias("period_from"), paths.month_text(F.col("end")).alias("period_to"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return timestamps.first_times(table(spark, sf, "time_axis"), table(spark, sf, "zone_labels"))


#: The distance of p3_found.
NEAR_KM = 0.5


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return proximity.near_pairs(table(spark, sf, "subset_points"), NEAR_KM)


def p3_regions(spark: SparkSession, sf: str) -> DataFrame:
    """The grids that each point lies in: a grid's region is the octagon between the middles and the thirds of its sides."""
    points = table(spark, sf, "subset_points")
    usable = points.where(proximity.usable_position(F.col("lat"), F.col("lon")) & F.col("grid_id").isNotNull()).withColumn("x", F.pmod("lon", F.lit(360.0)))
    ends = usable.groupBy("grid_id").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("x").alias("w"), F.max("x").alias("e"))
    at = lambda low, high, share: F.col(low) + (F.col(high) - F.col(low)) * share
    corner = lambda a, b: F.struct(at("s", "n", a).alias("lat"), at("w", "e", b).alias("lon"))
    ring = F.array(*(corner(a, b) for a, b in OCTAGON))
    return proximity.locate(points, ends.select("grid_id", ring.alias("vertices")), region="grid_id").withColumnRenamed("region", "in_grid")


#: Corners of an octagon in the unit square: latitude, longitude.
OCTAGON = ((0.0, 0.25), (0.0, 0.75), (0.25, 1.0), (0.75, 1.0), (1.0, 0.75), (1.0, 0.25), (0.75, 0.0), (0.25, 0.0))


#: Target columns of the header records: field and type. The second spellings are those the feeds have used so far.
HEADER = {
    "path": ("path", "string"),
    "file_type": ("file_type|File_Type|fileType|ftype|access_type|service", "string"),
    "data_node": ("data_node|dataNode|node|host.node", "string"),
    "version": ("version|Version|ver|dataset_version", "string"),
    "checksum": ("checksum|check.sum|cksum|digest", "string"),
    "time_units": ("time.units|time.unit|time.Units|time_units|tunits|axis.units", "string"),
    "time_calendar": ("time.calendar|time.cal|axis.calendar|calendar", "string"),
}
#: Fields approved later, replayed from the rescue column.
APPROVED = {
    "tracking_id": ("tracking_id|trackingId|uuid", "string"),
    "frequency": ("frequency|freq|time.frequency", "string"),
    "n_steps": ("n_steps|nsteps|steps|time.n", "bigint"),
    "size_mb": ("size_mb|sizeMB|size", "double"),
    "lat_min": ("lat_min|subset.lat_min|south", "double"),
    "instant": ("instant", "boolean"),
    "bnds": ("bnds", "boolean"),
}


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.schema_changes(drift.rescue_ingest(table(spark, sf, "raw_records"), {"path": ("path", "string")}))


def p2_table(spark: SparkSession, sf: str) -> DataFrame:
    records = drift.promote(drift.rescue_ingest(table(spark, sf, "raw_records"), HEADER), APPROVED)
    return records.select("record_id", "feed", "file_name", "line_no", "written_at", *HEADER, *APPROVED, F.col("_readable").alias("readable"), F.col("_rescued").alias("rescued"))


#: DuckDB SQL of the queries that SQL can express; the others are tested against brute force.
SQL = {
    "p2_found": r"""WITH t AS (SELECT DISTINCT feed, file_name, written_at, payload FROM raw_records WHERE feed IS NOT NULL AND file_name IS NOT NULL),
k AS (SELECT row_number() OVER () AS n, * FROM t WHERE json_valid(payload)), o AS MATERIALIZED (SELECT * FROM k WHERE json_type(payload) = 'OBJECT'),
j AS MATERIALIZED (SELECT n, feed, file_name, replace(substr(e.fullkey, 3), '"', '') AS field, CASE e.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'DOUBLE' THEN 'decimal' ELSE 'integer' END AS kind,
  e.type || CAST(e.value AS VARCHAR) AS v FROM o, json_tree(o.payload) e WHERE e.type NOT IN ('OBJECT', 'NULL') AND NOT contains(e.path, '[')),
p AS (SELECT n, v AS path FROM j WHERE field = 'path' AND kind <> 'array'), w AS (SELECT feed, file_name, min(written_at) AS "at" FROM t GROUP BY 1, 2),
s AS (SELECT feed, file_name, lag(file_name) OVER (PARTITION BY feed ORDER BY w."at", file_name) AS before FROM w),
f AS (SELECT feed, file_name, field, list_sort(list(DISTINCT kind)) AS kinds FROM j GROUP BY 1, 2, 3),
a AS (SELECT s.feed, s.file_name, f.field, f.kinds FROM s JOIN f ON f.feed = s.feed AND f.file_name = s.before), b AS (SELECT s.feed, s.file_name, f.field, f.kinds FROM s JOIN f USING (feed, file_name) WHERE s.before IS NOT NULL),
c AS (SELECT coalesce(a.feed, b.feed) AS feed, coalesce(a.file_name, b.file_name) AS file_name, coalesce(a.field, b.field) AS field, CASE WHEN b.field IS NULL THEN 'removed' WHEN a.field IS NULL THEN 'added' ELSE 'retyped' END AS change_kind
  FROM a FULL JOIN b ON a.feed = b.feed AND a.file_name = b.file_name AND a.field = b.field WHERE a.kinds IS DISTINCT FROM b.kinds),
x AS (SELECT c.feed, c.file_name, c.field AS gone, p.path, min(j.v) AS lo, max(j.v) AS hi FROM c JOIN s USING (feed, file_name) JOIN j ON j.feed = c.feed AND j.file_name = s.before AND j.field = c.field JOIN p USING (n) WHERE change_kind = 'removed' GROUP BY ALL),
y AS (SELECT c.feed, c.file_name, c.field AS came, p.path, min(j.v) AS lo, max(j.v) AS hi FROM c JOIN j ON j.feed = c.feed AND j.file_name = c.file_name AND j.field = c.field JOIN p USING (n) WHERE change_kind = 'added' GROUP BY ALL),
g AS (SELECT x.feed, x.file_name, gone, came, count(*) AS n FROM x JOIN y USING (feed, file_name, path) GROUP BY ALL HAVING bool_and(x.lo = x.hi AND y.lo = y.hi AND x.lo = y.lo)),
q AS (SELECT *, row_number() OVER (PARTITION BY feed, file_name, gone ORDER BY n DESC, levenshtein(lower(gone), lower(came)), gone, came) AS i, row_number() OVER (PARTITION BY feed, file_name, came ORDER BY n DESC, levenshtein(lower(gone), lower(came)), gone, came) AS k FROM g),
r AS (SELECT * FROM q WHERE i = 1 AND k = 1)
SELECT feed, file_name, 'renamed' AS change_kind, gone AS field, came AS new_field FROM r UNION ALL SELECT feed, file_name, change_kind, field, '' FROM c
WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.feed = c.feed AND r.file_name = c.file_name AND (change_kind = 'removed' AND gone = field OR change_kind = 'added' AND came = field))""",
    "p3_regions": f"""WITH p AS (SELECT point_id, grid_id, lat, ((lon % 360) + 360) % 360 AS x FROM subset_points WHERE lat BETWEEN -90 AND 90 AND isfinite(lat) AND isfinite(lon) AND abs(lon) < 1e19),
b AS (SELECT grid_id, min(lat) AS s, max(lat) AS n, min(x) AS w, max(x) AS e FROM p WHERE grid_id IS NOT NULL GROUP BY 1),
o AS (SELECT unnest(range({len(OCTAGON)})) AS k, unnest({[a for a, _ in OCTAGON]}) AS a, unnest({[b for _, b in OCTAGON]}) AS b),
v AS (SELECT grid_id, k, s + (n - s) * a AS y, w + (e - w) * b AS x FROM b, o), d AS (SELECT u.grid_id, u.y AS y1, u.x AS x1, v.y AS y2, v.x AS x2 FROM v u JOIN v ON v.grid_id = u.grid_id AND v.k = (u.k + 1) % {len(OCTAGON)}),
g AS (SELECT grid_id, least(y1, y2) AS y1, CASE WHEN y1 < y2 THEN x1 ELSE x2 END AS x1, greatest(y1, y2) AS y2, CASE WHEN y1 < y2 THEN x2 ELSE x1 END AS x2 FROM d WHERE y1 <> y2)
SELECT point_id, g.grid_id AS in_grid FROM p JOIN g ON p.lat >= g.y1 AND p.lat < g.y2 AND g.x1 + (g.x2 - g.x1) * (p.lat - g.y1) / (g.y2 - g.y1) <= p.x GROUP BY 1, 2 HAVING count(*) % 2 = 1""",
    "p3_found": """WITH p AS (SELECT point_id, lat, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z
FROM subset_points WHERE lat BETWEEN -90 AND 90 AND isfinite(lat) AND isfinite(lon) AND abs(lon) < 1e19)
SELECT a.point_id AS point_a, b.point_id AS point_b FROM p a JOIN p b ON b.lat BETWEEN a.lat - 0.0045 AND a.lat + 0.0045 AND a.point_id < b.point_id
WHERE power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2) <= power(2 * sin(0.5 / 6371 / 2), 2)""",
}

QUERIES = {
    "p1_found": p1_found,
    "p1_periods": p1_periods,
    "p2_found": p2_found,
    "p2_table": p2_table,
    "p3_found": p3_found,
    "p3_regions": p3_regions,
    "p5_found": p5_found,
}
