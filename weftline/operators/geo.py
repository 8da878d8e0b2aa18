"""Longitude/latitude boxes on periodic grids, cell vertices and spherical geometry."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.cftime import let


def normal_box(box: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    """A box (lon low, lon high, lat low, lat high) whose longitudes are equal modulo 360 but not equal spans the circle: its upper
    longitude moves by 1e-6, down, or up if it was below the lower."""
    low, high, south, north = box
    if low != high and low % 360 == high % 360:
        high += 1e-6 if high < low else -1e-6
    return low, high, south, north


def _mod(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """In the box; longitudes are periodic. A plain box includes its borders, a wrapped one leaves out its longitudes' borders."""
    low, high, south, north = normal_box(box)
    a, b = low % 360.0, high % 360.0
    wrapped = b - a < 0
    across = ~((_mod(lon) >= b) & (_mod(lon) <= a)) if wrapped else (_mod(lon) >= a) & (_mod(lon) <= b)
    return across & (lat >= south) & (lat <= north)


def any_vertex_in_box(vertices: Column, box: tuple[float, float, float, float]) -> Column:
    return F.exists(vertices, lambda v: in_box(v["lat"], v["lon"], box))


def outer_product_subset(grid: DataFrame, hit: Column, keys: list[str] | None = None, i: str = "i", j: str = "j", empty: str = "all") -> DataFrame:
    """Cells whose row and whose column have a hit: a rectangle of the grid, not the exact mask.

    An axis without any hit isn't cut (``empty`` = ``all``), or nothing is left (``empty`` = ``none``). Row and column sets are two small
    aggregates that the grid is semi-joined with.
    """
    keys = keys or []
    marked = grid.withColumn("_hit", hit)
    hits = marked.where("_hit")
    rows, columns = hits.select(*keys, i).distinct(), hits.select(*keys, j).distinct()
    cut = grid.join(rows, [*keys, i], "left_semi").join(columns, [*keys, j], "left_semi")
    if empty == "none":
        return cut.select(*grid.columns)
    # no hit anywhere: rows and columns are both without a hit
    rest = grid.join(hits.select(*keys).distinct(), keys, "left_anti") if keys else grid.join(F.broadcast(marked.agg(F.coalesce(F.bool_or("_hit"), F.lit(False)).alias("_any")))).where("not _any").drop("_any")
    return cut.select(*grid.columns).unionByName(rest.select(*grid.columns))


def mesh(lat: DataFrame, lon: DataFrame) -> DataFrame:
    """Product of two coordinate axes: every cell of a regular grid, which is what is asked for; the shorter axis is broadcast by size."""
    return lat.crossJoin(lon)


def bounds_vertices(lat_bounds: Column, lon_bounds: Column) -> Column:
    """Four corners of a cell from its bounds: latitudes low, high, low, high; longitudes low, low, high, high."""
    corner = lambda a, b: F.struct(lat_bounds[a].alias("lat"), _mod(lon_bounds[b]).alias("lon"))
    return F.array(corner(0, 0), corner(1, 0), corner(0, 1), corner(1, 1))


def vertex_source(columns: list[str]) -> str:
    """Where a grid's vertices come from: ``vertices``, ``bounds`` or ``none``; rotated and unstructured grids are not supported."""
    if {"lat_vertices", "lon_vertices"} <= set(columns):
        return "vertices"
    if {"lat_bnds", "lon_bnds"} <= set(columns):
        return "bounds"
    if {"rlat_bnds", "rlon_bnds"} <= set(columns):
        raise NotImplementedError("rotated grids need their vertices")
    return "none"


def to_cartesian(lat: Column, lon: Column) -> Column:
    """Unit vector struct<x, y, z> of degrees."""
    la, lo = F.radians(lat), F.radians(lon)
    return F.struct((F.cos(la) * F.cos(lo)).alias("x"), (F.cos(la) * F.sin(lo)).alias("y"), F.sin(la).alias("z"))


def to_spherical(v: Column, quadrant: bool = True) -> Column:
    """struct<lat, lon> in degrees. Without ``quadrant``: longitude from the plain quotient y/x, 90 where x is 0."""
    r = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"])
    lat = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v["z"] / r))))
    plain = F.when(v["x"] == 0, 90.0).otherwise(F.degrees(F.atan(v["y"] / v["x"])))
    return F.struct(lat.alias("lat"), (_mod(F.degrees(F.atan2(v["y"], v["x"]))) if quadrant else plain).alias("lon"))


def cross(a: Column, b: Column) -> Column:
    return F.struct((a["y"] * b["z"] - a["z"] * b["y"]).alias("x"), (a["z"] * b["x"] - a["x"] * b["z"]).alias("y"), (a["x"] * b["y"] - a["y"] * b["x"]).alias("z"))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def _sum_of(vectors: Column, axis: str) -> Column:
    return F.aggregate(vectors, F.lit(0.0), lambda a, u: a + u[axis])


def counter_clockwise(vertices: Column) -> Column:
    """Four vertices counter-clockwise around their centroid, from the (first) one of the greatest longitude; unchanged if no order is.

    One vertex follows another counter-clockwise if the triple product of the centroid and both unit vectors is positive.
    """
    start = -F.array_max(F.transform(vertices, lambda v, i: F.struct(_mod(v["lon"]).alias("l"), (-i).alias("i"))))["i"]
    turned = let(start, lambda s: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.element_at(vertices, (F.pmod(k + s, F.lit(4)) + 1).cast("int"))))
    with_units = let(turned, lambda t: F.struct(t.alias("t"), F.transform(t, lambda p: to_cartesian(p["lat"], p["lon"])).alias("u")))

    def follows(v: Column) -> Column:
        """4 x 4 flags: whether vertex j follows vertex i."""
        centre = F.struct(*(_sum_of(v["u"], axis).alias(axis) for axis in "xyz"))
        flags = let(centre, lambda c: F.transform(v["u"], lambda a: F.transform(v["u"], lambda b: dot(c, cross(a, b)) > 0)))
        return F.struct(v["t"].alias("t"), flags.alias("f"))

    def ordered(v: Column) -> Column:
        result = vertices
        for order in itertools.permutations((1, 2, 3)):
            ring = (0, *order)
            good = F.lit(True)
            for k in range(4):
                good = good & v["f"][ring[k]][ring[(k + 1) % 4]]
            result = F.when(good, F.array(*(v["t"][k] for k in ring))).otherwise(result)
        return result

    return let(let(with_units, follows), ordered)


def centroids(vertices: DataFrame, keys: list[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``keys, lat, lon``: the direction of the mean of unit vectors."""
    v = vertices.withColumn("_v", to_cartesian(F.col(lat), F.col(lon)))
    mean = v.groupBy(*keys).agg(F.avg("_v.x").alias("x"), F.avg("_v.y").alias("y"), F.avg("_v.z").alias("z"))
    return mean.select(*keys, to_spherical(F.struct("x", "y", "z")).alias("c")).select(*keys, "c.lat", "c.lon")


def widened_bounds(bounds: DataFrame, keys: list[str], low: str = "low", high: str = "high") -> DataFrame:
    """``keys, low, high``: outer longitude bounds of each axis. Bounds that miss the full circle by no more than the widest cell (and a
    tenth of a degree) are widened by half of what is missing on either side."""
    outer = bounds.groupBy(*keys).agg(F.min(low).alias("_low"), F.max(high).alias("_high"), F.max(F.col(high) - F.col(low)).alias("_widest"))
    missing = F.lit(360.0) - (F.col("_high") - F.col("_low"))
    half = F.when((missing > 0) & (missing - 0.1 <= F.col("_widest")), missing / 2).otherwise(0.0)
    return outer.select(*keys, (F.col("_low") - half).alias(low), (F.col("_high") + half).alias(high))
