"""Points near other points, and the region that contains a point, by trapezoidal decomposition.

The boundaries of regions are cut into ordered horizontal slabs (bands of latitude). Slabs are distributed, in cells along them; in
its slab a point is located by binary search among the edges.

For points near points, the region of a point is the eastern half of the latitude and longitude box around its disc; pairs are found
from their western point. Over the slabs that a box reaches into its edges are taken as upright and at the widest box's distance, so
that left edges and right edges have the same order along a slab: those regions hold a point whose right edge is the first not west
of it, up to the last whose left edge is not east of it, two binary searches. The exact distance decides.

For regions, slabs are cut again at the vertices of a region, within a cell: between two cuts the region has only edges that cross, in
one order from west to east. The cut is found by binary search, then the number of edges west of the point by another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

EARTH_KM = 6371.0


def usable_position(lat: Column, lon: Column) -> Column:
    """Neither null nor non-finite, latitude within 90 degrees, longitude no fill value."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e19)
    return finite(lat) & finite(lon) & (F.abs(lat) <= 90.0)


class Slabs:
    """Geometry of slabs and of the cells along them, the same in Spark and on the driver.

    A slab is ``HEIGHTS`` distances high; along it, cells are ``WIDTHS`` times as wide as the widest region in the slab, so that a
    region is copied into one or two slabs and mostly one cell of each. Where a region would span a large part of the circle (close
    to the poles), a slab is a single cell.
    """

    HEIGHTS = 4
    WIDTHS = 8

    def __init__(self, km: float):
        self.degrees = math.degrees(km / EARTH_KM) * (1 + 1e-9)
        self.height = self.HEIGHTS * self.degrees

    def slab(self, lat: Column) -> Column:
        return F.floor((lat + 90.0) / self.height)

    def reach(self, slab: Column) -> Column:
        """Greatest half width, in degrees of longitude, of a region that reaches into the slab; 360 where it spans the circle."""
        far = F.greatest(F.abs(slab * self.height - 90.0), F.abs((slab + 1) * self.height - 90.0)) + self.degrees
        sine = F.sin(F.radians(F.lit(self.degrees))) / F.cos(F.radians(F.least(far, F.lit(90.0 - 1e-9))))
        return F.when((far >= 90.0 - self.degrees) | (sine > 0.5), 360.0).otherwise(F.degrees(F.asin(F.least(sine, F.lit(1.0)))) * (1 + 1e-9))

    def reach_of(self, slab: np.ndarray) -> np.ndarray:
        """As :meth:`reach`, in numpy; equal but for rounding, which the searches allow for."""
        far = np.maximum(np.abs(slab * self.height - 90.0), np.abs((slab + 1) * self.height - 90.0)) + self.degrees
        sine = math.sin(math.radians(self.degrees)) / np.cos(np.radians(np.minimum(far, 90.0 - 1e-9)))
        return np.where((far >= 90.0 - self.degrees) | (sine > 0.5), 360.0, np.degrees(np.arcsin(np.minimum(sine, 1.0))) * (1 + 1e-9))

    def cells(self, reach: Column) -> Column:
        """Number of cells of a slab."""
        return F.greatest(F.lit(1), F.floor(360.0 / (self.WIDTHS * reach))).cast("long")


#: A point in its own cell; a visitor from the cell to the west or below; a copy in another part of a split cell.
_HOME, _VISIT, _COPY = 0, 1, 2
#: A place is (slab * _CELLS + cell) * _SUBS + part of the cell.
_CELLS, _SUBS = 2**32, 16
#: Split cells are joined by broadcast up to so many of them, by a shuffle beyond.
_HOT = 10_000
#: Distance between the ranges of two cells on the common axis of a batch, in degrees; more than any x within a cell.
_APART = 4000.0
#: Candidate pairs that are compared at once.
_BLOCK = 2_000_000


def _sweep(km: float):
    """Pairs of each place, from west to east, all places of a batch at once.

    The rows come ordered by place and x. The places of a batch are laid side by side on one axis, so that one binary search serves
    them all. From one batch to the next only the regions are kept that a later point of the last place may lie in, so that memory is
    bounded whatever the size of a cell.
    """
    limit, slabs = (2 * math.sin(km / EARTH_KM / 2)) ** 2, Slabs(km)

    def near(rows: dict, begin: int) -> Iterator[pd.DataFrame]:
        """Pairs of each row from ``begin`` on with the rows before it."""
        at, x = np.arange(begin, len(rows["x"])), rows["x"][begin:]
        low = np.searchsorted(rows["x"], x - rows["reach"][begin:] - 1e-6, "left")
        counts = np.maximum(at - low, 0)
        ends, done = np.cumsum(counts), 0
        while done < len(counts):
            stop = max(int(np.searchsorted(ends, (ends[done - 1] if done else 0) + _BLOCK, "right")), done + 1)
            n = counts[done:stop]
            b = np.repeat(at[done:stop], n)
            a = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[done:stop], n)
            ka, kb = rows["kind"][a], rows["kind"][b]
            keep = ((kb == _HOME) | (kb == _VISIT) & (ka == _HOME)) & (rows["id"][a] != rows["id"][b])
            a, b = a[keep], b[keep]
            keep = sum((rows[v][a] - rows[v][b]) ** 2 for v in ("vx", "vy", "vz")) <= limit
            if keep.any():
                one, two = rows["id"][a[keep]], rows["id"][b[keep]]
                yield pd.DataFrame({"point_a": np.minimum(one, two), "point_b": np.maximum(one, two)})
            done = stop

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, last = None, None
        for batch in batches:
            if not len(batch):
                continue
            place, tag = batch["place"].to_numpy(), batch["tag"].to_numpy()
            cells = np.column_stack([place, tag >> 2])
            run_no = np.concatenate([[0], np.cumsum((cells[1:] != cells[:-1]).any(axis=1))])
            lat, lon = np.radians(batch["lat"].to_numpy()), np.radians(batch["x"].to_numpy())
            rows = {"id": batch["id"].to_numpy(), "kind": tag & 3, "x": batch["x"].to_numpy() + _APART * run_no, "reach": slabs.reach_of(place // (_CELLS * _SUBS))}
            rows |= {"vx": np.cos(lat) * np.cos(lon), "vy": np.cos(lat) * np.sin(lon), "vz": np.sin(lat)}
            begin = 0
            if kept is not None and (cells[0] == last).all():
                begin = len(kept["x"])
                rows = {k: np.concatenate([kept[k], v]) for k, v in rows.items()}
            yield from near(rows, begin)
            last, shift = cells[-1], _APART * run_no[-1]
            still = rows["x"] >= max(rows["x"][-1] - rows["reach"][-1] - 1e-3, shift - _APART / 2)
            kept = {k: v[still] for k, v in rows.items()}
            kept["x"] = kept["x"] - shift

    return run


def near_pairs(points: DataFrame, km: float, key: str = "point_id", lat: str = "lat", lon: str = "lon", block: int = 50_000) -> DataFrame:
    """``point_a, point_b`` (a < b): all pairs of points at most ``km`` apart on a sphere of radius 6371 km.

    Longitudes count modulo 360. Points with a null key or an unusable position are left out; rows repeated with the same key and
    position count once; an empty table gives no pairs; other columns, whatever their names, are ignored. ``km``: from a decimetre to
    half the circle.

    A point goes to the cell it lies in, and as a visitor to those to the east and above that its box reaches into: about a fifth of
    the points twice. A cell of more than ``block`` points is cut into 4 x 4 finer ones, a distance high; where even one of these,
    in which most points are near each other, has more, its points are dealt out by key and copied to every part, still fewer rows
    than its pairs.
    """
    if not 1e-4 <= km <= math.pi * EARTH_KM:
        raise ValueError("km must be between 0.0001 and half the circle")
    slabs = Slabs(km)
    p = points.where(usable_position(F.col(lat), F.col(lon)) & F.col(key).isNotNull())
    p = p.select(F.col(key).cast("long").alias("id"), F.col(lat).cast("double").alias("lat"), F.pmod(F.col(lon), F.lit(360.0)).alias("lon"))
    p = p.withColumn("lon", F.when(F.col("lon") >= 360.0, 0.0).otherwise(F.col("lon")))
    p = p.withColumn("slab", slabs.slab(F.col("lat"))).withColumn("reach", slabs.reach(F.col("slab"))).withColumn("n", slabs.cells(F.col("reach")))
    p = p.withColumn("cell", F.least(F.floor(F.col("lon") / (360.0 / F.col("n"))), F.col("n") - 1))

    # where each row goes: slab, cell, turn (of the circle between the point's longitude and the cell's)
    at = lambda slab, cell, turn, kind: F.struct(slab.alias("slab"), cell.alias("cell"), turn.cast("int").alias("turn"), F.lit(kind).alias("kind"))
    none = F.array().cast("array<struct<slab:bigint,cell:bigint,turn:int,kind:int>>")
    size, following = 360.0 / F.col("n"), F.col("cell") + 1
    east = F.when((F.col("reach") < 360.0) & (F.col("lon") + F.col("reach") >= following * size), F.array(at(F.col("slab"), following % F.col("n"), F.floor(following / F.col("n")), _VISIT))).otherwise(none)
    up = F.col("slab") + 1
    far, many = slabs.reach(up), slabs.cells(slabs.reach(up))
    wide = 360.0 / many
    touched = F.transform(F.sequence(F.floor((F.col("lon") - far) / wide), F.floor((F.col("lon") + far) / wide)), lambda t: at(up, F.pmod(t, many), F.floor(t / many), _VISIT))
    above = F.when(slabs.slab(F.col("lat") + slabs.degrees) <= F.col("slab"), none).when(far >= 360.0, F.array(at(up, F.lit(0).cast("long"), F.lit(0), _VISIT))).otherwise(touched)
    home = F.array(at(F.col("slab"), F.col("cell"), F.lit(0), _HOME))
    rows = p.select("id", "lat", "lon", F.explode(F.concat(home, east, above)).alias("to")).select("id", "lat", (F.col("lon") - 360.0 * F.col("to.turn")).alias("x"), F.col("to.slab").alias("slab"), F.col("to.cell").alias("cell"), F.col("to.kind").alias("kind"))
    rows = rows.withColumn("base", F.col("slab") * _CELLS + F.col("cell"))

    # parts of a cell, 4 high and 4 wide; a row's own part, and those that its box touches
    width = 90.0 / slabs.cells(slabs.reach(F.col("slab")))
    part = lambda v: F.greatest(F.lit(0), F.least(F.lit(3), F.floor(v))).cast("int")
    high, across = (F.col("lat") + 90.0 - F.col("slab") * slabs.height) / slabs.degrees, F.when(slabs.reach(F.col("slab")) >= 360.0, 0.0).otherwise((F.col("x") - F.col("cell") * 4 * width) / width)
    own = part(high) * 4 + part(across)
    counts = p.select("lat", "slab", "cell", F.col("lon").alias("x")).groupBy((F.col("slab") * _CELLS + F.col("cell")).alias("base"), own.alias("part")).agg(F.count("*").alias("n"))
    # at most one cell in ``block`` points is split: few, as a rule, but as their number grows with the points it is checked
    hot = counts.groupBy("base").agg(F.sum("n").alias("all"), F.collect_list(F.struct("part", "n")).alias("parts")).where(F.col("all") > block)
    hot = hot.select("base", F.map_from_entries(F.transform("parts", lambda x: F.struct(x["part"], F.ceil(x["n"] / block).cast("int")))).alias("deals"))
    first = hot.limit(_HOT + 1).collect()
    if first:
        if len(first) <= _HOT:
            hot = F.broadcast(points.sparkSession.createDataFrame(first, hot.schema))
        span, near_x = F.lit(1.0), F.when(slabs.reach(F.col("slab")) >= 360.0, 0.0).otherwise(slabs.reach(F.col("slab")) / width)
        up_or_across = lambda low: F.sequence(part(low), part(across + near_x))
        grid = lambda ys: F.flatten(F.transform(ys, lambda y: F.transform(up_or_across(across - near_x), lambda x: y * 4 + x)))
        visits = grid(F.sequence(part(high - span), part(high + span)))
        # within a cell: to the east and above
        beyond = F.when(part(high) < 3, F.flatten(F.transform(F.array(part(high) + 1), lambda y: F.transform(up_or_across(across - near_x), lambda x: y * 4 + x)))).otherwise(F.array().cast("array<int>"))
        beyond = F.filter(beyond, lambda x: F.floor(high + span) > part(high))
        right = F.when((part(across) < 3) & (part(across + near_x) > part(across)), F.array(own + 1)).otherwise(F.array().cast("array<int>"))
        kinds = lambda parts, kind: F.transform(parts, lambda x: F.struct(x.cast("int").alias("part"), F.lit(kind).alias("kind")))
        targets = F.when(F.col("deals").isNull(), F.array(F.struct(F.lit(0).alias("part"), F.col("kind")))).when(F.col("kind") == _VISIT, kinds(visits, _VISIT)).otherwise(F.concat(kinds(F.array(own), _HOME), kinds(right, _VISIT), kinds(beyond, _VISIT)))
        spread = rows.join(hot, "base", "left").select("id", "lat", "x", "base", "deals", F.explode(targets).alias("to"))
        deals = F.coalesce(F.try_element_at("deals", F.col("to.part")), F.lit(1))
        mine = F.pmod(F.xxhash64("id"), deals).cast("int")
        tags = F.transform(F.sequence(F.lit(0), deals - 1), lambda k: k * 4 + F.when(F.col("to.kind") == _VISIT, _VISIT).when(k == mine, _HOME).otherwise(_COPY))
        rows = spread.select("id", "lat", "x", (F.col("base") * _SUBS + F.col("to.part")).alias("place"), F.explode(tags).alias("tag"))
    else:
        rows = rows.select("id", "lat", "x", (F.col("base") * _SUBS).alias("place"), F.col("kind").alias("tag"))
    rows = rows.withColumn("deal", F.shiftright("tag", 2)).repartition("place", "deal").sortWithinPartitions("place", "deal", "x", "id").drop("deal")
    return rows.mapInPandas(_sweep(km), "point_a long, point_b long").distinct()


def region_edges(regions: DataFrame, key: str = "region_id", vertices: str = "vertices", height: float = 1.0) -> DataFrame:
    """``slab, region, x1, y1, x2, y2``: trapezoidal decomposition of polygons, their edges cut at the slab borders.

    ``vertices`` is an array of struct<lat, lon>, in order, closed implicitly; an edge is a straight line in latitude and longitude.
    Horizontal edges bound no slab and are left out, as are polygons of fewer than three vertices.
    """
    v = F.col(vertices)
    ring = regions.where(F.size(v) >= 3).select(F.col(key).alias("region"), v.alias("v"))
    edges = ring.select("region", F.posexplode("v").alias("i", "a"), "v").select("region", "a", F.col("v")[F.pmod(F.col("i") + 1, F.size("v"))].alias("b"))
    up = F.col("a.lat") <= F.col("b.lat")
    edges = edges.where("a.lat <> b.lat").select("region", F.when(up, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("b"))
    first, last = F.floor(F.col("a.lat") / height), F.ceil(F.col("b.lat") / height) - 1
    edges = edges.withColumn("slab", F.explode(F.sequence(first, F.greatest(first, last))))
    low, high = F.greatest(F.col("a.lat"), F.col("slab") * height), F.least(F.col("b.lat"), (F.col("slab") + 1) * height)
    at = lambda y: F.col("a.lon") + (F.col("b.lon") - F.col("a.lon")) * (y - F.col("a.lat")) / (F.col("b.lat") - F.col("a.lat"))
    return edges.select(F.col("slab").cast("long").alias("slab"), "region", at(low).alias("x1"), low.alias("y1"), at(high).alias("x2"), high.alias("y2"))


class _Borders:
    """The edges of one region in a cell, cut at its vertices into trapezoids."""

    def __init__(self, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray):
        self.cuts = np.unique(np.concatenate([y1, y2]))
        first, last = np.searchsorted(self.cuts, y1), np.searchsorted(self.cuts, y2)
        n = last - first
        edge = np.repeat(np.arange(len(n)), n)
        slab = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        middle = (self.cuts[slab] + self.cuts[slab + 1]) / 2
        slope = (x2 - x1) / (y2 - y1)
        order = np.lexsort((x1[edge] + slope[edge] * (middle - y1[edge]), slab))
        self.edge, self.begin = edge[order], np.searchsorted(slab[order], np.arange(len(self.cuts)))
        self.x1, self.y1, self.x2, self.y2 = x1, y1, x2, y2

    def inside(self, lat: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Whether points lie in the region: the cut by binary search, then by another the edges not east of the point."""
        slab = np.searchsorted(self.cuts, lat, "right") - 1
        ok = (slab >= 0) & (slab < len(self.cuts) - 1)
        slab = np.where(ok, slab, 0)
        start, low, high = self.begin[slab], self.begin[slab].copy(), self.begin[np.minimum(slab + 1, len(self.begin) - 1)].copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            e = self.edge[np.minimum(middle, len(self.edge) - 1)]
            at = self.x1[e] + (self.x2[e] - self.x1[e]) * (lat - self.y1[e]) / (self.y2[e] - self.y1[e])
            west = open_ & (at <= x)
            low, high = np.where(west, middle + 1, low), np.where(open_ & ~west, middle, high)
        return ok & ((low - start) % 2 == 1)


def _locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come ordered by cell, a cell's edges before its points: only the edges of one cell are held."""
    last, edges, borders = None, [], None

    def points_of(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        lat, x, ids = (part[c].to_numpy() for c in ("y1", "x1", "id"))
        for region, (south, north, west, east, shape) in borders.items():
            at = np.flatnonzero((lat >= south) & (lat < north) & (x >= west) & (x <= east))
            if len(at) and len(hit := at[shape.inside(lat[at], x[at])]):
                yield pd.DataFrame({"point": ids[hit], "region": region})

    for batch in batches:
        for (slab, cell, part_no), rows in batch.groupby(["slab", "cell", "part"], sort=False):
            if (slab, cell, part_no) != last:
                last, edges, borders = (slab, cell, part_no), [], None
            is_edge = rows["kind"].to_numpy() == 0
            if is_edge.any():
                edges.append(rows[is_edge])
            if not is_edge.all() and edges:
                if borders is None:
                    borders = {}
                    for region, e in pd.concat(edges).groupby("id", sort=False):
                        x1, y1, x2, y2 = (e[c].to_numpy() for c in ("x1", "y1", "x2", "y2"))
                        borders[region] = y1.min(), y2.max(), min(x1.min(), x2.min()), np.inf, _Borders(x1, y1, x2, y2)
                yield from points_of(rows[~is_edge])


def locate(points: DataFrame, regions: DataFrame, key: str = "point_id", lat: str = "lat", lon: str = "lon", region: str = "region_id", vertices: str = "vertices", height: float = 1.0, width: float | None = None, block: int = 50_000) -> DataFrame:
    """``key, region``: the regions (simple polygons) that contain each point; a point in none has no row.

    Edges are cut at the borders of slabs of ``height`` degrees and copied along their slab into the cells, ``width`` degrees wide
    (default: as high), from their own to the region's last; points go to their cell. In the cell the edges of a region are cut again
    at its vertices, and a point is located by two binary searches: an odd number of the region's edges west of it means inside. A
    point on a lower or left border is inside, one on an upper or right border is not. Longitudes of points count modulo 360, in any
    turn that the regions' vertices use. Points with a null key or an unusable position, regions with a null key, null vertices or
    fewer than three of them are left out; repeated rows count once; keys may be of any type.

    Cells of more than ``block`` points are cut into lower slabs, in which a point meets only the edges of its own latitudes: edges are
    cut with them, so that a split copies no whole region.
    """
    width = width or height
    spark = points.sparkSession
    edges = region_edges(regions.where(F.col(region).isNotNull()), region, vertices, height)
    # keys travel as text
    edges = edges.withColumn("id", F.col("region").cast("string")).withColumns({"west": F.floor(F.least("x1", "x2") / width), "east": F.floor(F.greatest("x1", "x2") / width)})
    reach = edges.groupBy("slab", "id").agg(F.max("east").alias("last"))
    ends = edges.agg(F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2"))).first()
    p = points.where(usable_position(F.col(lat), F.col(lon)) & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(lat).cast("double").alias("y1"), F.pmod(F.col(lon), F.lit(360.0)).alias("_lon"))
    if ends[0] is None:
        return spark.createDataFrame([], StructType([StructField(key, points.schema[key].dataType), StructField("region", regions.schema[region].dataType)]))
    turns = range(math.floor(ends[0] / 360.0), math.floor(ends[1] / 360.0) + 1)
    p = p.withColumn("x1", F.explode(F.array(*(F.col("_lon") + 360.0 * t for t in turns)))).where(F.col("x1").between(*ends))
    p = p.select("id", "y1", "x1", F.floor(F.col("y1") / height).cast("long").alias("slab"), F.floor(F.col("x1") / width).cast("long").alias("cell"))
    hot = p.groupBy("slab", "cell").count().where(F.col("count") > block).select("slab", "cell", F.least(F.lit(4096), F.ceil(F.col("count") / block)).cast("int").alias("parts"))
    e = edges.join(reach, ["slab", "id"]).withColumn("cell", F.explode(F.sequence("west", "last"))).select("id", "x1", "y1", "x2", "y2", "slab", "cell")
    first = hot.limit(_HOT + 1).collect()
    if first:
        if len(first) <= _HOT:
            hot = F.broadcast(spark.createDataFrame(first, hot.schema))
        n = F.coalesce("parts", F.lit(1))
        within = lambda y: F.least(n - 1, F.greatest(F.lit(0), F.floor((y / height - F.col("slab")) * n))).cast("int")
        p = p.join(hot, ["slab", "cell"], "left").withColumn("part", within(F.col("y1")))
        e = e.join(hot, ["slab", "cell"], "left").withColumn("part", F.explode(F.sequence(within(F.col("y1")), within(F.col("y2")))))
        low, high = (F.col("slab") + F.col("part") / n) * height, (F.col("slab") + (F.col("part") + 1) / n) * height
        at = lambda y: F.when(y <= F.col("y1"), F.col("x1")).when(y >= F.col("y2"), F.col("x2")).otherwise(F.col("x1") + (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")))
        e = e.withColumns({"_low": F.greatest("y1", low), "_high": F.least("y2", high)}).where("_low < _high")
        e = e.withColumns({"x1": at(F.col("_low")), "x2": at(F.col("_high")), "y1": F.col("_low"), "y2": F.col("_high")})
    else:
        p, e = p.withColumn("part", F.lit(0)), e.withColumn("part", F.lit(0))
    none = F.lit(None).cast("double")
    rows = e.select("slab", "cell", "part", F.lit(0).alias("kind"), "id", "x1", "y1", "x2", "y2").unionByName(p.select("slab", "cell", "part", F.lit(1).alias("kind"), "id", "x1", "y1", none.alias("x2"), none.alias("y2")))
    found = rows.repartition("slab", "cell", "part").sortWithinPartitions("slab", "cell", "part", "kind").mapInPandas(_locate, "point string, region string").distinct()
    return found.select(F.col("point").cast(points.schema[key].dataType).alias(key), F.col("region").cast(regions.schema[region].dataType).alias("region"))
