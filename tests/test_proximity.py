"""Points near points, regions that contain points."""

import math
import random

from weftline.operators import proximity


def brute(points, km):
    unit = {}
    for i, la, lo in points:
        if i is None or la is None or lo is None or math.isnan(la) or math.isnan(lo) or math.isinf(la) or math.isinf(lo) or abs(la) > 90 or abs(lo) >= 1e19:
            continue
        a, o = math.radians(la), math.radians(lo)
        unit[i] = (math.cos(a) * math.cos(o), math.cos(a) * math.sin(o), math.sin(a))
    ids, limit = sorted(unit), 2 * math.sin(km / 6371 / 2)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if math.dist(unit[a], unit[b]) <= limit}


def test_against_brute_force(spark):
    rng, points = random.Random(4), []
    for i in range(700):
        kind = i % 7
        base = [(0.0, 0.0), (89.999, 10.0), (-90.0, 0.0), (45.0, 359.999), (45.0, -0.001 + 720), (60.0, 180.0), (-30.0, 12.5)][kind]
        points.append((i, max(-90.0, min(90.0, base[0] + rng.gauss(0, 0.02))), base[1] + rng.gauss(0, 0.03 if abs(base[0]) < 89 else 60)))
    points += [(1000, None, 1.0), (1001, 1.0, None), (1002, float("nan"), 1.0), (1003, 1e20, 1.0), (1004, 91.0, 1.0), (1005, 1.0, 1e20), (1006, 1.0, float("inf")), (None, 0.0, 0.0)]
    points += points[:30] + [(2000, 10.0, 10.0), (2001, 10.0, 370.0), (2002, 90.0, 5.0), (2003, 90.0, 185.0)]
    df = spark.createDataFrame([(*p, "x", 1, 2.0) for p in points], "point_id long, lat double, lon double, slab string, cell int, x double")
    for km in (0.5, 3.0, 150.0):
        got = [tuple(r) for r in proximity.near_pairs(df, km).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(points, km)


def test_hot_place_is_split(spark):
    rng = random.Random(5)
    points = [(i, 1.0 + rng.random() * 0.001, 2.0 + rng.random() * 0.001) for i in range(120)]
    df = spark.createDataFrame(points, "point_id long, lat double, lon double")
    assert {tuple(r) for r in proximity.near_pairs(df, 0.05, block=10).collect()} == brute(points, 0.05)


def test_one_cell_holds_most_points(spark):
    rng = random.Random(7)
    points = [(i, 1.0 + rng.random() * 0.02, 2.0 + rng.random() * 0.04) for i in range(1500)] + [(2000 + i, 1.0 + rng.gauss(0, 0.05), 2.0 + rng.gauss(0, 0.05)) for i in range(300)]
    points += [(3000 + i, 89.99 + rng.random() * 0.009, rng.random() * 360) for i in range(200)] + [(4000 + i, -0.02 + rng.random() * 0.04, rng.random() * 0.1 - 0.05) for i in range(200)]
    df = spark.createDataFrame(points, "point_id long, lat double, lon double")
    for km, block in ((0.5, 100), (0.5, 3), (2.0, 50)):
        got = [tuple(r) for r in proximity.near_pairs(df, km, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(points, km)


def test_points_are_copied_to_few_cells(spark, data):
    from weftline.session import table

    points = table(spark, data.replace("sf0.001", "sf0.01"), "subset_points")
    plan = proximity.near_pairs(points, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(concat" in plan and "Join" not in plan


def test_empty(spark):
    assert proximity.near_pairs(spark.createDataFrame([], "point_id long, lat double, lon double"), 1).count() == 0


def test_regions(spark):
    rng = random.Random(6)
    polygons = {"square": [(0, 0), (0, 10), (10, 10), (10, 0)], "seam": [(-5, 350), (-5, 370), (5, 370), (5, 350)], "triangle": [(20.5, 30.2), (25.3, 40.1), (31.7, 33.3)], "line": [(1, 1), (2, 2)]}
    regions = spark.createDataFrame([(k, [{"lat": float(a), "lon": float(b)} for a, b in v]) for k, v in polygons.items()], "region_id string, vertices array<struct<lat: double, lon: double>>")
    points = [(i, rng.uniform(-10, 40), rng.uniform(-20, 60)) for i in range(800)] + [(9000, None, 1.0), (9001, 0.0, 0.0)]

    def inside(v, la, lo):
        hit = False
        for (a, b), (c, d) in zip(v, v[1:] + v[:1]):
            if a > c:
                a, b, c, d = c, d, a, b
            if a <= la < c and b + (d - b) * (la - a) / (c - a) <= lo:
                hit = not hit
        return hit

    want = {(i, k) for i, la, lo in points if la is not None for k, v in polygons.items() if len(v) > 2 and any(inside(v, la, lo % 360 + t) for t in (-360, 0, 360))}
    got = {tuple(r) for r in proximity.locate(spark.createDataFrame(points, "point_id long, lat double, lon double"), regions, height=3.0).collect()}
    for block in (5, 60):
        assert {tuple(r) for r in proximity.locate(spark.createDataFrame(points, "point_id long, lat double, lon double"), regions, height=3.0, block=block).collect()} == got
    assert proximity.locate(spark.createDataFrame(points, "point_id long, lat double, lon double"), regions.limit(0)).count() == 0
    assert got == want and ("square" in {k for _, k in got}) and ("seam" in {k for _, k in got})


def test_detailed_border(spark):
    """A star of many corners: thousands of edges in a slab."""
    rng = random.Random(8)
    ring = [(10 + (3 + rng.random()) * math.sin(2 * math.pi * k / 3000), 20 + (3 + rng.random()) * math.cos(2 * math.pi * k / 3000)) for k in range(3000)]
    regions = spark.createDataFrame([(7, [{"lat": a, "lon": b} for a, b in ring]), (None, [{"lat": 0.0, "lon": 0.0}] * 3), (8, None)], "region_id int, vertices array<struct<lat: double, lon: double>>")
    points = [(f"p{i}", rng.uniform(5, 15), rng.uniform(15, 25)) for i in range(400)]
    df = spark.createDataFrame(points, "name string, lat double, lon double")

    def inside(la, lo):
        return sum(1 for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]) if min(a, c) <= la < max(a, c) and b + (d - b) * (la - a) / (c - a) <= lo) % 2

    for height, block in ((1.0, 50_000), (4.0, 20)):
        got = {tuple(r) for r in proximity.locate(df, regions, key="name", height=height, block=block).collect()}
        assert got == {(i, 7) for i, la, lo in points if inside(la, lo)}
