import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from itinera.operators import covering, land
from itinera.operators.covering import cover, finder, locate
from itinera.plans import dims


def jagged(rng, x, y, size, n):
    return [(x + size * rng.uniform(0.6, 1) * math.cos(2 * a * math.pi / n), y + size * rng.uniform(0.6, 1) * math.sin(2 * a * math.pi / n)) for a in range(n)]


def layer(spark, polygons):
    return spark.createDataFrame(polygons, dims.land(spark).schema)


def check(spark, polygons, points, **options):
    index = cover(layer(spark, polygons), **options)
    rows = spark.createDataFrame([(i, y, x) for i, (y, x) in enumerate(points)], "k long, lat double, lon double")
    got = {r.k: r.landmass for r in locate(rows, index).collect()}
    plain = land.landmasses(np.array([p[1] for p in points]), np.array([p[0] for p in points]), [rings for _, _, rings in polygons])
    assert got == {i: None if m < 0 else polygons[m][1] for i, m in enumerate(plain.tolist())}
    return index


@pytest.mark.parametrize(("most", "small"), [(48, True), (4, True), (4, False)])
def test_split_cells_hold_the_same_points(spark, monkeypatch, most, small):
    """Jagged coasts with holes, corners on cell borders and points on corners, edges and borders."""
    if not small:
        monkeypatch.setattr(covering, "BROADCAST_EDGES", 0)
    rng = random.Random(5)
    polygons = [(i, f"p{i}", [jagged(rng, *at, 120), jagged(rng, at[0], at[1], 0.7, 60)]) for i, at in enumerate([(0, 0, 6.0), (3, 2, 4.0), (-9.5, -3.2, 2.5)])]
    polygons.append((3, "square", [[(10.0, 0.0), (12.0, 0.0), (12.0, 2.0), (10.0, 2.0)], [(10.5, 0.5), (11.5, 0.5), (11.0, 1.5)]]))
    polygons.append((4, "steps", [[(k / 8 + 14, (k % 3) / 4) for k in range(40)] + [(19.0, -2.0), (14.0, -2.0)]]))
    points = [(rng.uniform(-8, 9), rng.uniform(-13, 20)) for _ in range(3000)]
    points += [(y / 4, x / 4) for y in range(-10, 12) for x in range(36, 80)]
    points += [(y, x) for _, _, rings in polygons for ring in rings for x, y in ring[:30]]
    index = check(spark, polygons, points, most=most)
    assert (index.deepest > 0) == (most == 4)


def test_index_grows_with_its_edges(spark):
    """Many corners in a few degrees: cells stay small, and edges are copied a few times only."""
    rng, n = random.Random(1), 20_000
    ring = [((3 + 0.05 * math.sin(a * 0.37) + rng.uniform(0, 1e-3)) * math.cos(2 * math.pi * a / n), (3 + 0.05 * math.sin(a * 0.37)) * math.sin(2 * math.pi * a / n)) for a in range(n)]
    points = [(rng.uniform(-3.2, 3.2), rng.uniform(-3.2, 3.2)) for _ in range(200)]
    index = check(spark, [(0, "coast", [ring])], points)
    sizes = index.cells.select(F.explode("rings").alias("r")).select(F.size("r.edges").alias("n")).agg(F.sum("n"), F.max("n")).first()
    assert sizes[0] < 4 * n and sizes[1] <= covering.MOST_EDGES


def test_many_equal_points_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(covering, "BROADCAST_EDGES", 0)
    square = layer(spark, [(0, "square", [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]])])
    points = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0.5D ELSE id * 0.01 END AS lat", "CASE WHEN id % 3 = 0 THEN 0.5D ELSE id * 0.02 END AS lon")
    assert locate(points, square).filter("landmass IS NOT NULL").count() == points.filter("lat > 0 AND lat < 1 AND lon > 0 AND lon < 1").count()


def test_empty_layers_nulls_and_short_rings(spark):
    points = spark.createDataFrame([(0, None, 1.0), (1, 1.0, None), (2, 0.5, 0.5)], "k long, lat double, lon double")
    for polygons in ([], [(0, "line", [[(0.0, 0.0), (1.0, 1.0)]])], [(0, "none", [])]):
        assert [r.landmass for r in locate(points, layer(spark, polygons)).collect()] == [None] * 3
    both = layer(spark, [(1, "later", [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]]), (0, "first", [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.1), (0.0, 1.0)]])])
    assert {r.k: r.landmass for r in locate(points, both).collect()} == {0: None, 1: None, 2: "first"}


@pytest.mark.parametrize("most", [6, 48])
def test_the_finder_says_what_the_joins_say(spark, most):
    """On cells of many levels and holes, at corners and edges too, and legs' samples as arrays touch what their rows do."""
    star = [(3 + (2 if i % 2 else 0.7) * math.cos(i * math.pi / 40), 2 + (2 if i % 2 else 0.7) * math.sin(i * math.pi / 40)) for i in range(80)]
    polygons = [(1, "star", [star, [(2.9, 1.9), (3.1, 1.9), (3.1, 2.1), (2.9, 2.1)]]), (0, "square", [[(3.0, 2.0), (4.0, 2.0), (4.0, 3.0), (3.0, 3.0)]]), (2, "line", [[(0.0, 0.0), (1.0, 1.0)]])]
    index = cover(layer(spark, polygons), most)
    rng = random.Random(5)
    points = [(rng.uniform(-1, 6), rng.uniform(-1, 6)) for _ in range(3000)] + [*star, (3.0, 2.0), (3.1, 2.1), (4.0, 3.0), (-200.0, 50.0)]
    rows = spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(points)], "k long, lat double, lon double")
    want = {r.k: r.landmass is not None for r in locate(rows, index).collect()}
    found = finder(index).on_land(*np.array(points).T)
    assert [want[i] for i in range(len(points))] == found.tolist() and any(want.values())
    at = lambda: (rng.uniform(1, 3), rng.uniform(2, 4))
    legs = [(1, i, *at(), *(at() if i % 9 else (2.0, 2.0)), [at() for _ in range(i % 4)] if i % 5 else None) for i in range(300)]
    legs += [(1, 300, 2.0, 2.0, 2.0, 2.0, None), (1, 301, None, 2.0, 2.0, 3.0, None), (1, 302, 1.0, 2.0, 1.0, 2.0, [(1.0, 2.0), (2.0, 3.0)])]
    rows = spark.createDataFrame(legs, "trip long, leg long, from_lat double, from_lon double, to_lat double, to_lon double, via array<struct<lat: double, lon: double>>")
    arrays, joins = ({r.leg: (r.land, r.water) for r in land.touched(rows, replace(index, small=small), step_km=2).collect()} for small in (True, False))
    assert arrays == joins and arrays[300] == arrays[301] == (False, False) and set(arrays.values()) >= {(True, True), (True, False)}
    assert finder(cover(layer(spark, []))).on_land(np.zeros(2), np.zeros(2)).tolist() == [False, False]


def test_samples_of_legs_make_no_rows(spark):
    rows = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0)], "trip long, leg long, from_lat double, from_lon double, to_lat double, to_lon double")
    plan = land.touched(rows, layer(spark, [(0, "a", [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]])]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
