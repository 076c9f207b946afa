import math

import pytest
from pyspark.sql import functions as F

from itinera.operators import clusters, folds, hubs, land, legs, places, routing, trips
from itinera.plans import dims

KM = 1 / 111.19492664455873  # degrees of latitude in a kilometre
HOUR = 3_600_000_000


def photos(spark, rows):
    return spark.createDataFrame([(1, i, us, lat, lon) for i, (us, lat, lon) in enumerate(rows)], "owner long, photo_id long, us long, lat double, lon double")


@pytest.mark.parametrize("rows, labels", [
    ([(0, 0.0, 0.0), (14 * HOUR, 0.0, 0.0)], [0, 0]),
    ([(0, 0.0, 0.0), (14 * HOUR + 1, 0.0, 0.0)], [0, 1]),
    ([(0, 0.0, 0.0), (1, 5.99 * KM, 0.0), (2, 20 * KM, 0.0)], [0, 0, 1]),
    ([(0, 0.0, 0.0), (20 * 60_000_000, 1.6 * KM, 0.0)], [0, 0]),
    ([(0, 0.0, 0.0), (20 * 60_000_000 + 1, 1.6 * KM, 0.0)], [0, 1]),
    ([(0, 0.0, 0.0), (None, 0.0, 0.0), (15 * HOUR, 0.0, 0.0)], [0, 1, 1]),
    ([(0, 0.0, 0.0), (1, 30 * KM, 0.0), (2, 0.0, 0.0)], [0, 1, 2]),
])
def test_photo_clusters(spark, rows, labels):
    got = {r.photo_id: r.cluster for r in clusters.label_photos(photos(spark, rows)).collect()}
    by_time = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    assert [got[i] for i in by_time] == labels
    assert clusters.unplaced(photos(spark, [(0, None, 1.0), (0, 1.0, 1.0)])).count() == 1


def stops_at(spark, positions, extra=""):
    rows = [(1, i, 1, p * KM, 0.0, i * HOUR, i * HOUR, [i], *n) for i, (p, *n) in enumerate(positions)]
    schema = "owner long, cluster int, n long, lat double, lon double, start_us long, end_us long, photo_ids array<int>"
    return spark.createDataFrame(rows, schema + extra)


def test_merge_reaches_by_grain_and_names(spark):
    close = stops_at(spark, [(0,), (4,), (1,)])
    assert [r.merge_km for r in clusters.merge_km(close).collect()] == [5.0]
    spread = stops_at(spark, [(0,), (3,), (30,), (34,)])  # steps 3, 27, 4: upper median 4
    assert math.isclose(clusters.merge_km(spread).first().merge_km, 2.4, rel_tol=1e-6)
    named = stops_at(spark, [(0, "a"), (11.9, "a"), (40, "b"), (41, "c")], ", city string")
    merged = {r.place: r.merged for r in clusters.merge_clusters(named, name="city").collect()}
    assert merged == {0: 2, 1: 1, 2: 1}
    wet = stops_at(spark, [(0, False), (1, True), (1.5, False)], ", sea boolean")
    got = clusters.merge_clusters(wet, apart="sea")
    assert {r.place: r.merged for r in got.collect()} == {0: 1, 1: 2}
    days = clusters.split_days(got).orderBy("day").collect()
    assert [(r.day, r.date, r.photo_ids) for r in days] == [(1, "1970-01-01", [1]), (2, "1970-01-01", [2])]


def test_fold_keeps_keys_together_when_a_join_turns_into_a_broadcast(spark):
    # The plan shuffles by owner for the join, which at run time broadcasts one side and reads the other where it lies.
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    held = spark.range(4000).selectExpr("id % 20 AS owner", "id div 20 AS k").repartition(7, "k")
    rows = held.join(held.groupBy("owner").agg(F.count("k").alias("n")), "owner", "left")

    def numbers():
        seen = iter(range(4000))
        return lambda k: next(seen)

    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        assert all(r.at == r.k for r in folds.fold_rows(rows, "owner", ["k"], ["k"], numbers, "at").collect())
    finally:
        for k in confs:
            spark.conf.unset(k)


def trip(spark, kms, names=None, hub=None):
    rows = [(1, i, (names or "ABCDEFGH")[i], None if k is None else k * KM, 0.0, None if hub is None else hub[i]) for i, k in enumerate(kms)]
    return spark.createDataFrame(rows, "trip long, seq int, name string, lat double, lon double, hub_id string")


def test_hubs_chain_by_anchor_and_declared_ids(spark):
    chain = hubs.proximity_groups(trip(spark, [0, 0.9, 1.8, None, 0.5]))
    assert {r.seq: r.anchor for r in chain.collect()} == {0: 0, 1: 0, 2: 2, 4: 0}
    tied = hubs.proximity_groups(trip(spark, [0, 50, 0, 50], hub=["x", None, None, "x"]))
    assert {r.seq: r.anchor for r in tied.collect()} == {0: 0, 1: 1, 2: 0, 3: 0}
    found = hubs.detect_hubs(hubs.proximity_groups(trip(spark, [0, 9, 0, 9, 0, 9]))).collect()
    assert {(r.anchor, r.visits, r.is_primary) for r in found} == {(0, 3, True), (1, 3, False)}


@pytest.mark.parametrize("kms, want", [
    ([0, 50, 0, 60, 70, 0, 80], [(0, 2, 1, "to B & back"), (2, 5, 2, "to D & E & back")]),
    ([0, 0, 0, 50], []),
    ([0, 10, 20, 30, 0, 0], [(0, 4, 3, "to B, C & 1 more & back")]),
    ([0, 10, 0], []),
])
def test_day_trips(spark, kms, want):
    got = hubs.day_trips(trip(spark, kms)).orderBy("start_seq").collect()
    assert [(r.start_seq, r.end_seq, r.spokes, r.label) for r in got] == want


def test_a_bad_stop_breaks_two_legs(spark):
    rows = legs.legs_of(trip(spark, [0, 10, None, 20, 30], names=["", "B", "C", "D", "E"])).orderBy("leg").collect()
    assert [(r.leg, r.from_name, r.to_name) for r in rows] == [(0, "stop-1", "B"), (3, "D", "E")]


def test_samples_follow_via_points(spark):
    point = "struct<lat: double, lon: double>"
    rows = spark.createDataFrame([(1, 0, [(0.0, 0.0), (0.0, 1.0), (0.0, 3.0)]), (1, 1, [(5.0, 5.0), (5.0, 5.0)])], f"trip long, leg int, path array<{point}>")
    inner = legs.sample_legs(rows, step_km=100).orderBy("s").collect()
    assert [round(r.lon, 6) for r in inner] == [0.75, 1.5, 2.25] and {r.leg for r in inner} == {0}
    ends = legs.sample_legs(rows, step_km=111.2, least=2, ends=True).orderBy("leg", "s").collect()
    assert [(r.leg, round(r.lon, 6)) for r in ends] == [(0, 0.0), (0, 1.0), (0, 2.0), (0, 3.0), (1, 5.0), (1, 5.0)]
    crossed = rows.select("leg", land.crosses_terrain(F.col("path"), lambda lon, lat: F.when(lon.between(1.15, 1.25), 0.5)).alias("x")).orderBy("leg").collect()
    assert [r.x for r in crossed] == [True, False]


def test_land_holes_notches_and_packs(spark):
    pts = spark.createDataFrame([("in", 38.0, 31.0), ("hole", 38.0, 40.0), ("rim", 36.0, 40.0), ("notch", 35.0, 32.0), ("arm", 35.0, 30.5), ("sea", 34.0, 28.0)], "p string, lat double, lon double")
    got = {r.p: r.landmass for r in land.locate(pts, dims.land(spark)).collect()}
    assert got == {"in": "main", "hole": None, "rim": "lake-land", "notch": None, "arm": "notch", "sea": None}
    pack = spark.createDataFrame([(0, "fine", [[(30.0, 37.0), (30.5, 37.0), (30.5, 37.5), (30.0, 37.5)]])], dims.land(spark).schema)
    box = spark.createDataFrame([(29.5, 36.5, 31.5, 38.5)], "w double, s double, e double, n double")
    fine = {r.p: r.on_land for r in land.locate_in_layers(pts, pack, box, dims.land(spark)).collect()}
    assert fine == {"in": False, "hole": False, "rim": True, "notch": False, "arm": True, "sea": False}


def leg_rows(spark, ends, extra=(), schema=""):
    rows = [(1, i, *e, *x) for i, (e, x) in enumerate(zip(ends, extra or [()] * len(ends)))]
    return spark.createDataFrame(rows, "trip long, leg int, from_lat double, from_lon double, to_lat double, to_lon double" + schema)


def test_landmasses_are_three_valued(spark):
    ends = [(38.0, 31.0, 38.0, 32.0), (38.0, 31.0, 38.0, 38.0), (38.0, 31.0, 20.0, 0.0), (35.95, 31.0, 38.0, 31.0), (38.0, 31.0, 35.85, 35.0)]
    got = {r.leg: r.same for r in land.same_landmass(leg_rows(spark, ends), dims.land(spark)).collect()}
    assert got == {0: True, 1: False, 2: None, 3: True, 4: None}
    apart = {r.leg: r.apart for r in land.across_water(leg_rows(spark, ends), dims.land(spark)).collect()}
    assert apart[0] is False and apart[1] is True and apart[2] is True


def test_vehicles(spark):
    ends = [(38.0, 31.0, 38.01, 31.0), (38.0, 31.0, 38.0, 35.0), (38.0, 31.0, 38.0, 42.5), (34.0, 30.5, 34.0, 33.5), (38.0, 31.0, -30.0, 31.0), (38.0, 31.0, -30.0, 31.0), (None, 31.0, 38.0, 35.0), (38.0, 31.0, 38.0, 35.0)]
    extra = [("modern", None), ("modern", 1960), ("classical", None), ("classical", None), ("industrial", 1910), ("industrial", 1850), ("modern", None), ("none", None)]
    got = land.infer_vehicles(leg_rows(spark, ends, extra, ", era string, year int"), dims.land(spark)).orderBy("leg").collect()
    assert [r.suggestion for r in got] == ["foot", "modern-car", "trireme", "roman-cart", "biplane", "steamer", "plane", "car"]


def test_audit_finds_the_wrong_medium(spark):
    ends = [(38.0, 31.0, 38.0, 36.0), (38.0, 31.0, 38.0, 28.0), (34.0, 28.0, 34.0, 29.5), (38.0, 31.0, 38.0, 28.0)]
    rows = leg_rows(spark, ends, [("car",), (" Galley ",), ("ferry",), ("jet",)], ", vehicle string")
    got = land.audit_legs(rows, dims.land(spark)).collect()
    assert [(r.leg, r.kind, len(r.examples)) for r in got] == [(1, "boat-over-land", 3)]
    assert land.audit_trips(rows, dims.land(spark)).first().findings == [1]


def test_routes_stay_in_their_medium(spark):
    polygons = [rings for _, rings in dims.LAND]
    rows = leg_rows(spark, [(34.0, 29.0, 36.0, 36.8), (33.5, 28.0, 33.5, 29.0), (35.2, 31.0, 35.2, 33.0)], [("boat",), ("boat",), ("car",)], ", vehicle string")
    for medium, want in (("sea", {0: True, 1: False}), ("land", {2: True})):
        got = routing.route_legs(rows, dims.land(spark), medium).collect()
        assert {r.leg: r.routed for r in got} == want
        for r in got:
            path = [(p.lon, p.lat) for p in r.path]
            first = next(e for e in rows.collect() if e.leg == r.leg)
            assert path[0] == (first.from_lon, first.from_lat) and path[-1] == (first.to_lon, first.to_lat)
            if r.routed:
                for a, b in zip(path[1:-2], path[2:-1]):
                    assert routing.stays(a, b, lambda x, y: routing.on_land(x, y, polygons) == (medium == "land"), 0.08)
    assert routing.find_path((0.0, 0.0), (1.0, 1.0), lambda x, y: x < 0.4, "sea") is None


@pytest.mark.parametrize("medium", ["sea", "land"])
def test_routes_avoid_what_the_moves_of_the_grid_miss(medium):
    clear = routing.find_path((0.0, 0.0), (3.0, 3.0), lambda x, y: x == x, medium)
    (x1, y1), (x2, y2) = clear[9:11]
    rock = lambda x, y: (abs(x - (x1 + x2) / 2) > 1e-3) | (abs(y - (y1 + y2) / 2) > 1e-3)
    assert not routing.stays(*clear[9:11], rock, 0.08)
    way = routing.find_path((0.0, 0.0), (3.0, 3.0), rock, medium)
    assert all(routing.stays(a, b, rock, 0.08) for a, b in zip(way[:-1], way[1:]))


def test_nearest_place_near_the_date_line_and_poles(spark):
    held = spark.createDataFrame([(1, "a", 10.0, 179.9), (2, "b", 89.9, 10.0), (3, "c", 10.0, -179.5)], "idx long, name string, lat double, lon double")
    asked = spark.createDataFrame([(1, 10.0, -179.95), (2, 89.9, -170.0), (3, 10.0, 0.0), (4, None, 0.0)], "q long, lat double, lon double")
    got = {r.q: r.idx for r in places.nearest_within(asked, held, 60.0).collect()}
    assert got == {1: 1, 2: 2, 3: None, 4: None}


def test_search_tiers(spark):
    rows = [(1, "Rome", 3000.0, None), (2, "Romeo", 9000.0, None), (3, "New Rome", 10.0, None), (4, "Naples", 900.0, {"it": "Napoli"}), (5, "Room", 1.0, None), (6, "Ağrı", 5.0, None)]
    held = spark.createDataFrame(rows, "idx long, name string, pop double, alt map<string,string>")
    alias = spark.createDataFrame([("roma", "Rome")], "alias string, name string")
    asked = spark.createDataFrame([("rome",), ("ROMA",), ("napoli",), ("nm",), ("agri",), ("",)], "query string")
    got = {}
    for r in places.search(asked, held, alias).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.idx, r.tier))
    assert got["rome"] == [(1, 0), (2, 0), (3, 2)]
    assert got["ROMA"][0] == (1, 1) and (1, 3) not in got["ROMA"] and got["napoli"] == [(4, 0)] and got["agri"] == [(6, 0)]
    assert "nm" not in got and "" not in got


def test_new_places_absorb_later_ones(spark):
    known = spark.createDataFrame([(1, "Çeşme", 38.3, 26.3)], "idx long, name string, lat double, lon double")
    batch = [(1, "cesme", 38.31, 26.3), (2, "Foça", 38.6, 26.7), (3, "FOCA", 38.62, 26.72), (4, "Foça", 39.0, 26.7), (5, "", 1.0, 1.0)]
    got = {r.ord: (r.is_new, r.idx) for r in places.new_places(known, spark.createDataFrame(batch, "ord long, name string, lat double, lon double")).collect()}
    assert got == {1: (False, 1), 2: (True, None), 3: (False, None), 4: (True, None)}


def test_migration_steps(spark):
    schema = "store long, version int, theme string, high_contrast boolean, trips array<struct<era: string, theme: string>>"
    rows = [(1, None, "hc", None, [("anatolia", "hc")]), (2, 1, "meadow", True, [("anatolia", "x")]), (3, 2, "hc", None, [("anatolia", "hc")]), (4, 0, None, None, None), (5, 7, "t", None, [])]
    got = {r.store: (r.version, r.theme, r.high_contrast, r.trips and [tuple(t) for t in r.trips]) for r in trips.migrate_stores(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == (2, "parchment", True, [("bronze-age", "nineteen-thirties-parchment")]) and got[2] == (2, "meadow", True, [("anatolia", "x")])
    assert got[3] == (2, "hc", False, [("anatolia", "hc")]) and got[4] == (2, None, False, None) and got[5][0] == 7


def test_addon_urls(spark):
    urls = ["http://x/data/regions/a.json", "http://x/a.MP3?x=1", "http://x/data/sample-trips/index.json", "http://x/data/sample-trips/era/id.json", "http://x/?q=/data/regions/", None]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(trips.is_addon(F.col("u")).alias("a")).collect()
    assert [r.a for r in got] == [True, True, False, True, False, False]


def test_nearest_place_across_the_flat_line(spark):
    held = [(1, "a", 76.85, 25.0), (2, "b", 76.83, -140.0), (3, "c", -76.85, 100.0), (4, "d", -76.83, 170.0)]
    asked = [(1, 76.83, 25.0), (2, 76.85, -140.0), (3, -76.83, 100.0), (4, -76.85, 170.0), (5, 76.85, 60.0)]
    held = spark.createDataFrame(held, "idx long, name string, lat double, lon double")
    asked = spark.createDataFrame(asked, "q long, lat double, lon double")
    got = {r.q: r.idx for r in places.nearest_within(asked, held, 60.0).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: None}


def test_a_long_fold_is_linear(spark):
    """One owner with 100,000 photos: the state is a few numbers, and nothing is gathered."""
    rows = spark.range(100_000).select(F.lit(1).alias("owner"), F.col("id").alias("photo_id"), (F.col("id") * 3_600_000_000).alias("us"), (F.col("id") % 7 * KM).alias("lat"), F.lit(0.0).alias("lon"))
    found = clusters.label_photos(rows)
    assert found.count() == 100_000 and found.agg(F.max("cluster")).first()[0] > 1000


def test_merge_vetoes_water_from_the_merged_place(spark):
    """The place merged so far is compared, not the stop before: its centre lies on the other landmass."""
    shore = spark.createDataFrame([(0, "west", [[(0.0, 0.0), (0.02, 0.0), (0.02, 1.0), (0.0, 1.0)]]), (1, "east", [[(0.03, 0.0), (0.2, 0.0), (0.2, 1.0), (0.03, 1.0)]])], dims.land(spark).schema)
    schema = "owner long, cluster int, n long, lat double, lon double, start_us long, end_us long, photo_ids array<int>"
    at = [(1, i, n, 0.5, lon, i * HOUR, i * HOUR, [i]) for i, (n, lon) in enumerate([(9, 0.015), (1, 0.0155), (1, 0.033)])]
    merged = lambda coast: {r.place: r.merged for r in clusters.merge_clusters(spark.createDataFrame(at, schema), land=coast).collect()}
    assert merged(None) == {0: 3} and merged(shore) == {0: 2, 1: 1}


def test_diameter_by_box_and_by_pairs(spark):
    import random

    rng = random.Random(2)
    rows = []
    for owner in range(200):
        lat, lon, size = rng.uniform(-80, 80), rng.choice([rng.uniform(-170, 170), 179.99]), rng.choice([0.01, 0.03, 0.045, 0.06, 0.2])
        for i in range(rng.randint(1, 6)):
            x = lon + rng.uniform(-size, size)
            rows.append((owner, i, lat + rng.uniform(-size, size) * 0.7, x - 360 if x > 180 else x))
    got = {r.owner: r.merge_km for r in clusters.merge_km(spark.createDataFrame(rows, "owner long, cluster int, lat double, lon double")).collect()}
    from itinera.operators.folds import km_between

    for owner in range(200):
        at = [r[2:] for r in rows if r[0] == owner]
        steps = sorted(km_between(*a, *b) for a, b in zip(at, at[1:]))
        near = max(km_between(*a, *b) for a in at for b in at) <= 5
        want = 5.0 if near else max(1.0, min(5.0, steps[len(steps) // 2] * 0.6))
        assert math.isclose(got[owner], want, rel_tol=1e-9), owner


def test_clipped_polygons_hold_the_same_points(spark):
    """A jagged coast of many corners over many cells, with holes, against the plain test of whole rings."""
    import random

    import numpy as np

    rng, polygons = random.Random(5), []
    for i, (x, y, size) in enumerate([(0, 0, 6.0), (3, 2, 4.0), (-9.5, -3.2, 2.5)]):
        ring = [(x + size * rng.uniform(0.6, 1) * math.cos(a * math.pi / 60), y + size * rng.uniform(0.6, 1) * math.sin(a * math.pi / 60)) for a in range(120)]
        polygons.append((i, f"p{i}", [ring, [(x - 1.0, y - 1.0), (x + 1.0, y - 1.0), (x + 1.0, y + 1.0), (x - 1.0, y + 1.0)]]))
    points = [(i, rng.uniform(-8, 9), rng.uniform(-13, 9)) for i in range(3000)] + [(3000 + i, float(y), float(x)) for i, (y, x) in enumerate([(0, 0), (1, 1), (-1, 5), (2, -9)])]
    found = land.locate(spark.createDataFrame(points, "k long, lat double, lon double"), spark.createDataFrame(polygons, dims.land(spark).schema)).collect()
    plain = land.landmasses(np.array([p[2] for p in points]), np.array([p[1] for p in points]), [rings for _, _, rings in polygons])
    assert {r.k: r.landmass for r in found} == {p[0]: None if m < 0 else f"p{m}" for p, m in zip(points, plain.tolist())}


def test_nearest_place_does_not_depend_on_row_numbers(spark):
    held = spark.createDataFrame([(i, f"p{i}", i * 0.3, i * 0.5) for i in range(100)], "idx long, name string, lat double, lon double")
    asked = spark.createDataFrame([(i, i % 100 * 0.3, i % 100 * 0.5) for i in range(400)], "q long, lat double, lon double").repartition(7, F.rand())
    got = places.nearest_within(asked, held, 20.0).repartition(5).collect()
    assert len(got) == 400 and all(r.idx == r.q % 100 for r in got)


def test_refined_places_move_and_rename(spark):
    known = spark.createDataFrame([(1, "Izmir", 38.40, 27.10, 100.0, ""), (2, "Foca", 38.6, 26.7, 5.0, "TR")], "idx long, name string, lat double, lon double, pop double, cc string")
    batch = spark.createDataFrame([(1, "İzmir", 38.44, 27.14, 4000.0, "TR"), (2, "IZMIR", 38.48, 27.18, 1.0, "GR"), (3, "Izmir", 38.41, 27.11, 1.0, None), (4, "New", 1.0, 1.0, None, None)], "ord long, name string, lat double, lon double, pop double, cc string")
    got = {(r.idx, r.first_ord): (r.name, r.lat, r.lon, r.pop, r.cc) for r in places.refine_places(known, batch).collect()}
    assert got == {(1, None): ("IZMIR", 38.48, 27.18, 4000.0, "TR"), (2, None): ("Foca", 38.6, 26.7, 5.0, "TR"), (None, 3): ("Izmir", 38.41, 27.11, 1.0, ""), (None, 4): ("New", 1.0, 1.0, 0.0, "")}


def test_search_keys_lose_no_match(spark):
    """Against every pair of query and name."""
    import random

    rng = random.Random(8)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(120)})
    held = spark.createDataFrame([(i, w, float(i % 7)) for i, w in enumerate(words)], "idx long, name string, pop double")
    queries = sorted({"".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(60)})
    got = {(r.query, r.idx, r.tier) for r in places.search(spark.createDataFrame([(q,) for q in queries], "query string"), held, spark.createDataFrame([], "alias string, name string"), limit=1000).collect()}
    want = set()
    for q in queries:
        hits = {(q, i, 0 if w.startswith(q) else 2) for i, w in enumerate(words) if q in w}
        near = lambda a, b: a == b or any(a[:i] + a[i + 1 :] == b for i in range(len(a))) or any(b[:i] + b[i + 1 :] == a for i in range(len(b))) or (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1)
        more = {(q, i, 3) for i, w in enumerate(words) if near(q, w) and q not in w} if len(q) >= 3 and len(hits) < 3 else set()
        want |= hits | more
    assert got == want


def test_steep_roads_are_led_around(spark):
    flat = [[[(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (0.0, 6.0)]]]
    hill = lambda lon, lat: 0.9 if 2.6 < lon < 3.4 and lat < 3.6 else 0.0
    straight = [(1.0, 3.0), (5.0, 3.0)]
    assert routing.route(straight, flat, "land") == straight
    way = routing.route(straight, flat, "land", hill)
    assert len(way) > 2 and all(hill(*p) == 0 for p in way) and routing.keeps_medium(way, straight, flat, "land")
    coast = spark.createDataFrame([(0, "all", flat[0])], dims.land(spark).schema)
    rows = leg_rows(spark, [(3.0, 1.0, 3.0, 5.0), (5.0, 1.0, 5.0, 2.0)], [("car",), ("car",)], ", vehicle string")
    column = lambda lon, lat: F.when((lon > 2.6) & (lon < 3.4) & (lat < 3.6), 0.9).otherwise(0.0)
    got = {r.leg: r for r in routing.route_legs(rows, coast, "land", hill, column).collect()}
    assert got[0].routed and got[0].kept and len(got[0].path) > 2 and not got[1].routed


def test_vertices_unwrap_the_hinted_way(spark):
    point = "struct<lat: double, lon: double>"
    rows = spark.createDataFrame([(1, 170.0, [(1.0, -175.0), (None, 3.0)], -160.0, None), (2, 10.0, None, 20.0, "west"), (3, 0.0, [(0.0, 90.0)], 0.0, "East")], f"k long, a double, via array<{point}>, b double, hint string")
    path = legs.expanded_vertices(F.lit(0.0), F.col("a"), F.col("via"), F.lit(0.0), F.col("b"), F.col("hint"), F.lit(None).cast("double"))
    got = {r.k: [p.lon for p in r.path] for r in rows.select("k", path.alias("path")).collect()}
    assert got == {1: [170.0, 185.0, 200.0], 2: [10.0, -340.0], 3: [0.0, 90.0, 360.0]}


def test_many_views_show_what_each_shows_alone(spark, monkeypatch):
    monkeypatch.setattr(places, "VIEW_BLOCK", 3)
    rows = [(i, float(i % 17), float(i % 23), float(i % 4) if i % 11 else None, i % 50 == 0) for i in range(900)] + [(900, None, None, 3.0, None)]
    held = spark.createDataFrame(rows, "ord long, lat double, lon double, score double, exempt boolean").repartition(5)
    views = [("a", 3.0, 4.0, 2.0), ("b", 9.0, 9.0, 4.0), ("c", 0.0, 0.0, 6.0), ("d", 5.0, 1.0, 8.0), ("e", 5.0, 1.0, 2.0), ("f", 1.0, 1.0, 50.0), ("g", 1.0, 7.0, 4.0)]
    got = places.density_budgets(held, spark.createDataFrame(views, "view string, lat double, lon double, zoom double")).collect()
    for name, lat, lon, zoom in views:
        want = sorted(map(tuple, places.density_budget(held, lat, lon, zoom).collect()))
        assert sorted((r.ord, r.exempt) for r in got if r.view == name) == want, name
    empty = places.density_budgets(held.limit(0), spark.createDataFrame(views, "view string, lat double, lon double, zoom double"))
    assert empty.count() == 0


def test_search_broadcasts_only_what_it_counted(spark, tmp_path, monkeypatch):
    spark.range(3000).selectExpr("id AS idx", "concat('Town ', lpad(id, 9, '0')) AS name", "cast(id % 100 AS double) AS pop").write.parquet(f"{tmp_path}/places")
    asked = spark.createDataFrame([("Town 000000007",), ("Twn 000000008",), ("town",)], "query string")
    search = lambda: places.search(asked, spark.read.parquet(f"{tmp_path}/places"), spark.createDataFrame([("village", "Town 000000009")], "alias string, name string"))
    want = sorted(search().collect())
    monkeypatch.setattr(places, "FEW_ROWS", 0)
    got = search()
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(got.collect()) == want and len(want) > 9


def test_views_by_number_change_neither_plan_nor_rows(spark, monkeypatch):
    """Blocks of views and of rows, tied ones too, are dealt out as rows: the plan doesn't grow with them."""
    for name, size in (("VIEW_BLOCK", 3), ("ROW_BLOCK", 2), ("TIED_BLOCK", 40), ("KEPT", 60)):
        monkeypatch.setattr(places, name, size, raising=False)
    held = spark.range(400).selectExpr("id AS ord", "cast(id % 19 AS double) AS lat", "cast(id % 23 AS double) AS lon", "cast(id % 2 AS double) AS score", "id % 40 = 0 AS exempt")
    asked = lambda n: spark.range(n).selectExpr("id AS view", "cast(id AS double) AS lat", "cast(id % 5 AS double) AS lon", "CASE WHEN id % 2 = 0 THEN 2D ELSE 6D END AS zoom")
    few, many = (places.density_budgets(held, asked(n)) for n in (4, 25))
    size = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size(few) == size(many)
    got = many.collect()
    for n in range(25):
        want = sorted(map(tuple, places.density_budget(held, float(n), float(n % 5), 6.0 if n % 2 else 2.0).collect()))
        assert sorted((r.ord, r.exempt) for r in got if r.view == n) == want, n


def test_a_query_that_all_places_match(spark):
    """Each task keeps eight rows of a query; the rarest piece is looked up, not the first."""
    held = spark.range(4000).selectExpr("id AS idx", "concat('Town ', id) AS name", "cast(id % 100 AS double) AS pop", "map('xx', concat('Ville ', id)) AS alt")
    asked = spark.createDataFrame([("t",), ("town",), ("ville 77",), ("n 3999",), ("vile 1234",)], "query string")
    found = places.search(asked, held, spark.createDataFrame([("ville 77", "Town 5"), ("zz", "Town 6")], "alias string, name string"))
    got = {}
    for r in found.orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.idx, r.tier))
    best = [(i * 100 + 99, 0) for i in range(8)]
    assert got["t"] == best and got["town"] == best and got["n 3999"] == [(3999, 2)]
    assert got["ville 77"][0] == (779, 0) and got["ville 77"][-1] != (5, 1) and len(got["ville 77"]) == 8
    assert "vile 1234" not in got


def test_the_route_memo_searches_what_it_lacks(spark, tmp_path):
    """A second run searches nothing; a changed coast only the legs near the change; the other medium is its own."""
    square = lambda x: [[(x, 0.4), (x + 0.4, 0.4), (x + 0.4, 0.6), (x, 0.6)]]
    coast = lambda far: spark.createDataFrame([(0, "near", square(1.0)), (1, "far", square(far))], dims.land(spark).schema)
    rows = leg_rows(spark, [(0.5, 0.8, 0.5, 1.8), (0.5, 20.8, 0.5, 21.9), (0.5, 0.8, 0.5, 1.8)], [("boat",)] * 3, ", vehicle string")
    memo = str(tmp_path / "memo")

    def run(land_layer):
        routing.route_legs(rows, land_layer, "sea", memo=memo)
        got = {r.leg: (r.routed, r.run, len(r.path)) for r in routing.route_legs(rows, land_layer, "sea", memo=memo).collect()}
        return got, spark.read.parquet(memo).count()

    first, n = run(coast(21.0))
    assert n == 2 and all(r[:2] == (True, 1) and r[2] > 2 for r in first.values()) and first[0] == first[2]
    second, n = run(coast(21.2))
    assert n == 3 and second[0] == first[0] and second[1][:2] == (True, 2)
    plain = {r.leg: r.path for r in routing.route_legs(rows, coast(21.2), "sea").collect()}
    assert plain == {r.leg: r.path for r in routing.route_legs(rows, coast(21.2), "sea", memo=memo).collect()}


def test_nearest_place_among_crowds(spark, monkeypatch):
    """Crowded cells are split level by level: crowds, one spot with many places, the date line, ties and places left out."""
    import random

    from itinera.operators.folds import km_between

    monkeypatch.setattr(places, "LEAF_PLACES", 4)
    rng = random.Random(6)
    held = [(10.0 + rng.gauss(0, 0.02), 20.0 + rng.gauss(0, 0.02)) for _ in range(300)] + [(50.0, 7.0)] * 40
    held += [(-5 + rng.uniform(-0.2, 0.2), (180 + rng.uniform(-0.2, 0.2) + 180) % 360 - 180) for _ in range(150)] + [(rng.uniform(-89, 89), rng.uniform(-180, 180)) for _ in range(100)]
    held += [(78 + rng.uniform(-1, 1), rng.uniform(-2, 2)) for _ in range(60)]
    asked = [(y + rng.gauss(0, 0.05), x + rng.gauss(0, 0.05)) for y, x in rng.sample(held, 150)] + held[::7] + [(10.3, 20.0)] * 30
    rows = spark.createDataFrame([(i, f"p{i}", y, x) for i, (y, x) in enumerate(held)], "idx long, name string, lat double, lon double")
    for same in (None, "own"):
        spots = [(q, y, x, next((i for i, p in enumerate(held) if p == (y, x)), -1)) for q, (y, x) in enumerate(asked)]
        got = places.nearest_within(spark.createDataFrame(spots, "q long, lat double, lon double, own long"), rows, 25.0, same)
        got = {r.q: (r.idx, r.km) for r in got.collect()}
        for q, y, x, own in spots:
            near = sorted((km_between(y, x, *p), i) for i, p in enumerate(held) if not (same and i == own))
            if near[0][0] > 25.0:
                assert got[q] == (None, None)
            else:
                assert math.isclose(got[q][1], near[0][0], abs_tol=1e-7) and math.isclose(near[0][0], km_between(y, x, *held[got[q][0]]), abs_tol=1e-7), q
                assert near[0][0] > 0 or got[q][0] == near[0][1]
