import json
import struct

import pytest
from pyspark.sql import functions as F

from itinera.operators import legs, trips
from itinera.sources import packs, readers


def jpeg(order="<", lat=(38, 30, 0), ref=b"N", lon=(26, 15, 0), lon_ref=b"E", taken=b"2024:02:30 10:11:12"):
    """A JPEG with an EXIF segment of a time and a position."""
    def entry(tag, kind, count, value):
        return struct.pack(order + "HHI", tag, kind, count) + value

    def packed(fmt, *v):
        return struct.pack(order + fmt, *v)

    root, exif, gps, data = 8, 38, 56, 120
    body = packed("H", 2) + entry(0x8769, 4, 1, packed("I", exif)) + entry(0x8825, 4, 1, packed("I", gps)) + packed("I", 0)
    body += packed("H", 1) + entry(0x9003, 2, 20, packed("I", data)) + packed("I", 0)
    rationals = lambda v: b"".join(packed("II", x, 1) for x in v)
    body += packed("H", 4) + entry(1, 2, 2, ref + b"\0\0\0") + entry(2, 5, 3, packed("I", data + 20))
    body += entry(3, 2, 2, lon_ref + b"\0\0\0") + entry(4, 5, 3, packed("I", data + 44)) + packed("I", 0)
    body = body.ljust(data - root, b"\0") + taken.ljust(20, b"\0") + rationals(lat) + rationals(lon)
    tiff = (b"II" if order == "<" else b"MM") + packed("HI", 42, root) + body
    segment = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\0\x04ab\xff\xe1" + struct.pack(">H", len(segment) + 2) + segment + b"\xff\xd9"


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif_fields(order):
    lat, lon, taken = readers.exif_fields(jpeg(order, ref=b"S"))
    assert (lat, lon, str(taken)) == (-38.5, 26.25, "2024-03-01 10:11:12")
    assert readers.exif_fields(jpeg(order, lat=(0, 0, 0), lon=(0, 0, 0)))[:2] == (None, None)
    assert readers.exif_fields(jpeg(order, lat=(95, 0, 0)))[:2] == (None, 26.25)


def test_damaged_photos_give_nulls():
    data = jpeg()
    for n in range(0, len(data), 7):
        readers.exif_fields(data[:n])
    assert readers.exif_fields(b"") == readers.exif_fields(b"\x89PNG") == (None, None, None)


def test_photo_scan(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(jpeg())
    (tmp_path / "b.heic").write_bytes(b"\0\0\0\x18ftypheic\0\0\0\0")
    (tmp_path / "c.jpg").write_bytes(b"no photo")
    got = {r.path.rsplit("/", 1)[-1]: r for r in readers.scan_photos(spark, str(tmp_path)).collect()}
    assert (got["a.jpg"].lat, got["a.jpg"].lon, str(got["a.jpg"].taken)) == (38.5, 26.25, "2024-03-01 10:11:12")
    assert got["b.heic"].heic and got["b.heic"].read_error and got["c.jpg"].lat is None and got["c.jpg"].taken is None


def test_trip_documents(spark, tmp_path):
    a = {"id": "t1", "stops": [{"name": "A", "lat": 1, "lon": 2, "vehicleToNext": "car"}, {"name": "B", "lat": 1.5, "lon": 2, "viaToNext": [{"lat": 1, "lon": 1}]}, {"name": "C"}]}
    b = {"name": "t2", "cities": [{"name": "X", "lat": 0, "lon": 0}, {"name": "Y", "lat": 0, "lon": 5}], "legs": [{"vehicle": "ferry", "bearingHint": "east"}]}
    (tmp_path / "a.json").write_text(json.dumps(a))
    (tmp_path / "b.json").write_text(json.dumps(b))
    stops = readers.stops_of(readers.read_trips(spark, str(tmp_path / "a.json")))
    assert [(r.seq, r.vehicle) for r in stops.orderBy("seq").collect()] == [(0, "car"), (1, None), (2, None)]
    assert [r.leg for r in legs.legs_of(stops).collect()] == [0]
    cities = readers.stops_of_cities(readers.read_city_trips(spark, str(tmp_path / "b.json")))
    leg = legs.legs_of(cities, prefix="city-").first()
    assert (leg.trip, leg.vehicle, leg.hint) == ("t2", "ferry", "east")


def test_catalog_manifests_and_strings(spark, tmp_path):
    (tmp_path / "index.json").write_text(json.dumps({"version": 1, "eras": [{"key": "e", "label": "E", "trips": ["t1", "t2"]}]}))
    (tmp_path / "t1.manifest.json").write_text(json.dumps({"tripId": "t1", "style": "s", "images": [{"stopId": "a", "prompt": "p", "size": "1"}]}))
    assert [(r.era, r.place, r.trip) for r in readers.read_catalog(spark, str(tmp_path / "index.json")).collect()] == [("e", 0, "t1"), ("e", 1, "t2")]
    images = readers.read_image_manifests(spark, str(tmp_path))
    stops = spark.createDataFrame([("t1", "a"), ("t1", "b")], "trip string, stop string")
    assert [r.stop for r in readers.missing_images(stops, images).collect()] == ["b"]
    (tmp_path / "en.json").write_text('{"a": "A",\n "b": "B"}')
    (tmp_path / "tr.json").write_text('{"a": "Ah", "b": ""}')
    both = readers.strings_with_fallback(readers.read_strings(spark, str(tmp_path / "tr.json")), readers.read_strings(spark, str(tmp_path / "en.json")))
    assert {r.key: r.text for r in both.collect()} == {"a": "Ah", "b": "B"}
    assert readers.safe_url_rows(spark, str(tmp_path / "absent.json"), "a int").count() == 0


def test_gazetteer_and_polygons(spark, tmp_path):
    (tmp_path / "g.txt").write_text("Rome;IT;41.9;12.5;2800|bad;row|Çeşme;TR;38.3;26.3;x")
    rows = readers.read_gazetteer(spark, str(tmp_path / "g.txt")).collect()
    assert [(r.name, r.pop) for r in rows] == [("Rome", 2800.0), ("Çeşme", None)]
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    features = [{"geometry": {"type": "Polygon", "coordinates": square}}, {"geometry": {"type": "MultiPolygon", "coordinates": [square, square]}}, {"geometry": None}]
    (tmp_path / "land.json").write_text(json.dumps({"features": features}))
    got = readers.read_polygons(spark, str(tmp_path / "land.json")).orderBy("ord").collect()
    assert [r.polygon for r in got] == ["0:0", "1:0", "1:1"] and got[0].rings[0][1].lon == 1.0


def test_pages(spark, tmp_path):
    row = spark.createDataFrame([("t", "A <b>", "<p>x</p>", '{"a":"</script>"}')], "trip string, title string, body string, data string")
    pages = row.select("trip", readers.standalone_page(F.col("title"), F.col("body"), F.col("data")).alias("html"))
    html = pages.first().html
    assert html.startswith("<!doctype html>") and "<title>A &lt;b&gt;</title>" in html and '{"a":"\\u003c/script>"}' in html
    assert readers.write_pages(pages, str(tmp_path / "out")) == 1
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["t.html"] and (tmp_path / "out" / "t.html").read_text() == html


def test_blob_store(spark, tmp_path):
    path = str(tmp_path / "store")
    blobs = lambda *rows: spark.createDataFrame(list(rows), "id string, bytes binary, type string")
    readers.put_blobs(spark, path, blobs(("a", b"1", "x"), ("b", b"2", "x")))
    readers.put_blobs(spark, path, blobs(("a", b"3", "y")))
    assert {r.id: bytes(r.bytes) for r in readers.get_blobs(spark, path).collect()} == {"a": b"3", "b": b"2"}
    wanted = spark.createDataFrame([("a",), ("c",), ("c",), (None,)], "id string")
    assert [r.id for r in trips.to_load(wanted, readers.get_blobs(spark, path), "id").collect()] == ["c"]


def test_pack_versions(spark):
    """The hash wraps at 32 bits, takes points in order, and follows the points that it takes."""
    def plain(coast):
        h = 5381
        wrap = lambda x: (int(x) + 2**31) % 2**32 - 2**31
        for ring in coast:
            for i in range(0, len(ring), max(1, len(ring) // 8)):
                h = wrap((wrap(h * 32) + h) + ring[i][0] * 1000 + ring[i][1])
        h, out = h % 2**32, ""
        while h:
            h, d = divmod(h, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
        return f"{sum(map(len, coast))}:{out or '0'}"

    rings = [[[-179.9 + i * 1.37, 89.5 - i * 0.71] for i in range(n)] for n in (3, 40, 101)]
    rows = [("r", None, rings), (None, "", rings[:2]), ("r", "2024", rings), ("r", None, rings[::-1]), ("r", None, []), ("r", None, None), ("", "x", None)]
    got = spark.createDataFrame(rows, f"region string, generated string, coast {packs.COAST}").select(packs.pack_version(F.col("region"), F.col("generated"), F.col("coast")).alias("v")).collect()
    assert [r.v for r in got] == ["r#" + plain(rings), "pack#" + plain(rings[:2]), "r@2024", "r#" + plain(rings[::-1]), "r#0:45h", "global", "pack@x"]


def test_packs_are_read_by_their_boxes(spark, tmp_path):
    ring = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0, 1.0]]
    rows = [("a", "A", "g", [0.0, 0.0, 2.0, 2.0], [ring, ring[:2], [[0.0, 0.0, 1.0]] * 4]), ("b", None, None, [5.0, 5.0, 6.0, 6.0], [ring, ring]), ("c", "C", None, [9.0, 9.0, 10.0, 10.0], None)]
    frame = spark.createDataFrame(rows, f"id string, region string, generated string, bbox array<double>, coast {packs.COAST}")
    assert packs.write_packs(frame, str(tmp_path)) == 3
    (tmp_path / "c.json").write_text("no json: it must not be read")
    polygons, boxes = packs.read_packs(spark, str(tmp_path), (-1.0, -1.0, 7.0, 7.0))
    assert sorted((r.ord, r.polygon, len(r.rings[0])) for r in polygons.collect()) == [(0, "A:0", 3), (65536, "pack:0", 3), (65537, "pack:1", 3)]
    assert sorted(map(tuple, boxes.collect())) == [(0.0, 0.0, 2.0, 2.0), (5.0, 5.0, 6.0, 6.0)]


def test_era_places_and_aliases(spark, tmp_path):
    places = [{"id": "p", "kind": "city", "lat": 1, "lon": 2, "aliases": {"classical": "Old", "atlas": {"name": "Mid", "activeFrom": 1600, "activeTo": 1700}, "modern": {"name": "New"}, "byzantium": ""}}]
    (tmp_path / "places.json").write_text(json.dumps(places))
    names = readers.read_era_places(spark, str(tmp_path / "places.json"))
    assert {(r.era, r.name, r.from_year, r.to_year) for r in names.collect()} == {("classical", "Old", None, None), ("atlas", "Mid", 1600, 1700), ("modern", "New", None, None)}
    asked = [(1, "p", "atlas", 1600), (2, "p", "atlas", 1700), (3, "p", "atlas", None), (4, "p", "byzantium", 900), (5, "q", "atlas", 1650), (6, "p", "classical", -5)]
    got = readers.alias_as_of(spark.createDataFrame(asked, "query long, place string, era string, year int"), names)
    assert {r.query: r.name for r in got.collect()} == {1: "Mid", 2: "New", 3: "Mid", 4: "New", 5: None, 6: "Old"}
    (tmp_path / "sources.json").write_text('{"p": "Pleiades:12:3", "q": "none"}')
    assert [tuple(r) for r in readers.read_attributions(spark, str(tmp_path / "sources.json")).collect()] == [("p", "Pleiades", "12:3")]


def test_headers_beyond_the_first_bytes(spark, tmp_path, monkeypatch):
    """A photo whose header ends beyond what is read at first is read whole; times fall back to later entries."""
    from itinera.plans.scan_queries import _jpeg

    place = (("N", (38, 30, 0)), ("E", (26, 15, 0)))
    (tmp_path / "far.jpg").write_bytes(_jpeg(None, None, "2001:02:03 04:05:06", place, lead=60_000))
    (tmp_path / "cut.jpg").write_bytes(_jpeg("2001:02:03 04:05:06", None, None, place, lead=10)[:200])
    for head in (64, 1000, 60_100, readers.HEAD_BYTES):
        monkeypatch.setattr(readers, "HEAD_BYTES", head)
        got = {n: readers._photo(str(tmp_path / n), (tmp_path / n).stat().st_size) for n in ("far.jpg", "cut.jpg")}
        assert got["far.jpg"][:3] == (False, 38.5, 26.25) and str(got["far.jpg"][3]) == "2001-02-03 04:05:06"
        assert got["cut.jpg"] == (False, None, None, None, False)


def test_shared_folder_must_be_named_on_a_cluster():
    from itinera.sources.storage import shared_dir

    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError):
        shared_dir(Session)


def test_heic_boxes_lead_to_the_exif_block(tmp_path):
    """The block in idat, in the file, in two extents; every cut of a file is damage or gives the same, and no other error."""
    import io

    from itinera.plans.scan_queries import _jpeg
    from itinera.sources import heif
    from itinera.sources.readers import tiff_fields

    position = (("S", (12, 30, 0)), ("E", (45, 15, 36)))
    for how in range(3):
        data = _jpeg("2019:03:04 05:06:07", None, None, position, lead=30, heic=how)
        lat, lon, taken = tiff_fields(heif.exif_tiff(io.BytesIO(data), len(data)))
        assert (lat, round(lon, 9), taken.isoformat()) == (-12.5, 45.26, "2019-03-04T05:06:07")
        for size in range(0, len(data), 7):
            with pytest.raises(heif.Damaged):
                heif.exif_tiff(io.BytesIO(data[:size]), size)
    plain = data.replace(b"Exif\0", b"mime\0", 1)
    assert heif.exif_tiff(io.BytesIO(plain), len(plain)) is None


def test_features_do_not_depend_on_their_ranges(tmp_path):
    import io
    import random

    from itinera.sources.features import features_in

    rng, shapes = random.Random(3), []
    for i in range(60):
        said = {"type": "Feature", "id": i, "properties": {"note": 'é {"type":"Feature", x' * (i % 3)}, "geometry": {"type": "Point", "coordinates": [i, i]}}
        shapes.append(json.dumps(said, ensure_ascii=False, indent=rng.choice([None, 1])))
    for body in ([], shapes[:1], shapes):
        data = ('{"type": "FeatureCollection", "features" : [ ' + " ,\n".join(body) + '], "more": [1]}').encode()
        for split in (7, 100, 1000, len(data)):
            found = [x["id"] for a in range(0, len(data), split) for _, x in features_in(io.BytesIO(data), len(data), a, min(len(data), a + split))]
            assert found == list(range(len(body))), (len(body), split)
    other = json.dumps({"type": "FeatureCollection", "features": [{"geometry": None, "type": "Feature"}] * 3}).encode()
    assert sum(len(list(features_in(io.BytesIO(other), len(other), a, a + 9))) for a in range(0, len(other), 9)) == 3
    broken = data.replace(b'"id": 7', b'"id" 7', 1)
    with pytest.raises(ValueError, match="feature at byte"):
        list(features_in(io.BytesIO(broken), len(broken), 0, len(broken)))
