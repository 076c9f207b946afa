"""Queries of the scans, sinks and streams: each writes files to the shared folder and reads them back."""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itinera.functions.text import display_name
from itinera.operators import land, legs
from itinera.plans import bridge
from itinera.plans.bridge import half_up, with_
from itinera.plans.registry import _EDGES, _FOLD, _LEG_KM, _LEGS, _landed, _read, query, r
from itinera.sources import packs, readers
from itinera.sources.storage import new_folder, write_files, write_lines
from itinera.streaming import ordered
from itinera.streaming import sessions as streams

# ---------------------------------------------------------------- trip documents

_LONG = ", long AS (SELECT trip FROM stops GROUP BY trip HAVING count(*) >= 2)"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stops of each trip in order: trip, s (array of structs)."""
    stops = bridge.stops(spark, sf_dir).select("trip", F.struct("seq", "name", "lat", "lon", "vehicle").alias("s"))
    return stops.groupBy("trip").agg(F.array_sort(F.collect_list("s")).alias("s"))


@query(with_("stops") + _LEGS + _LONG + f" SELECT trip::VARCHAR AS trip, leg, from_name, to_name, vehicle, {half_up(_LEG_KM, 3)} AS km FROM legs JOIN long USING (trip)")
def trip_scan(spark, sf_dir):
    fields = lambda s: F.struct(s["name"].alias("name"), s["lat"].alias("lat"), s["lon"].alias("lon"), s["vehicle"].alias("vehicleToNext"))
    docs = _documents(spark, sf_dir).select(F.to_json(F.struct(F.col("trip").cast("string").alias("id"), F.transform("s", fields).alias("stops"))).alias("value"))
    folder = new_folder(spark, "trips")
    write_lines(docs, folder, ".json")
    found = legs.legs_of(readers.stops_of(readers.read_trips(spark, folder, multi_line=False)))
    return found.select("trip", "leg", "from_name", "to_name", "vehicle", r(legs.leg_km(), 3).alias("km"))


@query(
    with_("stops")
    + _LONG
    + """ SELECT trip::VARCHAR AS trip, seq, name, lat, lon, CASE WHEN last THEN NULL ELSE vehicle END AS vehicle, CASE WHEN NOT last THEN (['east', 'west', NULL])[(seq % 3) + 1] END AS hint
    FROM (SELECT *, seq = max(seq) OVER (PARTITION BY trip) AS last FROM stops) JOIN long USING (trip)"""
)
def city_trip_scan(spark, sf_dir):
    city = lambda s: F.struct(s["name"].alias("name"), s["lat"].alias("lat"), s["lon"].alias("lon"))
    hint = lambda s: F.when(s["seq"] % 3 == 0, "east").when(s["seq"] % 3 == 1, "west")
    leg = lambda s: F.struct(s["vehicle"].alias("vehicle"), hint(s).alias("bearingHint"))
    between = F.slice("s", 1, F.size("s") - 1)
    doc = F.struct(F.col("trip").cast("string").alias("name"), F.transform("s", city).alias("cities"), F.transform(between, leg).alias("legs"))
    folder = new_folder(spark, "city-trips")
    write_lines(_documents(spark, sf_dir).select(F.to_json(doc).alias("value")), folder, ".json")
    return readers.stops_of_cities(readers.read_city_trips(spark, folder, multi_line=False)).drop("via")


@query("""SELECT r_regionkey::VARCHAR AS era, r_name AS label, (row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1)::INT AS place, n_name AS trip
    FROM region JOIN nation ON n_regionkey = r_regionkey""")  # fmt: skip
def catalog_scan(spark, sf_dir):
    nations = _read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    eras = _read(spark, sf_dir, "region").join(nations, F.col("n_regionkey") == F.col("r_regionkey"))
    era = F.struct(F.col("r_regionkey").cast("string").alias("key"), F.col("r_name").alias("label"), F.transform("n", lambda n: n["n_name"]).alias("trips"))
    folder = new_folder(spark, "catalogue")
    write_files(eras.agg(F.to_json(F.struct(F.collect_list(era).alias("eras"))).alias("content")).withColumn("name", F.lit("index.json")), folder)
    return readers.read_catalog(spark, f"{folder}/index.json")


def _manifests(spark, sf_dir):
    image = lambda s: F.struct(s["seq"].cast("string").alias("stopId"), F.concat(F.lit("view of "), s["name"]).alias("prompt"), F.lit("2x1").alias("size"))
    drawn = F.filter("s", lambda s: s["seq"] % 3 != 2)
    doc = F.struct(F.col("trip").cast("string").alias("tripId"), F.lit("ink").alias("style"), F.transform(drawn, image).alias("images"))
    folder = new_folder(spark, "manifests")
    write_lines(_documents(spark, sf_dir).select(F.to_json(doc).alias("value")), folder, ".manifest.json")
    return readers.read_image_manifests(spark, folder, multi_line=False)


@query(with_("stops") + " SELECT trip::VARCHAR AS trip, 'ink' AS style, seq::VARCHAR AS stop, 'view of ' || name AS prompt, '2x1' AS size FROM stops WHERE seq % 3 <> 2")
def image_manifest_scan(spark, sf_dir):
    return _manifests(spark, sf_dir)


@query(with_("stops") + " SELECT trip::VARCHAR AS trip, seq::VARCHAR AS stop FROM stops WHERE seq % 3 = 2")
def missing_images(spark, sf_dir):
    stops = bridge.stops(spark, sf_dir).select(F.col("trip").cast("string").alias("trip"), F.col("seq").cast("string").alias("stop"))
    return readers.missing_images(stops, _manifests(spark, sf_dir))


# ---------------------------------------------------------------- gazetteers, polygons, strings


@query(with_("places") + " SELECT name, 'C' || idx % 9 AS cc, lat, lon, CASE WHEN idx % 7 <> 1 THEN pop END AS pop FROM places WHERE idx % 50 <> 0")
def gazetteer_scan(spark, sf_dir):
    rows = bridge.places(spark, sf_dir)
    pop = F.when(F.col("idx") % 7 == 1, "many").otherwise(F.col("pop").cast("string"))
    line = F.when(F.col("idx") % 50 == 0, F.concat_ws(";", "name", F.lit("short"))).otherwise(
        F.concat_ws(";", "name", F.concat(F.lit("C"), F.col("idx") % 9), F.col("lat").cast("string"), F.col("lon").cast("string"), pop)
    )
    folder = new_folder(spark, "gazetteer")
    rows.select(line.alias("value")).write.option("lineSep", "|").text(folder)
    return readers.read_gazetteer(spark, folder)


@query(
    """WITH n AS (SELECT n_nationkey AS k, row_number() OVER (ORDER BY n_nationkey) - 1 AS f FROM nation),
    parts AS (SELECT f, 0 AS p, k, 10.0::DOUBLE AS w FROM n UNION ALL SELECT f, 1, k, 40.0::DOUBLE FROM n WHERE k % 3 = 0)
    SELECT (f * 2147483648 + p)::BIGINT AS ord, f || ':' || p AS polygon, CASE WHEN k % 2 = 0 AND k % 3 <> 0 THEN 2 ELSE 1 END AS rings, w + k AS west, k::DOUBLE AS south, w + k + 5 AS east, k::DOUBLE + 5 AS north FROM parts"""
)
def polygon_scan(spark, sf_dir):
    def square(x, y, size):
        corners = [(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]
        return F.concat(F.lit("["), F.concat_ws(",", *[F.concat(F.lit("["), F.concat_ws(",", a.cast("string"), b.cast("string")), F.lit("]")) for a, b in corners]), F.lit("]"))

    k = F.col("n_nationkey").cast("double")
    outer, hole, other = square(k + 10, k, 5), square(k + 11, k + 1, 1), square(k + 40, k, 5)
    many = F.col("n_nationkey") % 3 == 0
    rings = F.when(F.col("n_nationkey") % 2 == 0, F.concat_ws(",", outer, hole)).otherwise(outer)
    shape = F.when(many, F.concat(F.lit("[["), outer, F.lit("],["), other, F.lit("]]"))).otherwise(F.concat(F.lit("["), rings, F.lit("]")))
    feature = F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), F.when(many, "MultiPolygon").otherwise("Polygon"), F.lit('","coordinates":'), shape, F.lit("}}"))
    rows = _read(spark, sf_dir, "nation").select(F.struct("n_nationkey", feature.alias("feature")).alias("x"))
    listed = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["feature"]), ",").alias("all"))
    folder = new_folder(spark, "polygons")
    write_files(listed.select(F.lit("land.geojson").alias("name"), F.concat(F.lit('{"type":"FeatureCollection","features":['), "all", F.lit("]}")).alias("content")), folder)
    found = readers.read_polygons(spark, f"{folder}/land.geojson")
    edge = lambda axis, f: f(F.transform(F.col("rings")[0], lambda p: p[axis]))
    return found.select(
        "ord", "polygon", F.size("rings").alias("rings"), edge("lon", F.array_min).alias("west"), edge("lat", F.array_min).alias("south"), edge("lon", F.array_max).alias("east"), edge("lat", F.array_max).alias("north")
    )


@query(
    """WITH c AS (SELECT c_nationkey::VARCHAR AS file, c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS f FROM customer)
    SELECT file, (f * 2147483648)::BIGINT AS ord, k % 7 + 3 AS points, (k % 170)::DOUBLE AS west, (k % 80)::DOUBLE AS south FROM c WHERE k % 9 <> 4"""
)
def feature_ranges(spark, sf_dir):
    """Collections of each nation's customers, in different spacing, read in ranges of some features each; points are no polygons."""
    k, wide = F.col("c_custkey"), F.col("c_nationkey") % 2 == 0
    corners = F.transform(F.sequence(F.lit(0), (k % 7 + 2).cast("int")), lambda i: F.concat(F.lit("["), (k % 170 + i).cast("string"), F.lit(", "), (k % 80 + i % 2).cast("string"), F.lit("]")))
    shape = F.when(k % 9 == 4, F.lit('{"type":"Point","coordinates":[1,2]}')).otherwise(F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.array_join(corners, ","), F.lit("]]}")))
    note = F.when(k % 5 == 0, F.lit('"properties": {"note": "{\\"type\\":\\"Feature\\", é"}, ')).otherwise(F.lit(""))
    opens = F.when(wide, F.lit('{ "type" : "Feature",\n ')).otherwise(F.lit('{"type":"Feature",'))
    feature = F.concat(opens, note, F.lit('"geometry":'), shape, F.lit("}"))
    listed = _read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", feature.alias("t")))).alias("x"))
    body = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.col("x.t"), ",\n"), F.lit("]}\n"))
    folder = new_folder(spark, "collections")
    write_files(listed.select(F.concat("c_nationkey", F.lit(".geojson")).alias("name"), F.encode(body, "UTF-8").alias("content")), folder)
    ring = F.col("rings")[0]
    least = lambda axis: F.array_min(F.transform(ring, lambda p: p[axis]))
    found = readers.read_polygons(spark, folder, split_bytes=1500)
    return found.select(F.regexp_extract("path", r"([0-9]+)\.geojson$", 1).alias("file"), "ord", F.size(ring).cast("long").alias("points"), least("lon").alias("west"), least("lat").alias("south"))


@query("SELECT n_nationkey::VARCHAR AS key, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) ELSE n_name END AS text FROM nation")
def strings_scan(spark, sf_dir):
    nation = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("t"))
    own = nation.filter("k % 3 <> 1").select("k", F.when(F.col("k") % 3 == 0, F.lower("t")).otherwise("").alias("t"))
    folder = new_folder(spark, "strings")
    for name, rows in (("own", own), ("en", nation)):
        listed = rows.agg(F.map_from_entries(F.collect_list(F.struct(F.col("k").cast("string"), "t"))).alias("m"))
        write_files(listed.select(F.lit(f"{name}.json").alias("name"), F.to_json("m").alias("content")), folder)
    return readers.strings_with_fallback(readers.read_strings(spark, f"{folder}/own.json"), readers.read_strings(spark, f"{folder}/en.json"))


@query("""SELECT p_partkey AS item, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN 'Old ' || p_size WHEN 3 THEN 'No end ' || p_size END AS name,
    CASE p_size % 4 WHEN 1 THEN 100 + p_size WHEN 3 THEN -5 END AS from_year, CASE WHEN p_size % 4 = 1 THEN 900 END AS to_year FROM part WHERE p_size % 4 <> 2""")  # fmt: skip
def alias_parse(spark, sf_dir):
    size = F.col("p_size")
    bounded = F.to_json(F.struct(F.concat(F.lit("Old "), size).alias("name"), (100 + size).alias("activeFrom"), F.lit(900).alias("activeTo")))
    open_ = F.to_json(F.struct(F.concat(F.lit("No end "), size).alias("name"), F.lit(-5).alias("activeFrom")))
    raw = F.when(size % 4 == 0, F.col("p_name")).when(size % 4 == 1, bounded).when(size % 4 == 2, "").otherwise(open_)
    rows = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), readers.parse_alias(raw).alias("a"))
    return rows.filter("a IS NOT NULL").select("item", "a.name", F.col("a.from_year").cast("int").alias("from_year"), F.col("a.to_year").cast("int").alias("to_year"))


@query("SELECT n_nationkey AS key, n_name AS name FROM nation")
def missing_source(spark, sf_dir):
    """A source that is not there gives no rows; the one that is gives all of its."""
    folder = new_folder(spark, "fetched")
    write_lines(_read(spark, sf_dir, "nation").select(F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))).alias("value")), folder, ".json")
    schema = "key int, name string"
    found = [readers.safe_url_rows(spark, path, schema, multi_line=False) for path in (f"{folder}/absent.json", folder)]
    return found[0].unionByName(found[1])


@query("""SELECT p_partkey AS item, CASE WHEN p_size % 3 = 0 THEN 'tr ' || p_size WHEN p_size % 5 = 0 THEN 'el ' || p_size ELSE p_name END AS shown FROM part""")
def display_names(spark, sf_dir):
    size = F.col("p_size")
    tr, el = F.when(size % 3 == 0, F.concat(F.lit("tr "), size)).otherwise(""), F.when(size % 5 == 0, F.concat(F.lit("el "), size)).otherwise("")
    other = F.when(size % 7 != 6, F.create_map(F.lit("tr"), tr, F.lit("el"), el)).otherwise(F.create_map(F.lit("el"), el, F.lit("tr"), tr))
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), display_name(F.col("p_name"), other, ["xx", "tr", "", "el"]).alias("shown"))


# ---------------------------------------------------------------- pages and photos

_PAGE = (
    "'<!doctype html>\n<html lang=\"en\">\n<head>\n<meta charset=\"utf-8\">\n<meta http-equiv=\"Content-Security-Policy\" content=\"default-src ''none''; img-src data:; style-src ''unsafe-inline''; script-src ''unsafe-inline''\">\n"
    "<meta name=\"viewport\" content=\"width=device-width, initial-scale=1\">\n<title>' || title || '</title>\n<style></style>\n</head>\n<body>\n' || body || "
    "'\n<script id=\"trip-data\" type=\"application/json\">' || data || '</script>\n</body>\n</html>\n'"
)


@query(f"""SELECT trip, md5({_PAGE}) AS page FROM (SELECT s_suppkey::VARCHAR AS trip, CASE WHEN s_suppkey % 4 = 0 THEN 'A chronicle' ELSE s_name || ' &amp; co' END AS title,
    '<p>' || s_suppkey || '</p>' AS body, CASE WHEN s_suppkey % 3 = 0 THEN '{{}}' ELSE '{{"n":"\\u003c/script>' || s_suppkey || '"}}' END AS data FROM supplier)""")  # fmt: skip
def page_round_trip(spark, sf_dir):
    k = F.col("s_suppkey")
    title = F.when(k % 4 == 0, "").otherwise(F.concat("s_name", F.lit(" & co")))
    data = F.when(k % 3 != 0, F.concat(F.lit('{"n":"</script>'), k.cast("string"), F.lit('"}')))
    html = readers.standalone_page(title, F.concat(F.lit("<p>"), k.cast("string"), F.lit("</p>")), data)
    folder = new_folder(spark, "pages")
    readers.write_pages(_read(spark, sf_dir, "supplier").select(k.alias("trip"), html.alias("html")), folder)
    files = spark.read.text(folder, wholetext=True).select("value", F.input_file_name().alias("path"))
    return files.select(F.regexp_extract("path", r"([^/]+)\.html$", 1).alias("trip"), F.md5("value").alias("page"))


def _jpeg(taken: str | None, digitised: str | None, changed: str | None, position: tuple | None, lead: int, heic: int | None = None) -> bytes:
    """A JPEG's header with the EXIF entries that are given, after ``lead`` bytes of another segment."""
    data, blobs = 400, b""

    def entry(tag: int, kind: int, count: int, value: bytes) -> bytes:
        nonlocal blobs
        if len(value) > 4:
            value, blobs = struct.pack("<I", data + len(blobs)), blobs + value
        return struct.pack("<HHI", tag, kind, count) + value.ljust(4, b"\0")

    def directory(entries: list) -> bytes:
        return struct.pack("<H", len(entries)) + b"".join(entries) + struct.pack("<I", 0)

    text = lambda tag, t: [entry(tag, 2, 20, t.encode() + b"\0")] if t else []
    shot = directory(text(0x9003, taken) + text(0x9004, digitised))
    gps = []
    if position:
        for tag, (ref, parts) in ((1, position[0]), (3, position[1])):
            gps += [entry(tag, 2, 2, ref.encode() + b"\0"), entry(tag + 1, 5, 3, b"".join(struct.pack("<II", p, 1) for p in parts))]
    gps = directory(gps)
    changes = text(0x0132, changed)
    at = 8 + 2 + 12 * (len(changes) + 2) + 4
    root = directory([*changes, entry(0x8769, 4, 1, struct.pack("<I", at)), entry(0x8825, 4, 1, struct.pack("<I", at + len(shot)))])
    tiff = (b"II" + struct.pack("<HI", 42, 8) + root + shot + gps).ljust(data, b"\0") + blobs
    if heic is not None:
        return _heic(tiff, lead, heic)
    exif = b"Exif\0\0" + tiff
    return b"\xff\xd8" + b"\xff\xe0" + struct.pack(">H", lead + 2) + b"x" * lead + b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xd9"


def _heic(tiff: bytes, lead: int, how: int) -> bytes:
    """A HEIC file around an Exif block, which lies in idat (0), after the meta box (1), or after it in two extents (2)."""
    box = lambda kind, body: struct.pack(">I4s", len(body) + 8, kind) + body
    block = struct.pack(">I", 6) + b"Exif\0\0" + tiff
    items = [box(b"infe", b"\x02\0\0\0" + struct.pack(">HH4s", i, 0, kind) + b"\0") for i, kind in ((1, b"hvc1"), (7, b"Exif"))]
    iinf = box(b"iinf", b"\0\0\0\0" + struct.pack(">H", 2) + b"".join(items))

    def meta(at: int) -> bytes:
        half = len(block) // 2
        parts = [(at, half), (at + half, len(block) - half)] if how == 2 else [(at, len(block))]
        told = struct.pack(">HHHH", 7, int(how == 0), 0, len(parts)) + b"".join(struct.pack(">II", *p) for p in parts)
        iloc = box(b"iloc", b"\x01\0\0\0" + bytes([0x44, 0]) + struct.pack(">H", 2) + struct.pack(">HHHH", 1, 0, 0, 0) + told)
        return box(b"meta", b"\0\0\0\0" + iinf + iloc + (box(b"idat", block) if how == 0 else b""))

    before = box(b"ftyp", b"heic\0\0\0\0mif1") + box(b"free", b"x" * lead)
    start = 0 if how == 0 else len(before) + len(meta(0)) + 8
    return before + meta(start) + (box(b"mdat", block) if how else b"")


@query("""WITH k AS (SELECT s_suppkey AS k, s_suppkey % 6 AS kind FROM supplier)
    SELECT k::VARCHAR AS photo, kind = 5 AS heic, k % 12 = 11 AS read_error, CASE WHEN (kind < 3 AND k % 60 <> 0) OR k % 12 = 5 THEN (k % 60 + 30 / 60.0) * CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END END::DOUBLE AS lat,
        CASE WHEN (kind < 3 AND k % 60 <> 0) OR k % 12 = 5 THEN k % 170 + 15 / 60.0 + 36 / 3600.0 END::DOUBLE AS lon,
        CASE kind WHEN 0 THEN '2019-03-0' WHEN 1 THEN '2018-03-0' WHEN 2 THEN '2017-03-0' WHEN 3 THEN '2019-03-0' WHEN 5 THEN CASE WHEN k % 12 = 5 THEN '2019-03-0' END END || (1 + k % 9) || ' 10:11:12' AS taken FROM k""")  # fmt: skip
def photo_scan(spark, sf_dir):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, made = batch.column("k").to_pylist(), []
            for k in keys:
                kind, day = k % 6, f"03:0{1 + k % 9} 10:11:12"
                place = ((("N" if k % 2 == 0 else "S"), (k % 60, 30, 0)), ("E", (k % 170, 15, 36))) if (kind < 3 and k % 60) or kind == 5 else None
                if kind == 5:
                    whole = _jpeg(f"2019:{day}", None, None, place, lead=70_000 if k % 5 == 0 else 10, heic=k // 12 % 3)
                    made.append(whole if k % 12 == 5 else whole[: len(whole) - 40])
                elif kind == 4:
                    made.append(b"no photo at all")
                else:
                    times = (f"2019:{day}" if kind in (0, 3) else None, f"2018:{day}" if kind < 2 else None, f"2017:{day}" if kind < 3 else None)
                    made.append(_jpeg(*times, place, lead=60_000 if k % 5 == 0 else 10))
            names = [f"{k}.{'heic' if k % 6 == 5 else 'jpg'}" for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(made, pa.binary())], ["name", "content"])

    folder = new_folder(spark, "photos")
    write_files(_read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")).mapInArrow(run, "name string, content binary"), folder)
    found = readers.scan_photos(spark, folder)
    name = F.regexp_extract("path", r"([^/]+)\.[a-z]+$", 1)
    return found.select(name.alias("photo"), "heic", "read_error", "lat", "lon", F.date_format("taken", "yyyy-MM-dd HH:mm:ss").alias("taken"))


# ---------------------------------------------------------------- streams


def _streamed(spark, sf_dir, make, tag: str) -> DataFrame:
    """What a stream over the photos' files writes until it has read them all."""
    rows = bridge.photos(spark, sf_dir).withColumn("ts", F.timestamp_micros("us")).drop("us")
    folder = new_folder(spark, tag)
    rows.write.parquet(f"{folder}/in")
    stream = make(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
    sink = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


_SEEN = "seen AS (SELECT max(us) - 3600000000 AS mark FROM photos)"


@query(
    with_("photos")
    + f""", {_SEEN}, cuts AS (
        SELECT owner, us, coalesce(sum((us - prev >= 50400000000)::INT) OVER (PARTITION BY owner ORDER BY us, photo_id), 0) AS session
        FROM (SELECT *, lag(us) OVER (PARTITION BY owner ORDER BY us, photo_id) AS prev FROM photos WHERE us IS NOT NULL)),
    whole AS (SELECT owner, session, min(us) AS start_us, max(us) AS last_us, count(*) AS n FROM cuts GROUP BY owner, session)
    SELECT owner, start_us, last_us, n FROM whole, seen WHERE last_us + 50400000000 <= mark"""
)
def stream_sessions(spark, sf_dir):
    found = _streamed(spark, sf_dir, streams.session_stream, "stream-sessions")
    return found.select("owner", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"), "n")


@query(with_("photos") + _FOLD + " SELECT owner, photo_id, cluster FROM folded")
def stream_clusters(spark, sf_dir):
    return _streamed(spark, sf_dir, streams.label_stream, "stream-clusters")


@query(
    with_("photos")
    + f""", {_SEEN}, days AS (SELECT owner, us // 86400000000 AS day, count(*) AS n FROM photos WHERE us IS NOT NULL GROUP BY ALL)
    SELECT owner, (day * 86400000000)::BIGINT AS start_us, n FROM days, seen WHERE (day + 1) * 86400000000 <= mark"""
)
def stream_counts(spark, sf_dir):
    return _streamed(spark, sf_dir, streams.daily_counts, "stream-counts").select("owner", F.unix_micros("start").alias("start_us"), "n")


@query(
    with_("photos")
    + _FOLD
    + f""", {_SEEN.replace("max(us) - 3600000000", "max(us) // 1000 * 1000 - 3600000000")} SELECT owner, photo_id, cluster FROM folded, seen WHERE us < mark"""
)
def stream_ordered(spark, sf_dir):
    """Photos arrive up to 49 minutes late, in four micro-batches; labels go by the photos' own times."""
    rows = bridge.photos(spark, sf_dir).withColumn("ts", F.timestamp_micros("us"))
    arrival = F.coalesce("us", F.lit(0)) + F.col("photo_id") % 50 * 60_000_000
    rows, folder = rows.withColumn("arrival", arrival), new_folder(spark, "stream-ordered")
    cuts = rows.approxQuantile("arrival", [0.25, 0.5, 0.75], 0.01)
    for low, high in itertools.pairwise([float("-inf"), *cuts, float("inf")]):
        rows.filter((F.col("arrival") > low) & (F.col("arrival") <= high)).drop("us", "arrival").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.drop("us", "arrival").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    found = ordered.label_in_order(stream)
    with ordered.keyed_state(spark):
        sink = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out")


# ---------------------------------------------------------------- region packs

_WRAP = lambda x: f"((({x} + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)"


@query(
    f"""WITH points AS (SELECT c_nationkey AS k, c_custkey % 3 AS ring, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 3 ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey, c_custkey % 3) AS n,
        (c_custkey * 101 % 3600)::DOUBLE / 10 - 180 AS lon, (c_custkey * 37 % 1300)::DOUBLE / 10 - 60 AS lat FROM customer),
    packs AS (SELECT k, count(*) AS n, list([lon, lat] ORDER BY ring, i) FILTER (i % greatest(1, n // 8) = 0) AS picked FROM points GROUP BY k),
    hashed AS (SELECT k, n, list_reduce(picked, lambda h, p: [{_WRAP("trunc(" + _WRAP("h[1] * 32") + " + h[1] + p[1] * 1000 + p[2])")}, 0.0::DOUBLE], [5381.0::DOUBLE, 0.0::DOUBLE])[1]::BIGINT AS h FROM packs),
    told AS (SELECT k, n, CASE WHEN h < 0 THEN h + 4294967296 ELSE h END AS h FROM hashed)
    SELECT k::INT AS pack, CASE WHEN k % 5 = 2 THEN CASE WHEN k % 2 = 0 THEN 'pack' ELSE n_name END || '@2024-05-01' ELSE CASE WHEN k % 2 = 0 THEN 'pack' ELSE n_name END || '#' || n || ':' ||
        coalesce(nullif(ltrim(array_to_string(list_transform(range(6, -1, -1), lambda d: '0123456789abcdefghijklmnopqrstuvwxyz'[(h // pow(36, d)::BIGINT % 36 + 1)::INT]), ''), '0'), ''), '0') END AS version
    FROM told JOIN nation ON n_nationkey = k"""
)
def pack_versions(spark, sf_dir):
    """The version of a pack for each nation, whose coast has three rings of its customers' places."""
    place = F.array(F.expr("cast(c_custkey * 101 % 3600 AS double) / 10 - 180"), F.expr("cast(c_custkey * 37 % 1300 AS double) / 10 - 60"))
    rings = _read(spark, sf_dir, "customer").groupBy("c_nationkey", (F.col("c_custkey") % 3).alias("ring")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", place.alias("p")))).alias("ps"))
    coasts = rings.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("ring", F.col("ps.p").alias("r")))).alias("coast"))
    k = F.col("n_nationkey")
    rows = coasts.join(_read(spark, sf_dir, "nation"), F.col("c_nationkey") == k)
    version = packs.pack_version(F.when(k % 2 != 0, F.col("n_name")), F.when(k % 5 == 2, "2024-05-01").when(k % 5 == 3, ""), F.col("coast.r"))
    return rows.select(k.alias("pack"), version.alias("version"))


@query(
    with_("via_legs")
    + f""", {_EDGES}, samples AS (SELECT trip, leg, from_lat AS lat, from_lon AS lon FROM via_legs)"""
    + _landed("samples", "trip, leg")
    + """, packs AS (SELECT 26.0 + n_nationkey % 5 * 4 AS w, 33.0 + n_nationkey // 5 * 2 AS s FROM nation WHERE n_nationkey % 3 <> 0 AND n_nationkey < 20),
    met AS (SELECT l.trip, l.leg, any_value(landmass) AS landmass, bool_or(w IS NOT NULL) AS covered, bool_or(lon >= w + 1 AND lon < w + 3 AND lat >= s + 0.5 AND lat < s + 1.5) AS fine
        FROM located l LEFT JOIN packs ON lon BETWEEN w AND w + 4 AND lat BETWEEN s AND s + 2 GROUP BY l.trip, l.leg)
    SELECT trip, leg, CASE WHEN covered THEN coalesce(fine, false) ELSE landmass IS NOT NULL END AS on_land FROM met"""
)
def region_packs(spark, sf_dir):
    """Packs written and read back: synthetic and short rings go, packs elsewhere stay unread, and a pack decides in its box."""
    far = F.col("n_nationkey") >= 20
    w, s = F.lit(26.0) + F.col("n_nationkey") % 5 * 4, F.when(far, 70.0).otherwise(33.0 + F.floor(F.col("n_nationkey") / 5) * 2)
    point = lambda x, y, *flag: F.array(w + x, s + y, *[F.lit(1.0)] * len(flag))
    square = F.array(point(1, 0.5), point(3, 0.5), point(3, 1.5), point(1, 1.5, 1))
    border = F.array(point(0, 0, 1), point(4, 0, 1), point(4, 2, 1), point(0, 2, 1))
    rows = _read(spark, sf_dir, "nation").filter("n_nationkey % 3 <> 0").select(
        F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("id"), F.col("n_name").alias("region"), F.lit("2024-05-01").alias("generated"),
        F.array(w, s, w + 4, s + 2).alias("bbox"), F.array(border, square, F.array(point(0, 0), point(4, 2))).alias("coast"),
    )
    folder = new_folder(spark, "packs")
    packs.write_packs(rows, folder)
    polygons, boxes = packs.read_packs(spark, folder, (20.0, 30.0, 50.0, 45.0))
    points = bridge.via_legs(spark, sf_dir).select("trip", "leg", F.col("from_lat").alias("lat"), F.col("from_lon").alias("lon"))
    return land.locate_in_layers(points, polygons, boxes, bridge.coast(spark)).select("trip", "leg", "on_land")
