"""Readers and writers: trip documents, catalogues, gazetteers, polygons, photos, pages."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itinera.functions.text import escape_html, script_safe
from itinera.sources import heif
from itinera.sources.features import SPLIT_BYTES, read_features
from itinera.sources.storage import file_system, write_files

POINT = "struct<lat: double, lon: double>"
STOPS_SCHEMA = (
    "id string, era string, year int, title string, themeSuggestion string, viewport string, "
    "intro struct<title: string, dateline: string, body: string>, companions array<string>, "
    "stops array<struct<id: string, name: string, lat: double, lon: double, note: string, imagePrompt: string, "
    f"vehicleToNext: string, viaToNext: array<{POINT}>>>"
)
CITIES_SCHEMA = (
    "id string, name string, era string, companions array<string>, "
    "cities array<struct<name: string, country: string, lat: double, lon: double>>, "
    f"legs array<struct<vehicle: string, via: array<{POINT}>, bearingHint: string>>"
)


def read_trips(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Trip documents with a stops list: one row per document. Files of a document a line split over tasks."""
    return spark.read.schema(STOPS_SCHEMA).option("multiLine", multi_line).option("recursiveFileLookup", True).json(path)


def stops_of(trips: DataFrame) -> DataFrame:
    """trip, seq, name, lat, lon, vehicle, via of trips with two stops or more."""
    rows = trips.filter(F.size("stops") >= 2).select(F.col("id").alias("trip"), F.posexplode("stops").alias("seq", "s"))
    return rows.select("trip", "seq", "s.name", "s.lat", "s.lon", F.col("s.vehicleToNext").alias("vehicle"), F.col("s.viaToNext").alias("via"))


def read_city_trips(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Trip documents with cities and the legs between them."""
    return spark.read.schema(CITIES_SCHEMA).option("multiLine", multi_line).json(path)


def stops_of_cities(trips: DataFrame) -> DataFrame:
    """The same rows from cities and legs, paired by position; hint is a leg's bearing."""
    rows = trips.filter((F.size("cities") >= 2) & F.col("legs").isNotNull())
    rows = rows.select(F.coalesce("id", "name").alias("trip"), F.posexplode("cities").alias("seq", "c"), "legs")
    leg = F.get("legs", F.col("seq"))
    return rows.select("trip", "seq", "c.name", "c.lat", "c.lon", leg["vehicle"].alias("vehicle"), leg["via"].alias("via"), leg["bearingHint"].alias("hint"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """era, label, place, trip of a catalogue of trips by era."""
    schema = "eras array<struct<key: string, label: string, trips: array<string>>>"
    eras = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("eras").alias("e"))
    return eras.select(F.col("e.key").alias("era"), "e.label", F.posexplode("e.trips").alias("place", "trip"))


def read_image_manifests(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """trip, style, stop, prompt, size of image manifests (*.manifest.json) below a folder."""
    schema = "tripId string, style string, images array<struct<stopId: string, prompt: string, size: string>>"
    found = spark.read.schema(schema).option("multiLine", multi_line).option("recursiveFileLookup", True).option("pathGlobFilter", "*.manifest.json").json(path)
    return found.select(F.col("tripId").alias("trip"), "style", F.explode("images").alias("i")).select("trip", "style", F.col("i.stopId").alias("stop"), "i.prompt", "i.size")


def missing_images(stops: DataFrame, images: DataFrame) -> DataFrame:
    """Stops (trip, stop) without an image in their trip's manifest."""
    return stops.join(images.select("trip", "stop"), ["trip", "stop"], "left_anti")


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """key, text of a flat JSON object of interface strings."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "text"))


def strings_with_fallback(strings: DataFrame, fallback: DataFrame) -> DataFrame:
    """Every string of the fallback language, in the wanted one where it has it."""
    own = strings.select("key", F.col("text").alias("own"))
    return fallback.join(own, "key", "left").select("key", F.coalesce(F.nullif("own", F.lit("")), "text").alias("text"))


def parse_alias(raw: Column) -> Column:
    """A struct of name, from_year, to_year from an alias that is a plain name or a JSON object; null without a name."""
    shape = F.from_json(raw, "struct<name: string, activeFrom: int, activeTo: int>")
    bounded = raw.startswith("{")
    name = F.nullif(F.when(bounded, shape["name"]).otherwise(raw), F.lit(""))
    alias = F.struct(
        name.alias("name"), F.when(bounded, shape["activeFrom"]).alias("from_year"), F.when(bounded, shape["activeTo"]).alias("to_year")
    )
    return F.when(name.isNotNull(), alias)


def read_era_places(spark: SparkSession, path: str) -> DataFrame:
    """place, kind, lat, lon, era, name, from_year, to_year: a row per place and era."""
    schema = "id string, kind string, lat double, lon double, activeFrom int, activeTo int, aliases map<string,string>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    named = rows.select(F.col("id").alias("place"), "kind", "lat", "lon", F.explode("aliases").alias("era", "raw"))
    return named.withColumn("alias", parse_alias(F.col("raw"))).filter("alias IS NOT NULL").select("place", "kind", "lat", "lon", "era", "alias.*")


def alias_as_of(asked: DataFrame, names: DataFrame) -> DataFrame:
    """asked (query, place, era, year) with the name of the place in its era, else its modern one, else null.

    A bounded name counts only from its first year to before its last; without a
    year it counts always.
    """
    held = names.select("place", "era", F.col("name").alias("_name"), "from_year", "to_year")
    modern = names.filter("era = 'modern'").select("place", F.col("name").alias("_modern"))
    joined = asked.join(held, ["place", "era"], "left").join(modern, "place", "left")
    inside = F.coalesce(F.col("year") >= F.col("from_year"), F.lit(True)) & F.coalesce(F.col("year") < F.col("to_year"), F.lit(True))
    return joined.select("query", F.coalesce(F.when(F.col("year").isNull() | inside, F.col("_name")), "_modern").alias("name"))


def read_attributions(spark: SparkSession, path: str) -> DataFrame:
    """place, authority, id of a JSON object of ``Authority:Id`` by place."""
    rows = read_strings(spark, path).withColumn("p", F.split("text", ":", 2)).filter(F.size("p") == 2)
    return rows.select(F.col("key").alias("place"), F.col("p")[0].alias("authority"), F.col("p")[1].alias("id"))


def parse_gazetteer(rows: DataFrame) -> DataFrame:
    """name, cc, lat, lon, pop from lines of ``name;cc;lat;lon;pop``; shorter lines are left out."""
    parts = rows.select(F.split("value", ";").alias("f")).filter(F.size("f") >= 5)
    number = lambda i: F.col("f")[i].try_cast("double")
    return parts.select(F.col("f")[0].alias("name"), F.col("f")[1].alias("cc"), number(2).alias("lat"), number(3).alias("lon"), number(4).alias("pop"))


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """A gazetteer file whose records are parted by ``|``."""
    return parse_gazetteer(spark.read.option("lineSep", "|").text(path))


#: Parts of one multipolygon at most, so that the numbers of polygons never meet.
MOST_PARTS = 1 << 31


def read_polygons(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """ord, polygon, rings of a GeoJSON collection of polygons and multipolygons; path too, as several may be read at once.

    Files are read in byte ranges; a feature's number does not depend on them.
    """
    features = read_features(spark, path, split_bytes)
    one = F.array(F.from_json("coordinates", "array<array<array<double>>>"))
    many = F.from_json("coordinates", "array<array<array<array<double>>>>")
    parts = F.when(F.col("type") == "Polygon", one).when(F.col("type") == "MultiPolygon", many)
    polygons = features.select("path", "f", F.posexplode(parts).alias("p", "r"))
    rings = F.transform("r", lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))
    return polygons.filter(F.size("r") > 0).select((F.col("f") * MOST_PARTS + F.col("p")).alias("ord"), F.concat_ws(":", "f", "p").alias("polygon"), rings.alias("rings"), "path")


def safe_url_rows(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """JSON rows of a path, none where there is no such path."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("multiLine", multi_line).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def standalone_page(title: Column, body: Column, payload: Column, css: str = "") -> Column:
    """A complete HTML page with embedded data and a policy that loads nothing else."""
    # The policy and the skeleton of the page.
    policy = "default-src 'none'; img-src data:; style-src 'unsafe-inline'; script-src 'unsafe-inline'"
    head = f'<!doctype html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<meta http-equiv="Content-Security-Policy" content="{policy}">\n'
    head += '<meta name="viewport" content="width=device-width, initial-scale=1">\n<title>'
    middle = f"</title>\n<style>{css}</style>\n</head>\n<body>\n"
    data = '\n<script id="trip-data" type="application/json">'
    named = escape_html(F.coalesce(F.nullif(title, F.lit("")), F.lit("A chronicle")))
    end = "</script>\n</body>\n</html>\n"
    return F.concat(F.lit(head), named, F.lit(middle), F.coalesce(body, F.lit("")), F.lit(data), script_safe(F.coalesce(payload, F.lit("{}"))), F.lit(end))


def write_pages(pages: DataFrame, path: str) -> int:
    """Pages (trip, html) as files ``<trip>.html`` of one folder; returns how many."""
    return write_files(pages.select(F.concat(F.col("trip").cast("string"), F.lit(".html")).alias("name"), F.encode("html", "UTF-8").alias("content")), path)


def is_heic(data: bytes) -> bool:
    return len(data) >= 12 and data[4:8] == b"ftyp"


#: Bytes of a file that are read for its header; the whole file only where it ends beyond them.
HEAD_BYTES = 1 << 18
_EXIF_TIME = re.compile(r"(\d{4}):(\d{2}):(\d{2})[ T](\d{2}):(\d{2}):(\d{2})")


class CutShort(Exception):
    """The header goes on beyond the bytes that were read."""


def tiff_fields(tiff: bytes) -> tuple[float | None, float | None, datetime | None]:
    """Latitude, longitude and wall-clock time from an Exif block; damage raises.

    The time is that of the shot, else of digitising, else of the last change.
    """
    order = {b"II": "<", b"MM": ">"}[tiff[:2]]

    def directory(offset: int) -> dict[int, tuple[int, bytes]]:
        """Tag to (count, bytes from the value on)."""
        out = {}
        for i in range(struct.unpack_from(order + "H", tiff, offset)[0]):
            entry = offset + 2 + 12 * i
            tag, kind, count = struct.unpack_from(order + "HHI", tiff, entry)
            size = {3: 2, 4: 4, 5: 8, 9: 4, 10: 8}.get(kind, 1) * count
            start = entry + 8 if size <= 4 else struct.unpack_from(order + "I", tiff, entry + 8)[0]
            out[tag] = count, tiff[start : start + size]
        return out

    def pointer(value: tuple[int, bytes]) -> int:
        return struct.unpack_from(order + "I", value[1])[0]

    def angle(value, ref) -> float | None:
        if value is None or ref is None or value[0] < 3:
            return None
        parts = struct.unpack_from(order + "6I", value[1])
        d, m, s = (parts[i] / parts[i + 1] if parts[i + 1] else 0.0 for i in (0, 2, 4))
        return (d + m / 60 + s / 3600) * (-1 if ref[1][:1] in b"SW" and ref[1][:1] else 1)

    root = directory(struct.unpack_from(order + "I", tiff, 4)[0])
    taken = lat = lon = None
    shot = directory(pointer(root[0x8769])) if 0x8769 in root else {}
    if text := next((t for t in (shot.get(0x9003), shot.get(0x9004), root.get(0x0132)) if t and t[1].strip(b"\0 ")), None):
        if m := _EXIF_TIME.match(text[1].split(b"\0")[0].decode("latin-1")):
            y, mo, d, h, mi, s = map(int, m.groups())
            months = y * 12 + mo - 1
            taken = datetime(months // 12, months % 12 + 1, 1) + timedelta(days=d - 1, hours=h, minutes=mi, seconds=s)
    if 0x8825 in root:
        gps = directory(pointer(root[0x8825]))
        lat, lon = angle(gps.get(2), gps.get(1)), angle(gps.get(4), gps.get(3))
    lat = lat if lat is not None and -90 <= lat <= 90 else None
    lon = lon if lon is not None and -180 <= lon <= 180 else None
    return (None, None, taken) if lat == 0 and lon == 0 else (lat, lon, taken)


def exif_fields(data: bytes, whole: bool = True) -> tuple[float | None, float | None, datetime | None]:
    """The fields of a JPEG's EXIF segment; nulls where absent or damaged.

    Where ``data`` is only the ``whole`` file's beginning, CutShort tells that it is too little.
    """
    try:
        if not whole and len(data) < 2:
            raise CutShort
        if data[:2] != b"\xff\xd8":
            return None, None, None
        at = 2
        while data[at : at + 2] != b"\xff\xe1":
            if not whole and at + 4 > len(data):
                raise CutShort
            if data[at : at + 1] != b"\xff":
                return None, None, None
            at += 2 + struct.unpack_from(">H", data, at + 2)[0]
        if not whole and at + 2 + struct.unpack_from(">H", data, at + 2)[0] > len(data):
            raise CutShort
        if data[at + 4 : at + 8] != b"Exif":
            return None, None, None
        return tiff_fields(data[at + 10 :])
    except (struct.error, KeyError, IndexError, ValueError, OverflowError):
        if not whole:
            raise CutShort from None
        return None, None, None


def _photo(path: str, size: int) -> tuple:
    """heic, lat, lon, taken, read_error of one file."""
    store, name = file_system(path)
    with store.open_input_file(name) as file:
        head = file.read(12)
        if is_heic(head):
            try:
                tiff = heif.exif_tiff(file, size)
                return True, *(tiff_fields(tiff) if tiff else (None, None, None)), False
            except (struct.error, KeyError, IndexError, ValueError, OverflowError):
                return True, None, None, None, True
        head += file.read(HEAD_BYTES - len(head))
        try:
            return False, *exif_fields(head, whole=size <= len(head)), False
        except CutShort:
            return False, *exif_fields(head + file.read()), False


def scan_photos(spark: SparkSession, path: str) -> DataFrame:
    """path, heic, lat, lon, taken (wall clock), read_error of every file below a folder.

    Files are listed without their contents; tasks read the beginning of a JPEG, and of
    a HEIC file the boxes that lead to its Exif block and the block itself. A HEIC file
    whose boxes are damaged is a read_error; one without Exif has nulls.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            found = list(zip(*map(_photo, paths, batch.column("length").to_pylist()), strict=True)) or [()] * 5
            kinds = (pa.bool_(), pa.float64(), pa.float64(), pa.timestamp("us"), pa.bool_())
            columns = [pa.array(values, kind) for values, kind in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *columns], ["path", "heic", "lat", "lon", "taken", "read_error"])

    spread = files.repartition(spark.sparkContext.defaultParallelism, "path")
    return spread.mapInArrow(run, "path string, heic boolean, lat double, lon double, taken timestamp_ntz, read_error boolean")


def put_blobs(spark: SparkSession, path: str, blobs: DataFrame) -> None:
    """Add blobs (id, bytes, type) to a store of parquet generations; a later one of an id replaces it."""
    generation = F.lit(int(datetime.now().timestamp() * 1e6))
    blobs.withColumn("generation", generation).write.mode("append").parquet(path)


def get_blobs(spark: SparkSession, path: str) -> DataFrame:
    """The newest blob of each id."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy("id").agg(F.max("generation").alias("generation"))
    return rows.join(newest, ["id", "generation"], "left_semi").select("id", "bytes", "type").dropDuplicates(["id"])
