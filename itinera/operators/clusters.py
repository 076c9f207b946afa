"""Photos into stops: ordered folds over one owner's photos.

The folds are not associative, so an owner's photos pass one after another; each
fold's state is a few numbers, and its rows stream by (see folds).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itinera.functions.geo import EARTH_KM, haversine_km
from itinera.operators.folds import fold_rows, km_between
from itinera.operators.land import Coast, polygons_near

#: A stop's radius; the gap and the move that end it; its merge rules.
RADIUS_KM, GAP_HOURS, MOVE_KM, MOVE_MINUTES = 6.0, 14, 1.5, 20
PLACE_KM, NAME_KM, GRAIN, LEAST_KM = 5.0, 12.0, 0.6, 1.0
SEA_KM, SEA_SHARE = 10.0, 0.6


class PhotoFold:
    """Cluster numbers of one owner's photos in time order; the state is five numbers."""

    def __init__(self, k: int = -1, n: int = 0, lat: float = 0.0, lon: float = 0.0, before: int | None = None):
        self.k, self.n, self.lat, self.lon, self.before = k, n, lat, lon, before

    def __call__(self, us: int | None, lat: float, lon: float) -> int:
        km = km_between(self.lat / self.n, self.lon / self.n, lat, lon) if self.n else 0.0
        gap = 0 if us is None or self.before is None else us - self.before
        late, moved = gap > GAP_HOURS * 3_600_000_000, gap > MOVE_MINUTES * 60_000_000 and km > MOVE_KM
        if not self.n or km > RADIUS_KM or late or moved:
            self.k, self.n, self.lat, self.lon = self.k + 1, 0, 0.0, 0.0
        self.n, self.lat, self.lon = self.n + 1, self.lat + lat, self.lon + lon
        self.before = self.before if us is None else us
        return self.k


def placed(photos: DataFrame) -> DataFrame:
    return photos.filter("lat IS NOT NULL AND lon IS NOT NULL")


def unplaced(photos: DataFrame) -> DataFrame:
    """Photos that no stop can take: those without a position."""
    return photos.filter("lat IS NULL OR lon IS NULL")


def label_photos(photos: DataFrame) -> DataFrame:
    """owner, photo_id, us, lat, lon, cluster: photos in time order, undated ones last."""
    rows = placed(photos).select("owner", "photo_id", "us", "lat", "lon")
    return fold_rows(rows, "owner", [F.col("us").asc_nulls_last(), "photo_id"], ["us", "lat", "lon"], PhotoFold, "cluster")


def cluster_photos(photos: DataFrame) -> DataFrame:
    """One row per stop: owner, cluster, n, lat, lon, start_us, end_us, photo_ids."""
    return summarise(label_photos(photos))


def summarise(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("owner", "cluster").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("lat").alias("lat"),
        F.avg("lon").alias("lon"),
        F.min("us").alias("start_us"),
        F.max("us").alias("end_us"),
        F.array_sort(F.collect_list("photo_id")).alias("photo_ids"),
    )


def _spans_at_most(km: float) -> Column:
    """Whether all of an owner's stops ``c`` lie within a distance of each other.

    The box of the stops bounds the diameter from both sides and nearly always
    decides; only in between are pairs looked at.
    """
    low, high = (lambda axis: F.radians(F.array_min(F.transform("c", lambda p: p[axis])))), (lambda axis: F.radians(F.array_max(F.transform("c", lambda p: p[axis]))))
    south, north, west, east = low("lat"), high("lat"), low("lon"), high("lon")
    up, across = F.sin((north - south) / 2), F.sin((east - west) / 2)
    far_from_equator = F.greatest(F.abs(south), F.abs(north))
    near_equator = F.when(south * north <= 0, 0.0).otherwise(F.least(F.abs(south), F.abs(north)))
    arc = lambda h: F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), h))
    at_least = F.greatest(arc(up), arc(F.cos(far_from_equator) * across))
    at_most = arc(F.sqrt(up * up + F.cos(near_equator) * F.cos(near_equator) * across * across))
    beyond = lambda p: F.exists("c", lambda q: haversine_km(p["lat"], p["lon"], q["lat"], q["lon"]) > km)
    narrow = F.degrees(east - west) <= 180
    return F.when(narrow & (at_most <= km * (1 - 1e-9)), True).when(narrow & (at_least > km * (1 + 1e-9)), False).otherwise(~F.exists("c", beyond))


def merge_km(clusters: DataFrame) -> DataFrame:
    """The distance within which an owner's stops are one place: owner, merge_km.

    Where all lie close it is fixed; else it follows the upper median of the steps
    between consecutive stops.
    """
    rows = F.array_sort(F.collect_list(F.struct("cluster", "lat", "lon")))
    own = clusters.groupBy("owner").agg(rows.alias("c"))
    n = F.size("c")
    steps = F.array_sort(
        F.zip_with(F.slice("c", 1, n - 1), F.slice("c", 2, n), lambda p, q: haversine_km(p["lat"], p["lon"], q["lat"], q["lon"]))
    )
    own = own.withColumns({"close": _spans_at_most(PLACE_KM), "steps": F.when(n > 1, steps)})
    middle = F.element_at("steps", F.floor(F.size("steps") / 2).cast("int") + 1)
    grown = F.greatest(F.lit(LEAST_KM), F.least(F.lit(PLACE_KM), middle * GRAIN))
    return own.select("owner", F.when(F.col("close"), PLACE_KM).otherwise(grown).alias("merge_km"))


def _merge_step() -> Callable[..., int]:
    """Place numbers of one owner's stops in order."""
    k, n, lat, lon, known, coast = -1, 0, 0.0, 0.0, None, None

    def step(reach: float, count: int, at_lat: float, at_lon: float, name: str | None, apart: bool, polygons: list | None) -> int:
        nonlocal k, n, lat, lon, known, coast
        coast = Coast(polygons) if polygons is not None else coast
        joins = n > 0 and not apart
        if joins:
            here = lat / n, lon / n
            km = km_between(*here, at_lat, at_lon)
            near = (known == name and km <= NAME_KM) if known is not None and name is not None else km <= reach
            joins = near and not (coast is not None and coast.apart(*here, at_lat, at_lon, SEA_KM, SEA_SHARE))
        if not joins:
            k, n, lat, lon, known = k + 1, 0, 0.0, 0.0, name
        n, lat, lon = n + count, lat + at_lat * count, lon + at_lon * count
        return k

    return step


def merge_clusters(clusters: DataFrame, name: str | None = None, apart: str | None = None, land: DataFrame | None = None) -> DataFrame:
    """Fold consecutive stops of one place: owner, place, n, lat, lon, start_us, end_us, merged, days.

    ``name`` is a column with the place's name: equal names merge further, unequal
    ones never. With ``land`` a stop that lies across water from the place merged so
    far never joins it; ``apart`` is a boolean column that says so of a stop outright.
    """
    rows = clusters.select(
        "owner", "cluster", "n", "lat", "lon", "start_us", "end_us", "photo_ids",
        (F.col(name) if name else F.lit(None)).cast("string").alias("_name"),
        (F.coalesce(F.col(apart), F.lit(False)) if apart else F.lit(False)).alias("_apart"),
    ).join(merge_km(clusters), "owner")
    if land is None:
        rows = rows.withColumn("_coast", F.lit(None).cast("array<array<array<struct<lon: double, lat: double>>>>"))
    else:
        # An owner's polygons come with the first stop, once.
        box = clusters.groupBy("owner").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
        none = F.array().cast("array<array<array<struct<lon: double, lat: double>>>>")
        near = polygons_near(box, "owner", land).withColumn("_first", F.lit(0))
        rows = rows.withColumn("_first", F.when(F.col("cluster") == 0, 0)).join(near, ["owner", "_first"], "left").drop("_first")
        rows = rows.withColumn("_coast", F.when(F.col("cluster") == 0, F.coalesce("polygons", none))).drop("polygons")
    folded = fold_rows(rows, "owner", ["cluster"], ["merge_km", "n", "lat", "lon", "_name", "_apart", "_coast"], _merge_step, "place")
    return folded.groupBy("owner", "place").agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("lat") * F.col("n")) / F.sum("n")).alias("lat"),
        (F.sum(F.col("lon") * F.col("n")) / F.sum("n")).alias("lon"),
        F.min("start_us").alias("start_us"),
        F.max("end_us").alias("end_us"),
        F.count(F.lit(1)).alias("merged"),
        F.array_sort(F.collect_list(F.struct("cluster", "start_us", "end_us", "photo_ids"))).alias("days"),
    )


def split_days(merged: DataFrame) -> DataFrame:
    """The days of a merged stop: owner, place, day (1 up), date, photo_ids; stops of one day have none."""
    from itinera.functions.dates import utc_day

    days = merged.filter(F.size("days") > 1).select("owner", "place", F.posexplode("days").alias("i", "d"))
    return days.select("owner", "place", (F.col("i") + 1).alias("day"), utc_day(F.col("d.start_us")).alias("date"), "d.photo_ids")


def sessions(photos: DataFrame, hours: int = GAP_HOURS) -> DataFrame:
    """Dated photos cut where more than ``hours`` lie between two: owner, session, n, start_us, end_us."""
    order = Window.partitionBy("owner").orderBy("us", "photo_id")
    gap = F.col("us") - F.lag("us").over(order)
    cut = F.sum((gap > hours * 3_600_000_000).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    cut_rows = photos.filter("us IS NOT NULL").withColumn("session", F.coalesce(cut, F.lit(0)).cast("int"))
    return cut_rows.groupBy("owner", "session").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))
