"""Trips as stops and legs: pairing, lengths, expansion and sampling.

A trip's stops are its partition; nothing crosses trips, so every operator has one
shuffle by trip at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itinera.functions.geo import bearing_sign, half_up, haversine_km, unwrapped_path


def legs_of(stops: DataFrame, prefix: str = "stop-") -> DataFrame:
    """Consecutive stops (trip, seq, name, lat, lon, vehicle) as legs.

    A stop without a position ends the leg before it and the one after: pairs are
    formed first and filtered then.
    """
    nxt = Window.partitionBy("trip").orderBy("seq")
    here, there = F.struct("seq", "name", "lat", "lon"), F.lead(F.struct("seq", "name", "lat", "lon")).over(nxt)
    paired = stops.withColumns({"a": here, "b": there}).filter(
        "a.lat IS NOT NULL AND a.lon IS NOT NULL AND b.lat IS NOT NULL AND b.lon IS NOT NULL"
    )
    said = lambda s: F.coalesce(F.nullif(F.col(f"{s}.name"), F.lit("")), F.concat(F.lit(prefix), F.col(f"{s}.seq") + 1))
    extra = [c for c in ("vehicle", "via", "hint", "degrees") if c in stops.columns]
    return paired.select(
        "trip",
        F.col("a.seq").alias("leg"),
        said("a").alias("from_name"),
        said("b").alias("to_name"),
        F.col("a.lat").alias("from_lat"),
        F.col("a.lon").alias("from_lon"),
        F.col("b.lat").alias("to_lat"),
        F.col("b.lon").alias("to_lon"),
        *extra,
    )


def zip_legs(cities: DataFrame, legs: DataFrame) -> DataFrame:
    """Stops from cities (trip, seq, ...) and the legs after them (trip, seq, vehicle); a missing leg is empty."""
    return cities.join(legs, ["trip", "seq"], "left")


def leg_km() -> Column:
    return haversine_km(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon"))


def trip_lengths(legs: DataFrame) -> DataFrame:
    """Legs and whole kilometres of each trip."""
    return legs.groupBy("trip").agg(F.count(F.lit(1)).alias("legs"), half_up(F.sum(leg_km())).cast("long").alias("km"))


def running_km(legs: DataFrame) -> DataFrame:
    """Kilometres from the start of the trip to the end of each leg."""
    so_far = Window.partitionBy("trip").orderBy("leg").rowsBetween(Window.unboundedPreceding, 0)
    return legs.withColumn("km_so_far", F.sum(leg_km()).over(so_far))


def vertices(lat1: Column, lon1: Column, via: Column, lat2: Column, lon2: Column) -> Column:
    """A leg's path: its ends with the placed via points between them."""
    point = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))
    placed = F.filter(F.coalesce(via, F.array().cast("array<struct<lat: double, lon: double>>")), lambda v: v["lat"].isNotNull() & v["lon"].isNotNull())
    return F.concat(F.array(point(lat1, lon1)), placed, F.array(point(lat2, lon2)))


def expanded_vertices(lat1: Column, lon1: Column, via: Column, lat2: Column, lon2: Column, hint: Column, degrees: Column) -> Column:
    """A leg's path as it is drawn: every longitude unwrapped against the one before, the hinted way round."""
    path = vertices(lat1, lon1, via, lat2, lon2)
    lons = unwrapped_path(F.transform(path, lambda p: p["lon"]), bearing_sign(hint, degrees))
    return F.zip_with(path, lons, lambda p, lon: F.struct(p["lat"].alias("lat"), lon.alias("lon")))


def widest_step(path: Column) -> Column:
    """The largest difference of longitude between neighbours of a path."""
    n = F.greatest(F.size(path) - 1, F.lit(0))
    steps = F.zip_with(F.slice(path, 1, n), F.slice(path, 2, n), lambda a, b: F.abs(b["lon"] - a["lon"]))
    return F.coalesce(F.array_max(steps), F.lit(0.0))


def segment_km(path: Column) -> Column:
    """Lengths of the pieces of a path."""
    n = F.size(path)
    return F.zip_with(
        F.slice(path, 1, F.greatest(n - 1, F.lit(0))),
        F.slice(path, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: haversine_km(a["lat"], a["lon"], b["lat"], b["lon"]),
    )


def _along(path: Column, pieces: Column, t: Column) -> Column:
    """The point of a path at a share of its length."""
    total = F.aggregate(pieces, F.lit(0.0), lambda acc, d: acc + d)
    start = F.struct(F.lit(1).alias("i"), F.lit(0.0).alias("before"), F.lit(1).alias("n"))

    # Walk to the piece that holds the target: i counts pieces left behind, plus one.
    def step(acc: Column, d: Column) -> Column:
        behind = (acc["i"] == acc["n"]) & (acc["n"] < F.size(pieces)) & (acc["before"] + d < t * total)
        return F.struct(
            (acc["i"] + behind.cast("int")).alias("i"),
            (acc["before"] + F.when(behind, d).otherwise(0.0)).alias("before"),
            (acc["n"] + 1).alias("n"),
        )

    def point(acc: Column) -> Column:
        a, b = F.element_at(path, acc["i"]), F.element_at(path, acc["i"] + 1)
        length = F.element_at(pieces, acc["i"])
        f = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (t * total - acc["before"]) / length))).otherwise(0.0)
        return F.struct((a["lat"] + (b["lat"] - a["lat"]) * f).alias("lat"), (a["lon"] + (b["lon"] - a["lon"]) * f).alias("lon"))

    return F.aggregate(pieces, start, step, point)


def counted(legs: DataFrame, path: str, step_km: float, least: int, most: int) -> DataFrame:
    """Legs with _pieces (lengths), _km (their sum) and _n, by which their samples are counted."""
    sized = legs.withColumn("_pieces", segment_km(F.col(path))).withColumn("_km", F.aggregate("_pieces", F.lit(0.0), lambda acc, d: acc + d))
    return sized.withColumn("_n", F.greatest(F.lit(least), F.least(F.lit(most), half_up(F.col("_km") / step_km))).cast("int"))


#: Samples that are held at a time.
SAMPLE_BLOCK = 400_000


def inner_samples(batch: pa.RecordBatch, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of legs as ``counted`` gives them, all with a length, the samples s / n inside their paths: block by block the first leg, where each leg's begin, lons, lats.

    The same arithmetic as ``sample_legs`` with ends; every leg has one sample at least.
    """
    points, pieces = batch.column(path), batch.column("_pieces")
    first, p_first = points.offsets.to_numpy(), pieces.offsets.to_numpy()
    lat, lon = (points.values.field(c).to_numpy() for c in ("lat", "lon"))
    length, n, count = pieces.values.to_numpy(), batch.column("_n").to_numpy(), np.diff(p_first)
    low = 0
    while low < len(n):
        high = low + max(1, int(np.searchsorted(np.cumsum(n[low:] - 1), SAMPLE_BLOCK, "right")))
        each = n[low:high] - 1
        starts = np.cumsum(each) - each
        leg = np.repeat(np.arange(low, high), each)
        t = (np.arange(len(leg)) - np.repeat(starts, each) + 1) / n[leg]
        total = batch.column("_km").to_numpy()[leg]
        # The piece that holds the target: as many are left behind as end before it.
        ends, before, at = np.zeros(high - low), np.zeros(len(leg)), np.zeros(len(leg), int)
        for k in range(int(count[low:high].max()) - 1):
            more = k < count[low:high] - 1
            ends = ends + np.where(more, length[np.where(more, p_first[low:high] + k, 0)], 0.0)
            behind = more[leg - low] & (at == k) & (ends[leg - low] < t * total)
            before, at = np.where(behind, ends[leg - low], before), at + behind
        own = length[p_first[leg] + at]
        with np.errstate(divide="ignore", invalid="ignore"):
            f = np.where(own > 0, np.maximum(0.0, np.minimum(1.0, (t * total - before) / own)), 0.0)
        a = first[leg] + at
        yield low, starts, lon[a] + (lon[a + 1] - lon[a]) * f, lat[a] + (lat[a + 1] - lat[a]) * f
        low = high


def sample_legs(legs: DataFrame, path: str = "path", step_km: float = 40, least: int = 3, most: int = 400, ends: bool = False) -> DataFrame:
    """A row per sample of each leg: all its columns, s, t, lat, lon.

    Interior samples lie at s / (n + 1); with ends, at s / n for s = 0 to n. A path
    without length has no interior samples, and its own vertices with ends.
    """
    sized = counted(legs, path, step_km, least, most)
    moving = sized.filter("_km > 0")
    if ends:
        moving = moving.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("_n")))).withColumn("t", F.col("s") / F.col("_n"))
    else:
        moving = moving.withColumn("s", F.explode(F.sequence(F.lit(1), F.col("_n")))).withColumn("t", F.col("s") / (F.col("_n") + 1))
    moving = moving.withColumn("_at", _along(F.col(path), F.col("_pieces"), F.col("t")))
    out = moving.withColumns({"lat": F.col("_at.lat"), "lon": F.col("_at.lon")}).drop("_at", "_pieces", "_km", "_n")
    if not ends:
        return out
    still = sized.filter("_km <= 0 OR _km IS NULL").select("*", F.posexplode(path).alias("s", "_at"))
    still = still.withColumns({"t": F.col("s").cast("double"), "lat": F.col("_at.lat"), "lon": F.col("_at.lon")})
    return out.unionByName(still.drop("_at", "_pieces", "_km", "_n"))


def trip_box(stops: DataFrame, pad: float = 0.2) -> DataFrame:
    """The box of each trip's placed stops, padded by a share of its span (of half a degree at least)."""
    placed = stops.filter("lat IS NOT NULL AND lon IS NOT NULL").groupBy("trip")
    box = placed.agg(F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"))
    across, up = F.greatest(F.col("e") - F.col("w"), F.lit(0.5)) * pad, F.greatest(F.col("n") - F.col("s"), F.lit(0.5)) * pad
    return box.select(
        "trip", (F.col("w") - across).alias("w"), (F.col("s") - up).alias("s"), (F.col("e") + across).alias("e"), (F.col("n") + up).alias("n")
    )


def return_visits(stops: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """Visits to one place: how often and the first stop, for places visited often enough."""
    grouped = stops.groupBy(*keys).agg(F.count(F.lit(1)).alias("visits"), F.min("stop").alias("first_stop"))
    return grouped.filter(F.col("visits") >= least)


def place_key(place_id: Column, lat: Column, lon: Column) -> Column:
    """A stop's place: its id if it has one, else its position to three decimals; a missing coordinate is 0."""
    at = lambda x: F.format_string("%.3f", half_up(F.coalesce(x, F.lit(0.0)), 3) + 0.0)
    return F.when(F.coalesce(place_id, F.lit("")) != "", F.concat(F.lit("p:"), place_id)).otherwise(F.concat(F.lit("c:"), at(lat), F.lit(","), at(lon)))


def coalesce_stops(stops: DataFrame) -> DataFrame:
    """trip, place, rank (0 up, by first appearance), visits, seqs (in order) from stops (trip, seq, place_id, lat, lon)."""
    keyed = stops.select("trip", "seq", place_key(F.col("place_id"), F.col("lat"), F.col("lon")).alias("place"))
    grouped = keyed.groupBy("trip", "place").agg(F.count(F.lit(1)).alias("visits"), F.array_sort(F.collect_list("seq")).alias("seqs"))
    rank = F.row_number().over(Window.partitionBy("trip").orderBy(F.col("seqs")[0])) - 1
    return grouped.select("trip", "place", rank.alias("rank"), "visits", "seqs")
