"""Land and water: point in polygon, landmasses, leg audits, vehicle inference.

Polygons are looked up through a multi-level covering (``covering``), which every
function here takes in place of a layer; a layer is covered once per call.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from itinera.functions.geo import half_up
from itinera.functions.text import trimmed
from itinera.operators.covering import Covering, cover, finder, locate
from itinera.operators.folds import km_between
from itinera.operators.legs import counted, inner_samples, leg_km, sample_legs, segment_km, vertices
from itinera.plans import dims

#: Rings (km) by which a point off the coast reaches for land, and how far is trusted.
SNAP_KM, TRUST_KM, KM_PER_DEGREE = (2, 5, 10, 20), 10, 111.0


def polygons_near(boxes: DataFrame, key: str, land: DataFrame, pad: float = 1.0) -> DataFrame:
    """key, polygons (their rings, in order) that may touch each box (w, s, e, n), by the cells of both."""
    span = lambda low, high: F.sequence(F.floor(F.col(low) - pad), F.floor(F.col(high) + pad))
    cells = boxes.select(key, F.explode(span("s", "n")).alias("_row"), "w", "e").select(key, "_row", F.explode(span("w", "e")).alias("_column"))
    corner = lambda axis, f: F.floor(f(F.transform(F.col("rings")[0], lambda p: p[axis])))
    spread = land.withColumn("_row", F.explode(F.sequence(corner("lat", F.array_min), corner("lat", F.array_max))))
    spread = spread.withColumn("_column", F.explode(F.sequence(corner("lon", F.array_min), corner("lon", F.array_max)))).select("ord", "_row", "_column")
    near = cells.join(spread, ["_row", "_column"]).select(key, "ord").distinct().join(land.select("ord", "rings"), "ord")
    near = near.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "rings"))).alias("x"))
    return near.select(key, F.transform("x", lambda x: x["rings"]).alias("polygons"))


def on_land(lons: np.ndarray, lats: np.ndarray, polygons: list) -> np.ndarray:
    """Even-odd test of many points against polygons, each a list of rings of (lon, lat)."""
    return landmasses(lons, lats, polygons) >= 0


def landmasses(lons: np.ndarray, lats: np.ndarray, polygons: list) -> np.ndarray:
    """The number of the first polygon that holds each point, -1 for water."""
    out = np.full(lons.shape, -1)
    for i, rings in enumerate(polygons):
        inside = np.zeros((len(rings), *lons.shape), bool)
        for k, ring in enumerate(rings):
            for (x1, y1), (x2, y2) in zip(ring, [ring[-1], *ring[:-1]], strict=True):
                if y1 != y2:
                    inside[k] ^= ((y1 > lats) != (y2 > lats)) & (lons < (x2 - x1) * (lats - y1) / (y2 - y1) + x1)
        out[(out < 0) & inside[0] & ~inside[1:].any(axis=0)] = i
    return out


class Coast:
    """The polygons near some places, for tests inside a fold: what across_water says of tables."""

    def __init__(self, polygons: list):
        self.polygons = [[[(p["lon"], p["lat"]) for p in ring] for ring in rings] for rings in polygons]

    def landmass(self, lat: float, lon: float) -> int | None:
        """The trusted landmass of a position, reached outwards where it lies off it."""
        lats, lons = [lat], [lon]
        for km in [d for d in SNAP_KM if d <= TRUST_KM]:
            across = km / (KM_PER_DEGREE * max(0.2, math.cos(math.radians(lat))))
            for a in range(8):
                lats.append(lat + km / KM_PER_DEGREE * math.sin(a * math.pi / 4))
                lons.append(lon + across * math.cos(a * math.pi / 4))
        found = landmasses(np.array(lons), np.array(lats), self.polygons)
        return next((int(x) for x in found if x >= 0), None)

    def apart(self, lat1: float, lon1: float, lat2: float, lon2: float, km: float, share: float) -> bool:
        """Whether two positions lie on different landmasses, or far apart with mostly water between."""
        a, b = self.landmass(lat1, lon1), self.landmass(lat2, lon2)
        if a is not None and b is not None and a != b:
            return True
        if km_between(lat1, lon1, lat2, lon2) <= km:
            return False
        t = np.arange(1, 12) / 12
        return bool((~on_land(lon1 + (lon2 - lon1) * t, lat1 + (lat2 - lat1) * t, self.polygons)).mean() > share)


def locate_in_layers(points: DataFrame, packs: DataFrame, boxes: DataFrame, land: DataFrame | Covering) -> DataFrame:
    """Add on_land: a detailed pack whose box covers the point decides, else the coarse layer.

    packs: polygons as for ``locate``; boxes: w, s, e, n of each pack.
    """
    cells = boxes.withColumn("_row", F.explode(F.sequence(F.floor("s"), F.floor("n")))).withColumn("_column", F.explode(F.sequence(F.floor("w"), F.floor("e"))))
    cells = cells.groupBy("_row", "_column").agg(F.collect_list(F.struct("w", "s", "e", "n")).alias("_boxes"))
    here = points.withColumns({"_row": F.floor("lat"), "_column": F.floor("lon")}).join(cells, ["_row", "_column"], "left")
    covered = F.exists("_boxes", lambda b: F.col("lon").between(b["w"], b["e"]) & F.col("lat").between(b["s"], b["n"]))
    here = here.withColumn("_covered", F.coalesce(covered, F.lit(False))).drop("_row", "_column", "_boxes")
    both = locate(locate(here, packs, "_pack"), land, "_coarse")
    fine = F.when(F.col("_covered"), F.col("_pack").isNotNull()).otherwise(F.col("_coarse").isNotNull())
    return both.withColumn("on_land", fine).drop("_covered", "_pack", "_coarse")


def probes(lat: Column, lon: Column) -> Column:
    """A point and the eight bearings of each snap ring, in the order in which they are tried."""
    out = [F.struct(F.lit(0).alias("k"), F.lit(0).alias("snap_km"), lat.alias("lat"), lon.alias("lon"))]
    for km in SNAP_KM:
        up = F.lit(km / KM_PER_DEGREE)
        across = F.lit(float(km)) / (KM_PER_DEGREE * F.greatest(F.lit(0.2), F.cos(F.radians(lat))))
        for a in range(8):
            turn = a * math.pi / 4
            out.append(
                F.struct(F.lit(len(out)).alias("k"), F.lit(km).alias("snap_km"), (lat + up * math.sin(turn)).alias("lat"), (lon + across * math.cos(turn)).alias("lon"))
            )
    return F.array(*out)


def landmass_near(points: DataFrame, key: list[str], land: DataFrame | Covering) -> DataFrame:
    """key, landmass, snap_km: the landmass of each keyed point, reached outwards where it lies off it.

    Distinct positions are looked up once, and only those off land try the rings.
    """
    land = cover(land)
    spots = locate(points.select("lat", "lon").filter("lat IS NOT NULL AND lon IS NOT NULL").distinct(), land)
    on = spots.filter("landmass IS NOT NULL").withColumn("snap_km", F.lit(0))
    tries = F.slice(probes(F.col("lat"), F.col("lon")), 2, 8 * len(SNAP_KM))
    off = spots.filter("landmass IS NULL").select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.explode(tries).alias("p"))
    found = locate(off.select("_lat", "_lon", "p.*"), land).filter("landmass IS NOT NULL")
    best = found.groupBy("_lat", "_lon").agg(F.min(F.struct("k", "landmass", "snap_km")).alias("best"))
    reached = on.unionByName(best.select(F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), "best.landmass", "best.snap_km"))
    return points.select(*key, "lat", "lon").join(reached, ["lat", "lon"], "left").select(*key, "landmass", "snap_km")


def same_landmass(legs: DataFrame, land: DataFrame | Covering) -> DataFrame:
    """trip, leg, same: whether both ends share a landmass; null where one lies too far off any."""
    ends = legs.select("trip", "leg", F.lit("a").alias("at"), F.col("from_lat").alias("lat"), F.col("from_lon").alias("lon")).unionByName(
        legs.select("trip", "leg", F.lit("b").alias("at"), F.col("to_lat").alias("lat"), F.col("to_lon").alias("lon"))
    )
    near = landmass_near(ends, ["trip", "leg", "at"], land).withColumn("mass", F.when(F.col("snap_km") <= TRUST_KM, F.col("landmass")))
    both = near.groupBy("trip", "leg").agg(F.max(F.when(F.col("at") == "a", F.col("mass"))).alias("a"), F.max(F.when(F.col("at") == "b", F.col("mass"))).alias("b"))
    return both.select("trip", "leg", (F.col("a") == F.col("b")).alias("same"))


def _share_of_water(legs: DataFrame, land: DataFrame | Covering, lines: Column, n: int) -> DataFrame:
    """trip, leg, at, water: mean share of interior samples off land over the lines of each leg."""
    t = F.explode(F.sequence(F.lit(1), F.lit(n - 1)))
    rows = legs.select("trip", "leg", F.explode(lines).alias("x")).select("trip", "leg", "x.*", t.alias("i"))
    rows = rows.select(
        "trip", "leg", "at",
        (F.col("a_lat") + (F.col("b_lat") - F.col("a_lat")) * (F.col("i") / n)).alias("lat"),
        (F.col("a_lon") + (F.col("b_lon") - F.col("a_lon")) * (F.col("i") / n)).alias("lon"),
    )
    wet = F.avg(F.col("landmass").isNull().cast("double"))
    return locate(rows, land).groupBy("trip", "leg", "at").agg(wet.alias("water"))


def _line(at: str, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> Column:
    return F.struct(F.lit(at).alias("at"), a_lat.alias("a_lat"), a_lon.alias("a_lon"), b_lat.alias("b_lat"), b_lon.alias("b_lon"))


def water_fraction(legs: DataFrame, land: DataFrame | Covering, samples: int = 12) -> DataFrame:
    """trip, leg, water: the share of a leg's straight line that lies off land."""
    line = F.array(_line("leg", F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon")))
    return _share_of_water(legs, land, line, samples).drop("at")


def local_land(legs: DataFrame, land: DataFrame | Covering, reach: float = 0.03) -> DataFrame:
    """trip, leg, from_land, to_land: the share of land on four short lines through each end."""
    lines = []
    for at, lat, lon in (("from", F.col("from_lat"), F.col("from_lon")), ("to", F.col("to_lat"), F.col("to_lon"))):
        for up, across in ((1, 0), (0, 1), (1, 1), (1, -1)):
            u, c = up * reach, across * reach
            lines.append(_line(at, lat - u, lon - c, lat + u, lon + c))
    wet = _share_of_water(legs, land, F.array(*lines), 8)
    dry = lambda at: F.max(F.when(F.col("at") == at, 1 - F.col("water")))
    return wet.groupBy("trip", "leg").agg(dry("from").alias("from_land"), dry("to").alias("to_land"))


def across_water(legs: DataFrame, land: DataFrame | Covering, km: float = 10.0, share: float = 0.6) -> DataFrame:
    """trip, leg, apart: the ends lie on different landmasses, or far apart with mostly water between."""
    land = cover(land)
    far = legs.filter(leg_km() > km)
    wet = legs.join(same_landmass(legs, land), ["trip", "leg"]).join(water_fraction(far, land), ["trip", "leg"], "left")
    apart = F.coalesce(~F.col("same"), F.lit(False)) | F.coalesce(F.col("water") > share, F.lit(False))
    return wet.select("trip", "leg", apart.alias("apart"))


def modality(vehicle: Column) -> Column:
    """air, boat or land of a vehicle; an unknown or missing one goes by land."""
    v = F.lower(trimmed(vehicle))
    return F.when(v.isin(*dims.AIRCRAFT), "air").when(v.isin(*dims.BOATS), "boat").otherwise("land")


def audit_legs(legs: DataFrame, land: DataFrame | Covering, tolerance: float = 0.15) -> DataFrame:
    """Legs whose vehicle is off its medium on more than a share of its path.

    legs: as from ``legs_of``, with vehicle, and via if there are any. Returns trip,
    leg, vehicle, modality, kind, ratio, samples, offending, km, examples (the
    first three offending samples).
    """
    via = F.col("via") if "via" in legs.columns else F.lit(None).cast("array<struct<lat: double, lon: double>>")
    ground = legs.withColumn("modality", modality(F.col("vehicle"))).filter("modality <> 'air'")
    ground = ground.withColumn("path", vertices(F.col("from_lat"), F.col("from_lon"), via, F.col("to_lat"), F.col("to_lon")))
    ground = ground.withColumn("km", F.aggregate(segment_km(F.col("path")), F.lit(0.0), lambda acc, d: acc + d))
    sampled = locate(sample_legs(ground.select("trip", "leg", "vehicle", "modality", "km", "path")).drop("path"), land)
    wrong = F.when(F.col("modality") == "land", F.col("landmass").isNull()).otherwise(F.col("landmass").isNotNull())
    example = F.struct("s", half_up(F.col("lat"), 3).alias("lat"), half_up(F.col("lon"), 3).alias("lon"), half_up(F.col("t"), 2).alias("t"))
    found = sampled.groupBy("trip", "leg", "vehicle", "modality", "km").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(wrong).alias("offending"),
        F.slice(F.array_sort(F.collect_list(F.when(wrong, example))), 1, 3).alias("examples"),
    )
    ratio = F.col("offending") / F.col("samples")
    kind = F.when(F.col("modality") == "land", "land-vehicle-over-sea").otherwise("boat-over-land")
    return found.filter(ratio > tolerance).select(
        "trip", "leg", "vehicle", "modality", kind.alias("kind"), half_up(ratio, 3).alias("ratio"), "samples", "offending", half_up(F.col("km")).cast("long").alias("km"), "examples"
    )


def audit_trips(legs: DataFrame, land: DataFrame | Covering) -> DataFrame:
    """trip, legs, findings: how many legs each trip has and which are off their medium."""
    bad = audit_legs(legs, land).groupBy("trip").agg(F.array_sort(F.collect_list("leg")).alias("findings"))
    none = F.array().cast("array<int>")
    return legs.groupBy("trip").agg(F.count(F.lit(1)).alias("legs")).join(bad, "trip", "left").withColumn("findings", F.coalesce("findings", none))


def audit_rollup(legs: DataFrame, land: DataFrame | Covering) -> DataFrame:
    """Audits of trips rolled up: level (0 a trip, 1 an era, 3 all), era, trip, legs, off, km, worst.

    legs: as for ``audit_legs``, with era; a trip belongs to the era of each of its legs.
    ``off`` counts legs off their medium, ``km`` their length, ``worst`` is the largest
    share of such samples. A null era or trip is one of its own: level tells it from
    a subtotal.
    """
    bad = audit_legs(legs, land).select("trip", "leg", "km", "ratio")
    rows = legs.select("trip", "leg", "era").join(bad, ["trip", "leg"], "left")
    rolled = rows.rollup("era", "trip").agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("legs"), F.count("ratio").alias("off"),
        F.coalesce(F.sum("km"), F.lit(0)).alias("km"), F.max("ratio").alias("worst"),
    )
    return rolled.select("level", "era", "trip", "legs", "off", "km", "worst")


def touched(legs: DataFrame, land: DataFrame | Covering, step_km: float = 8) -> DataFrame:
    """trip, leg, land, water: which of both the inside of a leg's path touches.

    A small covering goes to the tasks, which test a leg's samples as arrays; else samples are rows.
    """
    index = cover(land)
    via = F.col("via") if "via" in legs.columns else F.lit(None).cast("array<struct<lat: double, lon: double>>")
    paths = legs.select("trip", "leg", vertices(F.col("from_lat"), F.col("from_lon"), via, F.col("to_lat"), F.col("to_lon")).alias("path"))
    if index.small:
        find = finder(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dry, wet = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
                for low, starts, lons, lats in inner_samples(batch, "path"):
                    on = find.on_land(lons, lats)
                    for out, hit in ((dry, on), (wet, ~on)):
                        out[low : low + len(starts)] = np.logical_or.reduceat(hit, starts)
                yield pa.RecordBatch.from_arrays([batch.column("trip"), batch.column("leg"), pa.array(dry), pa.array(wet)], ["trip", "leg", "land", "water"])

        moving = counted(paths, "path", step_km, 2, 400).filter("_km > 0")
        found = moving.mapInArrow(run, StructType([*paths.schema.fields[:2], StructField("land", BooleanType()), StructField("water", BooleanType())]))
    else:
        samples = sample_legs(paths, step_km=step_km, least=2, ends=True).drop("path").filter("s > 0 AND t < 1")
        found = locate(samples, index).select("trip", "leg", F.col("landmass").isNotNull().alias("land"), F.col("landmass").isNull().alias("water"))
    found = found.groupBy("trip", "leg").agg(F.bool_or("land").alias("land"), F.bool_or("water").alias("water"))
    return legs.select("trip", "leg").join(found, ["trip", "leg"], "left").select("trip", "leg", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("land", "water")])


def crosses(legs: DataFrame, land: DataFrame | Covering, medium: str, step_km: float = 8) -> DataFrame:
    """trip, leg, crosses: whether the inside of a leg's path touches ``land`` or ``water``."""
    return touched(legs, land, step_km).select("trip", "leg", F.col(medium).alias("crosses"))


def crosses_terrain(path: Column, cost, limit: float = 0.35) -> Column:
    """Whether any of nine points inside a piece of a path costs more than a limit; a null cost does not."""
    n = F.size(path)
    tenths = F.sequence(F.lit(1), F.lit(9))

    def over(a: Column, b: Column) -> Column:
        at = lambda i: cost(a["lon"] + (b["lon"] - a["lon"]) * i / 10, a["lat"] + (b["lat"] - a["lat"]) * i / 10)
        return F.exists(tenths, lambda i: F.coalesce(at(i) > limit, F.lit(False)))

    return F.exists(F.zip_with(F.slice(path, 1, n - 1), F.slice(path, 2, n), over), lambda hit: hit)


def infer_vehicles(legs: DataFrame, land: DataFrame | Covering, sea_share: float = 0.5) -> DataFrame:
    """trip, leg, suggestion: how a leg was probably travelled.

    legs: as from ``legs_of`` with era and year (either may be null). Water is
    sampled only for legs that distance and era do not decide, and the ends' shores
    and landmasses only for those that still need them.
    """
    land = cover(land)
    spark = legs.sparkSession
    eras = dims.eras(spark).select("era", "sea", "land", "air", F.floor((F.col("start_year") + F.col("end_year")) / 2 + 0.5).alias("mid"))
    since = F.create_map(*[F.lit(x) for pair in dims.AIR_SINCE.items() for x in pair])
    named = legs.join(eras, "era", "left").withColumns({"km": leg_km(), "known": F.col("land").isNotNull()})
    named = named.withColumns(
        {
            "sea": F.when(F.col("known"), F.col("sea")).otherwise("boat"),
            "land": F.when(F.col("known"), F.col("land")).otherwise("car"),
            "air": F.when(F.col("known"), F.col("air")).otherwise("plane"),
        }
    )
    early = F.coalesce(F.coalesce("year", "mid") < since[F.col("air")], F.lit(False))
    named = named.withColumn("flies", F.col("air").isNotNull() & ~early)
    open_ = named.filter((F.col("km") >= 5) & ~(F.col("flies") & (F.col("km") >= 4000)))
    wet = water_fraction(open_, land)
    shores = open_.join(wet.filter(F.col("water") > sea_share), ["trip", "leg"], "left_semi").filter("km < 150")
    full = (
        named.join(wet, ["trip", "leg"], "left")
        .join(local_land(shores, land), ["trip", "leg"], "left")
        .join(same_landmass(open_, land), ["trip", "leg"], "left")
    )
    shore = F.coalesce((F.col("km") < 12) & (F.greatest("from_land", "to_land") >= 0.25), F.lit(False))
    coastal = F.coalesce((F.col("km") < 150) & F.col("same") & (F.least("from_land", "to_land") >= 0.3), F.lit(False))
    said = (
        F.when(F.col("km").isNull(), "plane")
        .when(F.col("km") < 5, "foot")
        .when(F.col("flies") & (F.col("km") >= 4000), F.col("air"))
        .when((F.col("water") > sea_share) & ~coastal & ~shore, F.col("sea"))
        .when(F.col("flies") & (F.col("km") >= 2500), F.col("air"))
        .when(~F.col("same"), F.col("sea"))
        .otherwise(F.col("land"))
    )
    return full.select("trip", "leg", said.alias("suggestion"))


def raster(box: tuple[float, float, float, float], land: DataFrame | Covering, cell: float = 0.08, most: int = 14_400) -> DataFrame:
    """A grid over a box (w, s, e, n): r, c, lat, lon, on_land, near (a water cell beside land).

    Cells grow where the grid would exceed ``most`` cells; each axis has 24 at least.
    """
    land = cover(land)
    spark = land.polygons.sparkSession
    w, s, e, n = box
    columns, rows = max(24, math.ceil((e - w) / cell) + 1), max(24, math.ceil((n - s) / cell) + 1)
    if columns * rows > most:
        k = math.sqrt(most / (columns * rows))
        columns, rows = max(24, math.floor(columns * k)), max(24, math.floor(rows * k))
    cells = spark.range(rows * columns).select(F.floor(F.col("id") / columns).cast("int").alias("r"), (F.col("id") % columns).cast("int").alias("c"))
    placed = cells.select("r", "c", (F.lit(s) + F.col("r") * ((n - s) / (rows - 1))).alias("lat"), (F.lit(w) + F.col("c") * ((e - w) / (columns - 1))).alias("lon"))
    judged = locate(placed, land).withColumn("on_land", F.col("landmass").isNotNull()).drop("landmass")
    steps = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    beside = judged.filter("on_land").select("r", "c", F.explode(steps).alias("d")).select((F.col("r") + F.col("d.dr")).alias("r"), (F.col("c") + F.col("d.dc")).alias("c")).distinct()
    return judged.join(beside.withColumn("near", F.lit(True)), ["r", "c"], "left").withColumn("near", F.coalesce("near", F.lit(False)) & ~F.col("on_land"))
