"""Bases of a trip: proximity groups, hubs, and excursions from the primary hub."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itinera.functions.text import trimmed
from itinera.operators.folds import fold_rows, km_between

#: A base's radius and the visits that make one.
HUB_KM, HUB_VISITS = 1.0, 3


def _anchor_step(radius_km: float) -> Callable[[], Callable[..., int]]:
    """Anchors by latitude band, one radius high, and by hub; the first of those within reach wins."""
    degrees = math.degrees(radius_km / 6371.0)

    def make() -> Callable[..., int]:
        bands: dict[int, list[tuple[int, float, float]]] = {}
        hubs: dict[str, int] = {}

        def step(seq: int, lat: float, lon: float, hub: str | None) -> int:
            band = math.floor(lat / degrees)
            hits = [a for b in (band - 1, band, band + 1) for a, y, x in bands.get(b, ()) if km_between(y, x, lat, lon) <= radius_km]
            hits += [hubs[hub]] if hub in hubs else []
            if hits:
                return min(hits)
            bands.setdefault(band, []).append((seq, lat, lon))
            if hub:
                hubs[hub] = seq
            return seq

        return step

    return make


def proximity_groups(stops: DataFrame, radius_km: float = HUB_KM) -> DataFrame:
    """trip, seq, anchor: each placed stop joins the first earlier anchor within reach, or becomes one.

    Stops (trip, seq, lat, lon, and hub_id if there is one) of a trip pass in order;
    the anchors so far are the fold's state.
    """
    hub = F.col("hub_id") if "hub_id" in stops.columns else F.lit(None)
    rows = stops.filter("lat IS NOT NULL AND lon IS NOT NULL").select("trip", F.col("seq").cast("int").alias("seq"), "lat", "lon", hub.cast("string").alias("_hub"))
    return fold_rows(rows, "trip", ["seq"], ["seq", "lat", "lon", "_hub"], _anchor_step(radius_km), "anchor").drop("_hub")


def detect_hubs(groups: DataFrame, visits: int = HUB_VISITS, declared: str | None = None) -> DataFrame:
    """trip, anchor, visits, declared, is_primary: groups visited often enough or declared.

    The primary hub of a trip is the one with the most visits, the first on a tie.
    """
    said = F.bool_or(F.col(declared)) if declared else F.lit(False)
    counted = groups.groupBy("trip", "anchor").agg(F.count(F.lit(1)).alias("visits"), said.alias("declared"))
    hubs = counted.filter((F.col("visits") >= visits) | F.coalesce("declared", F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("trip").orderBy(F.desc("visits"), "anchor"))
    return hubs.withColumn("is_primary", rank == 1)


def hub_of_stop(groups: DataFrame, hubs: DataFrame) -> DataFrame:
    """Each stop with the hub that holds it, null for none."""
    return groups.join(hubs.select("trip", "anchor", "visits"), ["trip", "anchor"], "left").select(
        "trip", "seq", F.when(F.col("visits").isNotNull(), F.col("anchor")).alias("hub")
    )


def day_trips(stops: DataFrame, radius_km: float = HUB_KM) -> DataFrame:
    """Runs of stops between two visits to the primary hub: trip, start_seq, end_seq, spokes, label.

    A run that never comes back is left out.
    """
    groups = proximity_groups(stops, radius_km)
    base = detect_hubs(groups).filter("is_primary").select("trip", "anchor", F.lit(True).alias("at_base"))
    marked = (
        stops.join(groups.select("trip", "seq", "anchor"), ["trip", "seq"], "left")
        .join(base, ["trip", "anchor"], "left")
        .withColumn("at_base", F.coalesce("at_base", F.lit(False)))
    )
    order = Window.partitionBy("trip").orderBy("seq")
    marked = marked.withColumns(
        {
            "run": F.sum(F.col("at_base").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "visits": F.sum(F.col("at_base").cast("int")).over(Window.partitionBy("trip")),
        }
    )
    away = F.filter(F.array_sort(F.collect_list(F.when(~F.col("at_base"), F.struct("seq", trimmed(F.col("name")).alias("name"))))), lambda s: s.isNotNull())
    runs = marked.groupBy("trip", "run", "visits").agg(F.min("seq").alias("start_seq"), F.max("seq").alias("last"), away.alias("away"))
    runs = runs.filter((F.col("run") > 0) & (F.col("run") < F.col("visits")) & (F.size("away") > 0))
    names = F.filter(F.transform("away", lambda s: s["name"]), lambda n: n != "")
    n = F.size("names")
    said = lambda i: F.try_element_at("names", F.lit(i))
    label = (
        F.when(n == 1, F.concat(F.lit("to "), said(1), F.lit(" & back")))
        .when(n == 2, F.concat(F.lit("to "), said(1), F.lit(" & "), said(2), F.lit(" & back")))
        .when(n > 2, F.concat(F.lit("to "), said(1), F.lit(", "), said(2), F.lit(" & "), (n - 2).cast("string"), F.lit(" more & back")))
        .otherwise("day-trip")
    )
    return runs.withColumn("names", names).select(
        "trip", "start_seq", (F.col("last") + 1).alias("end_seq"), F.size("away").alias("spokes"), label.alias("label")
    )
