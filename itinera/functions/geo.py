"""Column builders for positions on the globe and on the map."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Latitude beyond which Web Mercator is cut.
MERCATOR_LAT = 85.0511
#: Zoom of a box that cannot be fitted.
DEFAULT_ZOOM = 4.4


def half_up(x: Column, digits: int = 0) -> Column:
    """Round halves towards plus infinity (Spark's round goes away from zero)."""
    scale = F.lit(10.0**digits)
    return F.floor(x * scale + 0.5) / scale


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null where any coordinate is."""
    a = F.radians(lat2 - lat1) / 2
    b = F.radians(lon2 - lon1) / 2
    h = F.sin(a) * F.sin(a) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(b) * F.sin(b)
    return F.lit(2 * EARTH_KM) * F.asin(F.when(h > 1, 1.0).otherwise(F.sqrt(h)))


def mercator_x(lon: Column) -> Column:
    return (lon + 180) / 360


def mercator_y(lat: Column) -> Column:
    phi = F.radians(clamp(lat, -MERCATOR_LAT, MERCATOR_LAT))
    return F.lit(0.5) - F.ln(F.tan(phi / 2 + math.pi / 4)) / (2 * math.pi)


def box_is_valid(w: Column, s: Column, e: Column, n: Column) -> Column:
    """A box in range whose west lies before its east and south before its north; false for nulls."""
    fine = (w < e) & (s < n) & (w >= -180) & (e <= 180) & (s >= -90) & (n <= 90)
    return F.coalesce(fine & ~(F.isnan(w) | F.isnan(s) | F.isnan(e) | F.isnan(n)), F.lit(False))


def fit_zoom(w: Column, s: Column, e: Column, n: Column, width: float, height: float) -> Column:
    """Zoom at which a box fills a canvas of 256-pixel tiles."""
    across = F.log2(F.lit(float(width)) / (256 * ((e - w) / 360)))
    up = F.log2(F.lit(float(height)) / (256 * ((n - s) / 360) / F.cos(F.radians((s + n) / 2))))
    return F.when(box_is_valid(w, s, e, n), F.least(across, up)).otherwise(DEFAULT_ZOOM)


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    """x within bounds; null stays null."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(x.isNotNull(), F.greatest(as_col(low), F.least(as_col(high), x)))


def bearing_sign(hint: Column, degrees: Column) -> Column:
    """+1 for an eastward hint, -1 for a westward one, else 0; degrees count from north."""
    turn = F.pmod(degrees, F.lit(360.0))
    return (
        F.when(F.lower(hint) == "east", 1)
        .when(F.lower(hint) == "west", -1)
        .when(hint.isNotNull(), 0)
        .when((turn > 0) & (turn < 180), 1)
        .when(turn > 180, -1)
        .otherwise(0)
    )


def unwrap_lon(start: Column, lon: Column, sign: Column) -> Column:
    """The copy of a longitude that lies in the hinted direction from start, or nearest without a hint."""
    east = lon + 360 * F.when(lon <= start, F.floor((start - lon) / 360) + 1).otherwise(0)
    west = lon - 360 * F.when(lon >= start, F.floor((lon - start) / 360) + 1).otherwise(0)
    near = F.when(lon - start > 180, lon - 360).when(lon - start < -180, lon + 360).otherwise(lon)
    return F.when(sign == 1, east).when(sign == -1, west).otherwise(near)


def unwrapped_path(lons: Column, sign: Column) -> Column:
    """Longitudes of a path, each unwrapped against the one before."""
    first = F.slice(lons, 1, 1)
    rest = F.slice(lons, 2, F.greatest(F.size(lons) - 1, F.lit(0)))
    return F.aggregate(rest, first, lambda done, lon: F.concat(done, F.array(unwrap_lon(F.element_at(done, -1), lon, sign))))


def score_population(thousands: Column) -> Column:
    """Importance of a place from 0 to 1; not positive or null gives 0."""
    p = F.ln(F.greatest(thousands, F.lit(30.0))) / math.log(11000)
    return F.when(thousands > 0, F.least(F.lit(1.0), p)).otherwise(0.0)


def furniture_scale(zoom: Column) -> Column:
    return F.coalesce(clamp(0.85 * F.pow(F.greatest(zoom, F.lit(4.0)) / 4, F.lit(0.66)), 0.85, 1.7), F.lit(0.85))


def zoom_scale(zoom: Column) -> Column:
    return F.coalesce(0.7 + (2.5 - 0.7) * ((clamp(zoom, 2.0, 11.0) - 2) / 9), F.lit(0.7))


def cap_for_zoom(zoom: Column) -> Column:
    """How many ranked places a zoom shows."""
    return F.when(zoom < 3, 30).when(zoom < 5, 100).when(zoom < 7, 300).when(zoom < 9, 800).otherwise(9999)


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd test of a point against a ring of (lon, lat) structs; the ring closes itself."""
    before = F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.size(ring) - 1))

    def crossed(p: Column, q: Column) -> Column:
        spans = (p["lat"] > lat) != (q["lat"] > lat)
        at = (q["lon"] - p["lon"]) * (lat - p["lat"]) / F.nullif(q["lat"] - p["lat"], F.lit(0.0)) + p["lon"]
        return spans & (lon < at)

    return F.size(F.filter(F.zip_with(ring, before, crossed), lambda hit: hit)) % 2 == 1


def pseudo_random(i: Column, salt: Column) -> Column:
    """A repeatable number from -1 to 1 for jitter; not exact across platforms."""
    x = F.sin(i * 12.9898 + salt * 78.233) * 43758.5453
    return (x - F.floor(x)) * 2 - 1


# Craft that are always drawn upright.
UPRIGHT = ("balloon", "hot-air-balloon", "hydrogen-balloon", "gas-balloon", "blimp", "zeppelin")


def orientation(vehicle: Column, heading: Column) -> Column:
    steady = vehicle.isin(*UPRIGHT) | heading.isNull() | F.isnan(heading)
    return F.when(F.coalesce(steady, F.lit(False)), 0.0).otherwise(heading)


def ease(name: str, t: Column) -> Column:
    """Easing curves by name; an unknown name eases in and out cubically."""
    t = clamp(t, 0.0, 1.0)
    u, v = 1 - t, 2 - 2 * t
    curves = {
        "linear": t,
        "easeInCubic": t * t * t,
        "easeOutCubic": 1 - u * u * u,
        "easeInOutQuad": F.when(t < 0.5, 2 * t * t).otherwise(1 - v * v / 2),
    }
    return curves.get(name, F.when(t < 0.5, 4 * t * t * t).otherwise(1 - v * v * v / 2))


def leg_duration_ms(pixels: Column, reduced: Column) -> Column:
    """How long a leg is animated: from its whole pixels, within bounds, halved for reduced motion."""
    base = clamp(F.greatest(pixels.cast("int"), F.lit(0)) / 0.15, 1600.0, 6000.0)
    return F.when(reduced, F.greatest(F.lit(400.0), half_up(base * 0.5))).otherwise(half_up(base)).cast("long")


def dms(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Decimal degrees; south and west are negative."""
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(ref.isin("S", "W"), -value).otherwise(value)


def sane_position(lat: Column, lon: Column) -> Column:
    """A struct of lat and lon: each null where out of range, both where both are exactly zero."""
    a, b = F.when(lat.between(-90, 90), lat), F.when(lon.between(-180, 180), lon)
    nowhere = F.coalesce((a == 0) & (b == 0), F.lit(False))
    return F.struct(F.when(~nowhere, a).alias("lat"), F.when(~nowhere, b).alias("lon"))
