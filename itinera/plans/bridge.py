"""Journeys over the driver's tables: places, photos, stops and years by integer rules.

The tables carry no positions, so these are derived from keys; ``SQL`` holds the
same rules for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itinera.functions.dates import micros_of
from itinera.operators.covering import Covering, cover
from itinera.plans import dims
from itinera.sources.storage import shared_dir

#: Vehicles with a first year.
DATED = sum(since is not None for *_, since in dims.VEHICLES)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """owner, photo_id, us (microseconds, some null), lat, lon (some null): from events."""
    return _read(spark, sf_dir, "events").select(
        F.col("user_id").alias("owner"),
        F.col("event_id").alias("photo_id"),
        F.when(F.col("event_id") % 37 != 5, micros_of(F.col("ts"))).alias("us"),
        F.expr("CASE WHEN event_id % 41 <> 7 THEN 35 + (user_id * 37 % 400) / 100D + (event_id * 13 % 11) / 500D END").alias("lat"),
        F.expr("33 + (user_id * 101 % 400) / 100D + (event_id * 7 % 5) / 500D").alias("lon"),
    )


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trip, seq, name, lat, lon (some null), arrive, depart, vehicle, companions: from orders."""
    base = _read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("trip"),
        F.col("o_orderkey").alias("stop"),
        F.expr("cast((o_orderkey * 7 + o_custkey) % 6 AS int)").alias("p"),
        F.expr("date_format(o_orderdate, 'yyyy-MM-dd')").alias("day"),
        "o_orderdate",
    )
    names = F.array(*[F.lit(v) for v, *_ in dims.VEHICLES])
    return base.select(
        "trip",
        "stop",
        F.expr("cast(row_number() OVER (PARTITION BY trip ORDER BY o_orderdate, stop) - 1 AS int)").alias("seq"),
        F.expr("concat('Place ', trip, '.', p)").alias("name"),
        F.expr("CASE WHEN stop % 53 <> 11 THEN 34 + (trip * 37 % 700) / 100D + p * 0.25D END").alias("lat"),
        F.expr("29 + (trip * 101 % 1300) / 100D + (p % 3) * 0.4D").alias("lon"),
        F.expr("CASE WHEN stop % 7 <> 3 THEN day END").alias("arrive"),
        F.expr("CASE WHEN stop % 11 <> 4 THEN date_format(date_add(o_orderdate, cast(stop % 40 AS int) - 2), 'yyyy-MM-dd') END").alias("depart"),
        F.when(F.col("stop") % 9 != 2, F.element_at(names, (F.col("stop") % DATED * 5 + 1).cast("int"))).alias("vehicle"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, name, lat, lon, pop (thousands): from customers."""
    return _read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("idx"),
        F.col("c_name").alias("name"),
        F.expr("cast(c_custkey * 37 % 1300 AS double) / 10 - 60").alias("lat"),
        F.expr("cast(c_custkey * 101 % 3600 AS double) / 10 - 180").alias("lon"),
        F.expr("c_acctbal / 2").alias("pop"),
    )


def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, year (signed), lat, lon: from parts."""
    return _read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item"), F.expr("cast(p_partkey * 97 % 3800 - 1750 AS int)").alias("year")
    )


_COASTS: dict[str, Covering] = {}


def coast(spark: SparkSession) -> Covering:
    """The land layer, covered once in a session."""
    key = f"{spark.sparkContext.applicationId} {shared_dir(spark)}"
    if key not in _COASTS or not _COASTS[key].exists():
        _COASTS[key] = cover(dims.land(spark))
    return _COASTS[key]


def _leg_table(spark: SparkSession, sf_dir: str, place: list[str]) -> DataFrame:
    """Legs from orders: trip, leg, ends, via (some unplaced), hint, degrees, vehicle."""
    at = lambda i: F.expr(place[i].replace("::DOUBLE", "D"))
    k = F.col("o_orderkey")
    names = F.array(*[F.lit(v) for v, *_ in dims.VEHICLES])
    via = F.array(F.struct(F.when(k % 3 >= 1, at(4)).alias("lat"), at(5).alias("lon")), F.struct(F.when((k % 3 == 2) & (k % 5 != 0), at(6)).alias("lat"), at(7).alias("lon")))
    return _read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("trip"), k.alias("leg"), *[at(i).alias(c) for i, c in enumerate(("from_lat", "from_lon", "to_lat", "to_lon"))], via.alias("via"),
        F.when(k % 4 == 0, "east").when(k % 4 == 1, "West").when(k % 4 == 2, "north").alias("hint"), (k * 13 % 720 - 360).cast("double").alias("degrees"),
        F.element_at(names, (k % len(dims.VEHICLES) + 1).cast("int")).alias("vehicle"),
    )


#: latitudes and longitudes of a leg's ends and two via points: over the world, and over our own land layer
_WORLD = [f"(o_orderkey * {m} % {1300 if i % 2 == 0 else 3600}) / 10::DOUBLE - {60 if i % 2 == 0 else 180}" for i, m in enumerate((37, 101, 53, 211, 29, 307, 31, 401))]
_REGION = [f"{33 if i % 2 == 0 else 26} + (o_orderkey * {m} % {1000 if i % 2 == 0 else 2000}) / 100::DOUBLE" for i, m in enumerate((37, 101, 53, 211, 29, 307, 31, 401))]


def world_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leg_table(spark, sf_dir, _WORLD)


def via_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leg_table(spark, sf_dir, _REGION)


_VEHICLES = ", ".join(f"'{v}'" for v, *_ in dims.VEHICLES)

#: The same tables as common table expressions for DuckDB.
SQL = {
    "photos": """photos AS (
        SELECT user_id AS owner, event_id AS photo_id,
               CASE WHEN event_id % 37 <> 5 THEN epoch_us(ts) END AS us,
               CASE WHEN event_id % 41 <> 7 THEN 35 + (user_id * 37 % 400) / 100::DOUBLE + (event_id * 13 % 11) / 500::DOUBLE END AS lat,
               33 + (user_id * 101 % 400) / 100::DOUBLE + (event_id * 7 % 5) / 500::DOUBLE AS lon
        FROM events)""",
    "stops": f"""stops_base AS (
        SELECT o_custkey AS trip, o_orderkey AS stop, ((o_orderkey * 7 + o_custkey) % 6)::INT AS p, o_orderdate,
               strftime(o_orderdate, '%Y-%m-%d') AS day
        FROM orders),
    stops AS (
        SELECT trip, stop, (row_number() OVER (PARTITION BY trip ORDER BY o_orderdate, stop) - 1)::INT AS seq,
               'Place ' || trip || '.' || p AS name,
               CASE WHEN stop % 53 <> 11 THEN 34 + (trip * 37 % 700) / 100::DOUBLE + p * 0.25::DOUBLE END AS lat,
               29 + (trip * 101 % 1300) / 100::DOUBLE + (p % 3) * 0.4::DOUBLE AS lon,
               CASE WHEN stop % 7 <> 3 THEN day END AS arrive,
               CASE WHEN stop % 11 <> 4 THEN strftime(o_orderdate::DATE + (stop % 40 - 2)::INT, '%Y-%m-%d') END AS depart,
               CASE WHEN stop % 9 <> 2 THEN ([{_VEHICLES}])[(stop % {DATED} * 5 + 1)::INT] END AS vehicle
        FROM stops_base)""",
    "places": """places AS (
        SELECT c_custkey AS idx, c_name AS name, (c_custkey * 37 % 1300)::DOUBLE / 10 - 60 AS lat,
               (c_custkey * 101 % 3600)::DOUBLE / 10 - 180 AS lon, c_acctbal / 2 AS pop
        FROM customer)""",
    "years": """years AS (SELECT p_partkey AS item, (p_partkey * 97 % 3800 - 1750)::INT AS year FROM part)""",
    "eras": "eras(ord, era, start_year, end_year, sea, land, air, theme, mode) AS (VALUES "
    + ", ".join(
        "("
        + ", ".join(
            [str(i), f"'{e[0]}'", str(e[1]), str(e[2])]
            + [f"'{x}'" if x else "NULL" for x in e[3:6]]
            + [f"'{e[6][0]}'", "'loose'" if e[0] in dims.LOOSE_ERAS else "'strict'"]
        )
        + ")"
        for i, e in enumerate(dims.ERAS)
    )
    + ")",
}


def _leg_sql(name: str, place: list[str]) -> str:
    return f"""{name} AS (SELECT o_custkey AS trip, o_orderkey AS leg, {place[0]} AS from_lat, {place[1]} AS from_lon, {place[2]} AS to_lat, {place[3]} AS to_lon,
        CASE WHEN o_orderkey % 3 >= 1 THEN {place[4]} END AS v1_lat, {place[5]} AS v1_lon, CASE WHEN o_orderkey % 3 = 2 AND o_orderkey % 5 <> 0 THEN {place[6]} END AS v2_lat, {place[7]} AS v2_lon,
        CASE o_orderkey % 4 WHEN 0 THEN 'east' WHEN 1 THEN 'West' WHEN 2 THEN 'north' END AS hint, (o_orderkey * 13 % 720 - 360)::DOUBLE AS degrees,
        ([{_VEHICLES}])[(o_orderkey % {len(dims.VEHICLES)} + 1)::INT] AS vehicle FROM orders)"""


SQL |= {"world_legs": _leg_sql("world_legs", _WORLD), "via_legs": _leg_sql("via_legs", _REGION)}


def km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Haversine distance in SQL."""
    return (
        f"(2 * 6371.0 * asin(least(1.0::DOUBLE, sqrt(sin(radians({lat2} - {lat1}) / 2) * sin(radians({lat2} - {lat1}) / 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lon2} - {lon1}) / 2) * sin(radians({lon2} - {lon1}) / 2)))))"
    )


def half_up(x: str, digits: int = 0) -> str:
    return f"(floor(({x}) * {10.0**digits} + 0.5) / {10.0**digits})"


def with_(*names: str) -> str:
    """A WITH clause of the named tables."""
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names)
