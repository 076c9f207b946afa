"""Queries by name, with the SQL that each is checked against.

Every query runs an operator over whole tables; results that come from sines and
logarithms are rounded, as engines differ in their last digits.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itinera.functions import dates, geo, text
from itinera.operators import clusters, hubs, land, legs, places, routing, trips
from itinera.plans import bridge, dims
from itinera.plans.bridge import half_up, km, with_
from itinera.sources.storage import new_folder
from itinera.sources import readers

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(x, digits: int = 6):
    """A rounded column."""
    return geo.half_up(x, digits)


# ---------------------------------------------------------------- return visits, clusters, hubs

VISITS = "owner, floor(lat * 1000 + 0.5)::BIGINT AS cell_lat, floor(lon * 1000 + 0.5)::BIGINT AS cell_lon"


@query(
    with_("photos")
    + f", cells AS (SELECT photo_id, {VISITS} FROM photos WHERE lat IS NOT NULL)"
    + " SELECT owner, cell_lat, cell_lon, count(*) AS visits, min(photo_id) AS first_stop FROM cells GROUP BY ALL HAVING count(*) >= 3"
)
def return_visits(spark, sf_dir):
    cell = lambda c: F.floor(F.col(c) * 1000 + 0.5)
    photos = clusters.placed(bridge.photos(spark, sf_dir))
    rows = photos.select("owner", F.col("photo_id").alias("stop"), cell("lat").alias("cell_lat"), cell("lon").alias("cell_lon"))
    return legs.return_visits(rows, ["owner", "cell_lat", "cell_lon"], least=3)


_FOLD = f"""
, ordered AS (
    SELECT *, row_number() OVER (PARTITION BY owner ORDER BY us NULLS LAST, photo_id) AS i FROM photos WHERE lat IS NOT NULL
), folded AS (
    SELECT owner, i, photo_id, us, lat, lon, 0 AS cluster, 1 AS n, lat AS s_lat, lon AS s_lon, us AS prev FROM ordered WHERE i = 1
    UNION ALL
    SELECT o.owner, o.i, o.photo_id, o.us, o.lat, o.lon,
           f.cluster + fresh::INT, CASE WHEN fresh THEN 1 ELSE f.n + 1 END,
           CASE WHEN fresh THEN o.lat ELSE f.s_lat + o.lat END, CASE WHEN fresh THEN o.lon ELSE f.s_lon + o.lon END, coalesce(o.us, f.prev)
    FROM folded f JOIN ordered o ON o.owner = f.owner AND o.i = f.i + 1,
    LATERAL (SELECT {km('f.s_lat / f.n', 'f.s_lon / f.n', 'o.lat', 'o.lon')} AS d) AS x,
    LATERAL (SELECT x.d > 6 OR coalesce(o.us - f.prev > 50400000000, false)
                    OR coalesce(x.d > 1.5 AND o.us - f.prev > 1200000000, false) AS fresh) AS y
)"""


@query(
    with_("photos")
    + _FOLD
    + """ SELECT owner, cluster, count(*) AS n, floor(avg(lat) * 1e6 + 0.5) / 1e6 AS lat, floor(avg(lon) * 1e6 + 0.5) / 1e6 AS lon,
    min(us) AS start_us, max(us) AS end_us, min(photo_id) AS first_photo, string_agg(photo_id::VARCHAR, ',' ORDER BY photo_id) AS photos FROM folded GROUP BY owner, cluster"""
)
def photo_clusters(spark, sf_dir):
    found = clusters.cluster_photos(bridge.photos(spark, sf_dir))
    return found.select("owner", "cluster", "n", r(F.col("lat")).alias("lat"), r(F.col("lon")).alias("lon"), "start_us", "end_us", F.col("photo_ids")[0].alias("first_photo"), F.array_join("photo_ids", ",").alias("photos"))


@query(
    with_("photos")
    + """ SELECT owner, count(*) FILTER (lat IS NOT NULL AND lon IS NOT NULL) AS placed,
    count(*) FILTER (lat IS NULL OR lon IS NULL) AS unallocated, coalesce(string_agg(photo_id::VARCHAR, ',' ORDER BY photo_id) FILTER (lat IS NULL OR lon IS NULL), '') AS rejects FROM photos GROUP BY owner"""
)
def clusters_with_rejects(spark, sf_dir):
    photos = bridge.photos(spark, sf_dir)
    kept = clusters.label_photos(photos).select("owner", "photo_id", F.lit(1).alias("ok"))
    rest = clusters.unplaced(photos).select("owner", "photo_id", F.lit(0).alias("ok"))
    both = kept.unionByName(rest).groupBy("owner")
    rejects = F.array_join(F.array_sort(F.collect_list(F.when(F.col("ok") == 0, F.col("photo_id")))), ",")
    return both.agg(F.sum("ok").alias("placed"), F.count_if(F.col("ok") == 0).alias("unallocated"), rejects.alias("rejects"))


_MERGE = f"""
, stops0 AS (
    SELECT owner, cluster, count(*) AS n, avg(lat) AS lat, avg(lon) AS lon, min(us) AS start_us, max(us) AS end_us FROM folded GROUP BY owner, cluster
), wide AS (
    SELECT a.owner, max({km('a.lat', 'a.lon', 'b.lat', 'b.lon')}) AS wide FROM stops0 a JOIN stops0 b USING (owner) GROUP BY a.owner
), steps AS (
    SELECT owner, list_sort(list({km('lat', 'lon', 'lat2', 'lon2')})) AS ds
    FROM (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM stops0 WINDOW w AS (PARTITION BY owner ORDER BY cluster))
    WHERE lat2 IS NOT NULL GROUP BY owner
), reach AS (
    SELECT owner, CASE WHEN wide <= 5 THEN 5.0 ELSE greatest(1.0, least(5.0, ds[(len(ds) // 2)::INT + 1] * 0.6)) END AS merge_km
    FROM wide LEFT JOIN steps USING (owner)
), merged AS (
    SELECT owner, cluster, 0 AS place, n AS m, lat * n AS s_lat, lon * n AS s_lon, n, start_us, end_us FROM stops0 WHERE cluster = 0
    UNION ALL
    SELECT o.owner, o.cluster, g.place + (NOT joins)::INT, CASE WHEN joins THEN g.m + o.n ELSE o.n END,
           CASE WHEN joins THEN g.s_lat + o.lat * o.n ELSE o.lat * o.n END, CASE WHEN joins THEN g.s_lon + o.lon * o.n ELSE o.lon * o.n END,
           o.n, o.start_us, o.end_us
    FROM merged g JOIN stops0 o ON o.owner = g.owner AND o.cluster = g.cluster + 1 JOIN reach ON reach.owner = o.owner,
    LATERAL (SELECT {km('g.s_lat / g.m', 'g.s_lon / g.m', 'o.lat', 'o.lon')} <= reach.merge_km AS joins) AS x
)"""


@query(
    with_("photos") + _FOLD + _MERGE + " SELECT owner, place, sum(n)::BIGINT AS n, count(*) AS merged, min(start_us) AS start_us, max(end_us) AS end_us FROM merged GROUP BY owner, place"
)
def cluster_merge(spark, sf_dir):
    merged = clusters.merge_clusters(clusters.cluster_photos(bridge.photos(spark, sf_dir)))
    return merged.select("owner", "place", "n", "merged", "start_us", "end_us")


@query(
    with_("photos")
    + _FOLD
    + _MERGE
    + """, days AS (SELECT *, row_number() OVER (PARTITION BY owner, place ORDER BY cluster) AS day, count(*) OVER (PARTITION BY owner, place) AS k FROM merged)
    SELECT owner, place, day::INT AS day, coalesce(strftime(make_timestamp(start_us), '%Y-%m-%d'), '') AS date, n AS photos FROM days WHERE k > 1"""
)
def cluster_days(spark, sf_dir):
    merged = clusters.merge_clusters(clusters.cluster_photos(bridge.photos(spark, sf_dir)))
    return clusters.split_days(merged).select("owner", "place", "day", "date", F.size("photo_ids").cast("long").alias("photos"))


@query(
    with_("photos")
    + """, cuts AS (
        SELECT owner, us, coalesce(sum((us - prev > 50400000000)::INT) OVER (PARTITION BY owner ORDER BY us, photo_id), 0) AS session
        FROM (SELECT *, lag(us) OVER (PARTITION BY owner ORDER BY us, photo_id) AS prev FROM photos WHERE us IS NOT NULL))
    SELECT owner, session::INT AS session, count(*) AS n, min(us) AS start_us, max(us) AS end_us FROM cuts GROUP BY owner, session"""
)
def photo_sessions(spark, sf_dir):
    return clusters.sessions(bridge.photos(spark, sf_dir))


_GROUPS = f"""
, placed AS (SELECT trip, seq, name, lat, lon FROM stops WHERE lat IS NOT NULL),
near AS (
    SELECT b.trip, b.seq, a.seq AS other FROM placed a JOIN placed b ON a.trip = b.trip AND a.seq < b.seq
    WHERE {km('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 1.0
), ordered AS (
    SELECT trip, seq, row_number() OVER (PARTITION BY trip ORDER BY seq) AS i FROM placed
), near_lists AS (
    SELECT o.trip, o.seq, o.i, coalesce(list_sort(list(n.other) FILTER (n.other IS NOT NULL)), []) AS others
    FROM ordered o LEFT JOIN near n USING (trip, seq) GROUP BY o.trip, o.seq, o.i
), walk AS (
    SELECT trip, i, seq, seq AS anchor, [seq] AS anchors FROM near_lists WHERE i = 1
    UNION ALL
    SELECT l.trip, l.i, l.seq, coalesce(hit, l.seq), CASE WHEN hit IS NULL THEN list_append(w.anchors, l.seq) ELSE w.anchors END
    FROM walk w JOIN near_lists l ON l.trip = w.trip AND l.i = w.i + 1,
    LATERAL (SELECT list_filter(w.anchors, lambda a: list_contains(l.others, a))[1] AS hit) AS x
), counted AS (
    SELECT trip, anchor, count(*) AS visits FROM walk GROUP BY trip, anchor HAVING count(*) >= 3
), hubs AS (
    SELECT trip, anchor, visits, row_number() OVER (PARTITION BY trip ORDER BY visits DESC, anchor) = 1 AS is_primary FROM counted
)"""


@query(with_("stops") + _GROUPS + " SELECT trip, anchor, visits, is_primary FROM hubs")
def trip_hubs(spark, sf_dir):
    groups = hubs.proximity_groups(bridge.stops(spark, sf_dir))
    return hubs.detect_hubs(groups).select("trip", "anchor", "visits", "is_primary")


@query(with_("stops") + _GROUPS + " SELECT trip, seq, CASE WHEN visits IS NOT NULL THEN anchor END AS hub FROM walk LEFT JOIN hubs USING (trip, anchor)")
def stop_hubs(spark, sf_dir):
    groups = hubs.proximity_groups(bridge.stops(spark, sf_dir))
    return hubs.hub_of_stop(groups, hubs.detect_hubs(groups))


@query(
    with_("stops")
    + _GROUPS
    + """, marked AS (
        SELECT s.trip, s.seq, trim(s.name) AS name, h.anchor IS NOT NULL AS base
        FROM stops s LEFT JOIN walk w USING (trip, seq) LEFT JOIN hubs h ON h.trip = s.trip AND h.anchor = w.anchor AND h.is_primary
    ), runs AS (
        SELECT *, sum(base::INT) OVER (PARTITION BY trip ORDER BY seq) AS run, sum(base::INT) OVER (PARTITION BY trip) AS visits FROM marked
    ), away AS (
        SELECT trip, run, min(seq) AS start_seq, max(seq) + 1 AS end_seq, count(*) FILTER (NOT base) AS spokes, list(name ORDER BY seq) FILTER (NOT base) AS names
        FROM runs WHERE run > 0 AND run < visits GROUP BY trip, run HAVING count(*) FILTER (NOT base) > 0
    )
    SELECT trip, start_seq, end_seq, spokes::INT AS spokes,
           CASE WHEN spokes = 1 THEN 'to ' || names[1] || ' & back'
                WHEN spokes = 2 THEN 'to ' || names[1] || ' & ' || names[2] || ' & back'
                ELSE 'to ' || names[1] || ', ' || names[2] || ' & ' || (spokes - 2) || ' more & back' END AS label
    FROM away"""
)
def day_trips(spark, sf_dir):
    return hubs.day_trips(bridge.stops(spark, sf_dir))


# ---------------------------------------------------------------- legs and geometry

_LEGS = """
, paired AS (
    SELECT trip, seq AS leg, name AS from_name, lead(name) OVER w AS to_name, lat AS from_lat, lon AS from_lon,
           lead(lat) OVER w AS to_lat, lead(lon) OVER w AS to_lon, vehicle
    FROM stops WINDOW w AS (PARTITION BY trip ORDER BY seq)
), legs AS (SELECT * FROM paired WHERE from_lat IS NOT NULL AND to_lat IS NOT NULL)"""
_LEG_KM = km("from_lat", "from_lon", "to_lat", "to_lon")


@query(with_("stops") + _LEGS + f" SELECT trip, leg, from_name, to_name, vehicle, {half_up(_LEG_KM, 3)} AS km FROM legs")
def legs_from_stops(spark, sf_dir):
    found = legs.legs_of(bridge.stops(spark, sf_dir))
    return found.select("trip", "leg", "from_name", "to_name", "vehicle", r(legs.leg_km(), 3).alias("km"))


@query(with_("stops") + """ SELECT c.trip, c.seq, c.name, l.vehicle FROM stops c LEFT JOIN (SELECT trip, seq, vehicle FROM stops WHERE stop % 5 <> 1) l USING (trip, seq)""")
def zip_legs(spark, sf_dir):
    stops = bridge.stops(spark, sf_dir)
    return legs.zip_legs(stops.select("trip", "seq", "name"), stops.filter("stop % 5 <> 1").select("trip", "seq", "vehicle"))


@query(with_("stops") + _LEGS + f" SELECT trip, count(*) AS legs, floor(sum({_LEG_KM}) + 0.5)::BIGINT AS km FROM legs GROUP BY trip")
def trip_length_rollup(spark, sf_dir):
    return legs.trip_lengths(legs.legs_of(bridge.stops(spark, sf_dir)))


@query(with_("stops") + _LEGS + f" SELECT trip, leg, {half_up(f'sum({_LEG_KM}) OVER (PARTITION BY trip ORDER BY leg)', 3)} AS km_so_far FROM legs")
def leg_running_km(spark, sf_dir):
    found = legs.running_km(legs.legs_of(bridge.stops(spark, sf_dir)))
    return found.select("trip", "leg", r(F.col("km_so_far"), 3).alias("km_so_far"))


@query(with_("places") + f""" SELECT idx, {half_up('(lon + 180) / 360', 6)} AS x,
    {half_up('0.5 - ln(tan(radians(greatest(-85.0511, least(85.0511, lat))) / 2 + pi() / 4)) / (2 * pi())', 6)} AS y FROM places""")  # fmt: skip
def mercator_xy(spark, sf_dir):
    return bridge.places(spark, sf_dir).select("idx", r(geo.mercator_x(F.col("lon"))).alias("x"), r(geo.mercator_y(F.col("lat"))).alias("y"))


_BOX = """
, raw AS (SELECT trip, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM stops WHERE lat IS NOT NULL GROUP BY trip),
boxes AS (
    SELECT trip, w - greatest(e - w, 0.5) * 0.2 AS w, s - greatest(n - s, 0.5) * 0.2 AS s, e + greatest(e - w, 0.5) * 0.2 AS e, n + greatest(n - s, 0.5) * 0.2 AS n
    FROM raw
)"""


@query(with_("stops") + _BOX + f""" SELECT trip, {half_up('w')} AS w, {half_up('s', 6)} AS s, {half_up('e', 6)} AS e, {half_up('n', 6)} AS n,
    w < e AND s < n AND w >= -180 AND e <= 180 AND s >= -90 AND n <= 90 AS valid,
    {half_up('least(log2(1280 / (256 * ((e - w) / 360))), log2(720 / (256 * ((n - s) / 360) / cos(radians((s + n) / 2)))))', 6)} AS zoom,
    {half_up('least(n, greatest(s, 36.5))', 6)} AS centre_lat, {half_up('least(e, greatest(w, 33.0))', 6)} AS centre_lon FROM boxes""")  # fmt: skip
def bbox_fit(spark, sf_dir):
    box = legs.trip_box(bridge.stops(spark, sf_dir))
    w, s, e, n = (F.col(c) for c in "wsen")
    return box.select(
        "trip", r(w, 0).alias("w"), r(s).alias("s"), r(e).alias("e"), r(n).alias("n"), geo.box_is_valid(w, s, e, n).alias("valid"),
        r(geo.fit_zoom(w, s, e, n, 1280, 720)).alias("zoom"), r(geo.clamp(F.lit(36.5), s, n)).alias("centre_lat"), r(geo.clamp(F.lit(33.0), w, e)).alias("centre_lon"),
    )


_PATHS = """
, paths AS (
    SELECT l_orderkey AS leg, list((l_partkey * 37 % 3600) / 10::DOUBLE - 180 ORDER BY l_linenumber, l_partkey) AS lons, count(*) AS n
    FROM lineitem GROUP BY l_orderkey
), hinted AS (
    SELECT *, CASE leg % 4 WHEN 0 THEN 'east' WHEN 1 THEN 'West' WHEN 2 THEN 'north' END AS hint, (leg * 13 % 720 - 360)::DOUBLE AS degrees FROM paths
), signed AS (
    SELECT *, CASE WHEN lower(hint) = 'east' THEN 1 WHEN lower(hint) = 'west' THEN -1 WHEN hint IS NOT NULL THEN 0
        WHEN degrees - 360 * floor(degrees / 360) > 0 AND degrees - 360 * floor(degrees / 360) < 180 THEN 1
        WHEN degrees - 360 * floor(degrees / 360) > 180 THEN -1 ELSE 0 END AS sign FROM hinted
), unwrapped AS (
    SELECT leg, sign, lons, n, 1 AS i, lons[1] AS lon, 0.0::DOUBLE AS jump FROM signed
    UNION ALL
    SELECT leg, sign, lons, n, i + 1, dest, abs(dest - lon) FROM unwrapped, LATERAL (SELECT lons[i + 1] AS raw) AS x, LATERAL (SELECT
        CASE WHEN sign = 1 THEN raw + 360 * CASE WHEN raw <= lon THEN floor((lon - raw) / 360) + 1 ELSE 0 END
             WHEN sign = -1 THEN raw - 360 * CASE WHEN raw >= lon THEN floor((raw - lon) / 360) + 1 ELSE 0 END
             WHEN raw - lon > 180 THEN raw - 360 WHEN raw - lon < -180 THEN raw + 360 ELSE raw END AS dest) AS y
    WHERE i < n
)"""


@query("WITH RECURSIVE " + _PATHS[2:].lstrip() + f" SELECT leg, {half_up('max_by(lon, i)', 6)} AS last_lon, {half_up('max(jump)', 6)} AS max_jump FROM unwrapped GROUP BY leg")
def unwrap_lon(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("k"))
    lon = lambda k: (k["l_partkey"] * 37 % 3600) / F.lit(10.0) - 180
    paths = rows.groupBy(F.col("l_orderkey").alias("leg")).agg(F.transform(F.array_sort(F.collect_list("k")), lon).alias("lons"))
    hint = F.when(F.col("leg") % 4 == 0, "east").when(F.col("leg") % 4 == 1, "West").when(F.col("leg") % 4 == 2, "north")
    sign = geo.bearing_sign(hint, (F.col("leg") * 13 % 720 - 360).cast("double"))
    path = paths.withColumn("sign", sign).withColumn("path", geo.unwrapped_path(F.col("lons"), F.col("sign")))
    jumps = F.zip_with(F.slice("path", 1, F.size("path") - 1), F.slice("path", 2, F.size("path")), lambda a, b: F.abs(b - a))
    return path.select("leg", r(F.element_at("path", -1)).alias("last_lon"), r(F.coalesce(F.array_max(jumps), F.lit(0.0))).alias("max_jump"))


@query(
    """SELECT l_orderkey AS item, l_linenumber AS line, """
    + ", ".join(
        f"{half_up(curve, 6)} AS {name}"
        for name, curve in {
            "linear": "t", "in_cubic": "t * t * t", "out_cubic": "1 - (1 - t) * (1 - t) * (1 - t)",
            "in_out_quad": "CASE WHEN t < 0.5 THEN 2 * t * t ELSE 1 - (2 - 2 * t) * (2 - 2 * t) / 2 END",
            "in_out_cubic": "CASE WHEN t < 0.5 THEN 4 * t * t * t ELSE 1 - (2 - 2 * t) * (2 - 2 * t) * (2 - 2 * t) / 2 END",
        }.items()
    )
    + """, CASE WHEN reduced THEN greatest(400, floor(ms * 0.5 + 0.5)) ELSE floor(ms + 0.5) END::BIGINT AS ms
    FROM (SELECT *, greatest(0.0, least(1.0, l_quantity / 40 - 0.1)) AS t, l_linenumber % 2 = 0 AS reduced,
                 greatest(1600.0::DOUBLE, least(6000.0::DOUBLE, greatest(trunc(l_extendedprice / 50)::INT, 0) / 0.15::DOUBLE)) AS ms FROM lineitem)"""
)
def ease_curves(spark, sf_dir):
    t = F.col("l_quantity") / 40 - 0.1
    names = {"linear": "linear", "in_cubic": "easeInCubic", "out_cubic": "easeOutCubic", "in_out_quad": "easeInOutQuad", "in_out_cubic": "no such curve"}
    return _read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("item"),
        F.col("l_linenumber").alias("line"),
        *[r(geo.ease(curve, t)).alias(name) for name, curve in names.items()],
        geo.leg_duration_ms(F.col("l_extendedprice") / 50, F.col("l_linenumber") % 2 == 0).alias("ms"),
    )


@query(
    with_("places")
    + f""", zoomed AS (SELECT *, (idx % 130) / 10::DOUBLE AS zoom FROM places)
    SELECT idx, {half_up('CASE WHEN pop > 0 THEN least(1.0, ln(greatest(pop, 30.0)) / ln(11000)) ELSE 0 END', 6)} AS score,
           CASE WHEN zoom < 3 THEN 30 WHEN zoom < 5 THEN 100 WHEN zoom < 7 THEN 300 WHEN zoom < 9 THEN 800 ELSE 9999 END AS cap,
           {half_up('greatest(0.85, least(1.7, 0.85 * pow(greatest(zoom, 4.0) / 4, 0.66)))', 6)} AS furniture,
           {half_up('0.7 + 1.8 * ((greatest(2.0, least(11.0, zoom)) - 2) / 9)', 6)} AS scale,
           CASE WHEN idx % 3 = 0 THEN 0.0 ELSE zoom END AS heading
    FROM zoomed"""
)
def place_scores(spark, sf_dir):
    zoom = (F.col("idx") % 130) / F.lit(10.0)
    vehicle = F.when(F.col("idx") % 3 == 0, "balloon").otherwise("car")
    return bridge.places(spark, sf_dir).select(
        "idx", r(geo.score_population(F.col("pop"))).alias("score"), geo.cap_for_zoom(zoom).alias("cap"), r(geo.furniture_scale(zoom)).alias("furniture"),
        r(geo.zoom_scale(zoom)).alias("scale"), geo.orientation(vehicle, zoom).alias("heading"),
    )


# ---------------------------------------------------------------- dates

_DAY = "CASE WHEN regexp_full_match(trim({0}), '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(trim({0}) AS DATE) END"
_MONTHS = "([" + ", ".join(f"'{m}'" for m in dates.MONTHS) + "])[month({0})]"


def _stay_sql() -> str:
    long, short = (lambda d: _MONTHS.format(d)), (lambda d: f"{_MONTHS.format(d)}[1:3]")
    tail = "CASE WHEN d - a = 1 THEN ' · 1 night' WHEN d - a > 1 THEN ' · ' || (d - a) || ' nights' ELSE '' END"
    return f"""CASE WHEN a IS NULL AND d IS NULL THEN '' WHEN d IS NULL THEN 'Arrived ' || day(a) || ' ' || {long('a')} || ' ' || year(a)
        WHEN a IS NULL THEN 'Departed ' || day(d) || ' ' || {long('d')} || ' ' || year(d)
        WHEN a = d THEN day(a) || ' ' || {long('a')} || ' ' || year(a)
        WHEN year(a) = year(d) AND month(a) = month(d) THEN day(a) || '–' || day(d) || ' ' || {long('d')} || ' ' || year(d) || {tail}
        WHEN year(a) = year(d) THEN day(a) || ' ' || {short('a')} || ' – ' || day(d) || ' ' || {short('d')} || ' ' || year(d) || {tail}
        ELSE day(a) || ' ' || {short('a')} || ' ' || year(a) || ' – ' || day(d) || ' ' || {short('d')} || ' ' || year(d) || {tail} END"""


_DATED = f"""
, dated AS (SELECT trip, seq, {_DAY.format('arrive')} AS a, {_DAY.format('depart')} AS d FROM stops)"""


@query(with_("stops") + _DATED + f" SELECT trip, seq, CASE WHEN d >= a THEN (d - a)::INT END AS nights, {_stay_sql()} AS line FROM dated")
def stay_lines(spark, sf_dir):
    a, d = dates.parse_day(F.col("arrive")), dates.parse_day(F.col("depart"))
    stops = bridge.stops(spark, sf_dir).select("trip", "seq", a.alias("a"), d.alias("d"))
    return stops.select("trip", "seq", dates.nights(F.col("a"), F.col("d")).alias("nights"), dates.stay_line(F.col("a"), F.col("d")).alias("line"))


@query(
    with_("stops")
    + _DATED
    + f""", ranges AS (SELECT trip, least(min(a), min(d)) AS s, greatest(max(a), max(d)) AS e FROM dated GROUP BY trip)
    SELECT trip, strftime(s, '%Y-%m-%d') AS first_day, strftime(e, '%Y-%m-%d') AS last_day,
        CASE WHEN s IS NULL THEN '' WHEN year(s) <> year(e) THEN upper({_MONTHS.format('s')}) || ' ' || year(s) || ' — ' || upper({_MONTHS.format('e')}) || ' ' || year(e)
             WHEN month(s) <> month(e) THEN upper({_MONTHS.format('s')}) || ' — ' || upper({_MONTHS.format('e')}) || ' · ' || year(s)
             ELSE upper({_MONTHS.format('s')}) || ' · ' || year(s) END AS plate
    FROM ranges WHERE s IS NOT NULL"""
)
def trip_date_range(spark, sf_dir):
    a, d = dates.parse_day(F.col("arrive")), dates.parse_day(F.col("depart"))
    first, last = F.min(F.least(a, d)), F.max(F.greatest(a, d))
    ranges = bridge.stops(spark, sf_dir).groupBy("trip").agg(first.alias("s"), last.alias("e")).filter("s IS NOT NULL")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return ranges.select("trip", day("s").alias("first_day"), day("e").alias("last_day"), dates.range_plate(F.col("s"), F.col("e")).alias("plate"))


@query(
    """WITH said AS (SELECT event_id, CASE WHEN event_id % 10 = 3 THEN 'bad' ELSE
        lpad((2000 + event_id % 30)::VARCHAR, 4, '0') || ':' || lpad((1 + event_id % 12)::VARCHAR, 2, '0') || ':' || lpad((1 + event_id % 31)::VARCHAR, 2, '0')
        || ' ' || lpad((event_id % 24)::VARCHAR, 2, '0') || ':10:' || lpad((event_id % 60)::VARCHAR, 2, '0') END AS text FROM events)
    SELECT event_id, CASE WHEN text <> 'bad' THEN epoch_us(make_timestamp(text[1:4]::INT, text[6:7]::INT, 1, 0, 0, 0.0)
        + to_days((text[9:10]::INT - 1)) + to_seconds(text[12:13]::INT * 3600 + text[15:16]::INT * 60 + text[18:19]::INT)) END AS us FROM said"""
)
def exif_dates(spark, sf_dir):
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    e = F.col("event_id")
    said = F.concat((2000 + e % 30).cast("string"), F.lit(":"), two(1 + e % 12), F.lit(":"), two(1 + e % 31), F.lit(" "), two(e % 24), F.lit(":10:"), two(e % 60))
    said = F.when(e % 10 == 3, "bad").otherwise(said)
    rows = _read(spark, sf_dir, "events").select("event_id", said.alias("said"))
    return rows.select("event_id", dates.micros_of(dates.exif_time(F.col("said"))).alias("us"))


# ---------------------------------------------------------------- text


@query(
    r"""WITH folded AS (SELECT doc_id, lower(strip_accents(text)) AS t FROM documents)
    SELECT doc_id, md5(trim(replace(replace(replace(replace(replace(t, 'ı', 'i'), 'ş', 's'), 'ğ', 'g'), 'ø', 'o'), 'ß', 'ss'), ' ')) AS folded FROM folded"""
)
def fold_names(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(text.fold(F.col("text"))).alias("folded"))


@query(
    r"""SELECT p_partkey AS item, (strip_accents(lower(said)) <> '') AND (p_size = 7 OR regexp_matches(strip_accents(lower(said)),
        'airport|aeroport|havalimani|havalimanı|flughafen|aeropuerto|aeroporto|heathrow|gatwick|stansted|luton|larnaca|paphos|ercan|bodrum|milas|dalaman|antalya|diagoras|\([a-z]{3}\)\s*$'))
        AS airport FROM (SELECT *, CASE p_size % 6 WHEN 0 THEN p_name || ' Aéroport' WHEN 1 THEN p_name || ' (LCA) ' WHEN 2 THEN '' WHEN 3 THEN 'Bodrum' ELSE p_name END AS said FROM part)"""
)
def airport_flag(spark, sf_dir):
    n = F.col("p_size") % 6
    said = F.when(n == 0, F.concat("p_name", F.lit(" Aéroport"))).when(n == 1, F.concat("p_name", F.lit(" (LCA) "))).when(n == 2, "").when(n == 3, "Bodrum").otherwise(F.col("p_name"))
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), text.is_airport(said, F.col("p_size") == 7).alias("airport"))


@query(
    r"""WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS w FROM documents),
    c AS (SELECT *, w[1:220] AS c0, regexp_replace(w[1:220], '(?s) [^ ]*$', '') AS c1 FROM t),
    d AS (SELECT *, CASE WHEN position(' ' IN c0) > 1 AND c1 <> '' THEN c1 ELSE c0 END AS cut FROM c),
    e AS (SELECT *, regexp_extract(cut, '(?s)^(.*[.!?]["''”’)\]]?)(?:\s|$)', 1) AS ends FROM d)
    SELECT doc_id, CASE WHEN length(w) <= 220 THEN w WHEN length(ends) >= 132 THEN regexp_replace(ends, '^\s+|\s+$', '', 'g')
        ELSE regexp_replace(cut, '[\s.,;:—-]+$', '') || '…' END AS intro FROM e"""
)
def intro_clamp(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", text.clamp_intro(F.col("text")).alias("intro"))


_ESCAPED = """replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')"""


@query(f"""SELECT page_id, md5({_ESCAPED.format('html')}) AS escaped,
    md5(replace(replace(regexp_replace(html, '</(script)', '\\\\u003c/\\1', 'gi'), '<!--', '\\u003c!--'), '-->', '--\\u003e')) AS embedded FROM pages""")  # fmt: skip
def html_escape(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", F.md5(text.escape_html(F.col("html"))).alias("escaped"), F.md5(text.script_safe(F.col("html"))).alias("embedded"))


_NAMES = "list_filter(list_transform(names, lambda x: trim(x)), lambda x: x <> '')"


@query(
    f"""WITH said AS (SELECT conv_id, list(role || ' ' || turn % 3 ORDER BY turn) AS all_names FROM conversations GROUP BY conv_id),
    cut AS (SELECT conv_id, list_concat(all_names[1:(conv_id % 5)::INT], ['  ']) AS names FROM said),
    clean AS (SELECT conv_id, {_NAMES} AS n FROM cut),
    joined AS (SELECT conv_id, CASE len(n) WHEN 0 THEN '' WHEN 1 THEN n[1] ELSE array_to_string(n[1:len(n) - 1], ', ') || ' & ' || n[len(n)] END AS j FROM clean)
    SELECT conv_id, CASE WHEN j = '' THEN '' ELSE '— ' || j END AS credit, CASE WHEN j = '' THEN '' ELSE 'with ' || j END AS present FROM joined"""
)
def credit_line(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    names = F.transform("t", lambda x: F.concat_ws(" ", x["role"], x["turn"] % 3))
    names = F.concat(F.slice(names, 1, (F.col("conv_id") % 5).cast("int")), F.array(F.lit("  ")))
    rows = rows.select("conv_id", text.clean_names(names).alias("n"))
    return rows.select("conv_id", text.credit_line(F.col("n")).alias("credit"), text.present_tag(F.col("n")).alias("present"))


def _people(spark, sf_dir):
    """Stops with own names on some, and trips with companions on some."""
    stops = bridge.stops(spark, sf_dir)
    own = F.when(F.col("stop") % 3 == 0, F.array(F.concat(F.lit(" P"), F.col("stop") % 5), F.lit(" "))).otherwise(F.array(F.lit("")))
    rows = stops.withColumns({"present": own, "photos": (F.col("stop") % 4).cast("int"), "note": F.when(F.col("stop") % 5 == 0, " n ").otherwise("")})
    companions = F.when(F.col("trip") % 2 == 0, F.array(F.lit("Ada"), F.concat(F.lit("C"), F.col("trip") % 7)))
    return rows, stops.select("trip").distinct().withColumn("companions", companions)


@query(
    with_("stops")
    + """ SELECT trip, seq, CASE WHEN stop % 3 = 0 THEN 'P' || stop % 5 WHEN trip % 2 = 0 THEN 'Ada,C' || trip % 7 ELSE '' END AS names,
    CASE WHEN stop % 3 = 0 THEN 'stop' WHEN trip % 2 = 0 THEN 'trip' END AS source FROM stops"""
)
def present_cascade(spark, sf_dir):
    stops, own = _people(spark, sf_dir)
    return trips.present(stops, own).select("trip", "seq", F.array_join("names", ",").alias("names"), "source")


def _privacy_sql(tier: str) -> str:
    notes = "0" if tier == "public" else "count(*) FILTER (stop % 5 = 0)"
    place = "Approximate locations" if tier == "public" else "Coordinates"
    return (
        with_("stops")
        + f""", counted AS (SELECT trip, sum(stop % 4)::BIGINT AS photos, {notes} AS notes,
            count(*) FILTER (coalesce(arrive, '') <> '' OR coalesce(depart, '') <> '') AS dates, max(CASE WHEN trip % 2 = 0 THEN 2 ELSE 0 END) AS people, count(*) AS n FROM stops GROUP BY trip),
        items AS (SELECT trip, unnest([{{'place': 0, 'label': 'Photographs', 'n': photos}}, {{'place': 1, 'label': 'Journal notes', 'n': notes}}, {{'place': 2, 'label': 'Travel dates', 'n': dates}},
            {{'place': 3, 'label': 'Companions', 'n': people}}, {{'place': 4, 'label': '{place}', 'n': n}}]) AS x FROM counted)
        SELECT trip, x.place::INT AS place, x.label AS label, x.n::BIGINT AS count FROM items WHERE x.n > 0"""
    )


@query(_privacy_sql("private"))
def privacy_manifest(spark, sf_dir):
    return trips.privacy_manifest(*_people(spark, sf_dir), tier="private")


@query(_privacy_sql("public"))
def privacy_manifest_public(spark, sf_dir):
    return trips.privacy_manifest(*_people(spark, sf_dir), tier="public")


@query(
    _privacy_sql("private").replace("SELECT trip, x.place::INT AS place, x.label AS label, x.n::BIGINT AS count FROM items WHERE x.n > 0", "SELECT trip, '<ul class=\"manifest\">' || string_agg("
    "'<li class=\"manifest-row\"><span class=\"manifest-label\">' || x.label || '</span><span class=\"manifest-count\">' || x.n || '</span></li>', '' ORDER BY x.place) || '</ul>' AS html FROM items WHERE x.n > 0 GROUP BY trip")
)
def manifest_html(spark, sf_dir):
    rows = trips.privacy_manifest(*_people(spark, sf_dir), tier="private")
    items = rows.groupBy("trip").agg(F.array_sort(F.collect_list(F.struct("place", "label", "count"))).alias("items"))
    return items.select("trip", text.manifest_list(F.col("items")).alias("html"))


# ---------------------------------------------------------------- eras, themes, vehicles


@query(with_("years", "eras") + " SELECT item, year, era, coalesce(year >= start_year AND year < end_year, false) AS covered FROM years LEFT JOIN eras ON year >= start_year AND year < end_year")
def era_for_year(spark, sf_dir):
    eras = dims.eras(spark).select("era", "start_year", "end_year")
    hit = (F.col("year") >= F.col("start_year")) & (F.col("year") < F.col("end_year"))
    joined = bridge.years(spark, sf_dir).join(F.broadcast(eras), hit, "left")
    return joined.select("item", "year", "era", F.col("era").isNotNull().alias("covered"))


@query(
    with_("eras")
    + """, items AS (SELECT c_custkey AS item, CASE WHEN c_custkey % 11 = 10 THEN 'unknown' ELSE (SELECT era FROM eras WHERE ord = c_custkey % 11) END AS era FROM customer)
    SELECT item, i.era, coalesce(e.theme, 'parchment') AS default_theme, coalesce(mode, 'loose') AS mode, sea, land, air,
           floor((start_year + end_year) / 2.0 + 0.5)::BIGINT AS mid_year FROM items i LEFT JOIN eras e ON e.era = i.era"""
)
def era_lookup(spark, sf_dir):
    eras = dims.eras(spark)
    names = eras.select("ord", "era")
    items = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"), (F.col("c_custkey") % 11).cast("int").alias("ord"))
    items = items.join(F.broadcast(names), "ord", "left").select("item", F.coalesce("era", F.lit("unknown")).alias("era"))
    mid = F.floor((F.col("start_year") + F.col("end_year")) / 2 + 0.5)
    joined = items.join(F.broadcast(eras), "era", "left")
    theme = F.coalesce(F.col("themes")[0], F.lit(dims.DEFAULT_THEME))
    return joined.select("item", "era", theme.alias("default_theme"), F.coalesce("mode", F.lit("loose")).alias("mode"), "sea", "land", "air", mid.alias("mid_year"))


_VALUES = ", ".join(f"('{e[0]}', {i}, '{t}')" for e in dims.ERAS for i, t in enumerate(e[6]))
_THEMES = f"themes(era, place, theme) AS (VALUES {_VALUES})"


#: The era of each customer's trip: one of all, an unknown one, or none.
_TRIP_ERAS = "trip_eras AS (SELECT c_custkey AS item, ([" + ", ".join(f"'{e[0]}'" for e in dims.ERAS) + ", 'nowhere', NULL])[(c_custkey % 12)::INT + 1] AS era FROM customer)"


def _trip_eras(spark, sf_dir):
    eras = F.array(*[F.lit(e[0]) for e in dims.ERAS], F.lit("nowhere"), F.lit(None).cast("string"))
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"), F.element_at(eras, (F.col("c_custkey") % 12).cast("int") + 1).alias("era"))


@query(f"""WITH {_THEMES}, {_TRIP_ERAS}, universal(place, theme) AS (VALUES (100, 'parchment'), (101, 'meadow')),
    offered AS (SELECT era, theme, place FROM themes UNION ALL
        SELECT e.era, u.theme, u.place FROM (SELECT DISTINCT era FROM themes) e, universal u WHERE NOT EXISTS (SELECT 1 FROM themes t WHERE t.era = e.era AND t.theme = u.theme))
    SELECT item, era, theme, place FROM trip_eras JOIN offered USING (era)""")  # fmt: skip
def available_themes(spark, sf_dir):
    """The themes that each trip can have by its era."""
    rows = _trip_eras(spark, sf_dir)
    return rows.join(F.broadcast(trips.available_themes(rows)), "era").select("item", "era", "theme", "place")


_OFFERS = f"""{_THEMES}, offers AS (SELECT era, theme FROM themes UNION SELECT era, u FROM themes, (VALUES ('parchment'), ('meadow')) AS v(u))"""
_STORED = """stored AS (SELECT c_custkey AS item, (['classical', 'atlas', 'nowhere', NULL, 'modern'])[(c_custkey % 5)::INT + 1] AS era,
    (['meadow', 'atlas-cream', 'modern-topo', 'odd', NULL, 'classical-mosaic', ''])[(c_custkey % 7)::INT + 1] AS theme FROM customer)"""


def _stored(spark, sf_dir):
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (F.col("c_custkey") % len(values)).cast("int") + 1)
    return _read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("item"),
        pick(["classical", "atlas", "nowhere", None, "modern"], "era").alias("era"),
        pick(["meadow", "atlas-cream", "modern-topo", "odd", None, "classical-mosaic", ""], "theme").alias("theme"),
    )


@query(f"""WITH {_OFFERS}, {_STORED}, based AS (
        SELECT s.*, coalesce((SELECT any_value(era) FROM themes t WHERE t.era = s.era), (SELECT any_value(era) FROM themes t WHERE t.theme = s.theme), 'nineteen-thirties') AS boot_era FROM stored s)
    SELECT item, boot_era, CASE WHEN EXISTS (SELECT 1 FROM offers o WHERE o.era = boot_era AND o.theme = b.theme) THEN theme
        ELSE (SELECT any_value(theme) FROM themes t WHERE t.era = boot_era AND place = 0) END AS boot_theme FROM based b""")  # fmt: skip
def boot_state(spark, sf_dir):
    return trips.boot_state(_stored(spark, sf_dir)).select("item", "boot_era", "boot_theme")


@query(f"""WITH {_THEMES}, {_STORED}, based AS (
        SELECT item, coalesce(nullif(era, ''), (SELECT any_value(era) FROM themes t WHERE t.theme = s.theme), 'nineteen-thirties') AS era, theme FROM stored s)
    SELECT item, era, coalesce(nullif(theme, ''), (SELECT any_value(theme) FROM themes t WHERE t.era = b.era AND place = 0), 'parchment') AS theme FROM based b""")  # fmt: skip
def trip_defaults(spark, sf_dir):
    return trips.fill_defaults(_stored(spark, sf_dir))


def _choices(spark, sf_dir):
    era = F.element_at(F.array(*[F.lit(e[0]) for e in dims.ERAS], F.lit("nowhere")), (F.col("event_id") % 11).cast("int") + 1)
    themes = [e[6][-1] for e in dims.ERAS] + ["meadow"]
    theme = F.element_at(F.array(*map(F.lit, themes)), (F.col("event_id") * 7 % 11).cast("int") + 1)
    kind = F.when(F.col("event_id") % 3 == 0, "era").otherwise("theme")
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("ord"), kind.alias("kind"), F.when(kind == "era", era).otherwise(theme).alias("key"))


_ERA_LIST = ", ".join(f"'{e[0]}'" for e in dims.ERAS) + ", 'nowhere'"
_THEME_LIST = ", ".join(f"'{e[6][-1]}'" for e in dims.ERAS) + ", 'meadow'"


@query(f"""WITH RECURSIVE {_OFFERS}, choices AS (
        SELECT user_id AS owner, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_id % 3 = 0 AS is_era,
            CASE WHEN event_id % 3 = 0 THEN ([{_ERA_LIST}])[(event_id % 11)::INT + 1] ELSE ([{_THEME_LIST}])[(event_id * 7 % 11)::INT + 1] END AS key FROM events),
    known AS (SELECT era, list(theme) AS offered FROM offers GROUP BY era), firsts AS (SELECT era, theme FROM themes WHERE place = 0),
    full_choices AS (SELECT c.*, k.offered AS key_offers, f.theme AS key_default FROM choices c LEFT JOIN known k ON k.era = c.key LEFT JOIN firsts f ON f.era = c.key),
    walk AS (
        SELECT DISTINCT owner, 0::BIGINT AS i, 'nineteen-thirties' AS era, 'parchment' AS theme FROM choices
        UNION ALL
        SELECT c.owner, c.i, CASE WHEN c.is_era AND c.key_offers IS NOT NULL THEN c.key ELSE w.era END,
            CASE WHEN c.is_era AND c.key_offers IS NOT NULL THEN CASE WHEN list_contains(c.key_offers, w.theme) THEN w.theme ELSE c.key_default END
                 WHEN NOT c.is_era AND list_contains(k.offered, c.key) THEN c.key ELSE w.theme END
        FROM walk w JOIN full_choices c ON c.owner = w.owner AND c.i = w.i + 1 JOIN known k ON k.era = w.era)
    SELECT owner, max_by(era, i) AS era, max_by(theme, i) AS theme FROM walk GROUP BY owner""")  # fmt: skip
def picker_states(spark, sf_dir):
    return trips.select_states(_choices(spark, sf_dir))


_ERA_VEHICLES = "era_vehicles(era, vehicle) AS (VALUES " + ", ".join(f"('{e}', '{v}')" for e, names in dims.ERA_VEHICLES.items() for v in names) + ")"
_SINCE = "since(vehicle, y) AS (VALUES " + ", ".join(f"('{v}', {y})" for v, _, y in dims.VEHICLES if y) + ")"


@query(
    with_("years", "eras")
    + f""", {_ERA_VEHICLES}, {_SINCE}, dated AS (SELECT item, era, CASE WHEN item % 4 = 0 THEN floor((start_year + end_year) / 2.0 + 0.5) ELSE year END AS y
        FROM years JOIN eras ON year >= start_year AND year < end_year)
    SELECT item, count(*) AS vehicles, min(vehicle) AS first_vehicle FROM dated JOIN era_vehicles USING (era) LEFT JOIN since s USING (vehicle) WHERE s.y IS NULL OR dated.y >= s.y GROUP BY item"""
)
def vehicles_for_era(spark, sf_dir):
    eras = dims.eras(spark)
    hit = (F.col("year") >= F.col("start_year")) & (F.col("year") < F.col("end_year"))
    dated = bridge.years(spark, sf_dir).join(F.broadcast(eras), hit)
    mid = F.floor((F.col("start_year") + F.col("end_year")) / 2 + 0.5)
    dated = dated.select("item", "era", F.when(F.col("item") % 4 == 0, mid).otherwise(F.col("year")).alias("y"))
    allowed = dims.era_vehicles(spark).join(dims.vehicles(spark), "vehicle")
    joined = dated.join(F.broadcast(allowed), "era").filter("min_year IS NULL OR y >= min_year")
    return joined.groupBy("item").agg(F.count(F.lit(1)).alias("vehicles"), F.min("vehicle").alias("first_vehicle"))


_BOATS = ", ".join(f"'{v}'" for v in dims.BOATS)
_AIR = ", ".join(f"'{v}'" for v in dims.AIRCRAFT)
_MODALITY = f"CASE WHEN lower(trim(vehicle)) IN ({_AIR}) THEN 'air' WHEN lower(trim(vehicle)) IN ({_BOATS}) THEN 'boat' ELSE 'land' END"
_DRAWN = "drawn(vehicle, glyph) AS (VALUES " + ", ".join(f"('{v}', '{dims.UNDRAWN.get(g, g)}')" for v, g, _ in dims.VEHICLES) + ")"


@query(with_("stops") + f""", {_DRAWN} SELECT trip, seq, {_MODALITY} AS modality, coalesce(glyph, 'car') AS glyph FROM stops LEFT JOIN drawn USING (vehicle)""")
def vehicle_modality(spark, sf_dir):
    stops = bridge.stops(spark, sf_dir)
    drawn = dims.vehicles(spark).select("vehicle", "picker_glyph")
    joined = stops.join(F.broadcast(drawn), "vehicle", "left")
    return joined.select("trip", "seq", land.modality(F.col("vehicle")).alias("modality"), F.coalesce("picker_glyph", F.lit("car")).alias("glyph"))


@query(f"""WITH {_TRIP_ERAS} SELECT item, era, viewport, w, s FROM trip_eras LEFT JOIN (VALUES """ + ", ".join(f"('{e}', '{v}')" for e, v in dims.ERA_VIEWPORTS.items())
    + """) AS e(era, viewport) USING (era) LEFT JOIN (VALUES """ + ", ".join(f"('{v[0]}', {v[1]}::DOUBLE, {v[2]}::DOUBLE)" for v in dims.VIEWPORTS) + ") AS v(viewport, w, s) USING (viewport)")
def era_viewports(spark, sf_dir):
    """The view that each trip opens with by its era; none for eras without one."""
    views = dims.era_viewports(spark).join(F.broadcast(dims.viewports(spark)), "viewport").select("era", "viewport", "w", "s")
    return _trip_eras(spark, sf_dir).join(F.broadcast(views), "era", "left").select("item", "era", "viewport", "w", "s")


def _alias_rows(spark, sf_dir):
    """Names of nations by era: plain, bounded, or only modern."""
    n = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"), "n_name")
    eras = dims.eras(spark).select("ord", "era", "start_year", "end_year")
    rows = n.join(F.broadcast(eras), (F.col("place") + F.col("ord")) % 3 != 1)
    return rows.select(
        "place", "era", F.concat("n_name", F.lit(" "), "era").alias("name"),
        F.when(F.col("place") % 2 == 0, F.col("start_year") + 50).alias("from_year"), F.when(F.col("place") % 5 < 3, F.col("end_year") - 100).alias("to_year"),
    )


@query(
    with_("years", "eras")
    + """, names AS (SELECT n_nationkey AS place, era, n_name || ' ' || era AS name, CASE WHEN n_nationkey % 2 = 0 THEN start_year + 50 END AS from_year,
        CASE WHEN n_nationkey % 5 < 3 THEN end_year - 100 END AS to_year FROM nation, eras WHERE (n_nationkey + ord) % 3 <> 1),
    asked AS (SELECT item, item % 26 AS place, era, CASE WHEN item % 9 <> 0 THEN year END AS year FROM years JOIN eras ON year >= start_year AND year < end_year)
    SELECT item, coalesce(CASE WHEN a.year IS NULL OR (coalesce(a.year >= n.from_year, true) AND coalesce(a.year < n.to_year, true)) THEN n.name END, m.name) AS name
    FROM asked a LEFT JOIN names n ON n.place = a.place AND n.era = a.era LEFT JOIN names m ON m.place = a.place AND m.era = 'modern'"""
)
def alias_as_of(spark, sf_dir):
    names = _alias_rows(spark, sf_dir)
    eras = dims.eras(spark).select("era", "start_year", "end_year")
    hit = (F.col("year") >= F.col("start_year")) & (F.col("year") < F.col("end_year"))
    asked = bridge.years(spark, sf_dir).join(F.broadcast(eras), hit).select("item", (F.col("item") % 26).alias("place"), "era", F.when(F.col("item") % 9 != 0, F.col("year")).alias("year"))
    return readers.alias_as_of(asked.withColumnRenamed("item", "query"), names).withColumnRenamed("query", "item")


@query("""WITH said AS (SELECT p_partkey AS item, CASE p_size % 5 WHEN 0 THEN p_size * 30 || ' BCE' WHEN 1 THEN 'c. ' || (1000 + p_size) WHEN 2 THEN ' ' WHEN 3 THEN '-' || p_size END AS text,
        (p_partkey * 97 % 3800 - 1750)::INT AS start_year FROM part)
    SELECT item, CASE WHEN regexp_matches(text, '\\d') THEN CASE WHEN text ILIKE '%BCE%' THEN -abs(regexp_extract(text, '-?\\d+')::INT) ELSE regexp_extract(text, '-?\\d+')::INT END
        ELSE floor((start_year + start_year + 51) / 2.0 + 0.5)::INT END AS year FROM said""")  # fmt: skip
def era_years(spark, sf_dir):
    size = F.col("p_size")
    said = F.when(size % 5 == 0, F.concat((size * 30).cast("string"), F.lit(" BCE"))).when(size % 5 == 1, F.concat(F.lit("c. "), (1000 + size).cast("string")))
    said = said.when(size % 5 == 2, " ").when(size % 5 == 3, F.concat(F.lit("-"), size.cast("string")))
    start = (F.col("p_partkey") * 97 % 3800 - 1750).cast("int")
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), dates.era_year(said, start, start + 51).alias("year"))


@query("""WITH raw AS (SELECT event_id, (event_id % 401 - 200) / 2::DOUBLE AS lat, (event_id % 801 - 400) / 2::DOUBLE AS lon FROM events),
    ranged AS (SELECT event_id, CASE WHEN lat BETWEEN -90 AND 90 THEN lat END AS lat, CASE WHEN lon BETWEEN -180 AND 180 THEN lon END AS lon FROM raw)
    SELECT event_id, CASE WHEN NOT coalesce(lat = 0 AND lon = 0, false) THEN lat END AS lat, CASE WHEN NOT coalesce(lat = 0 AND lon = 0, false) THEN lon END AS lon FROM ranged""")  # fmt: skip
def sane_positions(spark, sf_dir):
    lat, lon = (F.col("event_id") % 401 - 200) / F.lit(2.0), (F.col("event_id") % 801 - 400) / F.lit(2.0)
    return _read(spark, sf_dir, "events").select("event_id", geo.sane_position(lat, lon).alias("p")).select("event_id", "p.*")


@query("""WITH old AS (SELECT o_custkey AS store, (o_custkey % 4)::INT AS v, list((['anatolia', 'adventure', 'modern', 'classical'])[(o_orderkey % 4)::INT + 1] ORDER BY o_orderkey) AS eras,
        list((['hc', 'anatolia-bronze', 'parchment'])[(o_orderkey % 3)::INT + 1] ORDER BY o_orderkey) AS themes FROM orders GROUP BY o_custkey),
    keyed AS (SELECT *, (['hc', 'scriptorium-tournament', 'meadow'])[(store % 3)::INT + 1] AS theme FROM old)
    SELECT store, CASE WHEN v < 2 THEN 2 ELSE v END AS version,
        CASE WHEN v < 2 AND theme = 'hc' THEN 'parchment' WHEN v = 0 AND theme = 'scriptorium-tournament' THEN 'high-medieval-tournament' ELSE theme END AS theme,
        v < 2 AND (theme = 'hc' OR list_contains(themes, 'hc')) AS high_contrast,
        array_to_string(list_transform(eras, lambda e: CASE WHEN v = 0 AND e = 'anatolia' THEN 'bronze-age' WHEN v = 0 AND e = 'adventure' THEN 'nineteen-thirties' ELSE e END), ',') AS eras,
        array_to_string(list_transform(themes, lambda t: CASE WHEN v < 2 AND t = 'hc' THEN 'nineteen-thirties-parchment' WHEN v = 0 AND t = 'anatolia-bronze' THEN 'bronze-age-bronze' ELSE t END), ',') AS themes
    FROM keyed""")  # fmt: skip
def schema_migrate(spark, sf_dir):
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values)).cast("int") + 1)
    key = F.col("o_orderkey")
    trip = F.struct(key.alias("k"), pick(["anatolia", "adventure", "modern", "classical"], key).alias("era"), pick(["hc", "anatolia-bronze", "parchment"], key).alias("theme"))
    old = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("store")).agg(F.array_sort(F.collect_list(trip)).alias("trips"))
    old = old.select(
        "store", F.when(F.col("store") % 4 != 0, (F.col("store") % 4).cast("int")).alias("version"), pick(["hc", "scriptorium-tournament", "meadow"], F.col("store")).alias("theme"),
        F.lit(None).cast("boolean").alias("high_contrast"), F.transform("trips", lambda t: F.struct(t["era"].alias("era"), t["theme"].alias("theme"))).alias("trips"),
    )
    new = trips.migrate_stores(old)
    said = lambda c: F.array_join(F.transform("trips", lambda t: t[c]), ",").alias(f"{c}s")
    return new.select("store", "version", "theme", "high_contrast", said("era"), said("theme"))


# ---------------------------------------------------------------- places


def _points(spark, sf_dir):
    return _read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("point"), F.expr("cast(p_partkey * 37 % 1300 AS double) / 10 - 60 + (p_partkey % 7) * 0.05D").alias("lat"),
        F.expr("cast(p_partkey * 101 % 3600 AS double) / 10 - 180 + (p_partkey % 5) * 0.05D").alias("lon"),
    )


_POINTS = """
, points AS (SELECT p_partkey AS point, (p_partkey * 37 % 1300)::DOUBLE / 10 - 60 + (p_partkey % 7) * 0.05::DOUBLE AS lat,
    (p_partkey * 101 % 3600)::DOUBLE / 10 - 180 + (p_partkey % 5) * 0.05::DOUBLE AS lon FROM part)"""


@query(
    with_("places")
    + _POINTS
    + f""", hits AS (SELECT point, idx, name, {km('p.lat', 'p.lon', 'q.lat', 'q.lon')} AS d FROM points p JOIN places q
        ON abs(p.lat - q.lat) <= 0.6 AND idx <> point WHERE {km('p.lat', 'p.lon', 'q.lat', 'q.lon')} <= 60),
    best AS (SELECT point, min_by(idx, (d, idx)) AS idx, min_by(name, (d, idx)) AS place, min(d) AS d FROM hits GROUP BY point)
    SELECT point, idx, place, {half_up('d', 3)} AS km FROM points LEFT JOIN best USING (point)"""
)
def nearest_place(spark, sf_dir):
    found = places.nearest_within(_points(spark, sf_dir), bridge.places(spark, sf_dir), 60.0, same="point")
    return found.select("point", "idx", "place", r(F.col("km"), 3).alias("km"))


@query(
    with_("places")
    + """, asked AS (SELECT o_orderkey AS query, 'CUSTOMER#' || lpad((o_custkey % 500)::VARCHAR, 9, '0') AS name, (o_custkey % 500 * 37 % 1300)::DOUBLE / 10 - 60 + (o_orderkey % 9) * 0.02::DOUBLE AS lat,
        (o_custkey % 500 * 101 % 3600)::DOUBLE / 10 - 180 AS lon FROM orders),
    hits AS (SELECT query, idx, abs(p.lat - a.lat) + abs(p.lon - a.lon) AS d FROM asked a JOIN places p ON lower(p.name) = lower(a.name)),
    best AS (SELECT query, min_by(idx, (d, idx)) AS idx FROM hits WHERE d < 0.1 GROUP BY query)
    SELECT query, idx FROM asked LEFT JOIN best USING (query)"""
)
def reverse_lookup(spark, sf_dir):
    key = F.col("o_custkey") % 500
    asked = _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("query"), F.concat(F.lit("CUSTOMER#"), F.lpad(key.cast("string"), 9, "0")).alias("name"),
        ((key * 37 % 1300).cast("double") / 10 - 60 + (F.col("o_orderkey") % 9) * F.lit(0.02)).alias("lat"), ((key * 101 % 3600).cast("double") / 10 - 180).alias("lon"),
    )
    return places.reverse_lookup(asked, bridge.places(spark, sf_dir))


_BATCH = """
, batch AS (SELECT s_suppkey AS ord, 'customer#' || lpad((s_suppkey % 40)::VARCHAR, 9, '0') AS key, (s_suppkey % 40 * 37 % 1300)::DOUBLE / 10 - 60 + (s_suppkey % 7) * 0.02::DOUBLE AS lat,
    (s_suppkey % 40 * 101 % 3600)::DOUBLE / 10 - 180 AS lon FROM supplier)
, old AS (SELECT ord, min(idx) AS idx FROM batch b JOIN places p ON lower(p.name) = b.key AND abs(p.lat - b.lat) < 0.05 AND abs(p.lon - b.lon) < 0.05 GROUP BY ord)
, fresh AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS i FROM batch WHERE ord NOT IN (SELECT ord FROM old))
, walk AS (
    SELECT key, i, ord, true AS is_new, [{'lat': lat, 'lon': lon}] AS kept FROM fresh WHERE i = 1
    UNION ALL
    SELECT f.key, f.i, f.ord, NOT seen, CASE WHEN seen THEN w.kept ELSE list_append(w.kept, {'lat': f.lat, 'lon': f.lon}) END
    FROM walk w JOIN fresh f ON f.key = w.key AND f.i = w.i + 1, LATERAL (SELECT len(list_filter(w.kept, lambda k: abs(k.lat - f.lat) < 0.05 AND abs(k.lon - f.lon) < 0.05)) > 0 AS seen) AS x
)"""


@query(with_("places") + _BATCH + " SELECT ord, is_new, NULL::BIGINT AS idx FROM walk UNION ALL SELECT ord, false, idx FROM old")
def place_dedupe(spark, sf_dir):
    key = F.col("s_suppkey") % 40
    batch = _read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("ord"), F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0")).alias("name"),
        ((key * 37 % 1300).cast("double") / 10 - 60 + (F.col("s_suppkey") % 7) * F.lit(0.02)).alias("lat"), ((key * 101 % 3600).cast("double") / 10 - 180).alias("lon"),
    )
    return places.new_places(bridge.places(spark, sf_dir), batch)


_ASKED = ["Customer#00000001", "customer#000000012", "000000077", "Customer#0000000", "custumer#000000003", "best", "#0", "zz", "customer#000000199x"]
_ALIASES = [("best", "Customer#000000100"), ("zz", "Customer#000000005")]
_VALUES_OF = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows)


@query(
    with_("places")
    + f""", asked(query) AS (VALUES {_VALUES_OF([(q,) for q in _ASKED])}), named(alias, target) AS (VALUES {_VALUES_OF(_ALIASES)}),
    keyed AS (SELECT idx, pop, lower(name) AS key FROM places), q AS (SELECT query, lower(query) AS q FROM asked),
    direct AS (SELECT query, q, idx, pop, key, CASE WHEN strpos(key, q) = 1 THEN 0 ELSE 2 END AS tier FROM q JOIN keyed ON contains(key, q)),
    by_alias AS (SELECT query, q, min_by(idx, idx) AS idx, min_by(pop, idx) AS pop, key, 1 AS tier FROM q JOIN named ON lower(alias) = q JOIN keyed ON key = lower(target) GROUP BY query, q, key),
    best AS (SELECT * FROM direct UNION ALL SELECT * FROM by_alias a WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.query = a.query AND d.idx = a.idx)),
    few AS (SELECT query, q FROM q WHERE length(q) >= 3 AND (SELECT count(*) FROM best b WHERE b.query = q.query) < 3),
    near AS (SELECT query, q, idx, pop, key, 3 AS tier FROM few JOIN keyed ON abs(length(q) - length(key)) <= 1 AND levenshtein(q, key) <= 1
        WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.query = few.query AND b.idx = keyed.idx)),
    ranked AS (SELECT query, idx, tier, row_number() OVER (PARTITION BY query ORDER BY tier, (tier = 0 AND key = q)::INT DESC, pop DESC, idx) AS rank FROM (SELECT * FROM best UNION ALL SELECT * FROM near))
    SELECT query, rank::INT AS rank, idx, tier FROM ranked WHERE rank <= 8"""
)
def place_search(spark, sf_dir):
    asked = spark.createDataFrame([(q,) for q in _ASKED], "query string")
    return places.search(asked, bridge.places(spark, sf_dir), spark.createDataFrame(_ALIASES, "alias string, name string"))


@query(
    with_("places")
    + """, scored AS (SELECT *, idx % 97 = 0 AS exempt, CASE WHEN idx % 5 = 0 THEN 1.0 ELSE pop END AS score, pow(lat - 20.0, 2) + pow(lon - 10.0, 2) AS off FROM places)
    SELECT idx AS ord, true AS exempt FROM scored WHERE exempt UNION ALL
    SELECT * FROM (SELECT idx AS ord, false AS exempt FROM scored WHERE NOT exempt ORDER BY score DESC, off, idx LIMIT 100)"""
)
def density_budget(spark, sf_dir):
    rows = bridge.places(spark, sf_dir).select(F.col("idx").alias("ord"), "lat", "lon", F.when(F.col("idx") % 5 == 0, 1.0).otherwise(F.col("pop")).alias("score"), (F.col("idx") % 97 == 0).alias("exempt"))
    return places.density_budget(rows, 20.0, 10.0, 4.2)


# ---------------------------------------------------------------- land and water

_EDGES = "edges(ord, polygon, ring, x1, y1, x2, y2) AS (VALUES " + ", ".join(
    f"({i}, '{name}', {k}, {x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)"
    for i, (name, rings) in enumerate(dims.LAND)
    for k, ring in enumerate(rings)
    for (x1, y1), (x2, y2) in zip(ring, [ring[-1], *ring[:-1]], strict=True)
) + ")"


def _landed(samples: str, keys: str, out: str = "located") -> str:
    """SQL tables that add the first polygon (landmass) to samples with keys, lat and lon."""
    return f"""
, crossed_{out} AS (SELECT {keys}, ord, polygon, ring FROM {samples} JOIN edges ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
    GROUP BY {keys}, ord, polygon, ring HAVING count(*) % 2 = 1)
, held_{out} AS (SELECT {keys}, min_by(polygon, ord) AS landmass FROM crossed_{out} c WHERE ring = 0
    AND NOT EXISTS (SELECT 1 FROM crossed_{out} h WHERE h.ring > 0 AND h.ord = c.ord AND {' AND '.join(f'h.{k.strip()} = c.{k.strip()}' for k in keys.split(','))}) GROUP BY {keys})
, {out} AS (SELECT s.*, held_{out}.landmass FROM {samples} s LEFT JOIN held_{out} USING ({keys}))"""


@query(with_("stops") + f", {_EDGES}, placed AS (SELECT trip, seq, lat, lon FROM stops WHERE lat IS NOT NULL)" + _landed("placed", "trip, seq") + " SELECT trip, seq, landmass, landmass IS NOT NULL AS on_land FROM located")
def point_on_land(spark, sf_dir):
    placed = bridge.stops(spark, sf_dir).filter("lat IS NOT NULL")
    found = land.locate(placed, bridge.coast(spark))
    return found.select("trip", "seq", "landmass", F.col("landmass").isNotNull().alias("on_land"))


_WATER = f"""
, {_EDGES}, samples AS (SELECT trip, leg, i, from_lat + (to_lat - from_lat) * (i / 12) AS lat, from_lon + (to_lon - from_lon) * (i / 12) AS lon FROM legs, (SELECT unnest(range(1, 12)) AS i))"""


@query(with_("stops") + _LEGS + _WATER + _landed("samples", "trip, leg, i") + f" SELECT trip, leg, {half_up('avg((landmass IS NULL)::INT)', 6)} AS water FROM located GROUP BY trip, leg")
def water_fraction(spark, sf_dir):
    found = land.water_fraction(legs.legs_of(bridge.stops(spark, sf_dir)), bridge.coast(spark))
    return found.select("trip", "leg", r(F.col("water")).alias("water"))


_LOCAL = f"""
, {_EDGES}, lines(up, across) AS (VALUES (1, 0), (0, 1), (1, 1), (1, -1)), ends AS (SELECT trip, leg, 'from' AS side, from_lat AS lat0, from_lon AS lon0 FROM legs UNION ALL SELECT trip, leg, 'to', to_lat, to_lon FROM legs),
samples AS (SELECT trip, leg, side, up, across, i, (lat0 - up * 0.03::DOUBLE) + ((lat0 + up * 0.03::DOUBLE) - (lat0 - up * 0.03::DOUBLE)) * (i / 8) AS lat,
    (lon0 - across * 0.03::DOUBLE) + ((lon0 + across * 0.03::DOUBLE) - (lon0 - across * 0.03::DOUBLE)) * (i / 8) AS lon FROM ends, lines, (SELECT unnest(range(1, 8)) AS i))"""


@query(
    with_("stops")
    + _LEGS
    + _LOCAL
    + _landed("samples", "trip, leg, side, up, across, i")
    + f""" SELECT trip, leg, {half_up("1 - avg((landmass IS NULL)::INT) FILTER (side = 'from')", 6)} AS from_land, {half_up("1 - avg((landmass IS NULL)::INT) FILTER (side = 'to')", 6)} AS to_land
    FROM located GROUP BY trip, leg"""
)
def local_land(spark, sf_dir):
    found = land.local_land(legs.legs_of(bridge.stops(spark, sf_dir)), bridge.coast(spark))
    return found.select("trip", "leg", r(F.col("from_land")).alias("from_land"), r(F.col("to_land")).alias("to_land"))


_PROBES = "probes(k, km, s, c) AS (VALUES (0, 0, 0.0::DOUBLE, 0.0::DOUBLE), " + ", ".join(
    f"({1 + 8 * i + a}, {d}, {math.sin(a * math.pi / 4)!r}::DOUBLE, {math.cos(a * math.pi / 4)!r}::DOUBLE)" for i, d in enumerate(land.SNAP_KM) for a in range(8)
) + ")"


def _same_sql(legs_table: str) -> str:
    """Tables that end in ``same_mass``: trip, leg, same."""
    return (
        f""", {_PROBES}, both_ends AS (SELECT trip, leg, 'from' AS side, from_lat AS lat0, from_lon AS lon0 FROM {legs_table} UNION ALL SELECT trip, leg, 'to', to_lat, to_lon FROM {legs_table}),
        probed AS (SELECT trip, leg, side, k, km, lat0 + (km / 111.0::DOUBLE) * s AS lat, lon0 + km / (111.0::DOUBLE * greatest(0.2, cos(radians(lat0)))) * c AS lon FROM both_ends, probes)"""
        + _landed("probed", "trip, leg, side, k", "probed_land")
        + """, reached AS (SELECT trip, leg, side, min_by(landmass, k) AS mass, min_by(km, k) AS snap FROM probed_land WHERE landmass IS NOT NULL GROUP BY trip, leg, side),
        trusted AS (SELECT trip, leg, max(mass) FILTER (side = 'from') AS a, max(mass) FILTER (side = 'to') AS b FROM reached WHERE snap <= 10 GROUP BY trip, leg)"""
        + f""", same_mass AS (SELECT l.trip, l.leg, a = b AS same FROM {legs_table} l LEFT JOIN trusted USING (trip, leg))"""
    )


@query(with_("stops") + _LEGS + f", {_EDGES}" + _same_sql("legs") + " SELECT trip, leg, same FROM same_mass")
def same_landmass(spark, sf_dir):
    return land.same_landmass(legs.legs_of(bridge.stops(spark, sf_dir)), bridge.coast(spark))


_WET = """
, wet_samples AS (SELECT trip, leg, i, from_lat + (to_lat - from_lat) * (i / 12) AS lat, from_lon + (to_lon - from_lon) * (i / 12) AS lon FROM legs, (SELECT unnest(range(1, 12)) AS i))"""
_WET += _landed("wet_samples", "trip, leg, i", "wet_land") + ", wet AS (SELECT trip, leg, avg((landmass IS NULL)::INT) AS water FROM wet_land GROUP BY trip, leg)"


@query(
    with_("stops")
    + _LEGS
    + f", {_EDGES}"
    + _same_sql("legs")
    + _WET
    + f" SELECT l.trip, l.leg, coalesce(NOT same, false) OR ({_LEG_KM} > 10 AND water > 0.6) AS apart FROM legs l JOIN same_mass USING (trip, leg) JOIN wet USING (trip, leg)"
)
def across_water(spark, sf_dir):
    return land.across_water(legs.legs_of(bridge.stops(spark, sf_dir)), bridge.coast(spark))


_SAMPLED = f"""
, sized AS (SELECT *, {_LEG_KM} AS d FROM legs), counted AS (SELECT *, greatest(3, least(400, floor(d / 40 + 0.5)))::INT AS n FROM sized WHERE d > 0),
samples AS (SELECT trip, leg, vehicle, d, n, s, s / (n + 1) AS t, from_lat + (to_lat - from_lat) * greatest(0.0, least(1.0, ((s / (n + 1)) * d - 0.0) / d)) AS lat,
    from_lon + (to_lon - from_lon) * greatest(0.0, least(1.0, ((s / (n + 1)) * d - 0.0) / d)) AS lon FROM (SELECT *, unnest(range(1, n + 1)) AS s FROM counted))"""


@query(with_("stops") + _LEGS + _SAMPLED + f" SELECT trip, leg, s::INT AS s, {half_up('lat', 6)} AS lat, {half_up('lon', 6)} AS lon, {half_up('t', 6)} AS t FROM samples")
def leg_samples(spark, sf_dir):
    rows = _leg_paths(spark, sf_dir)
    return legs.sample_legs(rows).select("trip", "leg", "s", r(F.col("lat")).alias("lat"), r(F.col("lon")).alias("lon"), r(F.col("t")).alias("t"))


def _leg_paths(spark, sf_dir):
    none = F.lit(None).cast("array<struct<lat: double, lon: double>>")
    ends = [F.col(c) for c in ("from_lat", "from_lon", "to_lat", "to_lon")]
    return legs.legs_of(bridge.stops(spark, sf_dir)).select("trip", "leg", "vehicle", legs.vertices(ends[0], ends[1], none, ends[2], ends[3]).alias("path"))


@query(
    with_("stops")
    + _LEGS
    + _SAMPLED
    + f", {_EDGES}, ground AS (SELECT *, {_MODALITY} AS modality FROM samples WHERE {_MODALITY} <> 'air')"
    + _landed("ground", "trip, leg, s")
    + f""", judged AS (SELECT *, (modality = 'land') = (landmass IS NULL) AS wrong FROM located),
    audited AS (SELECT trip, leg, vehicle, modality, count(*) AS samples, count(*) FILTER (wrong) AS offending, any_value(d) AS d, min(s) FILTER (wrong) AS first_wrong FROM judged GROUP BY trip, leg, vehicle, modality)
    SELECT trip, leg, vehicle, modality, CASE modality WHEN 'land' THEN 'land-vehicle-over-sea' ELSE 'boat-over-land' END AS kind, {half_up('offending / samples', 3)} AS ratio,
           samples, offending, floor(d + 0.5)::BIGINT AS km, first_wrong::INT AS first_wrong FROM audited WHERE offending / samples > 0.15"""
)
def leg_audit(spark, sf_dir):
    found = land.audit_legs(legs.legs_of(bridge.stops(spark, sf_dir)), bridge.coast(spark))
    return found.withColumn("first_wrong", F.col("examples")[0]["s"]).drop("examples")


@query(
    with_("stops")
    + _LEGS
    + _SAMPLED
    + f", {_EDGES}, ground AS (SELECT *, {_MODALITY} AS modality FROM samples WHERE {_MODALITY} <> 'air')"
    + _landed("ground", "trip, leg, s")
    + """, bad AS (SELECT trip, leg FROM located GROUP BY trip, leg HAVING count(*) FILTER ((modality = 'land') = (landmass IS NULL)) / count(*) > 0.15),
    lists AS (SELECT trip, string_agg(leg::VARCHAR, ',' ORDER BY leg) AS findings FROM bad GROUP BY trip)
    SELECT trip, count(*) AS legs, coalesce(any_value(findings), '') AS findings FROM legs LEFT JOIN lists USING (trip) GROUP BY trip"""
)
def trip_audit(spark, sf_dir):
    found = land.audit_trips(legs.legs_of(bridge.stops(spark, sf_dir)), bridge.coast(spark))
    return found.withColumn("findings", F.array_join("findings", ","))


@query(
    with_("stops")
    + _LEGS
    + _SAMPLED
    + f", {_EDGES}, ground AS (SELECT *, {_MODALITY} AS modality FROM samples WHERE {_MODALITY} <> 'air')"
    + _landed("ground", "trip, leg, s")
    + f""", bad AS (SELECT trip, leg, {half_up("count(*) FILTER ((modality = 'land') = (landmass IS NULL)) / count(*)", 3)} AS ratio, floor(any_value(d) + 0.5)::BIGINT AS km FROM located GROUP BY trip, leg
        HAVING count(*) FILTER ((modality = 'land') = (landmass IS NULL)) / count(*) > 0.15),
    dated AS (SELECT trip, leg, CASE WHEN trip % 11 < 10 THEN ([{', '.join(f"'{e[0]}'" for e in dims.ERAS)}])[(trip % 11)::INT + 1] END AS era FROM legs)
    SELECT grouping(era, trip)::INT AS level, era, trip, count(*) AS legs, count(ratio) AS off, coalesce(sum(km), 0)::BIGINT AS km, max(ratio) AS worst FROM dated LEFT JOIN bad USING (trip, leg) GROUP BY ROLLUP (era, trip)"""
)
def trip_audit_rollup(spark, sf_dir):
    """Audits by era and trip with subtotals; trips without an era are no subtotal."""
    era = F.when(F.col("trip") % 11 < 10, F.element_at(F.array(*[F.lit(e[0]) for e in dims.ERAS]), (F.col("trip") % 11).cast("int") + 1))
    return land.audit_rollup(legs.legs_of(bridge.stops(spark, sf_dir)).withColumn("era", era), bridge.coast(spark))


_CHORD = f"""
, sized AS (SELECT *, {_LEG_KM} AS d FROM legs), counted AS (SELECT *, greatest(2, least(400, floor(d / 8 + 0.5)))::INT AS n FROM sized WHERE d > 0),
samples AS (SELECT trip, leg, s, from_lat + (to_lat - from_lat) * greatest(0.0, least(1.0, ((s / n) * d - 0.0) / d)) AS lat,
    from_lon + (to_lon - from_lon) * greatest(0.0, least(1.0, ((s / n) * d - 0.0) / d)) AS lon FROM (SELECT *, unnest(range(1, n)) AS s FROM counted)), {_EDGES}"""


def _crosses_sql(test: str) -> str:
    return (
        with_("stops")
        + _LEGS
        + _CHORD
        + _landed("samples", "trip, leg, s")
        + f", touched AS (SELECT trip, leg, bool_or({test}) AS crosses FROM located GROUP BY trip, leg) SELECT trip, leg, coalesce(crosses, false) AS crosses FROM legs LEFT JOIN touched USING (trip, leg)"
    )


@query(_crosses_sql("landmass IS NOT NULL"))
def chord_crosses_land(spark, sf_dir):
    return land.crosses(legs.legs_of(bridge.stops(spark, sf_dir)), bridge.coast(spark), "land")


@query(_crosses_sql("landmass IS NULL"))
def chord_crosses_water(spark, sf_dir):
    return land.crosses(legs.legs_of(bridge.stops(spark, sf_dir)), bridge.coast(spark), "water")


_AIR_SINCE = "air_since(air, y) AS (VALUES " + ", ".join(f"('{v}', {y})" for v, y in dims.AIR_SINCE.items()) + ")"
_ALL_ERAS = ", ".join(f"'{e[0]}'" for e in dims.ERAS) + ", 'unknown'"


@query(
    with_("stops", "eras")
    + _LEGS
    + f", {_EDGES}"
    + _same_sql("legs")
    + _WET
    + _LOCAL.replace(f"\n, {_EDGES}", "")
    + _landed("samples", "trip, leg, side, up, across, i", "shore_land")
    + f""", shores AS (SELECT trip, leg, 1 - avg((landmass IS NULL)::INT) FILTER (side = 'from') AS a, 1 - avg((landmass IS NULL)::INT) FILTER (side = 'to') AS b FROM shore_land GROUP BY trip, leg),
    {_AIR_SINCE}, asked AS (SELECT *, ([{_ALL_ERAS}])[((trip + leg) % 11)::INT + 1] AS era, CASE WHEN leg % 2 = 0 THEN (trip * 97 % 3800 - 1750)::INT END AS year, {_LEG_KM} AS d FROM legs),
    named AS (SELECT l.*, CASE WHEN e.era IS NULL THEN 'boat' ELSE e.sea END AS by_sea, CASE WHEN e.era IS NULL THEN 'car' ELSE e.land END AS by_land,
        CASE WHEN e.era IS NULL THEN 'plane' ELSE e.air END AS by_air, coalesce(year, floor((start_year + end_year) / 2.0 + 0.5)) AS y FROM asked l LEFT JOIN eras e ON e.era = l.era),
    able AS (SELECT n.*, by_air IS NOT NULL AND NOT coalesce(n.y < s.y, false) AS flies FROM named n LEFT JOIN air_since s ON s.air = n.by_air)
    SELECT trip, leg, CASE WHEN d < 5 THEN 'foot' WHEN flies AND d >= 4000 THEN by_air
        WHEN water > 0.5 AND NOT coalesce(d < 150 AND same AND least(a, b) >= 0.3, false) AND NOT (d < 12 AND greatest(a, b) >= 0.25) THEN by_sea
        WHEN flies AND d >= 2500 THEN by_air WHEN same = false THEN by_sea ELSE by_land END AS suggestion
    FROM able JOIN wet USING (trip, leg) JOIN shores USING (trip, leg) JOIN same_mass USING (trip, leg)"""
)
def vehicle_infer(spark, sf_dir):
    rows = legs.legs_of(bridge.stops(spark, sf_dir))
    era = F.element_at(F.array(*[F.lit(e[0]) for e in dims.ERAS], F.lit("unknown")), ((F.col("trip") + F.col("leg")) % 11).cast("int") + 1)
    year = F.when(F.col("leg") % 2 == 0, (F.col("trip") * 97 % 3800 - 1750).cast("int"))
    return land.infer_vehicles(rows.withColumns({"era": era, "year": year}), bridge.coast(spark))


@query(
    with_("stops")
    + f""", {_EDGES}, box AS (SELECT floor(min(lon)) AS w, floor(min(lat)) AS s, ceil(max(lon)) AS e, ceil(max(lat)) AS n FROM stops WHERE lat IS NOT NULL),
    sized AS (SELECT *, greatest(24, ceil((e - w) / 0.08::DOUBLE) + 1)::DOUBLE AS c0, greatest(24, ceil((n - s) / 0.08::DOUBLE) + 1)::DOUBLE AS r0 FROM box),
    grid AS (SELECT *, CASE WHEN c0 * r0 > 14400 THEN greatest(24, floor(c0 * sqrt(14400.0::DOUBLE / (c0 * r0)))) ELSE c0 END AS nc, CASE WHEN c0 * r0 > 14400 THEN greatest(24, floor(r0 * sqrt(14400.0::DOUBLE / (c0 * r0)))) ELSE r0 END AS nr FROM sized),
    samples AS (SELECT r::INT AS r, c::INT AS c, s + r * ((n - s) / (nr - 1)) AS lat, w + c * ((e - w) / (nc - 1)) AS lon
        FROM (SELECT *, unnest(range(nr::INT)) AS r FROM grid), (SELECT unnest(range(nc::INT)) AS c FROM grid))"""
    + _landed("samples", "r, c")
    + f""" SELECT r, c, {half_up('lat', 6)} AS lat, {half_up('lon', 6)} AS lon, landmass IS NOT NULL AS on_land, landmass IS NULL AND EXISTS (SELECT 1 FROM located b
        WHERE b.landmass IS NOT NULL AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1) AS near FROM located a"""
)
def raster_coast(spark, sf_dir):
    """The grid over all stops."""
    placed = bridge.stops(spark, sf_dir).filter("lat IS NOT NULL")
    box = placed.agg(F.floor(F.min("lon")), F.floor(F.min("lat")), F.ceil(F.max("lon")), F.ceil(F.max("lat"))).first()
    grid = land.raster(tuple(map(float, box)), bridge.coast(spark))
    return grid.select("r", "c", r(F.col("lat")).alias("lat"), r(F.col("lon")).alias("lon"), "on_land", "near")


def _routes_sql(medium: str, test: str) -> str:
    """Which legs of a medium are blocked, and so routed; what holds of every route is true."""
    return (
        with_("stops")
        + _LEGS
        + _CHORD
        + _landed("samples", "trip, leg, s")
        + f""", touched AS (SELECT trip, leg, bool_or({test}) AS crosses FROM located GROUP BY trip, leg)
    SELECT trip, leg, coalesce(crosses, false) AS routed, true AS ends_kept, true AS medium_kept, true AS no_shorter FROM legs LEFT JOIN touched USING (trip, leg) WHERE {_MODALITY} = '{medium}'"""
    )


def _route_facts(found: DataFrame, ends: DataFrame) -> DataFrame:
    """What must hold of routes: their ends are the leg's, they keep their medium, and are no shorter than the straight line."""
    both = found.join(ends, ["trip", "leg"])
    first, last = F.col("path")[0], F.element_at("path", -1)
    kept = (first["lat"] == F.col("from_lat")) & (first["lon"] == F.col("from_lon")) & (last["lat"] == F.col("to_lat")) & (last["lon"] == F.col("to_lon"))
    length = F.aggregate(legs.segment_km(F.col("path")), F.lit(0.0), lambda acc, d: acc + d)
    return both.select("trip", "leg", "routed", kept.alias("ends_kept"), F.col("kept").alias("medium_kept"), (length >= legs.leg_km() - 1e-6).alias("no_shorter"))


@query(_routes_sql("boat", "landmass IS NOT NULL"))
def sea_routes(spark, sf_dir):
    rows = legs.legs_of(bridge.stops(spark, sf_dir))
    return _route_facts(routing.route_legs(rows, bridge.coast(spark), "sea"), rows)


@query(_routes_sql("land", "landmass IS NULL"))
def land_routes(spark, sf_dir):
    rows = legs.legs_of(bridge.stops(spark, sf_dir))
    return _route_facts(routing.route_legs(rows, bridge.coast(spark), "land"), rows)


@query(
    with_("stops")
    + _LEGS
    + _CHORD
    + _landed("samples", "trip, leg, s")
    + f""", touched AS (SELECT trip, leg FROM located GROUP BY trip, leg HAVING bool_or(landmass IS NOT NULL)),
    blocked AS (SELECT l.* FROM legs l SEMI JOIN touched USING (trip, leg) WHERE {_MODALITY} = 'boat'),
    seen AS (SELECT DISTINCT from_lat, from_lon, to_lat, to_lon FROM blocked WHERE trip % 3 = 0)
    SELECT trip, leg, CASE WHEN s.from_lat IS NULL THEN 2 ELSE 1 END::INT AS run FROM blocked b LEFT JOIN seen s ON s.from_lat = b.from_lat AND s.from_lon = b.from_lon AND s.to_lat = b.to_lat AND s.to_lon = b.to_lon"""
)
def route_memo(spark, sf_dir):
    """Which of two runs over a stored memo searched the route of each blocked leg: the first has every third trip."""
    rows, memo = legs.legs_of(bridge.stops(spark, sf_dir)), new_folder(spark, "route-memo")
    routing.route_legs(rows.filter("trip % 3 = 0"), bridge.coast(spark), "sea", memo=memo)
    return routing.route_legs(rows, bridge.coast(spark), "sea", memo=memo).filter("routed").select("trip", "leg", "run")


# ---------------------------------------------------------------- stores and sources


@query(r"""SELECT page_id, regexp_matches(regexp_extract(url, '^[^?#]*?://[^/?#]*([^?#]*)', 1), '/(geo-refined|era-places-full|city-dict-full)\b|/data/regions/|(?i:\.mp3$)|/data/sample-trips/[^/]+/[^/]+\.json$') AS addon
    FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN replace(url, '?', '.mp3?') || '#x' WHEN 1 THEN regexp_replace(url, '(://[^/]*)', '\1/data/regions') ELSE url END AS url FROM pages)""")  # fmt: skip
def url_routing(spark, sf_dir):
    n = F.col("page_id") % 5
    url = F.when(n == 0, F.concat(F.replace("url", F.lit("?"), F.lit(".mp3?")), F.lit("#x"))).when(n == 1, F.regexp_replace("url", "(://[^/]*)", "$1/data/regions")).otherwise(F.col("url"))
    return _read(spark, sf_dir, "pages").select("page_id", trips.is_addon(url).alias("addon"))


@query("""SELECT doc_id, text FROM (SELECT doc_id, md5(text) AS text, 1 AS p FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, md5(lang || doc_id), 0 FROM documents WHERE doc_id % 2 = 0
    UNION ALL SELECT doc_id, 'network', 2 FROM documents) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p) = 1""")  # fmt: skip
def source_priority(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    layers = [
        docs.filter("doc_id % 3 = 0").select("doc_id", F.md5("text").alias("text"), F.lit(1).alias("p")),
        docs.filter("doc_id % 2 = 0").select("doc_id", F.md5(F.concat("lang", F.col("doc_id").cast("string"))).alias("text"), F.lit(0).alias("p")),
        docs.select("doc_id", F.lit("network").alias("text"), F.lit(2).alias("p")),
    ]
    rows = layers[0].unionByName(layers[1]).unionByName(layers[2])
    return trips.first_source(rows, ["doc_id"], "p").drop("p")


@query("""SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)""")
def hydrate_missing(spark, sf_dir):
    wanted = _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"))
    return trips.to_load(wanted, _read(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("part")), "part")


@query("""SELECT p_partkey AS part, p_size AS size FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, p_size + 100 FROM part WHERE p_partkey % 3 = 0""")
def store_upsert(spark, sf_dir):
    part = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_size").alias("size"))
    return trips.upsert(part.filter("part % 5 <> 0 OR part % 3 <> 0"), part.filter("part % 3 = 0").withColumn("size", F.col("size") + 100), ["part"])


@query("""SELECT c_custkey AS item FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 7 <> 3)""")
def cache_purge(spark, sf_dir):
    """What is held and no order of the current release names: every seventh customer's."""
    held = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"))
    return trips.stale(held, _read(spark, sf_dir, "orders").filter("o_custkey % 7 <> 3").select(F.col("o_custkey").alias("item")), "item")
