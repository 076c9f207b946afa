"""Queries of legs with via points and hints, named merges, layers, names and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from itinera.functions import dates, geo, text
from itinera.operators import clusters, land, legs, places, trips
from itinera.plans import bridge, dims
from itinera.plans.bridge import half_up, km, with_
from itinera.plans.registry import _BATCH, _EDGES, _FOLD, _MERGE, _MODALITY, _landed, _read, query, r

# ---------------------------------------------------------------- legs with via points and hints


def _unwrapped(before: str, lon: str) -> str:
    return f"""CASE WHEN sign = 1 THEN {lon} + 360 * CASE WHEN {lon} <= {before} THEN floor(({before} - {lon}) / 360) + 1 ELSE 0 END
        WHEN sign = -1 THEN {lon} - 360 * CASE WHEN {lon} >= {before} THEN floor(({lon} - {before}) / 360) + 1 ELSE 0 END
        WHEN {lon} - {before} > 180 THEN {lon} - 360 WHEN {lon} - {before} < -180 THEN {lon} + 360 ELSE {lon} END"""


_TURN = "degrees - 360 * floor(degrees / 360)"


@query(
    with_("world_legs")
    + f""", signed AS (SELECT *, CASE WHEN lower(hint) = 'east' THEN 1 WHEN lower(hint) = 'west' THEN -1 WHEN hint IS NOT NULL THEN 0 WHEN {_TURN} > 0 AND {_TURN} < 180 THEN 1 WHEN {_TURN} > 180 THEN -1 ELSE 0 END AS sign FROM world_legs),
    a AS (SELECT *, CASE WHEN v1_lat IS NOT NULL THEN {_unwrapped('from_lon', 'v1_lon')} END AS l1 FROM signed),
    b AS (SELECT *, CASE WHEN v2_lat IS NOT NULL THEN {_unwrapped('coalesce(l1, from_lon)', 'v2_lon')} END AS l2 FROM a),
    c AS (SELECT *, {_unwrapped('coalesce(l2, l1, from_lon)', 'to_lon')} AS l3 FROM b),
    d AS (SELECT trip, leg, list_filter([from_lon, l1, l2, l3], lambda x: x IS NOT NULL) AS xs FROM c)
    SELECT trip, leg, array_to_string(list_transform(xs, lambda x: floor(x * 10 + 0.5)::BIGINT::VARCHAR), ',') AS lons,
        {half_up('list_max(list_transform(range(1, len(xs)), lambda i: abs(xs[i + 1] - xs[i])))', 6)} AS widest FROM d"""
)
def leg_vertices(spark, sf_dir):
    rows = bridge.world_legs(spark, sf_dir)
    path = legs.expanded_vertices(F.col("from_lat"), F.col("from_lon"), F.col("via"), F.col("to_lat"), F.col("to_lon"), F.col("hint"), F.col("degrees"))
    rows = rows.select("trip", "leg", path.alias("path"))
    lons = F.array_join(F.transform("path", lambda p: F.floor(p["lon"] * 10 + 0.5).cast("string")), ",")
    return rows.select("trip", "leg", lons.alias("lons"), r(legs.widest_step(F.col("path"))).alias("widest"))


def _via_samples(least: int, step: int, steps: str) -> str:
    """Tables that end in ``samples``: points along paths with via points; ``steps`` is the range of s and the share it stands for."""
    numbers, share = steps.split("|")
    return f"""
, verts AS (SELECT trip, leg, vehicle, list_filter([{{'lat': from_lat, 'lon': from_lon}}, {{'lat': v1_lat, 'lon': v1_lon}}, {{'lat': v2_lat, 'lon': v2_lon}}, {{'lat': to_lat, 'lon': to_lon}}], lambda v: v.lat IS NOT NULL) AS vs FROM via_legs)
, pieces AS (SELECT trip, leg, vehicle, i, vs[i] AS a, vs[i + 1] AS b, {km('vs[i].lat', 'vs[i].lon', 'vs[i + 1].lat', 'vs[i + 1].lon')} AS d FROM (SELECT *, unnest(range(1, len(vs))) AS i FROM verts))
, sized AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY leg ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(d) OVER (PARTITION BY leg ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total,
    max(i) OVER (PARTITION BY leg) AS last FROM pieces)
, counted AS (SELECT leg, any_value(total) AS total, greatest({least}, least(400, floor(any_value(total) / {step} + 0.5)))::INT AS n FROM sized GROUP BY leg HAVING any_value(total) > 0)
, targets AS (SELECT leg, s, {share} AS t, total FROM (SELECT *, unnest({numbers}) AS s FROM counted))
, samples AS (SELECT p.trip, p.leg, p.vehicle, t.s, t.t, p.total AS d, a.lat + (b.lat - a.lat) * f AS lat, a.lon + (b.lon - a.lon) * f AS lon
    FROM targets t JOIN sized p ON p.leg = t.leg AND (p.before + p.d >= t.t * p.total OR p.i = p.last) AND (p.i = 1 OR p.before < t.t * p.total),
    LATERAL (SELECT CASE WHEN p.d > 0 THEN greatest(0.0, least(1.0, (t.t * p.total - p.before) / p.d)) ELSE 0 END AS f) AS x)"""


_INNER = _via_samples(3, 40, "range(1, n + 1)|s / (n + 1)")


@query(with_("via_legs") + _INNER + f" SELECT trip, leg, s::INT AS s, {half_up('lat', 5)} AS lat, {half_up('lon', 5)} AS lon FROM samples")
def leg_samples_via(spark, sf_dir):
    rows = bridge.via_legs(spark, sf_dir)
    path = legs.vertices(F.col("from_lat"), F.col("from_lon"), F.col("via"), F.col("to_lat"), F.col("to_lon"))
    found = legs.sample_legs(rows.select("trip", "leg", path.alias("path")))
    return found.select("trip", "leg", "s", r(F.col("lat"), 5).alias("lat"), r(F.col("lon"), 5).alias("lon"))


@query(
    with_("via_legs")
    + _INNER
    + f", {_EDGES}, ground AS (SELECT *, {_MODALITY} AS modality FROM samples WHERE {_MODALITY} <> 'air')"
    + _landed("ground", "trip, leg, s")
    + f""", judged AS (SELECT *, (modality = 'land') = (landmass IS NULL) AS wrong FROM located),
    audited AS (SELECT trip, leg, vehicle, modality, count(*) AS samples, count(*) FILTER (wrong) AS offending, any_value(d) AS d,
        list({{'s': s, 'a': floor(lat * 1000 + 0.5)::BIGINT, 'b': floor(lon * 1000 + 0.5)::BIGINT, 't': floor(t * 100 + 0.5)::BIGINT}} ORDER BY s) FILTER (wrong) AS w FROM judged GROUP BY trip, leg, vehicle, modality)
    SELECT trip, leg, vehicle, modality, {half_up('offending / samples', 3)} AS ratio, samples, offending, floor(d + 0.5)::BIGINT AS km,
        array_to_string(list_transform(w[1:3], lambda x: x.s || ':' || x.a || ':' || x.b || ':' || x.t), ' ') AS examples FROM audited WHERE offending / samples > 0.15"""
)
def leg_audit_via(spark, sf_dir):
    found = land.audit_legs(bridge.via_legs(spark, sf_dir), bridge.coast(spark))
    whole = lambda x, scale: F.floor(x * scale + 0.5).cast("string")
    said = F.transform("examples", lambda e: F.concat_ws(":", e["s"].cast("string"), whole(e["lat"], 1000), whole(e["lon"], 1000), whole(e["t"], 100)))
    return found.select("trip", "leg", "vehicle", "modality", "ratio", "samples", "offending", "km", F.array_join(said, " ").alias("examples"))


@query(
    with_("via_legs")
    + _via_samples(2, 8, "range(1, n)|s / n")
    + f", {_EDGES}"
    + _landed("samples", "trip, leg, s")
    + ", touched AS (SELECT trip, leg, bool_or(landmass IS NULL) AS wet, bool_or(landmass IS NOT NULL) AS dry FROM located GROUP BY trip, leg) SELECT trip, leg, coalesce(wet, false) AS wet, coalesce(dry, false) AS dry FROM via_legs LEFT JOIN touched USING (trip, leg)"
)
def chord_crosses_via(spark, sf_dir):
    found = land.touched(bridge.via_legs(spark, sf_dir), bridge.coast(spark))
    return found.select("trip", "leg", F.col("water").alias("wet"), F.col("land").alias("dry"))


@query(
    with_("via_legs")
    + """, verts AS (SELECT trip, leg, list_filter([{'lat': from_lat, 'lon': from_lon}, {'lat': v1_lat, 'lon': v1_lon}, {'lat': v2_lat, 'lon': v2_lon}, {'lat': to_lat, 'lon': to_lon}], lambda v: v.lat IS NOT NULL) AS vs FROM via_legs),
    tenths AS (SELECT trip, leg, vs[i].lat + (vs[i + 1].lat - vs[i].lat) * j / 10 AS lat, vs[i].lon + (vs[i + 1].lon - vs[i].lon) * j / 10 AS lon
        FROM (SELECT *, unnest(range(1, len(vs))) AS i FROM verts), (SELECT unnest(range(1, 10)) AS j))
    SELECT trip, leg, bool_or(coalesce(CASE WHEN lat > 40 THEN NULL WHEN lon BETWEEN 32.013 AND 34.017 THEN (lat - 33.0) / 20 END > 0.35 , false)) AS steep FROM tenths GROUP BY trip, leg"""
)
def terrain_crossings(spark, sf_dir):
    """Terrain costs more northwards inside a band of longitudes, and is unknown beyond a latitude."""
    cost = lambda lon, lat: F.when(~(lat > 40) & lon.between(32.013, 34.017), (lat - 33.0) / 20)
    rows = bridge.via_legs(spark, sf_dir)
    path = legs.vertices(F.col("from_lat"), F.col("from_lon"), F.col("via"), F.col("to_lat"), F.col("to_lon"))
    return rows.select("trip", "leg", path.alias("path")).select("trip", "leg", land.crosses_terrain(F.col("path"), cost).alias("steep"))


_PACK = [(0, "fine", [[(30.0, 37.0), (30.5, 37.0), (30.5, 37.5), (30.0, 37.5)]])]


@query(with_("via_legs") + f", {_EDGES}, samples AS (SELECT trip, leg, from_lat AS lat, from_lon AS lon FROM via_legs)" + _landed("samples", "trip, leg") + """
    SELECT trip, leg, CASE WHEN lon BETWEEN 29.5 AND 31.5 AND lat BETWEEN 36.5 AND 38.5 THEN lat >= 37.0 AND lat < 37.5 AND lon >= 30.0 AND lon < 30.5 ELSE landmass IS NOT NULL END AS on_land FROM located""")  # fmt: skip
def layered_land(spark, sf_dir):
    points = bridge.via_legs(spark, sf_dir).select("trip", "leg", F.col("from_lat").alias("lat"), F.col("from_lon").alias("lon"))
    coast = bridge.coast(spark)
    packs = spark.createDataFrame(_PACK, dims.land(spark).schema)
    boxes = spark.createDataFrame([(29.5, 36.5, 31.5, 38.5)], "w double, s double, e double, n double")
    return land.locate_in_layers(points, packs, boxes, coast).select("trip", "leg", "on_land")


# ---------------------------------------------------------------- merges, visits, times, names

_NAMED = _MERGE.replace("SELECT owner, cluster, 0 AS place,", "SELECT owner, cluster, name, 0 AS place,").replace("SELECT o.owner, o.cluster, g.place", "SELECT o.owner, o.cluster, CASE WHEN joins THEN g.name ELSE o.name END, g.place")
_NAMED = _NAMED.replace("GROUP BY owner, cluster\n), wide", "GROUP BY owner, cluster\n), wide").replace("FROM folded GROUP BY owner, cluster", ", CASE cluster % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'A' WHEN 3 THEN 'B' END AS name FROM folded GROUP BY owner, cluster")
_NAMED = _NAMED.replace("<= reach.merge_km AS joins) AS x", "AS dist) AS y, LATERAL (SELECT CASE WHEN g.name IS NOT NULL AND o.name IS NOT NULL THEN g.name = o.name AND dist <= 12 ELSE dist <= reach.merge_km END AS joins) AS x")


@query(with_("photos") + _FOLD + _NAMED + " SELECT owner, place, sum(n)::BIGINT AS n, count(*) AS merged, min(cluster) AS first_cluster FROM merged GROUP BY owner, place")
def cluster_merge_named(spark, sf_dir):
    k = F.col("cluster") % 4
    named = clusters.cluster_photos(bridge.photos(spark, sf_dir)).withColumn("city", F.when(k < 2, "A").when(k == 3, "B"))
    merged = clusters.merge_clusters(named, name="city")
    return merged.select("owner", "place", "n", "merged", F.col("days")[0]["cluster"].alias("first_cluster"))


@query(
    with_("stops")
    + """, keyed AS (SELECT trip, seq, CASE WHEN p IS NOT NULL THEN 'p:' || p ELSE printf('c:%.3f,%.3f', floor(coalesce(lat, 0) * 1000 + 0.5) / 1000, floor(coalesce(lon, 0) * 1000 + 0.5) / 1000) END AS place
        FROM (SELECT *, CASE WHEN stop % 3 = 0 THEN 'id' || (stop % 5) END AS p FROM stops)),
    grouped AS (SELECT trip, place, count(*) AS visits, min(seq) AS first, string_agg(seq::VARCHAR, ',' ORDER BY seq) AS seqs FROM keyed GROUP BY trip, place)
    SELECT trip, place, (row_number() OVER (PARTITION BY trip ORDER BY first) - 1)::INT AS rank, visits, seqs FROM grouped"""
)
def return_visit_lists(spark, sf_dir):
    stops = bridge.stops(spark, sf_dir).withColumn("place_id", F.when(F.col("stop") % 3 == 0, F.concat(F.lit("id"), F.col("stop") % 5)))
    found = legs.coalesce_stops(stops)
    return found.select("trip", "place", "rank", "visits", F.array_join(F.transform("seqs", lambda s: s.cast("string")), ",").alias("seqs"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(text[1:40], '^\s+|\s+$', '', 'g') AS title, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS dateline, CASE WHEN doc_id % 4 = 0 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE '' END AS body FROM documents)
    SELECT doc_id AS trip, CASE WHEN doc_id % 5 = 0 THEN '' ELSE title END AS title, dateline, md5(body) AS body, (CASE WHEN doc_id % 5 = 0 THEN '' ELSE title END) || dateline || body <> '' AS has_intro FROM t""")  # fmt: skip
def intros_present(spark, sf_dir):
    n = F.col("doc_id")
    docs = _read(spark, sf_dir, "documents").select(
        n.alias("trip"), F.when(n % 5 == 0, " \n ").otherwise(F.substring("text", 1, 40)).alias("title"), F.when(n % 3 == 0, None).otherwise(F.concat("lang", F.lit("  "))).alias("dateline"),
        F.when(n % 4 == 0, F.col("text")).otherwise("\t").alias("body"),
    )
    return trips.intros(docs).select("trip", "title", "dateline", F.md5("body").alias("body"), "has_intro")


@query(f"""SELECT event_id, {half_up("(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) * (event_id % 90 + (event_id % 60) / 60::DOUBLE + (event_id % 59) / 3600::DOUBLE)", 9)} AS degrees,
    {half_up("(x - floor(x)) * 2 - 1", 4)} AS jitter FROM (SELECT event_id, sin((event_id % 1000) * 12.9898::DOUBLE + (event_id % 7) * 78.233::DOUBLE) * 43758.5453::DOUBLE AS x FROM events)""")  # fmt: skip
def dms_and_jitter(spark, sf_dir):
    n = F.col("event_id")
    ref = F.when(n % 3 != 0, "N").when(n % 2 == 0, "S").otherwise("W")
    degrees = geo.dms((n % 90).cast("double"), (n % 60).cast("double"), (n % 59).cast("double"), ref)
    jitter = geo.pseudo_random((n % 1000).cast("double"), (n % 7).cast("double"))
    return _read(spark, sf_dir, "events").select("event_id", r(degrees, 9).alias("degrees"), r(jitter, 4).alias("jitter"))


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '2001' WHEN event_id % 3 = 0 THEN '2002' WHEN event_id % 5 = 0 THEN '2003' END AS y, 1 + event_id % 28 AS d FROM events)
    SELECT event_id, CASE WHEN y IS NOT NULL THEN y || '-07-' || lpad(d::VARCHAR, 2, '0') || ' 08:09:10' END AS taken FROM t""")  # fmt: skip
def photo_times(spark, sf_dir):
    n = F.col("event_id")
    said = lambda year: F.concat(F.lit(f"{year}:07:"), F.lpad((1 + n % 28).cast("string"), 2, "0"), F.lit(" 08:09:10"))
    times = [F.when(n % 2 == 0, said(2001)).otherwise(""), F.when(n % 3 == 0, said(2002)), F.when(n % 5 == 0, said(2003)).otherwise("")]
    return _read(spark, sf_dir, "events").select("event_id", F.date_format(dates.photo_time(*times), "yyyy-MM-dd HH:mm:ss").alias("taken"))


_CODES = sorted(dims.COUNTRIES)


@query(f"""WITH named(code, name) AS (VALUES {', '.join("('" + c + "', '" + n.replace("'", "''") + "')" for c, n in dims.COUNTRIES.items())}),
    asked AS (SELECT c_custkey AS item, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'ZZ' ELSE ({_CODES!r})[(c_custkey % {len(_CODES)})::INT + 1] END AS code FROM customer)
    SELECT item, coalesce(name, code, '') AS country FROM asked LEFT JOIN named USING (code)""")  # fmt: skip
def country_names(spark, sf_dir):
    n = F.col("c_custkey")
    code = F.when(n % 11 == 0, None).when(n % 13 == 0, "ZZ").otherwise(F.element_at(F.array(*map(F.lit, _CODES)), (n % len(_CODES)).cast("int") + 1))
    return _read(spark, sf_dir, "customer").select(n.alias("item"), text.country_name(code, dims.COUNTRIES).alias("country"))


# ---------------------------------------------------------------- places and stores


@query(
    with_("places")
    + _BATCH.split("\n, old AS")[0]
    + """, every AS (SELECT lower(name) AS key, name, idx, NULL::BIGINT AS ord, lat, lon, pop, CASE WHEN idx % 3 = 0 THEN '' ELSE 'K' END AS cc FROM places
        UNION ALL SELECT key, 'customer#' || key[10:], NULL, ord, lat, lon, (ord * 7 % 3000)::DOUBLE, CASE WHEN ord % 2 = 0 THEN 'B' || ord % 4 END FROM batch),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx NULLS LAST, ord) AS i FROM every),
    walk AS (
        SELECT key, i, i AS place, [{'n': i, 'lat': lat, 'lon': lon}] AS kept FROM numbered WHERE i = 1
        UNION ALL
        SELECT f.key, f.i, coalesce(hit, f.i), list_append(list_filter(w.kept, lambda k: k.n <> coalesce(hit, -1)), {'n': coalesce(hit, f.i), 'lat': f.lat, 'lon': f.lon})
        FROM walk w JOIN numbered f ON f.key = w.key AND f.i = w.i + 1,
        LATERAL (SELECT CASE WHEN f.idx IS NULL THEN list_min(list_transform(list_filter(w.kept, lambda k: abs(k.lat - f.lat) < 0.05 AND abs(k.lon - f.lon) < 0.05), lambda k: k.n)) END AS hit) AS x),
    full_rows AS (SELECT * FROM walk JOIN numbered USING (key, i))
    SELECT max(idx) AS idx, CASE WHEN max(idx) IS NULL THEN min(ord) END AS first_ord, max_by(name, i) AS name, max_by(lat, i) AS lat, max_by(lon, i) AS lon, max(coalesce(pop, 0)) AS pop,
        coalesce(min_by(cc, i) FILTER (coalesce(cc, '') <> ''), '') AS cc FROM full_rows GROUP BY key, place"""
)
def place_refine(spark, sf_dir):
    key = F.col("s_suppkey") % 40
    batch = _read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("ord"), F.concat(F.lit("customer#"), F.lpad(key.cast("string"), 9, "0")).alias("name"),
        ((key * 37 % 1300).cast("double") / 10 - 60 + (F.col("s_suppkey") % 7) * F.lit(0.02)).alias("lat"), ((key * 101 % 3600).cast("double") / 10 - 180).alias("lon"),
        (F.col("s_suppkey") * 7 % 3000).cast("double").alias("pop"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("B"), F.col("s_suppkey") % 4)).alias("cc"),
    )
    known = bridge.places(spark, sf_dir).withColumn("cc", F.when(F.col("idx") % 3 == 0, "").otherwise("K"))
    return places.refine_places(known, batch)


@query(
    with_("places")
    + """, asked AS (SELECT DISTINCT CASE s_suppkey % 6 WHEN 0 THEN 'Customer#' || lpad(s_suppkey::VARCHAR, 9, '0') WHEN 1 THEN lpad(s_suppkey::VARCHAR, 7, '0') WHEN 2 THEN 'CUSTOMR#' || lpad(s_suppkey::VARCHAR, 9, '0')
        WHEN 3 THEN 'cust' WHEN 4 THEN '#0' ELSE lpad(s_suppkey::VARCHAR, 9, '0') || 'x' END AS query FROM supplier),
    keyed AS (SELECT idx, pop, lower(name) AS key FROM places), q AS (SELECT query, lower(query) AS q FROM asked),
    best AS (SELECT query, q, idx, pop, key, CASE WHEN strpos(key, q) = 1 THEN 0 ELSE 2 END AS tier FROM q JOIN keyed ON contains(key, q)),
    few AS (SELECT query, q FROM q WHERE length(q) >= 3 AND (SELECT count(*) FROM best b WHERE b.query = q.query) < 3),
    near AS (SELECT query, q, idx, pop, key, 3 AS tier FROM few JOIN keyed ON abs(length(q) - length(key)) <= 1 AND levenshtein(q, key) <= 1
        WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.query = few.query AND b.idx = keyed.idx)),
    ranked AS (SELECT query, idx, tier, row_number() OVER (PARTITION BY query ORDER BY tier, (tier = 0 AND key = q)::INT DESC, pop DESC, idx) AS rank FROM (SELECT * FROM best UNION ALL SELECT * FROM near))
    SELECT query, rank::INT AS rank, idx, tier FROM ranked WHERE rank <= 8"""
)
def place_search_many(spark, sf_dir):
    k = F.col("s_suppkey")
    padded = lambda n: F.lpad(k.cast("string"), n, "0")
    said = F.when(k % 6 == 0, F.concat(F.lit("Customer#"), padded(9))).when(k % 6 == 1, padded(7)).when(k % 6 == 2, F.concat(F.lit("CUSTOMR#"), padded(9)))
    said = said.when(k % 6 == 3, "cust").when(k % 6 == 4, "#0").otherwise(F.concat(padded(9), F.lit("x")))
    asked = _read(spark, sf_dir, "supplier").select(said.alias("query")).distinct()
    return places.search(asked, bridge.places(spark, sf_dir), spark.createDataFrame([], "alias string, name string"))


@query("""SELECT p_partkey AS part, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1000 ELSE p_size END AS size FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 4 = 0""")
def legacy_copy(spark, sf_dir):
    part = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_size").alias("size"))
    return trips.copy_legacy(part.filter("part % 3 <> 0"), part.filter("part % 4 = 0").withColumn("size", F.col("size") + 1000), ["part"])


@query("""SELECT DISTINCT p_partkey AS part, p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 10""")
def hydrate_load(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    wanted = _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"))
    store = part.select(F.col("p_partkey").alias("part"), F.col("p_name").alias("name"))
    return trips.hydrated(wanted, store, part.filter("p_size > 10").select(F.col("p_partkey").alias("part")), "part")


@query("""SELECT c_custkey AS item, c_custkey IN (SELECT o_custkey FROM orders WHERE o_custkey % 10 <> 3) AS held FROM customer""")
def store_keys(spark, sf_dir):
    """Which keys a store holds after some are deleted from it."""
    keys = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item"))
    store = trips.without(keys, keys.filter("item % 10 = 3"), "item")
    return trips.held(_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item")), store, "item")


@query(
    with_("places")
    + """, scored AS (SELECT *, idx % 97 = 0 AS exempt, CASE WHEN idx % 5 = 0 THEN 1.0 ELSE pop END AS score FROM places),
    views AS (SELECT s_suppkey AS view, (s_suppkey * 37 % 1300)::DOUBLE / 10 - 60 AS y, (s_suppkey * 101 % 3600)::DOUBLE / 10 - 180 AS x,
        CASE s_suppkey % 4 WHEN 0 THEN 30 WHEN 1 THEN 100 WHEN 2 THEN 300 ELSE 800 END AS cap FROM supplier),
    ranked AS (SELECT view, idx AS ord, cap, row_number() OVER (PARTITION BY view ORDER BY score DESC, pow(lat - y, 2) + pow(lon - x, 2), idx) AS k FROM scored, views WHERE NOT exempt)
    SELECT view, idx AS ord, true AS exempt FROM scored, views WHERE exempt UNION ALL SELECT view, ord, false FROM ranked WHERE k <= cap"""
)
def density_views(spark, sf_dir):
    """The budget of many views at once; a fifth of all places tie at one score."""
    rows = bridge.places(spark, sf_dir).select(F.col("idx").alias("ord"), "lat", "lon", F.when(F.col("idx") % 5 == 0, 1.0).otherwise(F.col("pop")).alias("score"), (F.col("idx") % 97 == 0).alias("exempt"))
    k = F.col("s_suppkey")
    views = _read(spark, sf_dir, "supplier").select(
        k.alias("view"), F.expr("cast(s_suppkey * 37 % 1300 AS double) / 10 - 60").alias("lat"), F.expr("cast(s_suppkey * 101 % 3600 AS double) / 10 - 180").alias("lon"),
        F.when(k % 4 == 0, 2.0).when(k % 4 == 1, 4.9).when(k % 4 == 2, 5.0).otherwise(8.5).alias("zoom"),
    )
    return places.density_budgets(rows, views)
