"""Gazetteer queries: nearest place, reverse lookup, duplicates, search, and what a map shows.

Spatial joins go by grid cell, an equality that Spark can shuffle on; the exact
distance is checked afterwards. A cell is at least as wide as the radius, so a
match lies in the same cell or one of the eight around it. Cells of many places are
split, and a position goes down only into parts that can hold its nearest place.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from itinera.functions.geo import EARTH_KM, haversine_km
from itinera.functions.text import fold, within_one_edit
from itinera.operators.covering import met_cells
from itinera.operators.folds import fold_rows
from itinera.sources.storage import stored

#: Zoom below which a view shows so many ranked places.
CAPS = [(3, 30), (5, 100), (7, 300), (9, 800), (99, 9999)]


def _cells(lat: Column, lon: Column, degrees: float, columns: int) -> Column:
    """The 3 x 3 cells around a position; columns wrap at the date line."""
    row, column = F.floor(lat / degrees), F.floor((lon + 180) / degrees)
    around = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)]
    return F.array_distinct(F.array(*[F.struct((row + r).alias("row"), F.pmod(column + c, F.lit(columns)).alias("column")) for r, c in around]))


def nearest_within(points: DataFrame, places: DataFrame, radius_km: float, same: str | None = None) -> DataFrame:
    """The nearest place of each point within a radius: all columns of points, idx, name, km (null for none).

    points: lat, lon; places: idx, name, lat, lon. ``same`` names a column of
    points with the idx of a place to leave out. Ties go to the least idx.
    Longitudes shrink towards the poles, so rows beyond 80 degrees less a cell are
    compared in one column of cells, and points near that line in both schemes; the
    radius must be under 100 km.
    """
    polar = 80.0
    degrees = max(0.05, math.degrees(radius_km / EARTH_KM) / math.cos(math.radians(polar)) * 1.01)
    columns = math.floor(360 / degrees)  # the last column is wider, which its neighbours allow for
    degrees = 360 / columns
    flat = lambda lat, lon: F.when(F.abs(lat) > polar - degrees, F.lit(0.0)).otherwise(lon)
    # Up to 80 degrees a cell is as wide as the radius, so on both sides of the line
    # the cells around a point's own longitude hold all places that are not flat.
    own, zero = _cells(F.col("lat"), F.col("lon"), degrees, columns), _cells(F.col("lat"), F.lit(0.0), degrees, columns)
    line = F.abs(F.col("lat"))
    probed = F.when(line > polar, zero).when(line > polar - 2 * degrees, F.array_union(own, zero)).otherwise(own)
    # Positions are looked up once each, and what is found is joined back by position.
    own_id = (F.col(same) if same else F.lit(None).cast("long")).alias("_same")
    spots = points.filter("lat IS NOT NULL AND lon IS NOT NULL").select("lat", "lon", own_id).distinct()
    key = lambda row, column: F.concat_ws(":", row.cast("string"), column.cast("string"))
    asked = spots.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "_same", F.explode(F.transform(probed, lambda c: key(c["row"], c["column"]))).alias("cell"))
    # Of places at one position the first counts, or the second where the first is left out.
    held = best_of_each(places.filter("lat IS NOT NULL AND lon IS NOT NULL").select("idx", "name", "lat", "lon"), ["lat", "lon"], ["idx"], 2).drop("rank")
    east = (flat(F.col("lat"), F.col("lon")) + 180) / degrees
    held = held.withColumns({"y": F.col("lat") / degrees, "x": east, "cell": key(F.floor(F.col("lat") / degrees), F.pmod(F.floor(east), F.lit(columns)))})
    km = haversine_km(F.col("_lat"), F.col("_lon"), F.col("p.lat"), F.col("p.lon"))
    hits = None
    for leaves, children, small in _place_tree(held):
        found = met_cells(asked, leaves, ["cell"], small).filter("items IS NOT NULL").withColumn("p", F.explode("items")).withColumn("km", km)
        found = found.filter((F.col("km") <= radius_km) & ~F.col("p.idx").eqNullSafe(F.col("_same"))).select("_lat", "_lon", "_same", "km", "p.idx", "p.name")
        hits = found if hits is None else hits.unionByName(found)
        if children is not None:
            asked = _nearer(asked, children, small, radius_km)
    best = hits.groupBy("_lat", "_lon", "_same").agg(F.min(F.struct("km", "idx", "name")).alias("best"))
    there = (F.col("lat") == F.col("_lat")) & (F.col("lon") == F.col("_lon"))
    there = there & (F.col(same).eqNullSafe(F.col("_same")) if same else F.lit(True))
    return points.join(best, there, "left").select(*points.columns, "best.idx", F.col("best.name").alias("place"), "best.km")


#: Places of a cell from which on it is split, parts of a side of one that is, and levels at most (some centimetres).
LEAF_PLACES, PARTS, DEEPEST = 256, 8, 6


def _place_tree(held: DataFrame) -> Iterator[tuple[DataFrame, DataFrame | None, bool]]:
    """Level by level: cells with their few places; cells with their parts, at most 64, each with its box and one of its places.

    Cells of many places have parts only, and these come with the next level; where no
    cell has many, one level is all.
    """
    small = held.limit(FEW_ROWS + 1).count() <= FEW_ROWS
    for level in range(DEEPEST + 1):
        dense = held.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LEAF_PLACES).select("cell")
        last = level == DEEPEST or dense.isEmpty()
        few = held if last else held.join(dense, "cell", "left_anti")
        leaves = few.groupBy("cell").agg(F.collect_list(F.struct("idx", "name", "lat", "lon")).alias("items"))
        if last:
            yield leaves, None, small
            return
        part = lambda c: F.floor(F.col(c) * PARTS ** (level + 1)).cast("string")  # noqa: B023, E731
        held = stored(held.join(dense, "cell", "left_semi").withColumns({"parent": F.col("cell"), "cell": F.concat_ws("/", "cell", part("y"), part("x"))}), "dense-places")
        boxes = held.groupBy("parent", "cell").agg(
            F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"),
            F.min(F.struct("idx", "lat", "lon")).alias("one"), F.max(F.struct("idx", "lat", "lon")).alias("other"),
        )
        yield leaves, boxes.groupBy(F.col("parent").alias("cell")).agg(F.collect_list(F.struct("cell", "s", "n", "w", "e", "one", "other")).alias("parts")), small
        held = held.drop("parent")


def _nearer(asked: DataFrame, children: DataFrame, small: bool, radius_km: float) -> DataFrame:
    """The parts of cells that can hold a position's nearest place: none is farther than a place that another part is known to hold."""
    met = met_cells(asked, children, ["cell"], small).filter("parts IS NOT NULL").select("_lat", "_lon", "_same", F.explode("parts").alias("c"))
    to = lambda p: F.when(~F.col(p)["idx"].eqNullSafe(F.col("_same")), haversine_km(F.col("_lat"), F.col("_lon"), F.col(p)["lat"], F.col(p)["lon"]))
    up = F.radians(F.greatest(F.col("c.s") - F.col("_lat"), F.col("_lat") - F.col("c.n"), F.lit(0.0)))
    # The least difference of longitudes, either way round; great circles are no shorter than this says.
    turn = lambda x: F.pmod(x, F.lit(360.0))
    outside = turn(F.col("_lon") - F.col("c.w")) > F.col("c.e") - F.col("c.w")
    across = F.radians(F.when(outside, F.least(turn(F.col("c.w") - F.col("_lon")), turn(F.col("_lon") - F.col("c.e")))).otherwise(0.0))
    thin = F.sqrt(F.cos(F.radians("_lat")) * F.least(F.cos(F.radians("c.s")), F.cos(F.radians("c.n")))) * F.sin(across / 2)
    least = F.greatest(EARTH_KM * up, 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.abs(thin))))
    met = stored(met.select("_lat", "_lon", "_same", F.col("c.cell").alias("cell"), least.alias("least"), F.least(to("c.one"), to("c.other")).alias("most")), "near-parts")
    known = met.groupBy("_lat", "_lon", "_same").agg(F.min("most").alias("known")).withColumnsRenamed({"_lat": "_y", "_lon": "_x", "_same": "_s"})
    same_spot = (F.col("_lat") == F.col("_y")) & (F.col("_lon") == F.col("_x")) & F.col("_same").eqNullSafe(F.col("_s"))
    near = F.col("least") <= F.least(F.coalesce("known", F.lit(radius_km)), F.lit(radius_km)) * (1 + 1e-9) + 1e-6
    return met.join(known, same_spot).filter(near).select("_lat", "_lon", "_same", "cell")


def reverse_lookup(queries: DataFrame, places: DataFrame, reach: float = 0.1) -> DataFrame:
    """The place of a name near a position: query, idx (null for none).

    queries: query, name, lat, lon; places: idx, name, lat, lon, and alt (a map of
    spellings) if there are any. The nearest by the sum of both differences wins.
    """
    names = [places.select("idx", "lat", "lon", fold(F.col("name")).alias("key"))]
    if "alt" in places.columns:
        names.append(places.select("idx", "lat", "lon", F.explode(F.map_values("alt")).alias("key")).withColumn("key", fold(F.col("key"))))
    held = names[0] if len(names) == 1 else names[0].unionByName(names[1])
    asked = queries.select("query", fold(F.col("name")).alias("key"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    off = F.abs(F.col("lat") - F.col("_lat")) + F.abs(F.col("lon") - F.col("_lon"))
    hits = asked.join(held, "key").withColumn("off", off).filter(F.col("off") < reach)
    best = hits.groupBy("query").agg(F.min(F.struct("off", "idx")).alias("best"))
    return queries.select("query").join(best, "query", "left").select("query", F.col("best.idx").alias("idx"))


def _same_spot_step(box: float, refine: bool) -> Callable[[], Callable[..., int | None]]:
    """For the places of one folded name in order: the number of the one that each row falls to, its own if none."""

    def make() -> Callable[..., int]:
        cells: dict[tuple[int, int], dict[int, tuple[float, float]]] = {}
        n = -1

        def step(is_known: bool, lat: float, lon: float) -> int:
            nonlocal n
            n += 1
            r, c = math.floor(lat / box), math.floor(lon / box)
            around = [((i, j), cells.get((i, j), {})) for i in (r - 1, r, r + 1) for j in (c - 1, c, c + 1)]
            near = [(k, cell) for cell, held in around for k, (y, x) in held.items() if abs(y - lat) < box and abs(x - lon) < box]
            hit, cell = min(near) if near and not is_known else (n, None)
            if cell is None or refine:
                if cell is not None:
                    del cells[cell][hit]
                cells.setdefault((r, c), {})[hit] = lat, lon
            return hit

        return step

    return make


def _absorbed(known: DataFrame, batch: DataFrame, box: float, refine: bool) -> DataFrame:
    """Known places and rows of a batch with key, at (order in the key), to (``at`` of the place that holds the row)."""
    fine = "name <> '' AND lat IS NOT NULL AND lon IS NOT NULL"
    extra = [c for c in ("pop", "cc") if c in known.columns and c in batch.columns]
    long = lambda c: F.col(c).cast("long")
    held = known.filter(fine).select(long("idx").alias("idx"), F.lit(None).cast("long").alias("ord"), "name", "lat", "lon", *extra)
    rows = held.unionByName(batch.filter(fine).select(F.lit(None).cast("long").alias("idx"), long("ord").alias("ord"), "name", "lat", "lon", *extra))
    rows = rows.withColumns({"key": fold(F.col("name")), "_known": F.col("idx").isNotNull()})
    # Known places come first, so a row's number among its key is its place in this order.
    at = F.row_number().over(Window.partitionBy("key").orderBy(F.col("idx").asc_nulls_last(), "ord")) - 1
    numbered = fold_rows(rows, "key", [F.col("idx").asc_nulls_last(), "ord"], ["_known", "lat", "lon"], _same_spot_step(box, refine), "to")
    return numbered.withColumn("at", at)


def new_places(known: DataFrame, batch: DataFrame, box: float = 0.05) -> DataFrame:
    """A batch (ord, name, lat, lon) against known places (idx, name, lat, lon): ord, is_new, idx.

    A row is a duplicate of a place with the same folded name whose latitude and
    longitude both lie within the box; the first such place is named. Rows of the
    batch also absorb later ones.
    """
    rows = _absorbed(known, batch, box, refine=False)
    places = rows.filter("_known").select("key", F.col("at").alias("to"), F.col("idx").alias("place"))
    judged = rows.filter("NOT _known").join(places, ["key", "to"], "left")
    return judged.select("ord", (F.col("at") == F.col("to")).alias("is_new"), F.col("place").alias("idx"))


def refine_places(known: DataFrame, batch: DataFrame, box: float = 0.05) -> DataFrame:
    """The gazetteer after a batch that may correct it: idx (null for new), first_ord, name, lat, lon, pop, cc.

    A row that falls to a place moves and renames it; later rows are compared with
    where it is then. The larger population stays, and the first country code.
    """
    rows = _absorbed(known, batch, box, refine=True)
    last = F.max_by(F.struct("name", "lat", "lon"), F.col("at")).alias("last")
    codes = F.filter(F.array_sort(F.collect_list(F.struct("at", "cc"))), lambda x: F.coalesce(x["cc"], F.lit("")) != "")
    grouped = rows.groupBy("key", "to").agg(F.max("idx").alias("idx"), F.min("ord").alias("first_ord"), last, F.max(F.coalesce("pop", F.lit(0.0))).alias("pop"), codes.alias("codes"))
    first = F.when(F.col("idx").isNull(), F.col("first_ord"))
    return grouped.select("idx", first.alias("first_ord"), "last.name", "last.lat", "last.lon", "pop", F.coalesce(F.try_element_at("codes", F.lit(1))["cc"], F.lit("")).alias("cc"))


def _parts(text: Column, n: int | Column) -> Column:
    """All pieces of n characters of a text."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, n)))


def _grams(form: Column) -> Column:
    """Pieces of one, two and three characters, of those that the text has."""
    none = F.array().cast("array<string>")
    return F.flatten(F.array(*[F.when(F.length(form) >= n, _parts(form, n)).otherwise(none) for n in (1, 2, 3)]))


def _one_off(text: Column) -> Column:
    """A text and what is left of it without one character: texts one edit apart share one of these."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    left = F.transform(places, lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1)))
    return F.array_distinct(F.concat(F.array(text), left))


#: Rows of a side up to which it is sent to every task, by count.
FEW_ROWS = 200_000


def _if_few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(FEW_ROWS + 1).count() <= FEW_ROWS else rows


def best_of_each(rows: DataFrame, key: list[str], order: list[Column | str], most: Column | int, salt: Column | None = None, salts: int = 1) -> DataFrame:
    """The first ``most`` rows of each key, with rank.

    Each task keeps its own best of a key before any rows meet. With salts the best of
    shares of a key are found first, so that no task gets what all tasks kept of one.
    """
    if salts > 1:
        part = F.row_number().over(Window.partitionBy(*key, F.pmod(salt, F.lit(salts))).orderBy(*order))
        rows = rows.withColumn("rank", part).filter(F.col("rank") <= most).drop("rank")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= most)


def search(queries: DataFrame, places: DataFrame, aliases: DataFrame, limit: int = 8, least: int = 3) -> DataFrame:
    """Ranked matches of each query: query, rank, idx, tier.

    Tiers: 0 a name or other spelling begins with the query (equal names first), 1
    the query is an alias, 2 a name contains it, 3 it is one edit away. The last
    counts only for queries of three letters or more that match fewer than three
    rows otherwise. Within a tier larger places come first, then lower idx.

    All joins have keys: of a query's pieces of three characters it meets the names
    that hold the rarest, by counted postings, and for typos those that share a
    deletion with it. A place is judged with all its spellings at once, so each match
    is one row, and a task keeps ``limit`` of them for each query. What is broadcast is
    counted first: Spark goes by the bytes of compressed files, and would send all pieces
    of all names through the driver. A hint to merge yields to a broadcast of the other side.
    """
    asked = queries.select("query", fold(F.col("query")).alias("q")).filter("q <> ''").distinct()
    forms = F.array(fold(F.col("name")))
    if "alt" in places.columns:
        forms = F.array_distinct(F.concat(forms, F.coalesce(F.transform(F.map_values("alt"), fold), F.array().cast("array<string>"))))
    held = places.select("idx", "pop", fold(F.col("name")).alias("key"), forms.alias("forms"))

    pieces = asked.withColumn("gram", F.explode(_parts(F.col("q"), F.least(F.lit(3), F.length("q")))))
    wanted = _if_few(pieces.select("gram").distinct())
    every = F.array_distinct(F.flatten(F.transform("forms", _grams)))
    postings = held.select("idx", "pop", "key", "forms", F.explode(every).alias("gram")).join(wanted, "gram", "left_semi")
    counted = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = pieces.join(counted, "gram", "left").groupBy("query", "q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    rarest = stored(rarest.filter("r.n > 0").select("query", "q", F.col("r.gram").alias("gram")), "rarest-pieces")

    def direct_tier(q: Column, of: Column) -> Column:
        begins, holds = F.exists(of, lambda f: f.startswith(q)), F.exists(of, lambda f: f.contains(q))
        return F.when(begins, 0).when(holds, 2)

    direct = postings.hint("merge").join(_if_few(rarest), "gram").withColumn("tier", direct_tier(F.col("q"), F.col("forms"))).filter("tier IS NOT NULL")
    direct = direct.select("query", "q", "idx", "pop", "key", "tier")
    # Names are looked at before aliases: a row that holds the query stays there.
    named = aliases.select(fold(F.col("alias")).alias("q"), fold(F.col("name")).alias("target")).distinct()
    meant = _if_few(asked.join(named, "q"))
    first = held.join(_if_few(meant.select(F.col("target").alias("key")).distinct()), "key", "left_semi").groupBy("key").agg(F.min(F.struct("idx", "pop", "forms")).alias("p"))
    by_alias = meant.join(first, F.col("target") == F.col("key")).filter(direct_tier(F.col("q"), F.col("p.forms")).isNull())
    by_alias = by_alias.select("query", "q", "p.idx", "p.pop", "key", F.lit(1).alias("tier"))
    exact = ((F.col("tier") == 0) & (F.col("key") == F.col("q"))).cast("int")
    order = ["tier", exact.desc(), F.desc("pop"), "idx"]
    # The best rows also say which queries have few: of those they are all.
    best = stored(best_of_each(direct.unionByName(by_alias), ["query"], order, max(limit, least)).drop("rank"), "matches")
    few = asked.filter(F.length("q") >= 3).join(best.groupBy("query").agg(F.count(F.lit(1)).alias("hits")).hint("merge"), "query", "left").filter(F.coalesce("hits", F.lit(0)) < least)
    off = few.select("query", "q", F.explode(_one_off(F.col("q"))).alias("_left"))
    near = held.withColumn("_left", F.explode(_one_off(F.col("key")))).hint("merge").join(_if_few(off), "_left").filter(within_one_edit(F.col("q"), F.col("key")))
    near = near.select("query", "q", "idx", "pop", "key").distinct().join(best.select("query", "idx").hint("merge"), ["query", "idx"], "left_anti").withColumn("tier", F.lit(3))
    return best_of_each(best.unionByName(near), ["query"], order, limit).select("query", "rank", "idx", "tier")


def _cap(zoom: Column) -> Column:
    out = F.lit(CAPS[-1][1])
    for most, n in reversed(CAPS):
        out = F.when(zoom < most, n).otherwise(out)
    return out


#: Views of a tile, and rows that always show; rows of one score that a tile compares with its views, and rows that it keeps of them.
VIEW_BLOCK, ROW_BLOCK, TIED_BLOCK, KEPT = 4096, 4096, 65_536, 1_000_000


def _in_tiles(left: DataFrame, right: DataFrame, i: tuple[str, int], j: tuple[str, int], keys: list[str] | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides dealt into tiles, in which each pair meets once: ``left`` in i parts by a column, ``right`` in j, each copied for all parts of the other."""
    part = lambda by: F.pmod(F.xxhash64(by[0]), F.lit(by[1]))
    every = lambda by: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(by[1] - 1).cast("long")))
    tile = [*(keys or []), "_i", "_j"]
    dealt = left.withColumn("_i", part(i)).withColumn("_j", every(j)), right.withColumn("_j", part(j)).withColumn("_i", every(i))
    # A number of partitions of its own: few bytes go in and many rows come out, so tiles are not to be put together.
    return *(x.repartition(min(4096, i[1] * j[1]), *tile) for x in dealt), tile


def _nearest(views: DataFrame, tied: DataFrame, left: dict[int, int], counts: dict[int, int], most_tied: int) -> DataFrame:
    """Of rows (cap, ord, lat, lon) the ``left`` nearest to each view of a cap: view, ord."""
    parts = max(math.ceil(n / max(1, min(VIEW_BLOCK, KEPT // left[cap]))) for cap, n in counts.items())
    chunks = max(1, math.ceil(most_tied / TIED_BLOCK))
    asked, rows, tile = _in_tiles(views.select("view", "lat", "lon", "cap"), tied, ("view", parts), ("ord", chunks), ["cap"])
    schema = StructType([views.schema["view"], tied.schema["ord"], StructField("off", DoubleType()), StructField("cap", views.schema["cap"].dataType)])

    def run(key: tuple, own: pa.Table, held: pa.Table) -> pa.Table:
        most, found, offs = left[key[0].as_py()], [], []
        lat, lon, names = held.column("lat").to_numpy(), held.column("lon").to_numpy(), held.column("ord").to_numpy()
        for y, x in zip(own.column("lat").to_numpy(), own.column("lon").to_numpy(), strict=True):
            off = (lat - y) * (lat - y) + (lon - x) * (lon - x)
            near = np.flatnonzero(off <= np.partition(off, most - 1)[most - 1]) if len(off) > most else np.arange(len(off))
            near = near[np.lexsort((names[near], off[near]))[:most]]
            found.append(near)
            offs.append(off[near])
        view = own.column("view").take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
        at = pa.array(np.concatenate([np.zeros(0, int), *found]))
        return pa.table([view, held.column("ord").take(at), pa.array(np.concatenate([np.zeros(0), *offs])), pa.array([key[0].as_py()] * len(at), own.schema.field("cap").type)], schema.names)

    kept = asked.groupBy(*tile).cogroup(rows.groupBy(*tile)).applyInArrow(run, schema)
    if chunks > 1:
        most = F.create_map(*[F.lit(x) for pair in left.items() for x in pair])[F.col("cap")]
        kept = best_of_each(kept, ["view"], ["off", "ord"], most, F.xxhash64("ord"), 16)
    return kept.select("view", "ord")


def density_budgets(candidates: DataFrame, views: DataFrame) -> DataFrame:
    """What each of many views shows: view, ord, exempt. candidates: ord, lat, lon, score, exempt; views: view, lat, lon, zoom.

    Exempt rows always show; of the rest the best by score, then by nearness to the
    view's centre, up to the zoom's cap. Scores are the same for all views, so for each
    cap one order with a limit tells the score at which it is full: rows above show in
    every view of that cap, and rows below in none. Only rows of just that score are
    compared with the views, in tiles of some of both. The driver gets counts alone, and
    the plan is the same for any number of views.

    A missing score is 0, a missing position that of 0, 0, a missing zoom the closest view's.
    """
    rows = candidates.select("ord", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("lat", "lon", "score")], F.coalesce("exempt", F.lit(False)).alias("exempt"))
    asked = views.select("view", F.coalesce("lat", F.lit(0.0)).alias("lat"), F.coalesce("lon", F.lit(0.0)).alias("lon"), _cap(F.coalesce("zoom", F.lit(99.0))).alias("cap"))
    free, exempt = rows.filter("NOT exempt"), rows.filter("exempt").select("ord")
    counts = {r["cap"]: r["count"] for r in asked.groupBy("cap").count().collect()}
    full = {cap: free.select("score").orderBy(F.desc("score")).limit(cap).agg(F.min("score")).first()[0] for cap in sorted(counts)}
    full = {cap: last for cap, last in full.items() if last is not None}
    parts = max(1, math.ceil(sum(counts.values()) / VIEW_BLOCK))

    every, always, tile = _in_tiles(asked.select("view"), exempt, ("view", parts), ("ord", max(1, math.ceil(exempt.count() / ROW_BLOCK))))
    out = every.join(always.hint("merge"), tile).select("view", "ord", F.lit(True).alias("exempt"))
    if not full:
        return out
    # Rows by the caps in which they rank above the score that fills them, or just there.
    bounds = F.array(*[F.struct(F.lit(cap).alias("cap"), F.lit(last).alias("last")) for cap, last in full.items()])
    met = lambda test: free.withColumn("c", F.explode(F.filter(bounds, test))).select("c.cap", "ord", "lat", "lon")
    above, tied = met(lambda c: F.col("score") > c["last"]), met(lambda c: F.col("score") == c["last"])
    higher, level = ({r["cap"]: r["count"] for r in x.groupBy("cap").count().collect()} for x in (above, tied))
    shown = asked.repartition(parts, "view").join(F.broadcast(above.select("cap", "ord")), "cap").select("view", "ord")
    near = _nearest(asked, tied, {cap: cap - higher.get(cap, 0) for cap in full}, counts, max(level.values()))
    return out.unionByName(shown.unionByName(near).withColumn("exempt", F.lit(False)))


def density_budget(candidates: DataFrame, lat: float, lon: float, zoom: float) -> DataFrame:
    """What one view shows: ord, exempt. See ``density_budgets``.

    A top-k by order and limit keeps at most the cap in each task before any rows meet.
    """
    off = F.pow(F.coalesce("lat", F.lit(0.0)) - lat, 2) + F.pow(F.coalesce("lon", F.lit(0.0)) - lon, 2)
    free = F.coalesce("exempt", F.lit(False))
    cap = next((n for most, n in CAPS if zoom < most), CAPS[-1][1])
    shown = candidates.filter(~free).orderBy(F.desc(F.coalesce("score", F.lit(0.0))), off, "ord").limit(cap)
    return candidates.filter(free).select("ord", F.lit(True).alias("exempt")).unionByName(shown.select("ord", F.lit(False).alias("exempt")))
