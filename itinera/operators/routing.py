"""Routes that keep to their medium.

Legs are made distinct by a route key before anything is searched, and only those
whose straight path is blocked are. Each gets the polygons near it by a cell join
and is searched on its own grid in an Arrow function; a leg's grid is bounded, and
legs are independent, so the work spreads over tasks.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itinera.operators.covering import Covering, cover
from itinera.operators.folds import km_between
from itinera.operators.land import crosses, crosses_terrain, modality, on_land, polygons_near
from itinera.operators.legs import vertices
from itinera.sources.storage import stored

#: Grid cell, cells at most, padding of the box, snap rings, tolerance of a simplified path.
CELL, MOST_CELLS, PAD, PAD_SHARE, SNAP_RINGS, TOLERANCE = 0.08, 14_400, 1.6, 0.8, 2, 0.06
#: Degrees between the points by which a piece of a route is tested.
STRIDE = 0.08
#: Finer grids that a land route is tried on when the first finds no way.
FINER = ((0.04, 90_000), (0.02, 90_000))
#: Cost of a cell beside the other medium: ships hug the coast, roads avoid it.
EDGE_COST = {"sea": 0.92, "land": 1.04}
#: Cost of terrain from which on a road is led around it, and how it weighs on a way.
STEEP, TOLL = 0.35, 5

Terrain = Callable[[float, float], float | None]

Point = tuple[float, float]


def _km(a: Point, b: Point) -> float:
    return km_between(a[1], a[0], b[1], b[0])


def staying(path: list[Point], open_: Callable[[np.ndarray, np.ndarray], np.ndarray], step: float = STRIDE) -> list[bool]:
    """Whether the inside of each straight piece of a path stays in the medium."""
    pieces = list(itertools.pairwise(path))
    sizes = [max(1, math.ceil(math.hypot(b[0] - a[0], b[1] - a[1]) / step)) for a, b in pieces]
    shares = [np.arange(1, n) / n for n in sizes]
    lons, lats = (np.concatenate([a[i] + (b[i] - a[i]) * f for (a, b), f in zip(pieces, shares, strict=True)]) for i in (0, 1))
    return [bool(x.all()) for x in np.split(open_(lons, lats), np.cumsum(np.array(sizes) - 1)[:-1])]


def stays(a: Point, b: Point, open_: Callable[[np.ndarray, np.ndarray], np.ndarray], step: float = STRIDE) -> bool:
    """Whether the inside of a straight piece stays in the medium."""
    return staying([a, b], open_, step)[0]


#: Steps to the eight neighbours; step 7 - k leads back from step k.
STEPS = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))


def _shifted(shape: tuple[int, ...], dr: int, dc: int) -> tuple[tuple[slice, slice], tuple[slice, slice]]:
    """The cells that have a neighbour at a step, and these neighbours."""
    rows, columns = shape
    here = slice(max(0, -dr), rows - max(0, dr)), slice(max(0, -dc), columns - max(0, dc))
    there = slice(max(0, dr), rows - max(0, -dr)), slice(max(0, dc), columns - max(0, -dc))
    return here, there


class Grid:
    """Cells over the padded box of two ends (lon, lat), open where the medium is."""

    def __init__(self, a: Point, b: Point, open_, cell: float = CELL, most: int = MOST_CELLS):
        pads = [max(PAD, abs(a[i] - b[i]) * PAD_SHARE) for i in (0, 1)]
        low, high = ([f(a[i], b[i]) + d * pads[i] for i in (0, 1)] for f, d in ((min, -1), (max, 1)))
        size = [max(24, math.ceil((high[i] - low[i]) / cell) + 1) for i in (0, 1)]
        if size[0] * size[1] > most:
            k = math.sqrt(most / (size[0] * size[1]))
            size = [max(24, math.floor(n * k)) for n in size]
        self.low, self.step, self.size = low, [(high[i] - low[i]) / (size[i] - 1) for i in (0, 1)], size
        self.lons, self.lats = (low[i] + np.arange(size[i]) * self.step[i] for i in (0, 1))
        grid = np.meshgrid(self.lons, self.lats)
        self.open = open_(grid[0].ravel(), grid[1].ravel()).reshape(size[1], size[0])
        padded = np.pad(~self.open, 1)
        around = [padded[1 + r : 1 + r + size[1], 1 + c : 1 + c + size[0]] for r in (-1, 0, 1) for c in (-1, 0, 1)]
        self.edge = self.open & np.logical_or.reduce(around)
        # moves[r, c, k]: whether step k stays in the medium and squeezes between no two closed corners.
        self.moves = np.zeros((*self.open.shape, len(STEPS)), bool)
        half = min(self.step) * 0.5
        for k, (dr, dc) in enumerate(STEPS[:4]):
            here, there = _shifted(self.open.shape, dr, dc)
            free = self.open[here] & self.open[there]
            if dr and dc:
                free &= self.open[here[0], there[1]] | self.open[there[0], here[1]]
            n = max(1, math.ceil(math.hypot(dr * self.step[1], dc * self.step[0]) / half))
            lons, lats = (x[free] for x in (grid[0][here], grid[1][here]))
            ok = np.ones(len(lons), bool)
            for i in range(1, n):
                ok &= open_(lons + dc * self.step[0] * i / n, lats + dr * self.step[1] * i / n)
            free[free] = ok
            self.moves[(*here, k)] = free
            self.moves[(*there, 7 - k)] = free

    def reaches(self, start: tuple[int, int], goal: tuple[int, int]) -> bool:
        """Whether any way joins two cells."""
        seen = np.zeros(self.open.shape, bool)
        seen[start] = True
        while not seen[goal]:
            grown = seen.copy()
            for k, (dr, dc) in enumerate(STEPS):
                here, there = _shifted(seen.shape, dr, dc)
                grown[there] |= seen[here] & self.moves[(*here, k)]
            if (grown == seen).all():
                return False
            seen = grown
        return True

    def close(self, here: tuple[int, int], there: tuple[int, int]) -> None:
        """Take the step between two neighbours away."""
        k = STEPS.index((there[0] - here[0], there[1] - here[1]))
        self.moves[(*here, k)] = self.moves[(*there, 7 - k)] = False

    def point(self, cell: tuple[int, int]) -> Point:
        return float(self.lons[cell[1]]), float(self.lats[cell[0]])

    def snap(self, p: Point, rings: int = SNAP_RINGS) -> tuple[int, int] | None:
        """The open cell of a point, or the first open one in the rings around it."""
        c, r = (min(self.size[i] - 1, max(0, math.floor((p[i] - self.low[i]) / self.step[i] + 0.5))) for i in (0, 1))
        for k in range(rings + 1):
            for dr in range(-k, k + 1):
                for dc in range(-k, k + 1):
                    inside = 0 <= r + dr < self.size[1] and 0 <= c + dc < self.size[0]
                    if max(abs(dr), abs(dc)) == k and inside and self.open[r + dr, c + dc]:
                        return r + dr, c + dc
        return None


def find_path(a: Point, b: Point, open_, medium: str, cell: float = CELL, most: int = MOST_CELLS, terrain: Terrain | None = None) -> list[Point] | None:
    """A way between two ends (lon, lat) over open cells by A*, or None."""
    grid = Grid(a, b, open_, cell, most)
    start, goal = grid.snap(a), grid.snap(b)
    if start is None or goal is None or start == goal:
        return None
    while grid.reaches(start, goal):
        cells = _cheapest(grid, start, goal, medium, terrain)
        way = [grid.point(c) for c in cells]
        # A route's pieces are tested by other points than the grid's moves, which may miss a corner.
        off = [ends for ends, ok in zip(itertools.pairwise(cells), staying(way, open_), strict=True) if not ok]
        if not off:
            return way
        for here, there in off:
            grid.close(here, there)
    return None


def _cheapest(grid: Grid, start: tuple[int, int], goal: tuple[int, int], medium: str, terrain: Terrain | None) -> list[tuple[int, int]]:
    """The cells of the cheapest way between two that a way joins."""
    end = grid.point(goal)
    cost, came, done = {start: 0.0}, {start: None}, set()
    queue = [(_km(grid.point(start), end), 0, start)]
    while queue:
        _, _, here = heapq.heappop(queue)
        if here == goal:
            way = []
            while here is not None:
                way.append(here)
                here = came[here]
            return way[::-1]
        if here in done:
            continue
        done.add(here)
        at = grid.point(here)
        for k in np.nonzero(grid.moves[here])[0].tolist():
            there = here[0] + STEPS[k][0], here[1] + STEPS[k][1]
            if there in done:
                continue
            to = grid.point(there)
            price = _km(at, to) * (EDGE_COST[medium] if grid.edge[there] else 1.0)
            if terrain:
                price *= 1 + TOLL * (terrain(*to) or 0.0)
            if cost[here] + price < cost.get(there, math.inf):
                cost[there], came[there] = cost[here] + price, here
                heapq.heappush(queue, (cost[there] + _km(to, end), len(came), there))
    raise ValueError("no way joins the cells")


def simplify(path: list[Point], open_, tolerance: float = TOLERANCE) -> list[Point]:
    """Leave out points near the line from the last kept one, unless the shortcut leaves the medium."""
    if len(path) < 3:
        return path
    kept = [path[0]]
    for p, after in zip(path[1:-1], path[2:], strict=True):
        x, y = after[0] - kept[-1][0], after[1] - kept[-1][1]
        off = abs((p[0] - kept[-1][0]) * y - (p[1] - kept[-1][1]) * x) / (math.hypot(x, y) or 1e-9)
        if off > tolerance or not stays(kept[-1], after, open_):
            kept.append(p)
    return [*kept, path[-1]]


def is_steep(a: Point, b: Point, terrain: Terrain | None) -> bool:
    """Whether any of nine points inside a piece costs more than a road can take."""
    if terrain is None:
        return False
    return any((terrain(a[0] + (b[0] - a[0]) * i / 10, a[1] + (b[1] - a[1]) * i / 10) or 0.0) > STEEP for i in range(1, 10))


def route(path: list[Point], polygons: list, medium: str, terrain: Terrain | None = None) -> list[Point]:
    """The path with every blocked piece led around; pieces without a way stay straight.

    A piece is blocked if it leaves its medium, or on land if terrain costs too much.
    """
    land = medium == "land"

    def open_(lons: np.ndarray, lats: np.ndarray) -> np.ndarray:
        return on_land(lons, lats, polygons) == land

    out = [path[0]]
    for a, b in zip(path[:-1], path[1:], strict=True):
        if not stays(a, b, open_, 8 / 111) or (land and is_steep(a, b, terrain)):
            way = find_path(a, b, open_, medium, terrain=terrain)
            for cell, most in FINER if land else ():
                way = way or find_path(a, b, open_, medium, cell, most, terrain)
            near = lambda p, q: abs(p[0] - q[0]) < 1e-4 and abs(p[1] - q[1]) < 1e-4
            out += [p for p in simplify(way or [], open_) if not near(p, a) and not near(p, b)]
        out.append(b)
    return out


def keeps_medium(path: list[Point], straight: list[Point], polygons: list, medium: str) -> bool:
    """Whether a route leaves its medium nowhere but on its straight pieces and next to their ends."""
    own = set(straight)

    def open_(lons: np.ndarray, lats: np.ndarray) -> np.ndarray:
        return on_land(lons, lats, polygons) == (medium == "land")

    return all(a in own or b in own or ok for (a, b), ok in zip(itertools.pairwise(path), staying(path, open_), strict=True))


def route_key(path: Column) -> Column:
    """Paths that agree to four decimals at the ends and three between share a route."""
    fine = lambda p, d: F.concat_ws(",", F.format_number(p["lat"], d), F.format_number(p["lon"], d))
    n = F.size(path)
    inner = F.transform(F.slice(path, 2, F.greatest(n - 2, F.lit(0))), lambda p: fine(p, 3))
    return F.concat_ws("|", fine(path[0], 4), F.array_join(inner, "_"), fine(F.element_at(path, -1), 4))


MEMO = "key string, medium string, version long, way array<struct<lat: double, lon: double>>, kept boolean, run int"


def _memo(spark: SparkSession, path: str, medium: str) -> DataFrame:
    """The stored routes of a medium: key, version, way, kept, run. Of a route that two runs stored at once one counts."""
    try:
        rows = spark.read.schema(MEMO).parquet(path)
    except AnalysisException as cause:
        if cause.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], MEMO)
    return rows.filter(F.col("medium") == medium).groupBy("key", "version").agg(F.min_by(F.struct("way", "kept", "run"), "run").alias("x")).select("key", "version", "x.*")


def route_legs(
    legs: DataFrame,
    land: DataFrame | Covering,
    medium: str,
    terrain: Terrain | None = None,
    terrain_column: Callable[[Column, Column], Column] | None = None,
    memo: str | None = None,
    terrain_version: str = "",
) -> DataFrame:
    """trip, leg, routed, path (array of lat, lon), kept, run for the legs of one medium: ``sea`` or ``land``.

    ``terrain`` gives the cost of a position (lon, lat) for land routes, and
    ``terrain_column`` the same as a column, by which legs over steep terrain are
    found. ``kept`` tells that the search left the medium nowhere.

    ``memo`` is a table that keeps routes by key and version, which is a hash of the
    land near the leg (and ``terrain_version``): only routes that it lacks are searched,
    and added. So a second run searches none, and a changed coast those near the change.
    ``run`` says which run found a route (null without memo).
    """
    land = cover(land)
    wanted = {"sea": "boat", "land": "land"}[medium]
    via = F.col("via") if "via" in legs.columns else F.lit(None).cast("array<struct<lat: double, lon: double>>")
    own = legs.filter(modality(F.col("vehicle")) == wanted)
    own = own.withColumn("path", vertices(F.col("from_lat"), F.col("from_lon"), via, F.col("to_lat"), F.col("to_lon")))
    own = own.withColumn("key", route_key(F.col("path")))
    # One leg stands for all with its key.
    distinct = own.groupBy("key").agg(F.min_by(F.struct("trip", "leg", "path", "from_lat", "from_lon", "to_lat", "to_lon"), F.struct("trip", "leg")).alias("x"))
    distinct = distinct.select("key", "x.*")
    hit = crosses(distinct.withColumn("via", F.slice("path", 2, F.size("path") - 2)), land, "land" if medium == "sea" else "water")
    if medium == "land" and terrain_column is not None:
        steep = distinct.select("trip", "leg", crosses_terrain(F.col("path"), terrain_column, STEEP).alias("crosses"))
        hit = hit.unionByName(steep)
    blocked = distinct.join(hit.filter("crosses"), ["trip", "leg"], "left_semi").select("key", "path")

    # Polygons near a leg: by the degree cells of its padded box.
    reach = lambda axis, f: f(F.transform("path", lambda p: p[axis]))
    pad = lambda axis: F.greatest(F.lit(PAD), (reach(axis, F.array_max) - reach(axis, F.array_min)) * PAD_SHARE)
    box = blocked.select(
        "key", (reach("lat", F.array_min) - pad("lat")).alias("s"), (reach("lat", F.array_max) + pad("lat")).alias("n"),
        (reach("lon", F.array_min) - pad("lon")).alias("w"), (reach("lon", F.array_max) + pad("lon")).alias("e"),
    )
    near = polygons_near(box, "key", land.polygons, pad=0.0)

    kind = pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, kept = [], []
            for path, polygons in zip(batch.column("path").to_pylist(), batch.column("polygons").to_pylist(), strict=True):
                rings = [[[(p["lon"], p["lat"]) for p in r] for r in x] for x in polygons or []]
                straight = [(p["lon"], p["lat"]) for p in path]
                way = route(straight, rings, medium, terrain)
                out.append([{"lat": lat, "lon": lon} for lon, lat in way])
                kept.append(keeps_medium(way, straight, rings, medium))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, kind), pa.array(kept, pa.bool_())], ["key", "way", "kept"])

    spark = legs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    work, run_number = blocked.join(near, "key", "left"), F.lit(None).cast("int")

    def searched(rows: DataFrame) -> DataFrame:  # searches are long: spread them, however few bytes they are
        return rows.repartition(tasks, "key").mapInArrow(run, "key string, way array<struct<lat: double, lon: double>>, kept boolean")

    if memo is None:
        ways = searched(work.select("key", "path", "polygons")).withColumn("run", run_number)
    else:
        version = F.xxhash64(F.lit(f"{terrain_version}"), F.coalesce("polygons", F.array().cast(near.schema["polygons"].dataType)))
        work = stored(work.withColumn("version", version), "route-work")
        held = _memo(spark, memo, medium)
        lacking = work.join(held, ["key", "version"], "left_anti")
        number = (held.agg(F.max("run")).first()[0] or 0) + 1
        found = searched(lacking.select("key", "path", "polygons")).join(lacking.select("key", "version"), "key")
        found.select("key", F.lit(medium).alias("medium"), "version", "way", "kept", F.lit(number).alias("run")).write.mode("append").parquet(memo)
        ways = _memo(spark, memo, medium).join(work.select("key", "version"), ["key", "version"]).drop("version")
    joined = own.join(ways, "key", "left")
    return joined.select("trip", "leg", F.col("way").isNotNull().alias("routed"), F.coalesce("way", "path").alias("path"), F.coalesce("kept", F.lit(True)).alias("kept"), "run")
