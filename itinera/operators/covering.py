"""A multi-level cell covering of polygons: stored once, read by every caller.

Cells are one degree wide at level 0, and one that holds many edges is split into four
until each holds few. For each ring near it a cell has

* the edges that touch its box,
* what lies fully east of it, reduced to a flag and to the latitudes within the cell
  where that flag turns. A run of edges east of a cell is crossed by a ray an odd number
  of times exactly if one of its two ends lies above the ray; so runs leave their ends
  alone, and inner vertices cancel.

So a point is decided in its own cell by the same half-open ray to the east as against
the whole polygon, with the same arithmetic, and a coast costs its edges, whatever their
number: not whole polygons per cell, and not every edge in each cell west of it.

Defined results: points without a position lie in no polygon; rings of fewer than three
points hold none; equal polygons are told apart by ord, of which the least wins; an empty
layer holds nothing. Longitudes are taken as they are, without wrapping.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itinera.sources.storage import still_there, stored

#: Edges and turns of a cell from which on it is split, and the level at which that ends (some 7 m).
MOST_EDGES = 48
MOST_LEVEL = 14
#: Degrees by which an edge must miss a cell to count as beside it: far more than what arithmetic rounds.
MARGIN = 1e-9
#: Edges of a covering up to which it is sent to every task; beyond that points are dealt by cell.
BROADCAST_EDGES = 400_000
#: Share of all points from which on a cell counts as hot: its points then stay where they are.
HOT_SHARE = 0.001

RING = "struct<ord: int, ring: int, polygon: string, base: int, turns: array<double>, edges: array<struct<x1: double, y1: double, x2: double, y2: double>>>"
CELL = f"level int, row long, column long, rings array<{RING}>"


def root_cells(land: DataFrame) -> DataFrame:
    """Polygons (ord, polygon, rings of lon/lat structs) by cell of one degree: row, column, rings."""
    rings = land.select(F.col("ord").cast("int").alias("ord"), "polygon", F.posexplode("rings").alias("ring", "r")).filter("size(r) > 2")
    n = F.size("r")
    before, after = F.concat(F.slice("r", -1, 1), F.slice("r", 1, n - 1)), F.concat(F.slice("r", 2, n - 1), F.slice("r", 1, 1))
    south = F.floor(F.array_min(F.transform("r", lambda p: p["lat"])))
    corner = F.transform(F.arrays_zip(F.col("r").alias("p"), before.alias("q"), after.alias("s")), lambda v: v)
    corners = rings.select("ord", "polygon", "ring", south.alias("south"), F.explode(corner).alias("v"))
    p, q, s = F.col("v.p"), F.col("v.q"), F.col("v.s")
    corners = corners.select(
        "ord", "polygon", "ring", "south",
        p["lon"].alias("x1"), p["lat"].alias("y1"), q["lon"].alias("x2"), q["lat"].alias("y2"),
        F.floor(F.least(p["lon"], q["lon"])).alias("k1"), F.floor(F.least(p["lon"], s["lon"])).alias("k2"),
    )
    edges = corners.filter("y1 <> y2").withColumn("row", F.explode(F.sequence(F.floor(F.least("y1", "y2")), F.floor(F.greatest("y1", "y2")))))
    edges = edges.withColumn("column", F.explode(F.sequence(F.floor(F.least("x1", "x2")), F.floor(F.greatest("x1", "x2")))))
    edges = edges.select("row", "column", "ord", "polygon", "ring", F.struct("x1", "y1", "x2", "y2").alias("edge"), F.lit(0).alias("base"), F.lit(None).cast("double").alias("turn"))
    # A corner between an edge east of some columns and one that is not turns the ray's parity there.
    turns = corners.filter("k1 <> k2").withColumn("column", F.explode(F.sequence(F.least("k1", "k2"), F.greatest("k1", "k2") - 1)))
    turns = turns.withColumn("row", F.explode(F.sequence(F.col("south"), F.floor("y1"))))
    within = F.col("row") == F.floor("y1")
    turns = turns.select(
        "row", "column", "ord", "polygon", "ring", F.lit(None).cast(edges.schema["edge"].dataType).alias("edge"),
        F.when(within, 0).otherwise(1).alias("base"), F.when(within, F.col("y1")).alias("turn"),
    )
    held = edges.unionByName(turns).groupBy("row", "column", "ord", "polygon", "ring")
    held = held.agg((F.sum("base") % 2).cast("int").alias("base"), F.collect_list("turn").alias("turns"), F.collect_list("edge").alias("edges"))
    held = held.filter("base = 1 OR size(turns) > 0 OR size(edges) > 0")
    return held.groupBy("row", "column").agg(F.sort_array(F.collect_list(F.struct("ord", "ring", "polygon", "base", "turns", "edges"))).alias("rings"))


def _child(ring: tuple, w: float, s: float, e: float, n: float) -> tuple | None:
    """What a ring is to a cell within the one that it is given for; None for nothing."""
    order, number, polygon, base, turns, edges = ring
    x1, y1, x2, y2 = edges.T
    low_y, high_y = np.minimum(y1, y2), np.maximum(y1, y2)
    edges, x1, y1, x2, y2, low_y, high_y = (v[(low_y < n) & (high_y > s)] for v in (edges, x1, y1, x2, y2, low_y, high_y))
    # Where an edge is within the cell's latitudes; one that passes the cell by is wholly east or west of it there.
    at = [x1 + (x2 - x1) * (np.clip(y, low_y, high_y) - y1) / (y2 - y1) for y in (s, n)]
    east, west = np.minimum(*at) > e + MARGIN, np.maximum(*at) < w - MARGIN
    turns = np.concatenate((turns, edges[east][:, [1, 3]].ravel()))
    base = (base + int((turns >= n).sum())) % 2
    y, times = np.unique(turns[(turns > s) & (turns < n)], return_counts=True)
    turns = y[times % 2 == 1]
    edges = edges[~east & ~west]
    return (order, number, polygon, base, turns, edges) if base or len(turns) or len(edges) else None


def _leaves(rings: list[tuple], level: int, row: int, column: int, most: int) -> Iterator[tuple[int, int, int, list[tuple]]]:
    if level == MOST_LEVEL or sum(len(r[4]) + len(r[5]) for r in rings) <= most:
        yield level, row, column, rings
        return
    side = 0.5 ** (level + 1)
    for r in (2 * row, 2 * row + 1):
        for c in (2 * column, 2 * column + 1):
            own = [x for ring in rings if (x := _child(ring, c * side, r * side, (c + 1) * side, (r + 1) * side))]
            yield from _leaves(own, level + 1, r, c, most)


def split_cells(roots: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """Cells of every level from those of one degree; of a split one all parts are there, empty ones too."""
    size = F.aggregate("rings", F.lit(0), lambda acc, r: acc + F.size(r["turns"]) + F.size(r["edges"]))
    kind = pa.list_(
        pa.struct([("ord", pa.int32()), ("ring", pa.int32()), ("polygon", pa.string()), ("base", pa.int32()), ("turns", pa.list_(pa.float64())),
                   ("edges", pa.list_(pa.struct([(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")])))])
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, column, rings = (batch.column(c)[i].as_py() for c in ("row", "column", "rings"))
                held = [
                    (x["ord"], x["ring"], x["polygon"], x["base"], np.array(x["turns"], float), np.array([tuple(e.values()) for e in x["edges"]], float).reshape(-1, 4))
                    for x in rings
                ]
                leaves = list(_leaves(held, 0, row, column, most))
                told = [
                    [{"ord": o, "ring": k, "polygon": p, "base": b, "turns": t.tolist(), "edges": [dict(zip(("x1", "y1", "x2", "y2"), e, strict=True)) for e in es.tolist()]} for o, k, p, b, t, es in own]
                    for *_, own in leaves
                ]
                numbers = [pa.array([leaf[k] for leaf in leaves], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*numbers, pa.array(told, kind)], ["level", "row", "column", "rings"])

    few = roots.filter(size <= most).select(F.lit(0).alias("level"), "row", "column", "rings")
    return few.unionByName(roots.filter(size > most).mapInArrow(split, CELL))


@dataclass
class Covering:
    """Cells (level, row, column, rings) of a layer, and by root the deepest level, where there is one beyond 0."""

    polygons: DataFrame
    cells: DataFrame
    depths: DataFrame
    deepest: int
    small: bool

    def exists(self) -> bool:
        return still_there(self.cells) and still_there(self.depths)


def cover(land: DataFrame | Covering, most: int = MOST_EDGES) -> Covering:
    """The stored covering of a layer: polygons with ord, polygon, rings (of lon/lat structs). One that is made stays."""
    if isinstance(land, Covering):
        return land
    cells = stored(split_cells(root_cells(land), most), "covering")
    root = lambda c: F.expr(f"shiftright({c}, level)")
    depths = stored(cells.filter("level > 0").groupBy(root("row").alias("_row"), root("column").alias("_column")).agg(F.max("level").alias("_depth")), "depths")
    edges, deepest = cells.agg(F.sum(F.aggregate("rings", F.lit(1), lambda acc, r: acc + F.size(r["edges"]) + F.size(r["turns"]))), F.max("level")).first()
    return Covering(land, cells, depths, deepest or 0, (edges or 0) <= BROADCAST_EDGES)


def met_cells(points: DataFrame, cells: DataFrame, key: list[str], small: bool) -> DataFrame:
    """Left join of points with one row a cell. A cell that many points are in doesn't become one task."""
    if small:
        return points.join(F.broadcast(cells), key, "left")
    counted = stored(points.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")), "points-by-cell")
    total = counted.agg(F.sum("_n")).first()[0] or 0
    hot = F.broadcast(counted.filter(F.col("_n") > max(1, int(total * HOT_SHARE))).drop("_n"))
    apart = points.join(hot, key, "left_anti")
    there = points.join(hot, key, "left_semi")
    return there.join(F.broadcast(cells.join(hot, key, "left_semi")), key, "left").unionByName(apart.join(cells, key, "left"))


def locate(points: DataFrame, land: DataFrame | Covering, out: str = "landmass", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add the first polygon that holds each point, holes left out; null for water."""
    index = cover(land)
    y, x = F.col(lat), F.col(lon)
    here = points.withColumns({"_row": F.floor(y), "_column": F.floor(x), "_level": F.lit(0), "_depth": F.lit(0)})
    if index.deepest:
        # A point asks for its cell of each level; of a root that is split one of them exists.
        here = met_cells(here.drop("_depth"), index.depths, ["_row", "_column"], index.small).withColumn("_depth", F.coalesce("_depth", F.lit(0)))
        here = here.withColumn("_level", F.explode(F.sequence(F.when(F.col("_depth") > 0, 1).otherwise(0), F.col("_depth"))))
        scale = F.pow(F.lit(2.0), F.col("_level"))
        here = here.withColumns({"_row": F.floor(y * scale), "_column": F.floor(x * scale)})
    cells = index.cells.select(F.col("level").alias("_level"), F.col("row").alias("_row"), F.col("column").alias("_column"), F.col("rings").alias("_rings"))
    met = met_cells(here, cells, ["_level", "_row", "_column"], index.small).filter("_depth = 0 OR _rings IS NOT NULL")

    def crossed(e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        return spans & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])

    def odd(r: Column) -> Column:
        return (r["base"] + F.size(F.filter(r["turns"], lambda t: t > y)) + F.size(F.filter(r["edges"], crossed))) % 2 == 1

    inside = F.transform(F.filter("_rings", odd), lambda r: F.struct(r["ord"].alias("ord"), r["ring"].alias("ring"), r["polygon"].alias("polygon")))
    first = F.try_element_at(F.filter("_in", lambda r: (r["ring"] == 0) & ~F.exists("_in", lambda h: (h["ord"] == r["ord"]) & (h["ring"] > 0))), F.lit(1))
    return met.withColumn("_in", inside).withColumn(out, first["polygon"]).drop("_level", "_row", "_column", "_depth", "_rings", "_in")


@dataclass
class Finder:
    """A covering's cells as arrays, by which many points are looked up in a task, as ``locate`` does by joins."""

    levels: list[tuple[int, np.ndarray, np.ndarray]]
    rings: np.ndarray
    ring: dict[str, np.ndarray]
    turns: tuple[np.ndarray, np.ndarray]
    edges: tuple[np.ndarray, np.ndarray]

    def on_land(self, lons: np.ndarray, lats: np.ndarray) -> np.ndarray:
        """Whether each point lies in any polygon, by the same arithmetic as ``locate``."""
        cell, out = np.full(lons.shape, -1), np.zeros(lons.shape, bool)
        for level, keys, numbers in self.levels:
            own = _cell_keys(np.floor(lats * 2.0**level).astype(np.int64), np.floor(lons * 2.0**level).astype(np.int64))
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            cell = np.where(keys[at] == own, numbers[at], cell)
        order = np.argsort(cell, kind="stable")
        starts = np.flatnonzero(np.diff(cell[order], prepend=-2))
        for start, end in zip(starts, [*starts[1:], len(order)], strict=True):
            points = order[start:end]
            if (k := cell[points[0]]) >= 0:
                out[points] = self._inside(k, lons[points], lats[points])
        return out

    def _inside(self, cell: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        held: dict[int, list] = {}
        for r in range(self.rings[cell], self.rings[cell + 1]):
            turns = self.turns[1][self.turns[0][r] : self.turns[0][r + 1]]
            odd = np.full(x.shape, self.ring["base"][r] % 2 == 1)
            for t in turns:
                odd ^= t > y
            for x1, y1, x2, y2 in self.edges[1][self.edges[0][r] : self.edges[0][r + 1]]:
                odd ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            outer, hole = held.setdefault(int(self.ring["ord"][r]), [np.zeros(x.shape, bool), np.zeros(x.shape, bool)])
            np.logical_or(hole if self.ring["ring"][r] else outer, odd, out=hole if self.ring["ring"][r] else outer)
        return np.logical_or.reduce([outer & ~hole for outer, hole in held.values()]) if held else np.zeros(x.shape, bool)


def _cell_keys(row: np.ndarray, column: np.ndarray) -> np.ndarray:
    return row * 2**32 + column


def finder(index: Covering) -> Finder:
    """The finder of a small covering; it goes to every task."""
    kind = pa.list_(pa.struct([("ord", pa.int32()), ("ring", pa.int32()), ("base", pa.int32()), ("turns", pa.list_(pa.float64())), ("edges", pa.list_(pa.list_(pa.float64())))]))
    flat = F.transform("rings", lambda r: F.struct(r["ord"].alias("ord"), r["ring"].alias("ring"), r["base"].alias("base"), r["turns"].alias("turns"), F.transform(r["edges"], lambda e: F.array(e["x1"], e["y1"], e["x2"], e["y2"])).alias("edges")))
    table = index.cells.select("level", "row", "column", flat.alias("rings")).toArrow()
    level, row, column = (table.column(c).to_numpy().astype(np.int64) for c in ("level", "row", "column"))
    rings = pa.concat_arrays([*table.column("rings").cast(kind).chunks, pa.array([], kind)])
    ring = rings.values
    turns, edges = ring.field("turns"), ring.field("edges")
    levels = []
    for n in np.unique(level):
        numbers = np.flatnonzero(level == n)
        keys = _cell_keys(row[numbers], column[numbers])
        order = np.argsort(keys)
        levels.append((int(n), keys[order], numbers[order]))
    fields = {c: ring.field(c).to_numpy() for c in ("ord", "ring", "base")}
    return Finder(levels, rings.offsets.to_numpy(), fields, (turns.offsets.to_numpy(), turns.values.to_numpy()), (edges.offsets.to_numpy(), edges.values.values.to_numpy().reshape(-1, 4)))
