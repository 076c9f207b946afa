"""Region packs: detailed coasts of a box each, in files of their own, read only where they are wanted.

A folder holds ``index.json``, a list of {id, bbox: [w, s, e, n]}, and ``<id>.json`` with
region, generated, bbox and coast (rings of [lon, lat] or [lon, lat, 1] for a synthetic
point, which only closes a coast along the pack's border).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from itinera.sources.storage import file_system, write_files

COAST = "array<array<array<double>>>"


def pack_version(region: Column, generated: Column, coast: Column) -> Column:
    """What changes when a pack does: region@generated, else region#points:hash of the coast; ``global`` for no coast at all.

    The hash takes about eight points of each ring in order, h * 33 + 1000 lon + lat with
    32-bit wrap-around after the shift and after the sum, as a number to base 36.
    """
    span = 1 << 32
    wrap = lambda x: F.pmod(x + (span >> 1), F.lit(span)) - (span >> 1)
    some = F.transform(coast, lambda r: F.filter(r, lambda p, i: i % F.greatest(F.lit(1), F.floor(F.size(r) / 8)) == 0))
    points = F.flatten(some)
    step = lambda h, p: wrap((((wrap(h * 32) + h).cast("double") + p[0] * 1000) + p[1]).cast("long"))
    h = F.aggregate(points, F.lit(5381).cast("long"), step)
    n = F.aggregate(coast, F.lit(0), lambda acc, r: acc + F.size(r))
    name = F.when(F.coalesce(region, F.lit("")) == "", "pack").otherwise(region)
    hashed = F.concat(name, F.lit("#"), n.cast("string"), F.lit(":"), F.lower(F.conv(F.pmod(h, F.lit(span)).cast("string"), 10, 36)))
    stamped = F.coalesce(generated, F.lit("")) != ""
    return F.when(coast.isNull() & ~stamped, "global").otherwise(F.when(stamped, F.concat(name, F.lit("@"), generated)).otherwise(hashed))


def real_ring(ring: list) -> bool:
    """Whether a ring bounds land: three points and more, not all of them synthetic."""
    return len(ring) >= 3 and any(len(p) < 3 or p[2] != 1 for p in ring)


@dataclass
class Pack(InputPartition):
    number: int
    path: str
    box: tuple


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")
        self.box = tuple(map(float, options["box"].split(","))) if options.get("box") else None

    def partitions(self) -> list[Pack]:
        """A partition for each listed pack whose box meets the one asked for."""
        store, base = file_system(self.folder)
        with store.open_input_file(f"{base}/index.json") as file:
            listed = json.loads(file.read())
        met = lambda b: self.box is None or (b[0] <= self.box[2] and b[2] >= self.box[0] and b[1] <= self.box[3] and b[3] >= self.box[1])
        return [Pack(i, f"{self.folder}/{x['id']}.json", tuple(x["bbox"])) for i, x in enumerate(listed) if met(x["bbox"])]

    def read(self, partition: Pack) -> Iterator[tuple]:
        store, name = file_system(partition.path)
        with store.open_input_file(name) as file:
            pack = json.loads(file.read())
        rings = [ring for ring in pack.get("coast") or [] if isinstance(ring, list) and real_ring(ring)]
        own = [[[(float(p[0]), float(p[1])) for p in ring]] for ring in rings]
        yield partition.number, pack.get("region"), pack.get("generated"), *map(float, partition.box), own


class RegionPacks(DataSource):
    """Format ``region_packs``: a row per pack, with its polygons. Options: path; box (w,s,e,n), which leaves other packs unread."""

    @classmethod
    def name(cls) -> str:
        return "region_packs"

    def schema(self) -> str:
        return "pack int, region string, generated string, w double, s double, e double, n double, polygons array<array<array<struct<lon: double, lat: double>>>>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_packs(spark: SparkSession, folder: str, box: tuple[float, float, float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """The polygons (ord, polygon, rings) and the boxes (w, s, e, n) of the packs that meet a box; of equal land the first pack wins."""
    spark.dataSource.register(RegionPacks)
    reader = spark.read.format("region_packs").option("path", folder)
    packs = (reader.option("box", ",".join(map(str, box))) if box else reader).load()
    polygons = packs.select("pack", "region", F.posexplode("polygons").alias("k", "rings"))
    name = F.concat_ws(":", F.coalesce("region", F.lit("pack")), "k")
    return polygons.select((F.col("pack") * 65_536 + F.col("k")).alias("ord"), name.alias("polygon"), "rings"), packs.select("w", "s", "e", "n")


def write_packs(packs: DataFrame, folder: str) -> int:
    """Packs (id, region, generated, bbox, coast) as files, and the index of them; returns how many."""
    body = F.to_json(F.struct("region", "generated", "bbox", "coast"))
    n = write_files(packs.select(F.concat(F.col("id"), F.lit(".json")).alias("name"), F.encode(body, "UTF-8").alias("content")), folder)
    # An entry a pack: ids and boxes alone, in order of the ids.
    listed = packs.agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "bbox")))).alias("all"))
    write_files(listed.select(F.lit("index.json").alias("name"), F.encode("all", "UTF-8").alias("content")), folder)
    return n
