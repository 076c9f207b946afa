"""GeoJSON collections in byte ranges: one file of many gigabytes is many tasks.

A feature begins where ``{"type": "Feature"`` stands. That text cannot occur inside a
JSON string, whose quotes are escaped. A range owns the features that begin in it and
reads on to the end of its last. Files whose features begin otherwise, with geometry or
an id first, say so in their first bytes and are read whole.

Defined results: features without polygons have no rows; a feature of damaged JSON is
an error that names its place; an empty collection has no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itinera.sources.storage import file_system, stored

BOUNDARY = re.compile(rb'\{\s*"type"\s*:\s*"Feature"\s*[,}]')
#: How a collection begins, up to its first feature or its end.
HEAD = re.compile(rb'"features"\s*:\s*\[\s*(\{\s*"type"\s*:\s*"Feature"\s*[,}]|\])')
#: Bytes in which a boundary, or the head of a file, is looked for beyond a range.
REACH, HEAD_BYTES, CHUNK = 256, 1 << 16, 1 << 20
SPLIT_BYTES = 64 << 20


def features_in(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """Offset and object of the features that begin in [start, end)."""
    file.seek(0)
    whole = HEAD.search(file.read(min(size, HEAD_BYTES))) is None
    if whole:
        if start == 0:
            file.seek(0)
            yield from enumerate(json.loads(file.read()).get("features") or [])
        return
    file.seek(start)
    data, at, ended = b"", start, False  # data begins at byte ``at`` of the file
    while True:
        found = BOUNDARY.search(data)
        place = at + found.start() if found else None
        if place is not None and place >= end:
            return
        after = BOUNDARY.search(data, found.end()) if found else None
        if found and (after or ended):
            text = data[found.start() : after.start() if after else len(data)].decode("utf-8")
            try:
                yield place, json.JSONDecoder().raw_decode(text)[0]
            except json.JSONDecodeError as cause:
                raise ValueError(f"feature at byte {place}: {cause}") from cause
            cut = after.start() if after else len(data)
            data, at = data[cut:], at + cut
            continue
        if ended:
            return
        if not found:  # no feature of ours can begin before what may be a boundary cut in two
            cut = max(0, len(data) - REACH)
            data, at = data[cut:], at + cut
            if at >= end:
                return
        more = file.read(CHUNK)
        ended = not more
        data += more


def read_features(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, f (number in its file), type, coordinates (JSON) of every feature of one or many collections."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size")).filter("size > 0")
    step = F.lit(split_bytes).cast("long")
    ranges = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, step)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, name = file_system(r["path"])
                held: list[tuple] = []

                def told() -> pa.RecordBatch:
                    path, start, k, kind, coordinates = map(list, zip(*held, strict=True))  # noqa: B023
                    held.clear()  # noqa: B023
                    return pa.RecordBatch.from_arrays(
                        [pa.array(path), pa.array(start, pa.int64()), pa.array(k, pa.int64()), pa.array(kind, pa.string()), pa.array(coordinates, pa.string())],
                        ["path", "start", "k", "type", "coordinates"],
                    )

                with store.open_input_file(name) as file:
                    for k, (_, feature) in enumerate(features_in(file, r["size"], r["start"], min(r["size"], r["start"] + split_bytes))):
                        shape = feature.get("geometry") or {}
                        held.append((r["path"], r["start"], k, shape.get("type"), json.dumps(shape.get("coordinates"))))
                        if len(held) == 1000:
                            yield told()
                if held:
                    yield told()

    spread = ranges.repartition(max(1, min(ranges.count(), 1 << 16)), "path", "start")
    rows = stored(spread.mapInArrow(run, "path string, start long, k long, type string, coordinates string"), "features")
    # A range's first number: a row a range, so few.
    counted = rows.groupBy("path", "start").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    first = counted.select("path", "start", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(first, ["path", "start"]).select("path", (F.col("before") + F.col("k")).alias("f"), "type", "coordinates")
