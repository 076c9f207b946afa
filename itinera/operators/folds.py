"""Ordered folds: one label a row, from a state that follows the rows of a key in order.

The rows of a key are sorted within their partition and stream through a Python
step in Arrow batches, so a fold costs one shuffle by key and as much time as it has
rows; the state alone is held in memory, however many rows a key has. A window numbers
the rows, since only an operator that needs a key's rows together keeps them so: Spark
leaves out a repartition after a join by the key, and the join's own when it broadcasts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def km_between(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """Great-circle distance, as haversine_km says."""
    p, q = math.radians(lat1), math.radians(lat2)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def fold_rows(rows: DataFrame, key: str, order: list[Column | str], fields: list[str], make: Callable[[], Callable[..., int | None]], label: str) -> DataFrame:
    """rows with a column ``label``: what a step, made anew for each key, says of the fields of each row in order."""
    ordered = rows.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(*order)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, current = None, None
        for batch in batches:
            keys, columns = batch.column(key).to_pylist(), [batch.column(f).to_pylist() for f in fields]
            labels = []
            for k, *values in zip(keys, *columns, strict=True):
                if step is None or k != current:
                    step, current = make(), k
                labels.append(step(*values))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(labels, pa.int32())], [*batch.schema.names[:-1], label])

    return ordered.mapInArrow(run, StructType([*rows.schema.fields, StructField(label, IntegerType())]))
