"""The folder that driver and executors share, and files that tasks write there under names of their own."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-shared-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a folder of our own, on one machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own_dir()
    return base.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it is computed once and outlives its executors."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def still_there(table: DataFrame) -> bool:
    """Whether a table of ``stored`` has not been deleted meanwhile."""
    from pyarrow.fs import FileType

    store, path = file_system(table.stored_at)
    return store.get_file_info(path).type == FileType.Directory


def file_system(uri: str):
    """A pyarrow file system and the path in it; file: paths may have one slash."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def _put(folder: str, name: str, data: bytes) -> None:
    """A complete file under its final name, or none; one that an earlier attempt left is replaced."""
    store, base = file_system(folder)
    store.create_dir(base, recursive=True)
    draft = f"{base}/.draft-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(data)
    store.move(draft, f"{base}/{name}")


def write_files(files: DataFrame, folder: str) -> int:
    """Files (name, content) into a folder, one each; returns how many. All or none of a file is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                _put(folder, name, content)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    rows = files.select(F.col("name").cast("string"), F.col("content").cast("binary"))
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_lines(lines: DataFrame, folder: str, suffix: str) -> None:
    """Lines (value) into a file of each partition, with a suffix of the caller's; a partition streams by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        out, n, draft = None, 0, f"{base}/.draft-{uuid.uuid4().hex}"
        for batch in batches:
            if out is None and batch.num_rows:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(draft)
            if out is not None:
                out.write("".join(f"{x}\n" for x in batch.column("value").to_pylist()).encode())
            n += batch.num_rows
        if out is not None:
            out.close()
            store.move(draft, f"{base}/part-{TaskContext.get().partitionId():06d}{suffix}")
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    lines.select("value").mapInArrow(run, "n long").agg(F.sum("n")).collect()
