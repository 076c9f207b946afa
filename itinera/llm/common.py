"""Small helpers that the corpus operators share: tables, shared storage, words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only on one machine, where the session names none, a temporary folder is set; on a
    cluster such a folder would lose rows, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    It cuts lineage: the copy outlives any executor, and several readers do not
    compute it again. Where no later result reads it, ``discard`` deletes it.
    """
    spark = df.sparkSession
    path = new_dir(spark, tag)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and nothing reads any more."""
    for df in stored:
        store, path = filesystem(df.stored_at)
        store.delete_dir(path)


#: Share of all rows from which on a key counts as hot. It bounds the keys that are
#: broadcast: at most 1 / HOT_SHARE.
HOT_SHARE = 0.001


def join_counted(rows: DataFrame, values: DataFrame, key: list[str], total: int, share: float = HOT_SHARE, how: str = "inner") -> DataFrame:
    """Join rows with ``values``, one row a key whose column ``n`` says how many rows have it, without a hot task.

    Of ``total`` rows at most 1 / share keys have more than that share; their values
    are broadcast, so their rows stay where they are. Only the others are shuffled.
    """
    most = max(1, int(total * share))
    hot = F.broadcast(values.filter(F.col("n") > most))
    cold = values.filter(F.col("n") <= most)
    apart = rows.join(hot.select(*key), key, "left_anti")
    return rows.join(hot, key).unionByName(apart.join(cold, key, how)).drop("n")


def filesystem(uri: str):
    """A pyarrow file system and the path in it; file: paths may have one slash."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def put_in_place(store, draft: str, final: str) -> None:
    """Give a complete draft its final name; one that an earlier attempt left is replaced."""
    from pyarrow.fs import FileType

    if store.get_file_info(final).type != FileType.NotFound:
        store.delete_file(final)
    store.move(draft, final)


#: Rows of two or three numbers up to which a key table is sent to every task.
BROADCAST_ROWS = 1_000_000


def small_or_shuffled(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of keys, to be broadcast if its counted rows are few; else Spark shuffles the join."""
    return F.broadcast(keys) if keys.limit(rows + 1).count() <= rows else keys


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_table(digits: bool = True) -> bytes:
    """Byte by byte: A-Z to lower case; letters, digits if wanted, and all bytes beyond ASCII stay; the rest separates words."""
    kept = lambda c: c.islower() or (digits and c.isdigit())
    return bytes(ord(c) if kept(c) else ord(" ") for c in (chr(b).lower() for b in range(128))) + bytes(range(128, 256))


def words_within(text: bytes | None, fold: bytes, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8 by ``fold_table``, those of about ``most`` bytes at a time."""
    data = text or b""
    open_: list[bytes] = []
    for at in range(0, max(1, len(data)), most):
        piece = data[at : at + most].translate(fold)
        cut = piece.rfind(b" ") if at + most < len(data) else len(piece)
        if cut < 0:
            open_.append(piece)
            continue
        yield b"".join([*open_, piece[:cut]]).split()
        open_ = [piece[cut:]]


_KEPT: dict[str, dict] = {}


def kept(kind: str) -> dict:
    """What this Python worker keeps from task to task for tasks of one kind (see ``giving_back``)."""
    return _KEPT.setdefault(kind, {})


def drop_kept(kind: str | None) -> None:
    """Forget what this Python worker keeps for tasks of other kinds."""
    for other in set(_KEPT) - {kind}:
        del _KEPT[other]


def giving_back(run: Callable[[Iterator], Iterator], kind: str | None = None) -> Callable[[Iterator], Iterator]:
    """A task's function that returns what it has freed to the machine when it ends.

    Python workers outlive their tasks, and what their allocators keep for later adds up
    over the stages of a pipeline. So does what earlier stages kept for tasks of their own
    kind: all but that of this ``kind`` goes before the task begins.
    """

    def wrapped(batches: Iterator) -> Iterator:
        import pyarrow

        drop_kept(kind)
        yield from run(batches)
        gc.collect()
        pyarrow.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:  # glibc alone has it
            trim(0)

    return wrapped
