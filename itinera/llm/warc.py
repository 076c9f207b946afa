"""WARC archives: a writer with revisit records, and a splittable reader.

Every record is a gzip member of its own, so an archive can be read from the
middle. The reader's tasks take byte ranges: a task looks for gzip magic in its
range, takes a candidate for a member only if its head inflates to a WARC version
line, and owns the records that start inside its range. Having found one, it goes
on from member to member, reading beyond its range only to end its last record. What
it inflates is measured and hashed again, and must agree with the record's headers.

Which record of equal payloads is the response comes from the heavy-hitter split
of exact dedup, so a payload that a third of all pages share is no hot key.

Defined results: null payload is empty; the null id sorts last and is written as
an empty header; repeated rows with one id and payload are written each, one of
them as the response; of equal payloads with one least id the row first by url is
it; payloads of any length are written and read whole, one at a time; other columns
play no part, whatever their names; an empty table writes no archive. Archives get
their final name only when complete, so a task that is run again replaces its own
file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itinera.llm.common import filesystem, materialise, new_dir, put_in_place, small_or_shuffled
from itinera.llm.exact_dedup import group_copies

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
#: Bytes of an archive that one task scans.
SPLIT_BYTES = 32 << 20
#: Bytes read at once.
CHUNK = 1 << 18
#: Inflated bytes of a candidate that are looked at before it counts as a record.
PROBE = 512


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1 of a payload."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(role: str, page_id: int | None, digest: str, copy: str = "") -> str:
    """A name that follows from what the record holds, so that revisits can refer to it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{role}/{page_id}/{digest}/{copy}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = "1970-01-01T00:00:00Z", copy: str = "") -> bytes:
    """One gzip member with a response, or a revisit that holds no payload but its digest and length.

    ``copy`` tells the revisits of one page and payload apart.
    """
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = b"" if revisit else http + payload
    kind = "revisit" if revisit else "response"
    head = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(kind, page_id, digest, copy if revisit else '')}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += [
            f"WARC-Refers-To: {record_id('response', refers_to, digest)}",
            f"WARC-Refers-To-Page-ID: {'' if refers_to is None else refers_to}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    data = VERSION + "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def checked_payload(headers: dict[str, str], block: bytes) -> bytes:
    """The payload of a record's block, which must be what its headers say; a revisit has none."""
    if headers.get("warc-type") != "response":
        return b""
    payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
    told = headers.get("warc-payload-length"), headers.get("warc-payload-digest")
    if told != (str(len(payload)), f"sha1:{payload_digest(payload)}"):
        raise ValueError(f"payload of {headers.get('warc-record-id')} differs from its headers")
    return payload


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block of an inflated record."""
    if not data.startswith(b"WARC/1."):
        raise ValueError("no WARC version line")
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        headers[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = int(headers["content-length"])
    if len(rest) < size:
        raise ValueError("record is cut short")
    return headers, rest[:size]


class DamagedRecord(ValueError):
    """A member that begins as a WARC record and cannot be read to its end."""


class _Window:
    """A file read forward in chunks, from any position."""

    def __init__(self, file, size: int, start: int):
        self.file, self.size, self.start, self.data = file, size, start, b""
        file.seek(start)

    def more(self) -> bool:
        left = self.size - self.start - len(self.data)
        if left <= 0:
            return False
        self.data += self.file.read(min(CHUNK, left))
        return True

    def drop(self, position: int) -> None:
        self.data = self.data[position - self.start :]
        self.start = position


def _is_record(window: _Window, at: int) -> bool:
    """Whether the bytes at a magic inflate to the head of a WARC record."""
    inflate = zlib.decompressobj(31)
    head, seen = b"", at - window.start
    while len(head) < PROBE:
        if seen >= len(window.data) and not window.more():
            break
        piece = window.data[seen : seen + 4096]  # shorter where the window ends
        try:
            head += inflate.decompress(piece, PROBE)
        except zlib.error:
            return False
        seen += len(piece)
        if head and not b"WARC/1.".startswith(head[:7]):
            return False
        if inflate.eof:
            break
    return head.startswith(b"WARC/1.")


def read_split(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of the records that begin in [start, end).

    Bytes that never were a record are passed over. A member whose head inflates to a
    WARC version line is one: if it is damaged or cut short, DamagedRecord says where.
    """
    window, at, known = _Window(file, size, start), start, False
    while at < min(end, size):
        if not known:  # look for the next member
            while (found := window.data.find(MAGIC, at - window.start)) < 0:
                at = max(at, window.start + len(window.data) - len(MAGIC) + 1)
                window.drop(at)
                if at >= end or not window.more():
                    return
            at = window.start + found
            if at >= end:
                return
        if not _is_record(window, at):  # it never was a record: search on
            at, known = at + 1, False
            continue
        window.drop(at)
        inflate, parts = zlib.decompressobj(31), []
        try:
            while True:
                parts.append(inflate.decompress(window.data))
                if inflate.eof:
                    break
                window.drop(window.start + len(window.data))  # what is inflated need not be kept
                if not window.more():
                    raise ValueError("member is cut short")
            headers, block = parse(b"".join(parts))
        except (zlib.error, ValueError, KeyError) as cause:
            raise DamagedRecord(f"record at byte {at}: {cause}") from cause
        yield at, headers, block
        at = window.start + len(window.data) - len(inflate.unused_data)
        known = window.data[at - window.start :].startswith(MAGIC) or (at - window.start + 3 > len(window.data) and at < size)


def archive(pages: DataFrame, out_dir: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Write pages as archives in a folder, which is returned."""
    out_dir = out_dir or new_dir(pages.sparkSession, "warc")
    store, base = filesystem(out_dir)
    store.create_dir(base, recursive=True)
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    named = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")
    )
    digests = materialise(named.select("page_id", F.sha2("payload", 256).alias("digest")), "payload-digests")
    grouped = group_copies(digests, "page_id", "digest")
    # A page's role follows from its id and digest; repeats of one row differ in kept alone.
    roles = materialise(
        grouped.groupBy("page_id", "digest", "keep_id").agg(F.count_if("kept").alias("responses")), "payload-roles"
    )
    # Only pages with an equal payload elsewhere need their role; the others stay where they are.
    copies = roles.filter(~F.col("page_id").eqNullSafe(F.col("keep_id")) | (F.col("responses") != 1))
    copies = small_or_shuffled(copies.select(F.col("page_id").alias("_page_id"), F.col("digest").alias("_digest"), "keep_id", "responses"))
    met = F.col("page_id").eqNullSafe(F.col("_page_id")) & (F.sha2("payload", 256) == F.col("_digest"))
    joined = named.join(copies, met, "left")
    own = F.col("_digest").isNull()
    rows = joined.select("page_id", "url", "payload", F.when(own, F.col("page_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.when(own, 1).otherwise(F.col("responses")).alias("responses"))
    # Of repeated rows the first becomes the response: number them only where there are any.
    repeated = grouped.groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not repeated.isEmpty():
        same = Window.partitionBy("page_id", F.xxhash64("payload")).orderBy("url")
        rows = rows.withColumn("responses", F.when(F.row_number().over(same) == 1, F.col("responses")).otherwise(0))

    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, base = filesystem(out_dir)
        draft, out, n = f"{base}/.draft-{part:06d}-{uuid.uuid4().hex}", None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or store.open_output_stream(draft)
            for at in range(0, batch.num_rows, 64):
                for i, r in enumerate(batch.slice(at, 64).to_pylist()):
                    revisit = not r["responses"]
                    payload = r["payload"].encode("utf-8", "surrogatepass")
                    out.write(record(r["page_id"], r["url"], payload, r["keep_id"], revisit, date, f"{part}/{n + at + i}"))
            n += batch.num_rows
        if out:
            out.close()
            put_in_place(store, draft, f"{base}/part-{part:06d}.warc.gz")
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return out_dir


def splits(spark, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Byte ranges of all archives in a folder: path, size, start, end."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder)
    step = F.lit(split_bytes).cast("long")
    ranges = files.filter("length > 0").select("path", F.col("length").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step)).alias("start"))
    return ranges.withColumn("end", F.least(F.col("start") + step, F.col("size")))


def read_archives(spark, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A row per record: path, offset, headers (map), payload (binary)."""
    ranges = splits(spark, folder, split_bytes)
    n = max(1, ranges.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, name = filesystem(r["path"])
                with store.open_input_file(name) as file:
                    held, size = [], 0
                    try:
                        for at, headers, block in read_split(file, r["size"], r["start"], r["end"]):
                            held.append((r["path"], at, headers, checked_payload(headers, block)))
                            size += len(block)
                            if size > 4 << 20 or len(held) >= 1000:
                                yield _records(held)
                                held, size = [], 0
                    except DamagedRecord as cause:
                        raise DamagedRecord(f"{r['path']}: {cause}") from cause
                    if held:
                        yield _records(held)

    def _records(held: list) -> pa.RecordBatch:
        path, offset, headers, payload = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(path, pa.string()), pa.array(offset, pa.int64()), pa.array([list(h.items()) for h in headers], pa.map_(pa.string(), pa.string())), pa.array(payload, pa.binary())],
            ["path", "offset", "headers", "payload"],
        )

    spread = ranges.repartition(n, "path", "start")
    return spread.mapInArrow(read, "path string, offset long, headers map<string,string>, payload binary")


def page_records(records: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    h = F.col("headers")
    return records.select(
        h["warc-page-id"].try_cast("long").alias("page_id"),
        h["warc-payload-length"].cast("long").alias("payload_bytes"),
        F.regexp_replace(h["warc-payload-digest"], "^sha1:", "").alias("payload_digest"),
        h["warc-type"].alias("record_type"),
        h["warc-refers-to-page-id"].try_cast("long").alias("refers_to"),
        F.length("payload").cast("long").alias("block_bytes"),
    )


def round_trip(pages: DataFrame, split_bytes: int = SPLIT_BYTES, **columns) -> DataFrame:
    """Write the archives, read them back and return their records."""
    return page_records(read_archives(pages.sparkSession, archive(pages, **columns), split_bytes))
