"""Token-id output in fixed-width bit-packed files.

Documents are range-partitioned by ``doc_id``; each partition streams one file:
every id takes the minimum number of bits that the vocabulary needs, ids are cut
into blocks, and an index at the end holds the byte offset of every block and the
id, start and length of every document. Blocks unpack by numpy at once, and any
range of ids is read by its blocks alone. Only a total per file goes through the
driver, to turn starts within files into starts over all files.

File format ("BPK1"), little-endian::

    magic | blocks | index | footer
    block   BLOCK ids of ``bits`` bits each, padded to a byte
    index   block offsets (u64) | document ids (i64, then one null flag byte each)
            | document starts in the file (u64, one more than documents)
    footer  bits, block, n_blocks, n_docs, n_ids, index offset (u64 each) | magic

Defined results: null text encodes as empty, so it holds the end id alone;
repeated rows are written each, side by side; null ids come first, and rows of one id
go by a hash of their text; texts of any length are encoded whole; other columns play
no part, whatever their names; an empty table writes no file. Files go to the shared folder under their final name only when
complete, so a task that is run again replaces its own file by equal bytes.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itinera.llm.common import filesystem, giving_back, kept, new_dir, put_in_place

MAGIC = b"BPK1"
#: Ids in a block.
BLOCK = 4096
#: Distinct words whose ids a Python worker keeps at most.
MEMO_WORDS = 400_000
#: Bytes of text in a file, about; files are as many as the shuffle partitions at least.
FILE_BYTES = 128 << 20


def id_bits(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, least bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = each
    return np.packbits(wide, axis=1, bitorder="little").reshape(-1).view("<u4")


class Writer:
    """Streams documents into one file."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.rest, self.offsets, self.n_docs, self.n_ids = np.zeros(0, "<u4"), array("q"), 0, 0
        self.docs, self.null, self.starts = array("q"), bytearray(), array("q", [0])
        self.at = out.write(MAGIC) and len(MAGIC)

    def add(self, doc_ids: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Documents and all their ids in a row."""
        self.docs.extend([0 if d is None else d for d in doc_ids])
        self.null.extend([d is None for d in doc_ids])
        self.starts.frombytes((self.n_ids + np.cumsum(lengths)).astype(np.int64).tobytes())
        self.n_docs, self.n_ids = len(self.docs), self.starts[-1]
        self.rest = np.concatenate((self.rest, ids))
        whole = len(self.rest) // self.block * self.block
        for i in range(0, whole, self.block):
            self._block(self.rest[i : i + self.block])
        self.rest = self.rest[whole:]

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        for part, kind in ((self.offsets, "<u8"), (self.docs, "<i8"), (self.null, None), (self.starts, "<u8")):
            self.out.write(np.array(part, kind).tobytes() if kind else bytes(part))
        self.out.write(struct.pack("<6Q", self.bits, self.block, len(self.offsets), self.n_docs, self.n_ids, self.at) + MAGIC)


class Reader:
    """Random access to the ids of a file."""

    FOOTER = struct.calcsize("<6Q") + len(MAGIC)

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - self.FOOTER)
        footer = file.read(self.FOOTER)
        if footer[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a complete token file")
        self.bits, self.block, n_blocks, n_docs, self.n_ids, self.index_at = struct.unpack("<6Q", footer[: -len(MAGIC)])
        file.seek(self.index_at)
        index = file.read(size - self.FOOTER - self.index_at)
        self.offsets = np.frombuffer(index, "<u8", n_blocks)
        docs = np.frombuffer(index, "<i8", n_docs, 8 * n_blocks)
        null = np.frombuffer(index, np.uint8, n_docs, 8 * (n_blocks + n_docs))
        self.docs = [None if x else d for d, x in zip(docs.tolist(), null.tolist(), strict=True)]
        self.starts = np.frombuffer(index, "<u8", n_docs + 1, 8 * (n_blocks + n_docs) + n_docs).astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids [start, end) of the file; reads the blocks that hold them."""
        if start >= end:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (end - 1) // self.block
        ends = np.concatenate((self.offsets[1:], [self.index_at])).astype(np.int64)
        self.file.seek(int(self.offsets[first]))
        data = self.file.read(int(ends[last] - self.offsets[first]))
        parts = []
        for b in range(first, last + 1):
            n = min(self.block, self.n_ids - b * self.block)
            at = int(self.offsets[b] - self.offsets[first])
            parts.append(unpack(data[at : at + (n * self.bits + 7) // 8], n, self.bits))
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]


#: A space next to other white space: there a text is not cut.
MIXED = re.compile(r" (?:(?=\s)|(?<=\s ))")


#: Pieces of Latin letters, digits and ASCII signs, with single line ends within. An
#: apostrophe may begin a contraction, so it is none of the signs.
PLAIN = re.compile(r"[0-9A-Za-zÀ-ÖØ-öø-ſ!-&(-/:-@\[-`{-~]+(?:\n[0-9A-Za-zÀ-ÖØ-öø-ſ!-&(-/:-@\[-`{-~]+)*")
#: In a token's bytes, a place where the byte-level pattern parts joined plain pieces.
PARTING = re.compile(
    rb"(?:[A-Za-z]|(?:^|[\xc3-\xc5])[\x80-\xbf])(?=[^A-Za-z\x80-\xff'])|[0-9](?=[^0-9\x80-\xc2\xc6-\xff'])"
    rb"|[!-&(-/:-@\[-`{-~](?=[0-9A-Za-z \n\xc3-\xc5])|\n(?=[!-&(-~\xc3-\xc5])"
)
#: Plain pieces that the model merges at once: more of them make its queue slower.
MERGED = 64


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


LETTERS = byte_letters()
BYTES = {ord(c): b for b, c in LETTERS.items()}


def merges_within_words(model: dict) -> bool:
    """Whether no merge of a byte-level BPE reaches over a place where plain text is parted, so that the model parts it there by itself."""
    if model.get("ignore_merges") or model.get("fuse_unk"):
        return False  # then what a word becomes hangs on where it ends
    merged = ("".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges") or [])
    return not any(PARTING.search(t.translate(BYTES).encode("latin-1", "replace")) for t in merged)


def cuts_at_spaces(tokenizer: dict) -> bool:
    """Whether a tokenizer's file describes a byte-level BPE that never merges over a space before a word."""
    before, model = tokenizer.get("pre_tokenizer") or {}, tokenizer.get("model") or {}
    plain = model.get("type") == "BPE" and not model.get("dropout") and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix"))
    byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    added = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) and " " not in t["content"] for t in tokenizer.get("added_tokens") or [])
    return plain and bool(byte_level) and added and not tokenizer.get("normalizer") and not tokenizer.get("truncation") and not tokenizer.get("padding")


class WordEncoder:
    """Encodes texts with a byte-level BPE tokenizer, each distinct word once.

    A byte-level BPE never merges across a single space between two visible
    characters: the piece before ends there and the space begins the next one.
    So a text is cut before such spaces, and equal pieces share one encoding.
    Where spaces meet other white space, the text is not cut. New pieces are
    encoded in one go, and the byte lengths of their tokens part them again; that a
    token ends where a piece does is checked. Plain pieces go to the tokenizer's model
    without its pattern, if no merge of the vocabulary reaches from word to word.
    Tokenizers of any other make (``cuts`` is false then) encode whole texts.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        made = json.loads(self.tokenizer.to_str())
        self.cuts = cuts_at_spaces(made)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bare = Tokenizer(self.tokenizer.model) if self.cuts and merges_within_words(made["model"]) else None
        special = {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        tokens = {i: len(t) for t, i in self.tokenizer.get_vocab().items()} | special
        self.token_bytes = np.array([tokens.get(i, 0) for i in range(max(tokens) + 1)], np.int64)
        #: ids of " " + piece, and of the pieces that begin a text
        self.memo: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {"": b""}
        self.memo_words = memo_words
        self.met = bytearray(1 << 22)

    @staticmethod
    def pieces(text: str) -> list[str]:
        """The first piece, and the others without the space that begins them."""
        parts = text.split(" ")
        if not MIXED.search(text):
            return parts
        out = [parts[0]]
        for p in parts[1:]:
            if p and out[-1] and not p[0].isspace() and not out[-1][-1].isspace():
                out.append(p)
            else:
                out[-1] += " " + p
        return out

    def _keep(self, known: dict[str, bytes]) -> None:
        """Keep the pieces that have probably been met before: only such are worth it."""
        met, last = self.met, len(self.met) - 1
        for piece, ids in known.items():
            at = hash(piece) & last
            if met[at]:
                self.memo[piece] = ids
            else:
                met[at] = 1

    def _each(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _part(self, pieces: list[str], ids: np.ndarray) -> Iterator[tuple[str, bytes]]:
        """Each of the pieces, that were encoded one after the other, with its ids."""
        ends = np.cumsum(np.fromiter((len(p.encode()) + 1 for p in pieces), np.int64, len(pieces)))
        reach = np.cumsum(self.token_bytes[ids])
        cuts = np.searchsorted(reach, ends) + 1
        if len(reach) < cuts[-1] or not np.array_equal(reach[cuts - 1], ends):
            raise ValueError("a token reaches over the end of a piece")
        data, at = ids.tobytes(), 0
        for p, cut in zip(pieces, (cuts * 4).tolist(), strict=True):
            yield p, data[at:cut]
            at = cut

    def _plain(self, pieces: list[str]) -> list[str]:
        """The plain ones of some pieces, without added tokens."""
        if self.bare is None:
            return []
        plain = list(filter(PLAIN.fullmatch, pieces))
        whole = " ".join(plain)
        for token in self.added:
            if token in whole:
                plain = [p for p in plain if token not in p]
        return plain

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        known = {}
        plain = self._plain(new)
        for i in range(0, len(plain), 20_000):
            part = plain[i : i + 20_000]
            shown = [" " + " ".join(part[j : j + MERGED]) for j in range(0, len(part), MERGED)]
            shown = [x.encode().decode("latin-1").translate(LETTERS) for x in shown]
            ids = [x.ids for x in self.bare.encode_batch_fast(shown, add_special_tokens=False)]
            known.update(self._part(part, np.fromiter(chain.from_iterable(ids), "<u4")))
        new = [p for p in new if p not in known]
        apart = [p for p in new if not p or p[0].isspace() or p[-1].isspace()]
        known.update(zip(apart, self._each([" " + p for p in apart]), strict=True))
        new = [p for p in new if p not in known]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            ids = self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids
            known.update(self._part(part, np.array(ids, "<u4")))
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.cuts:
            return self._each(texts)
        cut = [self.pieces(t) for t in texts]
        heads = [pieces.pop(0) for pieces in cut]
        found = [list(map(self.memo.get, pieces)) for pieces in cut]
        open_ = [(cut[i], ids, [k for k, x in enumerate(ids) if x is None]) for i, ids in enumerate(found) if None in ids]
        new = {pieces[k] for pieces, _, at in open_ for k in at}
        known = self._learn(list(new))
        for pieces, ids, at in open_:
            for k in at:
                ids[k] = known[pieces[k]]
        if len(self.memo) >= self.memo_words and 4 * len(new) > sum(map(len, cut)):
            self.memo.clear()  # it no longer fits the texts
        if len(self.memo) < self.memo_words:
            self._keep(known)
        if len(self.heads) >= self.memo_words:
            self.heads = {"": b""}
        fresh = list(set(heads).difference(self.heads))
        self.heads.update(zip(fresh, self._each(fresh), strict=True))
        return [b"".join([self.heads[h], *ids]) for h, ids in zip(heads, found, strict=True)]


#: The kind of tasks for which Python workers keep an encoder.
ENCODING = "token encoder"


def encoder_for(path: str) -> WordEncoder:
    """One encoder per Python worker, so that its memo lasts over the tasks of its stage."""
    encoders = kept(ENCODING)
    if path not in encoders:
        encoders[path] = WordEncoder(path)
    return encoders[path]


def write_token_files(
    docs: DataFrame,
    tokenizer_path: Callable[[], str],
    out_dir: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    partitions: int | None = None,
) -> DataFrame:
    """Write the files; returns path, n_docs, n_ids, first of each file, in order of the documents.

    tokenizer_path is called in the tasks, so that each machine finds its own copy.
    """
    spark = docs.sparkSession
    out_dir = out_dir or new_dir(spark, "tokens")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = partitions or max(least, -(-(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // FILE_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        files, base = filesystem(out_dir)
        files.create_dir(base, recursive=True)
        final, draft = f"{base}/part-{part:06d}.bpk", f"{base}/.draft-{part:06d}-{uuid.uuid4().hex}"
        writer = encoder = None
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                if writer is None:
                    encoder = encoder_for(tokenizer_path())
                    out = files.open_output_stream(draft)
                    writer = Writer(out, id_bits(encoder.vocabulary))
                found = [x + end for x in encoder.encode(piece.column("text").to_pylist())]
                ids = np.frombuffer(b"".join(found), "<u4")
                writer.add(piece.column("doc_id").to_pylist(), ids, np.fromiter(map(len, found), np.int64) // 4)
        if writer is None:
            return
        writer.close()
        out.close()
        put_in_place(files, draft, final)
        name = out_dir.rstrip("/") + final.removeprefix(base)
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int64()), "path": [name], "n_docs": pa.array([writer.n_docs], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64())}
        )

    totals = sorted(ordered.mapInArrow(giving_back(write, ENCODING), "part long, path string, n_docs long, n_ids long").collect())
    listed, first = [], 0
    for t in totals:
        listed.append((t.path, t.n_docs, t.n_ids, first))
        first += t.n_ids
    return spark.createDataFrame(listed, "path string, n_docs long, n_ids long, first long")


def read_token_files(files: DataFrame, batch_ids: int = 1 << 20) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                store, name = filesystem(path)
                with store.open_input_file(name) as file:
                    reader = Reader(file, file.size())
                    starts, i = reader.starts, 0
                    while i < len(reader.docs):
                        j = max(i + 1, int(np.searchsorted(starts, starts[i] + batch_ids, "right")) - 1)
                        data = memoryview(reader.ids(int(starts[i]), int(starts[j])).tobytes())
                        places = ((starts[i : j + 1] - starts[i]) * 4).tolist()
                        crcs = [zlib.crc32(data[a:b]) for a, b in zip(places[:-1], places[1:], strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(reader.docs[i:j], pa.int64()), pa.array(starts[i:j] + first), pa.array(np.diff(starts[i : j + 1])), pa.array(crcs, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        i = j

    n = max(1, min(files.count(), 10_000))
    return files.repartition(n, "path").mapInArrow(giving_back(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: Callable[[], str], **options) -> DataFrame:
    """Write the documents' token files and return what they hold per document."""
    return read_token_files(write_token_files(docs, tokenizer_path, **options))
