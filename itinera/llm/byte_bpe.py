"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decoding.

A sequence of tokens is the BPE encoding of its bytes exactly when each token encodes
to itself and each two neighbours encode to themselves: merges go by (rank, place), so
what happens within a run of final tokens does not depend on what stands around it.
So the merges compile into a nondeterministic transducer that guesses where tokens end,
follows the next one through the vocabulary's prefixes, and drops a guess as soon as two
neighbours would have merged across. Every text has exactly one accepted path.
Its subsets are made deterministic as bytes first ask for them, and kept: a state is the
set of open guesses with the tokens each has pending, and a token is emitted once all
guesses agree on it. A guess is open for at most the longest token, so the lookahead is
bounded. A state holds no position, so equal surroundings share states.

The decoder takes ids in pieces of any size and gives bytes that end with a whole
character; what is left of a character waits for the next piece.

Defined results: null text encodes as empty, which has no token; texts of any length are
encoded whole, a batch of pieces at a time; a piece that is itself a token is that token,
also if its merges would give others; repeated rows are encoded each; other columns play
no part, whatever their names; an empty table gives an empty result; ids beyond the
vocabulary are an error.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps between states, pairs of tokens and pieces with their ids that a Python worker
#: keeps at most; beyond that they are forgotten and made again.
MOST_STEPS = 800_000
MOST_PAIRS = 500_000
MEMO_PIECES = 250_000
#: Characters of a piece that is kept at most.
MEMO_LENGTH = 32
#: Pieces that are encoded at once.
BATCH = 1 << 15


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines "base64 rank"."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class Merges:
    """What the ranks say of tokens and their neighbours; the vocabulary as a tree of bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        if missing := [i for i in range(256) if bytes([i]) not in ranks]:
            raise ValueError(f"{len(missing)} single bytes have no token")
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        #: Node after a node (0: the root) and a byte, by node << 8 | byte; the token that ends at a node.
        self.child: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                node = self.child.setdefault(node << 8 | byte, len(self.child) + 1)
            self.token_at[node] = rank
        #: Tokens that their own merges give, so that they occur within texts.
        self.met_at = dict(self.token_at)
        self._spines: dict[int, tuple[list, list] | None] = {}
        for node, rank in self.token_at.items():
            token = self.tokens[rank]
            if len(token) > 1 and not self._is_made(token):
                del self.met_at[node]
        self._pairs: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> list[tuple[int, int, int]]:
        """The merges of data one by one, each as (start, end, rank)."""
        cuts, done = list(range(len(data) + 1)), []
        get = self.ranks.get
        found = [get(data[i : i + 2], math.inf) for i in range(len(data) - 1)]
        while found and (rank := min(found)) != math.inf:
            i = found.index(rank)
            done.append((cuts[i], cuts[i + 2], rank))
            del cuts[i + 1], found[i]
            for k in (i - 1, i):
                if 0 <= k < len(found):
                    found[k] = get(data[cuts[k] : cuts[k + 2]], math.inf)
        return done

    def _is_made(self, token: bytes) -> bool:
        done = self.merge(token)
        return bool(done) and done[-1][:2] == (0, len(token))

    def encode(self, data: bytes) -> list[bytes]:
        """The merges carried out on the whole of data: what the transducer must equal."""
        ends = set(range(len(data) + 1))
        for start, end, _ in self.merge(data):
            ends.difference_update(range(start + 1, end))
        cuts = sorted(ends)
        return [data[a:b] for a, b in itertools.pairwise(cuts)]

    def spines(self, rank: int) -> tuple[list, list] | None:
        """What stands at a token's left and right edge while it is merged: (piece, born, gone) by rank.

        None if an early merge has to wait for a later rank, so that ranks are no times.
        """
        if rank not in self._spines:
            token = self.tokens[rank]
            done, last = self.merge(token), (None, math.inf)
            left = [(token[:1], -1), *((token[:end], by) for start, end, by in done if start == 0), last]
            right = [(token[-1:], -1), *((token[start:], by) for start, end, by in done if end == len(token)), last]
            timed = all(a[2] <= b[2] for a, b in itertools.pairwise(done))
            self._spines[rank] = tuple([(piece, born, gone) for (piece, born), (_, gone) in itertools.pairwise(side)] for side in (left, right)) if timed else None
        return self._spines[rank]

    def neighbours(self, a: int, b: int) -> bool:
        """Whether token a followed by b encodes to these two: no merge over the border ever has its turn."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= MOST_PAIRS:
                self._pairs.clear()
            known = self._pairs[a, b] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        first, second = self.spines(a), self.spines(b)
        if first is None or second is None:
            return self.encode(self.tokens[a] + self.tokens[b]) == [self.tokens[a], self.tokens[b]]
        left, right, get = first[1], second[0], self.ranks.get
        for x, x_born, x_gone in left:
            for y, y_born, y_gone in right:
                rank = get(x + y)
                # Of equal ranks the left one is merged first: a's own merge comes before, b's after.
                if rank is not None and max(rank, x_born, y_born) < x_gone and max(rank, x_born, y_born) <= y_gone:
                    return False
        return True


class Transducer:
    """Bytes in, token ids out, by states that are made when first met."""

    def __init__(self, merges: Merges, most_steps: int = MOST_STEPS):
        self.merges, self.most_steps = merges, most_steps
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        #: Next state and emitted ids, by state << 8 | byte.
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        #: A guess: ids pending, the id before (-1 at the start), the node that the next token has reached.
        self.start = self._number((((), -1, 0),))

    def _number(self, state: tuple) -> int:
        number = self.numbers.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        return number

    def _step(self, at: int, byte: int) -> tuple[int, tuple[int, ...]]:
        child, met_at, neighbours = self.merges.child.get, self.merges.met_at.get, self.merges.neighbours
        found = []
        for pending, before, node in self.states[at]:
            node = child(node << 8 | byte)
            if node is None:
                continue
            found.append((pending, before, node))
            token = met_at(node)
            if token is not None and (before < 0 or neighbours(before, token)):
                found.append(((*pending, token), token, 0))
        first = found[0][0]
        agreed = min(len(guess[0]) for guess in found)
        for guess in found:
            while guess[0][:agreed] != first[:agreed]:
                agreed -= 1
        state = tuple([(guess[0][agreed:], guess[1], guess[2]) for guess in found]) if agreed else tuple(found)
        if len(self.steps) >= self.most_steps:
            self._forget()
            return self._number(state), first[:agreed]
        out = self.steps[at << 8 | byte] = self._number(state), first[:agreed]
        return out

    def encode(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        out: list[int] = []
        at = self.start
        for byte in data:
            at, emitted = self.steps.get(at << 8 | byte) or self._step(at, byte)
            if emitted:
                out += emitted
        ended = ()
        for pending, before, node in self.states[at]:
            if before < 0 and node in self.merges.token_at:  # the piece is a token, so nothing has been emitted
                return [self.merges.token_at[node]]
            if not node:
                ended = pending
        return [*out, *ended]


#: Stand-ins of the kinds that a pattern tells apart: letter, number, neither.
KINDS = ((r"\p{L}", "ə"), (r"\p{N}", "٠"), (None, "☃"))


def unlike_letters() -> dict[int, str]:
    """Characters that the two libraries' Unicode versions class differently, with a stand-in of the kind to follow.

    Encoding follows the library whose results it must equal; the other one cuts the texts.
    """
    import regex
    import tiktoken

    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    single = {bytes([i]): i for i in range(256)}

    def kind(pattern: str) -> tuple[set[str], set[str]]:
        found = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        return set(bytes(found).decode()), set(regex.findall(pattern, every))

    wanted, given = zip(*(kind(pattern) for pattern, _ in KINDS[:-1]), strict=True)
    odd = set().union(*(a ^ b for a, b in zip(wanted, given, strict=True)))
    stands = [stand for _, stand in KINDS]
    return {ord(c): next((s for s, of in zip(stands, wanted, strict=False) if c in of), stands[-1]) for c in odd}


class Encoder:
    """Texts to ids: pieces by the pattern, each distinct piece once through the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_pieces: int = MEMO_PIECES):
        import regex

        self.transducer = Transducer(Merges(ranks))
        self.pattern = regex.compile(pattern)
        self.odd = unlike_letters()
        #: Ids by piece in two generations: when the younger is full it becomes the older, and what is asked for again stays.
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.memo_pieces = memo_pieces

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, a batch at a time."""
        seen = text
        if not text.isascii() and any(ord(c) in self.odd for c in set(text)):
            seen = text.translate(self.odd)
        if seen is text and len(text) <= 4 * BATCH:
            yield self.pattern.findall(text)
            return
        found = self.pattern.finditer(seen)
        while part := [text[m.start() : m.end()] for m in itertools.islice(found, BATCH)]:
            yield part

    def _ids(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("I", self.transducer.encode(piece.encode())).tobytes()
        if len(piece) <= MEMO_LENGTH:
            if len(self.memo) >= self.memo_pieces:
                self.memo, self.older = {}, self.memo
            self.memo[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        out = []
        for part in self.pieces(text or ""):
            found = list(map(self.memo.get, part))
            out += found if None not in found else [self._ids(p) if ids is None else ids for p, ids in zip(part, found, strict=True)]
        return b"".join(out)


def _utf8_table() -> np.ndarray:
    """Next state by state and byte: 0 between characters, 8 an error; the others wait for what may follow.

    1, 2, 3: that many more bytes; 4 to 7: after E0, ED, F0, F4, whose next byte has a narrower range.
    """
    to = np.full((8, 256), 8, np.uint8)
    to[0, 0x00:0x80] = 0
    to[0, 0xC2:0xE0], to[0, 0xE0:0xF0], to[0, 0xF0:0xF5] = 1, 2, 3
    to[0, 0xE0], to[0, 0xED], to[0, 0xF0], to[0, 0xF4] = 4, 5, 6, 7
    to[1, 0x80:0xC0], to[2, 0x80:0xC0], to[3, 0x80:0xC0] = 0, 1, 2
    to[4, 0xA0:0xC0], to[5, 0x80:0xA0], to[6, 0x90:0xC0], to[7, 0x80:0x90] = 1, 1, 2, 2
    return to


UTF8 = _utf8_table()


def utf8_state(state: int, data: bytes) -> int:
    """The state after data. An error ends the character before it; its byte is looked at again as a first one."""
    for byte in data:
        after = int(UTF8[state, byte])
        if after == 8 and state:
            after = int(UTF8[0, byte])
        state = after if after < 8 else 0
    return state


class Decoder:
    """Ids to bytes in pieces: each ends with a whole character, or with bytes that never will be one."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = [tokens.get(i) for i in range(max(tokens) + 1)]
        #: Tokens after which the machine is between characters if it was before.
        self.whole = np.array([t is not None and utf8_state(0, t) == 0 and utf8_state(0, t[:1]) != 8 for t in self.tokens])
        self.reset()

    def reset(self) -> None:
        self.state, self.rest = 0, b""

    def feed(self, ids: np.ndarray) -> bytes:
        if len(ids) == 0:
            return b""
        parts = [self.tokens[i] for i in ids.tolist()]
        if None in parts:
            raise ValueError("an id has no token")
        at, n = 0, len(parts)
        split = np.flatnonzero(~self.whole[ids])
        while at < n:
            if self.state == 0:  # whole tokens change nothing: on to the next that is not
                k = int(np.searchsorted(split, at))
                at = int(split[k]) if k < len(split) else n
            if at < n:
                self.state = utf8_state(self.state, parts[at])
                at += 1
        data = self.rest + b"".join(parts)
        open_ = 0
        if self.state:  # the open character begins at the last byte that no character continues
            open_ = 1
            while data[-open_] & 0xC0 == 0x80:
                open_ += 1
        self.rest = data[len(data) - open_ :]
        return data[: len(data) - open_]

    def finish(self) -> bytes:
        """What is left of a character that never was completed."""
        rest = self.rest
        self.reset()
        return rest

    def stream(self, ids: Iterable[np.ndarray]) -> Iterator[str]:
        """Text in pieces; bytes that are no character become U+FFFD."""
        self.reset()
        for part in ids:
            yield self.feed(part).decode("utf-8", "replace")
        yield self.finish().decode("utf-8", "replace")


_MADE: dict[tuple[str, str], tuple[Encoder, Decoder]] = {}


def coder_for(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """One encoder and decoder per Python worker, so that states and pieces last over tasks."""
    if (path, pattern) not in _MADE:
        ranks = read_ranks(path)
        _MADE[path, pattern] = Encoder(ranks, pattern), Decoder({i: t for t, i in ranks.items()})
    return _MADE[path, pattern]


def _per_text(docs: DataFrame, take: str, column: str, out: str, made: Callable[[], Callable[[list], dict[str, pa.Array]]]) -> DataFrame:
    """A row per document: its id column as doc_id, and what ``made()`` gives for lists of values."""
    kind = docs.schema[take].dataType.simpleString()
    rows = docs.select(F.col(take).alias("doc_id"), F.col(column).alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = None
        for batch in batches:
            each = each or made()
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                found = each(piece.column("value").to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *found.values()], ["doc_id", *found])

    return rows.mapInArrow(run, f"doc_id {kind}, {out}")


def encode_texts(docs: DataFrame, path: Callable[[], str], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit integers) of each document.

    path is called in the tasks, so that each machine finds its own copy of the vocabulary.
    """

    def made():
        encoder, _ = coder_for(path(), pattern)
        return lambda texts: {"ids": pa.array([encoder.encode(t) for t in texts], pa.binary())}

    return _per_text(docs, id_col, text_col, "ids binary", made)


def decode_ids(rows: DataFrame, path: Callable[[], str], pattern: str, id_col: str = "doc_id", ids_col: str = "ids", step: int = 1 << 16) -> DataFrame:
    """doc_id and text of each row of ids; null ids are none. Bytes that are no character become U+FFFD."""

    def made():
        _, decoder = coder_for(path(), pattern)

        def text(data: bytes | None) -> str:
            ids = np.frombuffer(data or b"", "<u4")
            return "".join(decoder.stream(ids[i : i + step] for i in range(0, len(ids), step)))

        return lambda values: {"text": pa.array([text(v) for v in values], pa.string())}

    return _per_text(rows, id_col, ids_col, "text string", made)


def round_trip(docs: DataFrame, path: Callable[[], str], pattern: str, id_col: str = "doc_id", text_col: str = "text", step: int = 1 << 16) -> DataFrame:
    """Encode and decode each document: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def made():
        encoder, decoder = coder_for(path(), pattern)

        def each(texts: list[str | None]) -> dict[str, pa.Array]:
            n, ids_hash, text_hash = [], [], []
            for t in texts:
                data = encoder.encode(t)
                ids = np.frombuffer(data, "<u4")
                decoder.reset()
                decoded = hashlib.sha256()
                for i in range(0, len(ids), step):
                    decoded.update(decoder.feed(ids[i : i + step]))
                decoded.update(decoder.finish())
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(data).hexdigest())
                text_hash.append(decoded.hexdigest())
            return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_hash), "decoded_sha256": pa.array(text_hash)}

        return each

    return _per_text(docs, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", made)
