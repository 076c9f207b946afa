import functools
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from itinera.llm import byte_bpe
from itinera.llm.byte_bpe import Decoder, Encoder, Merges, Transducer, coder_for, decode_ids, encode_texts, read_ranks, round_trip
from itinera.llm.queries import byte_bpe_ranks_path as path


@pytest.fixture(scope="module")
def coder():
    return coder_for(path(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def known():
    return library()


def ids_of(known, text):
    return np.array(known.encode_ordinary(text), "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("ab 's'tLLé日\n1", max_size=80))
def test_equals_the_library(text):
    encoder, _ = coder_for(path(), public_tokenizers.PATTERN)
    assert encoder.encode(text) == ids_of(library(), text)


@functools.cache
def read_ranks_once():
    return read_ranks(path())


@functools.cache
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks_once(), special_tokens={})


def test_every_character_and_long_texts(coder, known):
    every = "".join(f"a{chr(c)}1" for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for text in (every, "a" * 200_000, "ab" * 50_000, " " * 20_000 + "x", "日本語" * 30_000, "é" * 50_000, "\n \t" * 9_000):
        assert coder[0].encode(text) == ids_of(known, text)


def test_lookahead_is_bounded(coder):
    encoder, rnd = coder[0], random.Random(2)
    longest = max(map(len, encoder.transducer.merges.ranks))
    encoder.encode("".join(chr(rnd.choice([rnd.randrange(97, 123), rnd.randrange(0x3040, 0x9000)])) for _ in range(30_000)))
    assert max(len(pending) for state in encoder.transducer.states for pending, _, _ in state) <= longest


def test_forgetting_states_changes_nothing(known):
    merges = Merges(read_ranks_once())
    small, rnd = Transducer(merges, most_steps=50), random.Random(4)
    for _ in range(200):
        piece = "".join(rnd.choices("etaoin shrdlué日本", k=rnd.randrange(1, 40))).replace(" ", "")
        if piece:
            assert small.encode(piece.encode()) == known._core_bpe.encode_single_piece(piece.encode())


def test_small_vocabularies_with_odd_merges():
    """Random ranks: tokens that their merges never give, ranks out of order, long runs."""
    rnd = random.Random(8)
    for _ in range(60):
        words = {bytes([b]) for b in range(256)}
        while len(words) < 256 + 40:
            words.add(bytes(rnd.choices(b"abc", k=rnd.randrange(2, 6))))
        late = sorted(words - {w for w in words if len(w) == 1}, key=lambda w: rnd.random())
        ranks = {w: i for i, w in enumerate([*(bytes([b]) for b in range(256)), *late])}
        plain = tiktoken.Encoding("own", pat_str="[a-z]+", mergeable_ranks=ranks, special_tokens={})
        transducer = Transducer(Merges(ranks))
        for _ in range(60):
            piece = bytes(rnd.choices(b"abc", k=rnd.randrange(1, 30)))
            assert transducer.encode(piece) == plain._core_bpe.encode_single_piece(piece), (piece, late)


def test_missing_bytes_are_an_error():
    with pytest.raises(ValueError, match="no token"):
        Merges({b"a": 0})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 50_255), max_size=40), st.integers(1, 7))
def test_streams_decode_like_the_whole(ids, step):
    _, decoder = coder_for(path(), public_tokenizers.PATTERN)
    whole = b"".join(decoder.tokens[i] for i in ids)
    ids = np.array(ids, "<u4")
    parts = [ids[i : i + step] for i in range(0, len(ids), step)]
    assert "".join(decoder.stream(parts)) == whole.decode("utf-8", "replace")
    decoder.reset()
    for part in parts:
        decoder.feed(part).decode("utf-8", "replace")
    decoder.finish()


def test_streams_of_valid_text_never_cut_a_character(coder):
    encoder, decoder = coder
    text = "naïve 日本語 🏔️ Ελλάδα \U00010000 x" * 20
    ids = np.frombuffer(encoder.encode(text), "<u4")
    decoder.reset()
    parts = [decoder.feed(ids[i : i + 1]) for i in range(len(ids))]
    assert "".join(p.decode() for p in parts) == text and decoder.finish() == b""


def test_unknown_ids_are_an_error(coder):
    with pytest.raises((ValueError, IndexError)):
        Decoder({0: b"a", 2: b"b"}).feed(np.array([1]))


def test_frames(spark, known):
    rows = [(1, "Hello, world"), (2, None), (3, ""), (3, ""), (None, "é " * 9), (4, "It's 2024 日本\n\n  x"), (5, "word " * 200_000), (5, "x" * 300_000)]
    docs = spark.createDataFrame([(d, t, "a", "b") for d, t in rows], "doc_id long, text string, value string, ids string")

    def wanted(text):
        ids = ids_of(known, text or "")
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    got = round_trip(docs, path, public_tokenizers.PATTERN).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((d, *wanted(t)) for d, t in rows), key=str)
    ids = encode_texts(docs, path, public_tokenizers.PATTERN)
    assert sorted((r.doc_id, bytes(r.ids)) for r in ids.collect() if r.doc_id) == sorted((d, ids_of(known, t or "")) for d, t in rows if d)
    back = decode_ids(ids, path, public_tokenizers.PATTERN, step=3)
    assert sorted((r.doc_id, r.text) for r in back.collect() if r.doc_id) == sorted((d, t or "") for d, t in rows if d)
    assert round_trip(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_the_memo_is_bounded(monkeypatch, known):
    monkeypatch.setattr(byte_bpe, "MEMO_LENGTH", 12)
    encoder = Encoder(read_ranks_once(), public_tokenizers.PATTERN, memo_pieces=10)
    text = " ".join(f"w{i}" for i in range(200)) + " averyverylongwordindeed"
    assert encoder.encode(text) == ids_of(known, text) and len(encoder.memo) <= 10
