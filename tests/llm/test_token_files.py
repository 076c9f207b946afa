import io
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from itinera.llm.token_files import Reader, WordEncoder, cuts_at_spaces, merges_within_words, Writer, pack, token_output, unpack, write_token_files

SCHEMA = "doc_id long, text string, start long, part string"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001, dtype=np.uint64).astype("<u4")
    data = pack(ids, bits)
    assert len(data) == (1001 * bits + 7) // 8 and (unpack(data, 1001, bits) == ids).all()


def test_random_access():
    out, rng = io.BytesIO(), np.random.default_rng(5)
    writer = Writer(out, 11, block=64)
    docs = [rng.integers(0, 2048, n).astype("<u4") for n in (0, 1, 63, 64, 65, 500, 7)]
    for i in (0, 3):
        part = docs[i : i + 3] if i == 0 else docs[3:]
        writer.add(list(range(i, i + len(part))), np.concatenate(part), np.array([len(d) for d in part]))
    writer.close()
    reader = Reader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    whole = np.concatenate(docs)
    assert reader.docs == list(range(7)) and reader.n_ids == len(whole)
    for a, b in [(0, 700), (0, 0), (63, 65), (127, 129), (640, 700), (5, 6)]:
        assert (reader.ids(a, b) == whole[a:b]).all()
    with pytest.raises(ValueError):
        Reader(io.BytesIO(out.getvalue()[:-1]), len(out.getvalue()) - 1)


def test_word_encoder_equals_the_tokenizer():
    rng = random.Random(2)
    plain = Tokenizer.from_file(PATH)
    alphabet = ["the", "Ünï", "don't", "12", "$$$", ",", "...", ".\n", "\n\n", "_", "!é", "²", "\n", "\t", " ", "  ", " ", "\x1c", "　", "<|endoftext|>", "𝒳", "a" * 50]
    texts = ["", " ", "a", " a", "a "] + ["".join(rng.choice(alphabet) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 60))) for _ in range(800)]
    for memo in (10, 10**6):
        encoder = WordEncoder(PATH, memo)
        for i in range(0, len(texts), 50):
            got = encoder.encode(texts[i : i + 50])
            for text, ids in zip(texts[i : i + 50], got):
                assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


class Counted:
    """A tokenizer that notes what it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.given += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_plain_pieces_go_to_the_model_alone():
    """New plain words need no pattern; signs, line ends, added tokens and other letters part as the tokenizer parts them."""
    plain, encoder, rng = Tokenizer.from_file(PATH), WordEncoder(PATH), random.Random(9)
    encoder.tokenizer = Counted(encoder.tokenizer)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 12)))
    for letters in ("abcxyzéöñß019.,$#", "abÉſ019.,$#*_-!\n", "ab'st.,\n ×÷µª½١Ⅷ\x85"):
        texts = [" ".join(word(letters) for _ in range(rng.randint(1, 200))) for _ in range(60)]
        if "\n" in letters:
            texts += ["a <|endoftext|>b c<|endoftext|>\n d", "x ab\ncd.\n\nef g\n"]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        if "\n" not in letters:  # only what begins a text
            assert not any(" " in t for t in encoder.tokenizer.given)
    assert encoder._plain(["word", "été.\nNon", "don't", "a\n\nb", "a<|endoftext|>", "µ"]) == ["word", "été.\nNon"]


def test_merges_over_words_are_met():
    """Where a merge reaches over a place at which the pattern parts, the pattern is kept."""
    for crossing in ("e .", "e Ġ", "1 a", ". Ċ", "Ċ a", "© 1", "- Ã"):
        assert not merges_within_words({"merges": ["t h", crossing]}), crossing
        assert not merges_within_words({"merges": [crossing.split(" ")]})
    assert merges_within_words({"merges": ["t h", "Ġ th", "Ã ©", "' s", ". .", "Ġ 1", ["Ċ", "Ċ"], "Ġ ."]})
    assert not merges_within_words({"merges": [], "ignore_merges": True})


def test_files_hold_every_document(spark):
    plain = Tokenizer.from_file(PATH)
    rows = [(i * 7 % 101, f"text {i} " * (i % 9)) for i in range(101)] + [(200, None), (201, ""), (5, "again"), (5, "again"), (202, "long word " * 20_000), (None, "no id")]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], SCHEMA).repartition(3)
    got = token_output(df, lambda: public_tokenizers.path("byte_bpe_50k.json"), partitions=5).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    start, want = 0, {}
    for doc_id, text in rows:
        tokens = plain.encode(text or "", add_special_tokens=False).ids + [0]
        want.setdefault(doc_id, []).append((len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
    for r in got:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        start += r.n_tokens


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert token_output(df, lambda: PATH).count() == 0 and write_token_files(df, lambda: PATH).count() == 0


def test_other_tokenizers_encode_whole_texts(tmp_path):
    """A file whose tokens may reach over spaces is not cut at them."""
    made = json.loads(Tokenizer.from_file(PATH).to_str())
    assert cuts_at_spaces(made)
    for change in ({"pre_tokenizer": None}, {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {**made["pre_tokenizer"], "add_prefix_space": True}}):
        other = {**made, **change}
        assert not cuts_at_spaces(other)
        path = tmp_path / "other.json"
        path.write_text(json.dumps(other))
        plain = Tokenizer.from_file(str(path))
        texts = ["the Cat  sat", " on THE mat\n now", ""]
        got = WordEncoder(str(path)).encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_no_encoder_outlives_its_stage(spark):
    from itinera.llm.common import giving_back

    docs = spark.createDataFrame([(i, f"word{i} and more", 0, "") for i in range(64)], SCHEMA)
    assert token_output(docs, lambda: PATH).count() == 64

    def held(batches):
        import gc

        import pyarrow as pa

        for batch in batches:
            n = sum(type(x).__name__ == "WordEncoder" for x in gc.get_objects())
            yield pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows, pa.int64())], ["n"])

    rows = spark.range(64).repartition(16).mapInArrow(giving_back(held), "n long")
    assert rows.agg({"n": "max"}).first()[0] == 0  # workers of the encoding tasks among them
