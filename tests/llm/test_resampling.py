import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from itinera.llm import resampling
from itinera.llm.resampling import Tournament, features_of, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, score string, run string, place string, rank string"


def features(text, run):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, run + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, run=1, buckets=10_000, seed=2024, percent=10, least=20):
    """Sorted (doc_id, n_features, weight, score, rank), by brute force."""
    bucket = lambda found: Counter(zlib.crc32(x.encode()) % buckets for x in found)
    own = [(d, *features(t, run)) for d, t in docs]
    s, t = Counter(), Counter()
    for _, _, found in own:
        s += bucket(found)
    for text in target:
        t += bucket(features(text, run)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (all_s + buckets) / ((s[k] + 1) * (all_t + buckets)))) for k in range(buckets)]
    rows = []
    for d, n, found in own:
        weight = sum(gain[k] * c for k, c in bucket(found).items())
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def corpus(n, seed=5):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Éa", "ß", "x1", "日本"]
    return [(i, " ".join(rnd.choices(vocabulary, k=rnd.randrange(0, 60)))) for i in range(n)]


def frame(spark, docs, parts=5):
    return spark.createDataFrame([(d, t, "s", "r", "p", "k") for d, t in docs], SCHEMA).repartition(parts)


def found(rows):
    return sorted(map(tuple, rows.collect()), key=str)


@pytest.mark.parametrize(("run", "percent", "rows"), [(1, 10, 1 << 18), (2, 35, 16), (3, 100, 7)])
def test_equals_brute_force(spark, monkeypatch, run, percent, rows):
    monkeypatch.setattr(resampling, "RUN_ROWS", rows)
    monkeypatch.setattr(resampling, "RANGE_ROWS", (16, 32))
    docs, target = corpus(700), [t for _, t in corpus(30, 6)]
    benchmark = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample(frame(spark, docs), benchmark, run=run, percent=percent)
    assert found(got) == plain(docs, target, run, percent=percent)


def test_nulls_ties_repeats_and_long_texts(spark):
    docs = corpus(120) + [(None, "a " * 30), (None, "a " * 30), (7, None), (8, ""), (9, "?! " * 9), (10, "Word " * 300_000), (11, "z" * 3_000_000 + " a" * 20)]
    docs += [(500, "same text " * 15)] * 400  # one document is most of all rows
    got = resample(frame(spark, docs), spark.createDataFrame([("same w1 w2",), (None,)], "text string"), percent=60)
    assert found(got) == plain(docs, ["same w1 w2", None], percent=60)


def test_empty_tables_and_draws(spark):
    none, some = frame(spark, []), frame(spark, corpus(40))
    target = spark.createDataFrame([], "text string")
    assert found(resample(none, target)) == []
    assert found(resample(some, target)) == plain(corpus(40), [])
    assert {r[4] for r in found(resample(some, target, percent=0))} == {None}
    assert {r[4] for r in found(resample(some, target, least_words=1000))} == {None}


def test_draw_follows_the_target(spark):
    docs = [(i, ("apple pear plum " if i % 5 == 0 else "bolt nut gear ") * 3 + " ".join(f"v{(i * k) % 97}" for k in range(15))) for i in range(2000)]
    got = resample(frame(spark, docs), spark.createDataFrame([("apple pear plum",)] * 50, "text string"), percent=10)
    drawn = [r.doc_id for r in got.filter("rank IS NOT NULL").collect()]
    assert len(drawn) == 200 and sum(d % 5 == 0 for d in drawn) > 190


def test_features_of_pieces_equal_those_of_the_whole():
    text = ("One two, three-four É5 " * 150_000).encode()
    got = Counter(f for part in features_of(text, 3) for f in part)
    assert got == Counter(f.encode() for f in features(text.decode(), 3)[1])


def test_tournament_merges_any_number_of_sources():
    rnd = random.Random(3)
    for k in range(12):
        sources = [sorted(rnd.randbytes(3) for _ in range(rnd.randrange(0, 9))) for _ in range(k)]
        got = [key for key, _ in Tournament([iter([(x, None) for x in s]) for s in sources])] if sources else []
        assert got == sorted(x for s in sources for x in s)
