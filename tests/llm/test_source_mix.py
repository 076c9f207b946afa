import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from itinera.llm import source_mix as M
from itinera.llm.source_mix import mix, mixed, sainte_lague, take_words, water_fill

SCHEMA = "doc_id long, text string, source string, shard string, target double"


def slow_sainte_lague(votes, seats, most):
    out = [0] * len(votes)
    for _ in range(seats):
        q = [Fraction(v) / (2 * n + 1) if n < m and v > 0 else Fraction(-1) for v, n, m in zip(votes, out, most)]
        best = max(range(len(q)), key=lambda i: q[i])
        if q[best] < 0:
            break
        out[best] += 1
    return out


def test_sainte_lague_equals_highest_quotients():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 8)
        votes = [rng.choice([0, 1, 2, 3, 10, rng.randint(1, 1000)]) for _ in range(n)]
        most = [rng.choice([10**6, rng.randint(0, 20)]) for _ in range(n)]
        seats = rng.randint(0, 60)
        got = sainte_lague(np.array(votes), seats, np.array(most)).tolist()
        want = slow_sainte_lague(votes, seats, most)
        assert sum(got) == sum(want) and sorted(zip(votes, got)) == sorted(zip(votes, want)) if len(set(most)) == 1 else sum(got) == sum(want)


def slow_targets(sizes, weights):
    left, full = 1.5 * sum(sizes), {}
    while True:
        open_ = [i for i in range(len(sizes)) if i not in full]
        total = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / total for i in open_} if total else {}
        over = [i for i in open_ if share[i] > 2 * sizes[i] + 1e-9]
        if not over:
            return [full.get(i, share.get(i, 0.0)) for i in range(len(sizes))]
        for i in over:
            full[i] = 2.0 * sizes[i]
            left -= full[i]


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 100, 5, 7], [0, 0], [5], [1000, 1, 1, 1], []])
def test_targets(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    assert np.allclose(water_fill(sizes, weights), slow_targets(sizes, weights))


def rows():
    rng, out = random.Random(2), []
    for i in range(900):
        source = rng.choice(["a", "a", "a", "b", "É", "z", None])
        out.append((i, " ".join(f"w{i}.{j}" for j in range(rng.choice([0, 1, 5, 40, 300])))[:20_000], source, "s", 0.0))
    return out + [(900, None, "b", "s", 0.0), (901, " \t ", "b", "s", 0.0), (3, out[3][1], out[3][2], "s", 0.0), (902, "x " * 60_000, "z", None, None)]


@pytest.mark.parametrize("shard_words", [1 << 18, 3000])
def test_taken_words_come_near_targets(spark, shard_words):
    data = rows()
    got = mix(spark.createDataFrame(data, SCHEMA).repartition(3), shard_words=shard_words).collect()
    assert len(got) == len(data)
    sizes = {}
    for doc_id, text, source, *_ in data:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, slow_targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    by_id = {d[0]: d for d in data}
    taken = {}
    for r in got:
        source = by_id[r.doc_id][2]
        assert r.size == len((by_id[r.doc_id][1] or "").split()) and r.source_size == sizes[source]
        assert abs(r.target - want[source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[source] = taken.get(source, 0) + r.taken
    for s in names:
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 64
    again = mix(spark.createDataFrame(data, SCHEMA).repartition(5), shard_words=shard_words).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_mixed_rows_hold_the_taken_words(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    out = mixed(df, shard_words=3000)
    assert out.columns == df.columns
    counts, texts = {}, {}
    for r in out.collect():
        counts[r.source] = counts.get(r.source, 0) + len(r.text.split())
        texts.setdefault(r.doc_id, []).append(r.text)
    want = {}
    by_id = {}
    for r in mix(df, shard_words=3000).collect():
        by_id[r.doc_id] = r
    for doc_id, text, source, *_ in data:
        want[source] = by_id[doc_id].target
    for s, target in want.items():
        assert abs(counts.get(s, 0) - target) <= 0.01 * target + 64
    whole = sum(t == dict((d[0], d[1]) for d in data)[i] for i, ts in texts.items() for t in ts)
    assert whole > 0.7 * sum(map(len, texts.values()))


def test_take_words():
    assert take_words(" a  b\tc d", [(0, 4)]) == " a  b\tc d" and take_words(" a  b\tc d", [(0, 1), (2, 4)]) == "a\nc d"


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mix(df).count() == 0 and mixed(df).count() == 0


def test_taken_words_equal_a_plain_ring(spark):
    """Word by word: a shard's quota of blocks is laid around its ring of documents from the seeded start."""
    rng = random.Random(12)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([0, 1, 3, 8, 50, 400, 3000])) for i in range(300)]
    sized = spark.createDataFrame(rows, "row long, source string, size long")
    found = M.mix_sizes(sized, shard_words=5000).select(
        "row", "source", "shard", "size", "taken", F.xxhash64("key").alias("place"), F.xxhash64(F.lit(M.SEED), "source", "shard").alias("start")
    ).collect()
    shards = {}
    for r in found:
        shards.setdefault((r.source, r.shard), []).append(r)
    plan = M.plan_mix([(source, shard, sum(r.size for r in docs)) for (source, shard), docs in shards.items()])
    assert len(shards) > 8 and sum(r.taken for r in found) > 0
    for (source, shard), docs in shards.items():
        docs.sort(key=lambda r: (r.place, r.row))
        words = [r.row for r in docs for _ in range(r.size)]
        blocks = [words[i : i + M.BLOCK] for i in range(0, len(words), M.BLOCK)]
        taken = dict.fromkeys((r.row for r in docs), 0)
        first = docs[0].start % len(blocks) if blocks else 0
        for k in range(plan[source][2][shard]):
            for row in blocks[(first + k) % len(blocks)]:
                taken[row] += 1
        assert {r.row: r.taken for r in docs} == taken


def test_very_long_texts_and_clashing_names(spark):
    rows = [(1, "word " * 200_000, "s", 5, "x", 1.0), (2, "a b", "s", 6, "y", 2.0), (3, None, None, 7, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row long, _row string, target double")
    assert {r.doc_id: r["size"] for r in M.mix(docs).collect()} == {1: 200_000, 2: 2, 3: 0}
    out = M.mixed(docs)
    assert out.columns == docs.columns and out.filter("doc_id = 1").count() >= 1
