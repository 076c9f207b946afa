import hashlib
import random
import re

import numpy as np
import pytest

from itinera.llm.decontaminate import FmIndex, _rounds, contamination, cut_spans, decontaminated, suffix_order

SCHEMA = "doc_id long, text string, spans string, item_id long"
ITEMS = "item_id long, text string, n_words long"


def brute_words(text):
    folded = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute(text, items):
    words, hit, found = brute_words(text), set(), set()
    for item_id, item in items:
        w = brute_words(item)
        for i in range(max(1, len(w) - 9) if w else 0):
            window = w[i : i + 10]
            for j in range(len(words) - len(window) + 1):
                if words[j : j + len(window)] == window:
                    hit |= set(range(j, j + len(window)))
                    found.add(str(item_id))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_suffix_order():
    rng = np.random.default_rng(0)
    for text in ([0], [1, 1, 1, 1, 0], rng.integers(1, 3, 500).tolist() * 2 + [0], rng.integers(1, 9, 300).tolist() + [0]):
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert suffix_order(np.array(text)).tolist() == want


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 6, 2000)
    index = FmIndex(text, 7)
    table = rng.integers(1, 6, (60, 4))
    lengths = rng.integers(1, 5, 60)
    low, high = index.search(table, lengths)
    for row, n, a, b in zip(table, lengths, low, high):
        p = row[4 - n :].tolist()
        want = [i for i in range(len(text) - n + 1) if text[i : i + n].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def cases():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "ß𝒳"]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([30, 12, 10, 9, 3, 14, 25])]
    items += [(2, "alpha beta"), (None, "zeta eta theta iota"), (50, None), (51, " .,- "), (52, items[0][1])]
    docs = [None, "", "...", "Alpha--BETA alpha beta gamma", items[0][1].upper(), f"pre {items[1][1]} mid x {items[1][1]} post"]
    docs += [" ".join(rng.choices(vocabulary, k=200)) for _ in range(30)] + [f"x {' '.join(items[5][1].split()[2:13])}, y", "zeta eta theta iota"]
    docs += ["q " * 60_000 + items[2][1], "w0 " * 50_000]
    return [(i, t) for i, t in enumerate(docs)] + [(4, docs[4])], items


@pytest.mark.parametrize("shard_words, round_words", [(1 << 20, 10**6), (500, 40)])
def test_equal_to_brute_force(spark, shard_words, round_words):
    docs, items = cases()
    df = spark.createDataFrame([(*d, "s", 0) for d in docs], SCHEMA).repartition(2)
    bench = spark.createDataFrame([(*i, 0) for i in items], ITEMS)
    items = [("" if i is None else i, t) for i, t in items]
    got = contamination(df, bench, shard_words=shard_words, round_words=round_words).collect()
    assert len(got) == len(docs)
    texts = dict(docs)
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(texts[r.doc_id], items), r.doc_id


def test_cut_takes_passages_out(spark):
    assert cut_spans("One, two three. Four!", [(1, 3)]) == "One, . Four!"
    item = " ".join(f"q{i}" for i in range(15))
    rows = [(1, f"Keep this. {item} And this.", "s", 1), (2, item, "s", 1), (3, None, "s", 1), (4, "clean", None, None)]
    out = decontaminated(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, item, 0)], ITEMS))
    assert out.columns == ["doc_id", "text", "spans", "item_id"]
    assert {r.doc_id: r.text for r in out.collect()} == {1: "Keep this.  And this.", 3: None, 4: "clean"}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], ITEMS)
    assert contamination(docs, items).count() == 0
    one = contamination(spark.createDataFrame([(1, "a b", None, None)], SCHEMA), items).first()
    assert (one.n_words, one.n_hit, one.contaminated) == (2, 0, False)


def test_rounds_hold_bounded_words(spark):
    """Every round has at most its words, long items are cut into overlapping pieces, and no window is lost."""
    rng = random.Random(6)
    items = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([3, 12, 30, 60])))) for i in range(14)] + [(0, "same row of words")] * 200
    df = spark.createDataFrame([(*i, 0) for i in items], ITEMS).select("item_id", "text")
    for most in (25, 10_000):
        rounds = list(_rounds(df, most))
        assert all(sum(len(t.split()) for _, t in r) <= most for r in rounds)
        windows = lambda rows: {(i, tuple(w[j : j + 10])) for i, w in ((i, t.split()) for i, t in rows) for j in range(max(1, len(w) - 9))}
        assert windows(x for r in rounds for x in r) == windows(items)
