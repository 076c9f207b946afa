import numpy as np
import pytest
from pyspark.sql import functions as F

from itinera.llm.components import connected_components
from itinera.llm.simhash import drop_near_copies, fingerprint, near_dedup, near_links, tile_links

SCHEMA = "doc_id long, text string, fp string, component_id long"


def slow_fingerprint(spark, text):
    words = (text or "").lower().split(None) if (text or "").isascii() else None
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [r[0] & (2**64 - 1) for r in spark.createDataFrame([(i, s) for i, s in enumerate(shingles)], "i int, s string").orderBy("i").select(F.xxhash64("s")).collect()]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t", "One", "one TWO", "a b c", "a b c d", "a b c a b c a b c x\ty\n z" * 7])
def test_fingerprint_is_spark_xxhash64(spark, text):
    assert fingerprint(text) == slow_fingerprint(spark, text)


def test_only_ascii_is_folded():
    assert fingerprint("É b c") != fingerprint("é b c") and fingerprint("A b c") == fingerprint("a B C")
    assert fingerprint("a\u00a0b") != fingerprint("a b")


def brute_components(values, radius=3):
    values, root = sorted(values), {}
    for v in values:
        if v in root:
            continue
        todo, root[v] = [v], v
        while todo:
            x = todo.pop()
            for w in values:
                if w not in root and bin(w ^ x).count("1") <= radius:
                    root[w] = v
                    todo.append(w)
    return root


def planted(seed, n, clusters):
    rng = np.random.default_rng(seed)
    values = {int(x) for x in rng.integers(0, 2**64, n, dtype=np.uint64)} | {0, 2**64 - 1}
    for _ in range(clusters):
        x = int(rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(30):
            x ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))
            values.add(x)
    return sorted(values)


def same_parts(values, a, b):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for x, y in zip(a, b):
        p, q = sorted((root(x), root(y)))
        parent[q] = p
    return {v: root(v) for v in values} == brute_components(values)


def test_tiles_lose_no_link():
    values = np.array(planted(1, 200, 5), np.uint64)
    assert same_parts(values.tolist(), *(x.tolist() for x in tile_links(values, None)))
    left, right = values[::2], values[1::2]
    parts = [tile_links(left, None), tile_links(right, None), tile_links(left, right)]
    assert same_parts(values.tolist(), *(np.concatenate(x).tolist() for x in zip(*parts)))


@pytest.mark.parametrize("tile, blocks", [(4, None), (1024, None), (1024, 5), (8, 6)])
def test_distributed_links_equal_brute_force(spark, tile, blocks):
    values = planted(2, 300, 4) + [(5 << 48) | i for i in range(40)]
    values = sorted(set(values))
    df = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    rows = near_links(df, tile, blocks).collect()
    unsigned = lambda x: x & (2**64 - 1)
    assert same_parts(values, [unsigned(r.a) for r in rows], [unsigned(r.b) for r in rows])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (3, 2), (None, 1)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(30)}


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base), (9, base + " tail"), (7, None), (8, ""), (1, "quite another text here"), (1, "quite another text here"), (None, base)]
    rows += [(20, "x" * 300_000 + " y"), (21, "y " * 100_000)]
    got = near_dedup(spark.createDataFrame([(*r, "f", 0) for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[5].component_id == by[3].component_id == by[None].component_id == 3
    assert by[7].component_id == by[8].component_id == 7 and by[7].fingerprint == "0" * 16
    near = bin(int(by[9].fingerprint, 16) ^ int(by[5].fingerprint, 16)).count("1") <= 3
    assert by[9].component_id == (3 if near else 9)
    assert near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base, "f", 0), (3, base, "f", 0), (3, base, "f", 0), (None, base, "f", 0), (None, "alone here", "g", None), (8, "", "f", 0), (7, None, "f", 0)]
    out = drop_near_copies(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "fp", "component_id"]
    assert sorted((str(r.doc_id), r.fp) for r in out.collect()) == [("3", "f"), ("7", "f"), ("None", "g")]


def near_pairs(texts, width=5):
    sets = [{" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in (t.lower().split() for t in texts)]
    return [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]


@pytest.mark.parametrize("tile", [8, 1024])
def test_edited_copies_go_as_brute_force_says(spark, tile):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 5000, 100)) for _ in range(20)]
    for base in range(6):  # chains of copies, each with words edited in the one before
        for _ in range(8):
            words = texts[base if _ == 0 else -1].split()
            at = rng.integers(0, 100)
            words[at : at + rng.integers(1, 8)] = ["edited"]
            texts.append(" ".join(words))
    base = texts[19].split()  # one large group, each with one other word
    texts += [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(5, 95, 2)]
    parent = list(range(len(texts)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    linked = near_pairs(texts)
    for i, j in linked + [(i, j) for i in range(len(texts)) for j in range(i) if (fingerprint(texts[i]) ^ fingerprint(texts[j])).bit_count() <= 3]:
        p, q = sorted((root(i), root(j)))
        parent[q] = p
    want = sorted({root(i) for i in range(len(texts))})
    docs = spark.createDataFrame([(i, t, "f", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    assert sorted(r.doc_id for r in drop_near_copies(docs, tile=tile, by_shingles=True).collect()) == want
    assert drop_near_copies(docs, tile=tile).count() > len(want)


def test_shingles_of_empty_and_repeated_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base, "f", 0), (3, base, "f", 0), (3, base, "f", 0), (None, base + " tail", "f", 0), (None, "alone here", "g", None), (8, "", "f", 0), (7, None, "f", 0)]
    out = drop_near_copies(spark.createDataFrame(rows, SCHEMA), by_shingles=True)
    assert sorted((str(r.doc_id), r.fp) for r in out.collect()) == [("3", "f"), ("7", "f"), ("None", "g")]
    assert drop_near_copies(spark.createDataFrame([], SCHEMA), by_shingles=True).count() == 0


def test_other_columns_may_have_any_name(spark):
    rows = [(5, "a b c d e f", 1, 2, 3, True, "k"), (3, "a b c d e f", 4, 5, 6, False, "l"), (3, "a b c d e f", 4, 5, 6, False, "l"), (9, "quite other words than these", 7, None, 9, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long, _hash long, _words long, _first boolean, keep string")
    for by_shingles in (False, True):
        out = drop_near_copies(docs, by_shingles=by_shingles)
        assert out.columns == docs.columns
        assert sorted(map(tuple, out.collect())) == [rows[1], rows[3]]


def test_tiles_skip_far_population_counts(monkeypatch):
    """Rows and columns of far population counts are never compared, and no link is lost by it."""
    values, seen = np.array(planted(4, 500, 8), np.uint64), 0
    real = np.bitwise_count

    def counted(x):
        nonlocal seen
        seen += x.size if x.ndim == 2 else 0
        return real(x)

    monkeypatch.setattr(np, "bitwise_count", counted)
    links = tile_links(values, None)
    monkeypatch.undo()
    assert 0 < seen < 0.8 * len(values) ** 2
    assert same_parts(values.tolist(), *(x.tolist() for x in links))
