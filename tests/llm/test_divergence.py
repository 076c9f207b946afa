import random
import re
from collections import Counter

import pytest

from itinera.llm.divergence import audit_sources

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, value string"


def plain(docs, least=3, top=200):
    docs = [(t or "", lang or "", source or "") for t, lang, source in docs]
    terms = [TERM.findall(t.translate(LOWER)) for t, _, _ in docs]
    out = []
    for lang in {d[1] for d in docs}:
        own = [(words, d[2]) for words, d in zip(terms, docs, strict=True) if d[1] == lang]
        held = Counter(w for words, _ in own for w in set(words))
        kept = sorted(w for w, n in held.items() if n >= least)
        v = len(kept)
        groups = {source: Counter() for _, source in own}
        for words, source in own:
            groups[source].update(w for w in words if held[w] >= least)
        whole = sum(groups.values(), Counter())
        share = lambda counts, w: 1 + 10**9 * (counts[w] + 1) // (sum(counts.values()) + v)
        f = lambda p, q: (p - q) * (p - q) // q
        shares = {s: {w: share(c, w) for w in kept} for s, c in groups.items()}
        of_lang = {w: share(whole, w) for w in kept}
        for source, p in shares.items():
            pairs = [(-sum(f(p[w], q[w]) for w in kept), other) for other, q in shares.items() if other != source]
            best = [(-f(p[w], of_lang[w]), w) for w in kept if groups[source][w] and p[w] > of_lang[w]]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(best, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, source, part, item, -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def frame(spark, docs, parts=4):
    return spark.createDataFrame([(i, t, lang, source, "t", 9, "v") for i, (t, lang, source) in enumerate(docs)], SCHEMA).repartition(parts)


def corpus(n, seed=1):
    rnd = random.Random(seed)
    words = ["the", "of", "Été", "日本", "a1b", "x", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))]
    return [(" ".join(rnd.choices(words, k=rnd.randrange(0, 50))), rnd.choice(["en", "de", None]), rnd.choice(["s1", "s1", "s1", "s2", "é3", None])) for _ in range(n)]


def found(rows):
    return sorted(map(tuple, rows.collect()))


@pytest.mark.parametrize("options", [{}, {"held": 5, "shard_rows": 40, "top_terms": 7}, {"least_docs": 1}, {"least_docs": 10_000}])
def test_equals_brute_force(spark, options):
    docs = corpus(400)
    got = found(audit_sources(frame(spark, docs), **options))
    assert got == plain(docs, options.get("least_docs", 3), options.get("top_terms", 200))


def test_nulls_repeats_long_texts_and_groups_without_terms(spark):
    docs = [(None, None, None), ("", "en", "empty"), ("12 34 !?", "en", "digits"), ("Alone", "fr", "only"), ("alone", "fr", "other")]
    docs += [("the same words here", "en", "hot")] * 300 + [("Word other " * 150_000 + "q" * 2_000_000, "en", "long")] * 3 + [("word the", "en", "few")] * 2
    assert found(audit_sources(frame(spark, docs))) == plain(docs)


def test_empty_table(spark):
    assert found(audit_sources(frame(spark, []))) == []


def test_equal_values_rank_by_item(spark):
    docs = [(f"{w} common", "en", "a") for w in ("zz", "yy", "é", "b") for _ in range(3)] + [("common", "en", s) for s in ("b", "c", "d")]
    assert found(audit_sources(frame(spark, docs))) == plain(docs)
