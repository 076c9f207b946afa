import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from itinera.llm import source_mix
from itinera.llm.simhash import fingerprint

corpus_pipeline = pytest.importorskip("corpus_pipeline")

DIR = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").cache()
    source, columns = docs.count(), docs.columns
    counts = [source]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR).cache()
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[1] >= 0.95 * source and counts[2] < counts[1] and counts[3] >= 0.9 * counts[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect()
    assert len(last) == counts[-1]
    last.sort(key=lambda r: r.start)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(last, last[1:]))


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    assert docs.count() == 0


def words(text):
    folded = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def test_stages_equal_brute_force(spark):
    """Each stage on its own input: the kept rows, the cut passages, the taken words, the tokens."""
    bench = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    phrases = {tuple(w[i : i + 10]) for w in map(words, bench) for i in range(max(1, len(w) - 9))}
    source = spark.read.parquet(f"{DIR}/documents.parquet").cache()
    held = {r.doc_id: r for r in source.collect()}

    named = corpus_pipeline.identify_language(spark, source, DIR).cache()
    texts = {r.doc_id: r.text for r in named.collect()}
    assert all(texts[i] == held[i].text for i in texts)
    assert {i for i, r in held.items() if len(r.text) > 200} <= set(texts)

    kept = corpus_pipeline.drop_near_copies(spark, named, DIR).cache()
    prints = {i: fingerprint(t) for i, t in texts.items()}
    roots, ids = {}, sorted(prints)
    for i in ids:
        todo = [] if i in roots else [i]
        while todo:
            j = todo.pop()
            if j not in roots:
                roots[j] = i
                todo += [k for k in ids if k not in roots and (prints[j] ^ prints[k]).bit_count() <= 3]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(roots.values()))

    clean = corpus_pipeline.decontaminate_benchmark(spark, kept, DIR).cache()
    after = {r.doc_id: r.text for r in clean.collect()}
    for r in kept.collect():
        w = words(r.text)
        hit = {j for i in range(len(w)) for n in {len(p) for p in phrases} if tuple(w[i : i + n]) in phrases for j in range(i, i + n)}
        if hit:
            assert words(after.get(r.doc_id, "")) == [x for i, x in enumerate(w) if i not in hit]
        else:
            assert after[r.doc_id] == r.text

    mixed = corpus_pipeline.mix_sources(spark, clean, DIR).cache()
    taken = {r.doc_id: r.taken for r in source_mix.mix(clean).collect()}
    target, got = {}, {}
    for r in mixed.collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
        assert taken[r.doc_id] >= 0 and r.text.split()[0] in after[r.doc_id]
    for r in source_mix.mix(clean).join(clean.select("doc_id", "source"), "doc_id").collect():
        target[r.source] = r.target
    assert all(abs(got.get(s, 0) - t) <= 0.01 * t + 64 for s, t in target.items())

    plain = Tokenizer.from_file(corpus_pipeline.byte_bpe_path())
    want = sorted((r.doc_id, zlib.crc32(np.array(plain.encode(r.text, add_special_tokens=False).ids + [0], "<u4").tobytes())) for r in mixed.collect())
    assert sorted((r.doc_id, r.ids_crc32) for r in corpus_pipeline.write_tokens(spark, mixed, DIR).collect()) == want


def test_near_dedup_stage_leaves_no_near_copy(spark):
    """Of texts whose five-word shingles overlap by 0.8 one stays."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    texts = [r.text for r in dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, DIR).collect()]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for t in texts)]
    assert len(sets) > 150
    assert not [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
