import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from itinera.llm import language_id as L
from itinera.llm.language_id import Model, build_model, fold, has_letter, identify, keep_identified, ngram_hashes, train

SCHEMA = "doc_id long, text string, lang string, score double, keep string"
LETTERS = {"aa": "abcdefg ", "bb": "fghijklm ", "cc": "mnopqrsé "}


def corpus(n=60, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = sorted(LETTERS)[i % 3]
        rows.append((i, "".join(rng.choices(LETTERS[lang], k=200)), lang, 0.0, ""))
    return rows


def test_held_out_rule_and_accuracy(spark):
    rows = corpus(120) + [(1000, None, "aa", 0.0, ""), (1001, "123 !!", "aa", 0.0, ""), (1002, "", None, 0.0, ""), (1003, "abc " * 50_000, None, None, None)]
    rows += [rows[0], (None, "abcd gfed", None, 0.0, "")]
    got = identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in corpus(120)}
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id in (1000, 1001, 1002):
            assert r.lang_pred == "und" and r.rejected
        if r.doc_id in truth:
            assert r.lang_pred == truth[r.doc_id] and not r.rejected
    assert {r.lang_pred for r in got if r.doc_id == 1003} == {"aa"}


def test_model_equals_a_plain_kneser_ney():
    """Every probability, and that they sum to one, against dictionaries."""
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcd ", k=80)) for _ in range(12)]
    order, grams = 3, {}
    for t in texts:
        p = fold(t)
        for n in (1, 2, 3):
            for i in range(len(p) - n + 1):
                g = tuple(p[i : i + n].tolist())
                grams.setdefault(n, {}).setdefault(g, 0)
                grams[n][g] += 1
    h = lambda g: ngram_hashes(np.array(g, np.uint64), len(g))[0] if g else np.uint64(0)
    counts = {n: tuple(np.array([f(g) for g in grams[n]], np.uint64) for f in (h, lambda g: h(g[:-1]), lambda g: h(g[1:]))) + (np.array(list(grams[n].values())),) for n in grams}
    model = build_model({"x": counts}, order)

    used = {3: dict(grams[3])}
    for n in (2, 1):
        used[n] = {g: len({b[0] for b in grams[n + 1] if b[1:] == g}) or min(grams[n][g], 1) for g in grams[n]}

    def discount(n):
        ones, twos = (sum(c == k for c in used[n].values()) for k in (1, 2))
        return ones / (ones + 2 * twos) if ones and twos else 0.5

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / (len(used[1]) + 1)
        around = {k: c for k, c in used[n].items() if k[:-1] == g[:-1]}
        if not around:
            return p(g[1:])
        total, d = sum(around.values()), discount(n)
        return max(around.get(g, 0) - (d if g in around else 0), 0) / total + d * len(around) / total * p(g[1:])

    alphabet = [g[0] for g in grams[1]]
    for context in [(), (0,), tuple(fold("ab")[:2].tolist()), (ord("a"), ord("b"))]:
        assert abs(sum(p((*context, c)) for c in alphabet) + p((*context, 77)) - 1) < 1e-9
    for t in ["abcd", "dd cc", "xyz", "a"]:
        points = fold(t).tolist()
        want = -sum(math.log(p(tuple(points[max(0, i - 2) : i + 1]))) for i in range(1, len(points))) / (len(points) - 1)
        assert abs(model.cross_entropy(fold(t))[0] - want) < 1e-9


def test_long_texts_are_scored_in_parts(spark, monkeypatch):
    model = train(spark.createDataFrame(corpus(), SCHEMA))
    texts = ["abc def " * 80_000, "", None, "a", "12", "mno  é pq rs" * 40, "ABC\ud800 déf", "½ Ⅷ ① ²"]
    points, starts = L.fold_all(texts)
    assert [points[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == [fold(t).tolist() for t in texts]
    apart = np.array([model.cross_entropy(fold(t)) for t in texts])
    assert np.allclose(model.cross_entropies(points, starts), apart)
    short, cut = L.fold_all(texts[1:])
    monkeypatch.setattr(L, "SCORE_POINTS", 37)
    assert np.allclose(model.cross_entropies(short, cut), apart[1:])
    assert model.predict(texts)[0][-1] == "und" and not has_letter(texts[-1])


def test_many_languages_take_several_blocks(spark):
    """Blocks do not change a language's model, and only bound what n-grams cost."""
    rng, rows = random.Random(3), []
    for i in range(220):
        lang = f"l{i % 11:02d}"
        rows.append((i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz"[i % 11 : i % 11 + 6] + " ", k=150)), lang, 0.0, ""))
    model = train(spark.createDataFrame(rows, SCHEMA))
    alone = train(spark.createDataFrame([r for r in rows if r[2] == "l09"], SCHEMA))
    assert len(model.blocks) == 2 and len(model.languages) == 11
    for _, text, *_ in rows[:30]:
        assert np.allclose(model.cross_entropy(fold(text))[9], alone.cross_entropy(fold(text))[0])


def test_rejects_other_scripts_and_keeps_the_rest(spark):
    rows = corpus(90) + [(500, "слово и дело " * 9, None, 0.0, ""), (501, None, None, 0.0, "")]
    out = keep_identified(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "lang", "score", "keep"]
    assert sorted(r.doc_id for r in out.collect()) == list(range(90))


def test_no_labels_and_empty(spark):
    rows = [(1, "abc", None, 0.0, "")]
    assert identify(spark.createDataFrame(rows, SCHEMA)).first().lang_pred == "und"
    assert identify(spark.createDataFrame([], SCHEMA)).count() == 0
    assert not has_letter("1_2") and has_letter("é") and Model([]).predict(["a"])[0] == ["und"]


def test_copies_do_not_thin_the_sample(spark):
    """A language of few texts in very many rows keeps all of these in its sample."""
    rows = [r for r in corpus(90)]
    many = spark.createDataFrame([r for r in rows if r[2] == "aa"], SCHEMA).crossJoin(spark.range(1000).select("id")).drop("id")
    rest = spark.createDataFrame([r for r in rows if r[2] != "aa"], SCHEMA)
    thin = train(many.unionByName(rest), sample_docs=40)
    whole = train(spark.createDataFrame(rows, SCHEMA), sample_docs=40)
    assert thin.languages == whole.languages == ["aa", "bb", "cc"]
    for a, b in zip(thin.blocks[0], whole.blocks[0], strict=True):
        assert np.array_equal(a.keys, b.keys) and np.allclose(a.values, b.values)


def sentences():
    """Four languages of the given tables' kind, and what is none of them."""
    rng = random.Random(11)
    parts = {lang: ["".join(rng.choices(letters, k=rng.randint(2, 3))) for _ in range(40)] for lang, letters in {"w": "etaoinsh", "x": "lmdeuro", "y": "scahtng", "z": "bordina"}.items()}

    def text(lang, n):
        return " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(n))

    return rng, parts, text


def test_rejection_is_a_quantile_of_clean_text_of_any_length(spark):
    rng, parts, text = sentences()
    rows = [(i, text(lang, rng.randint(5, 120)), lang, 0.0, "") for i in range(800) for lang in parts]
    model = train(spark.createDataFrame(rows, SCHEMA))
    clean = [text(rng.choice("wxyz"), rng.randint(1, 200)) for _ in range(2000)]
    assert model.predict(clean)[3].mean() <= 0.005
    other = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(rng.randint(8, 60))) for _ in range(300)]
    other += ["the quick brown fox jumps over the lazy dog while nobody was looking", "questa frase non appartiene a nessuna delle lingue conosciute qui", "быстрая лиса перепрыгнула через собаку", "ova rečenica nije napisana ni na jednom od naučenih jezika"] * 20
    assert model.predict(other)[3].mean() >= 0.95


FOREIGN = """questa frase non appartiene a nessuna delle lingue conosciute qui
ova rečenica nije napisana ni na jednom od naučenih jezika
the quick brown fox jumps over the lazy dog while nobody was looking
der schnelle braune Fuchs springt über den faulen Hund und niemand sieht zu
dzisiaj jest bardzo ładna pogoda i wszyscy idziemy razem na długi spacer
tämä lause on kirjoitettu suomeksi eikä sitä pitäisi tunnistaa
быстрая лиса перепрыгнула через собаку и убежала в тёмный лес
for (int i = 0; i < n; i++) { sum += values[i] * weights[i]; } return sum;
SELECT name, count(*) FROM users WHERE active GROUP BY name ORDER BY 2 DESC
aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa
het is vandaag mooi weer en we gaan naar het strand met de kinderen
bugün hava çok güzel ve biz denize gideceğiz
jag vill gärna ha en kopp kaffe och en bulle tack så mycket
o rato roeu a roupa do rei de roma e a rainha ficou muito zangada
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor
kuinka paljon tämä maksaa ja missä on lähin pankki
les enfants jouent dans le jardin pendant que leur mère prépare le dîner
def parse(line): return [int(x) for x in line.split(",") if x.strip()]""".splitlines()


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_rejection_is_alike_on_small_and_large_tables(spark, sf):
    """The tables' invented prose stays; real sentences of any language, code and random letters go."""
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    model = train(docs.filter(~L.held_out(F.col("doc_id"))))
    rng = random.Random(5)
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(rng.randint(8, 60))) for _ in range(40)]
    gone = model.predict(FOREIGN + noise)[3]
    assert gone[: len(FOREIGN)].mean() >= 0.9 and gone[len(FOREIGN) :].all(), [t for t, x in zip(FOREIGN, gone, strict=False) if not x]
    kept = [r.text for r in docs.select("text").collect() if has_letter(r.text)]
    assert model.predict(kept)[3].mean() <= 0.0005


def test_thresholds_do_not_follow_single_junk_documents():
    """A calibration document of junk among a hundred moves the thresholds by little."""
    rng = np.random.default_rng(2)
    rows = []
    for doc in range(100):
        for k in range(2, 11):
            for n in range(4):
                rows.append(("w", k, 1.5 + rng.normal(0, 1 / 2 ** (k / 2)), 1.0, True, 4.5 if (k, n) == (2, 0) else None, 900 if (k, n) == (2, 0) else None))
    columns = ["lang", "size", "entropy", "evidence", "right", "noise", "chars"]
    clean = pd.DataFrame(rows, columns=columns)
    junk = pd.DataFrame([("w", k, 5.0, 1.0, True, None, None) for k in range(2, 11) for _ in range(4)], columns=columns).astype(clean.dtypes)
    a, b = L.thresholds(clean, ["w", "x"]), L.thresholds(pd.concat([clean, junk], ignore_index=True), ["w", "x"])
    assert a.shape == (2, L.LENGTHS) and np.allclose(a[0], a[1]) and np.isfinite(a).all()
    assert np.abs(a - b).max() < 0.3 and a[0, 8] < 3.0
    over = clean["entropy"].to_numpy() > a[0][clean["size"]]
    assert over.mean() <= 0.002


def test_identify_equals_each_text_by_itself(spark):
    rows = corpus(150) + [(900 + i, t, None, 0.0, "") for i, t in enumerate(["", "a", "zzz qqq", None, "abc mno " * 20_000])]
    df = spark.createDataFrame(rows, SCHEMA)
    model = train(df.filter(~L.held_out(F.col("doc_id"))))
    texts = {r[0]: r[1] for r in rows}
    for r in identify(df.repartition(3)).collect():
        text = texts[r.doc_id]
        if not has_letter(text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        entropies = model.cross_entropy(fold(text))
        assert r.lang_pred == model.languages[int(entropies.argmin())] and abs(r.cross_entropy - entropies.min()) < 1e-9
        limit = model.thresholds[int(entropies.argmin()), int(L.length_class(np.array([len(fold(text)) - 1]))[0])]
        assert r.rejected == (entropies.min() > limit)
