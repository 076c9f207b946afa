"""Language identification by interpolated Kneser-Ney character models.

One model per language, over folded text (letters lower-cased, anything else one
space; a letter is what ``str.isalpha`` says). The n-gram counts come from a bounded
sample of labelled documents, counted in Spark tasks. Each language's model is kept
as differences: what an n-gram adds to the log probability that its suffix gives,
and what a context takes off. The log probability of a text is then a plain sum
over its n-grams, and an n-gram that a language lacks adds nothing. Up to
LANGUAGES_IN_BLOCK languages share one sorted hash array per order, so the model
grows in proportion to the n-grams of all languages, not to their product. The
language of the lowest cross-entropy per character wins.

Rejection is calibrated on sample documents that do not train: whole, in pieces of
one word up to thousands of letters, and with their letters shuffled. A language's
threshold for a length is the median cross-entropy of its own pieces plus the larger of
two distances. One is SHARE of the way from there to its shuffled text, which has the
language's letters but none of its order, as text of other languages has: it tells these
apart. The other keeps short text, whose cross-entropy varies: the QUANTILE of the
deviations, which falls with length as ``a / sqrt(length) + b``, fitted to the BODY
quantiles of all lengths and languages at once and carried on to QUANTILE as an
exponential tail, plus MARGIN. Medians and the body are steady in small samples and do
not follow single documents of junk, so a small table has thresholds close to those of a
large one. The score is a logistic curve over the evidence for the first language
against the second.

Defined results: null text, or text without a letter, is ``und`` with score 0 and
is rejected; ties go to the first language by name; repeated rows are predicted
each; without labelled rows every document is ``und``; an empty table gives an
empty result; texts of any length are read whole, in parts of bounded size; other
columns keep their names and values, whatever these are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itinera.llm.common import giving_back, materialise, small_or_shuffled

ORDER = 4
#: The sample: at most so many labelled documents of each language, those of least hash.
SAMPLE_DOCS = 1800
#: Every so-manieth of them calibrates the model instead of training it.
CALIBRATION_EVERY = 6
#: Languages that share one sorted hash array.
LANGUAGES_IN_BLOCK = 8
#: Share of a language's own text that its threshold keeps, and nats a character above it.
QUANTILE, MARGIN = 0.999, 0.1
#: Quantile of the deviations that is measured, and the share of the way to shuffled text.
BODY, SHARE = 0.95, 0.45
#: Lengths (as powers of two) of the calibration pieces, and pieces of each a document.
LENGTHS, PIECES = 13, 4
UNKNOWN = "und"
#: Range of the hashes by which texts are sampled.
SPAN = 1 << 40
#: Characters that are folded at once at least, and points that are scored at once.
FOLD_CHARS, SCORE_POINTS = 1 << 18, 1 << 16


@lru_cache(1)
def _letters() -> np.ndarray:
    """For every code point the lower-case letter, or 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            out[point] = ord(char.lower()[0])
    return out


def fold_all(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Folded points of all texts in a row, and where each text starts (one more than texts)."""
    line = "".join([f"\n{t or ''}\n" for t in texts])
    points = _letters()[np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")]
    sizes = np.fromiter((len(t or "") + 2 for t in texts), np.int64, len(texts))
    kept = points != 0
    kept[1:] |= points[:-1] != 0
    starts = np.concatenate(([0], np.cumsum(sizes)))
    kept[starts[:-1]] = True
    return points[kept].astype(np.uint64), np.concatenate(([0], np.cumsum(kept)))[starts]


def fold(text: str | None) -> np.ndarray:
    """Code points of the text, with one space (0) for each run of non-letters, and around it."""
    return fold_all([text])[0]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def ngram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n-gram."""
    if len(points) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(points) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + points[i : i + len(out)] + np.uint64(1)
    return _mixed(out)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


class Table:
    """A sorted hash array with a row of values for each hash; the last row is that of unknown ones."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, weights: np.ndarray | None):
        self.keys = np.concatenate((keys, [np.uint64(2**64 - 1)]))
        self.values, self.weights = values, weights
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        # Hashes are even, so their first bits lead to within a few keys of the place.
        self.heads = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash."""
        at = self.heads[(hashes >> self.shift).astype(np.int64)].astype(np.int64)
        less = np.nonzero(self.keys[at] < hashes)[0]
        while len(less):
            at[less] += 1
            less = less[self.keys[at[less]] < hashes[less]]
        return np.where(self.keys[at] == hashes, at, len(self.keys) - 1)


@dataclass
class Model:
    languages: list[str]
    order: int = ORDER
    #: blocks of languages in order, each a table per n-gram order
    blocks: list[list[Table]] = field(default_factory=list)
    #: per language and length: cross-entropy from which on text is rejected
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    curve: tuple[float, float] = (1.0, 0.0)

    def cross_entropies(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Nats a character of each text [text, language]; every text starts and ends with a space."""
        sizes = np.diff(starts)
        total = np.zeros((len(sizes), len(self.languages)))
        texts = np.nonzero(sizes > 1)[0]
        if not len(texts):
            return total
        place = np.arange(len(points)) - np.repeat(starts[:-1], sizes)  # within the text
        at = 0
        for tables in self.blocks:
            width = tables[0].values.shape[1]
            block = total[:, at : at + width]
            at += width
            for a in range(0, len(points), SCORE_POINTS):
                b, low = min(len(points), a + SCORE_POINTS), max(0, a - self.order + 1)
                raw = np.zeros(b - low, np.uint64)
                summed = np.zeros((b - a, width))
                for n in range(1, self.order + 1):
                    before = np.concatenate((np.zeros(1, np.uint64), raw[:-1])) if n > 1 else raw
                    raw = before * np.uint64(0x9E3779B97F4A7C15) + points[low:b] + np.uint64(1)
                    where = tables[n - 1].find(_mixed(raw[a - low :]))
                    where[place[a:b] < n - 1] = len(tables[n - 1].keys) - 1 if n > 1 else 0
                    summed += tables[n - 1].values[where]
                cuts = np.unique(np.concatenate(([a], starts[(starts > a) & (starts < b)])))
                owner = np.searchsorted(starts, cuts, "right") - 1
                np.add.at(block, owner, np.add.reduceat(summed, cuts - a, axis=0))
            # The first space is given, and no character follows the last one.
            first = tables[0].find(ngram_hashes(points[:1], 1))
            block[texts] -= tables[0].values[first] - tables[0].weights[first]
            for n in range(1, self.order):
                ending = texts[sizes[texts] >= n]
                grams = np.stack([points[starts[ending + 1] - n + i] for i in range(n)], axis=1)
                raw = np.zeros(len(ending), np.uint64)
                for i in range(n):
                    raw = raw * np.uint64(0x9E3779B97F4A7C15) + grams[:, i] + np.uint64(1)
                block[ending] -= tables[n - 1].weights[tables[n - 1].find(_mixed(raw))]
        total[sizes <= 1] = 0  # nothing but a space
        return -total / np.maximum(1, sizes - 1)[:, None]

    def cross_entropy(self, points: np.ndarray) -> np.ndarray:
        return self.cross_entropies(points, np.array([0, len(points)]))[0]

    def judge(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its cross-entropy, the evidence for it and whether it is rejected, per text."""
        entropies, sizes = self.cross_entropies(points, starts), np.diff(starts) - 1
        best = entropies.argmin(axis=1)
        least = entropies[np.arange(len(best)), best]
        second = np.partition(entropies, 1, axis=1)[:, 1] if entropies.shape[1] > 1 else least + 1.0
        evidence = (second - least) * np.sqrt(np.maximum(1, sizes))
        rejected = np.zeros(len(best), bool)
        if self.thresholds.size:
            rejected = least > self.thresholds[best, length_class(sizes)]
        return best, least, evidence, rejected

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Languages, scores, cross-entropies and whether rejected."""
        points, starts = fold_all(texts)
        known = np.diff(starts) > 1
        if not self.languages:
            known[:] = False
            best, least, score, rejected = np.zeros(len(texts), int), np.full(len(texts), np.nan), np.zeros(len(texts)), ~known
        else:
            best, least, evidence, rejected = self.judge(points, starts)
            a, b = self.curve
            score = np.where(known, 1 / (1 + np.exp(-np.clip(a * evidence + b, -30, 30))), 0.0)
        named = [self.languages[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist(), strict=True)]
        return named, score, np.where(known, least, np.nan), rejected | ~known


def length_class(sizes: np.ndarray) -> np.ndarray:
    """Power of two of a length, within the calibrated range."""
    return np.clip(np.floor(np.log2(np.maximum(1, sizes))).astype(int), 0, LENGTHS - 1)


def count_ngrams(sample: DataFrame, order: int = ORDER) -> DataFrame:
    """n-grams of labelled texts: lang, n, gram and context hash, last symbol's suffix hash, count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                points = fold(text)
                for n in range(1, order + 1):
                    counts.setdefault((lang, n), []).append((ngram_hashes(points, n), points))
        for (lang, n), parts in counts.items():
            grams = np.concatenate([h for h, _ in parts])
            keys, first, times = np.unique(grams, return_index=True, return_counts=True)
            # The context is the gram without its last symbol, the suffix without its first.
            context = np.concatenate([ngram_hashes(p, n - 1)[: len(h)] if n > 1 else np.zeros(len(h), np.uint64) for h, p in parts])
            suffix = np.concatenate([ngram_hashes(p, n - 1)[1 : len(h) + 1] if n > 1 else np.zeros(len(h), np.uint64) for h, p in parts])
            columns = [keys, context[first], suffix[first]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array([n] * len(keys), pa.int32())]
                + [pa.array(c.view(np.int64)) for c in columns]
                + [pa.array(times.astype(np.int64))],
                ["lang", "n", "gram", "context", "suffix", "times"],
            )

    found = sample.select("lang", "text").mapInArrow(giving_back(run), "lang string, n int, gram long, context long, suffix long, times long")
    return found.groupBy("lang", "n", "gram", "context", "suffix").agg(F.sum("times").alias("times"))


def _kneser_ney(grams: dict[int, tuple], order: int) -> tuple[list, float]:
    """Interpolated Kneser-Ney of one language as differences.

    grams[n]: gram, context, suffix, times. Returns per order the sorted grams, what
    each adds to the log probability that its suffix gives after its context has
    taken its weight off, and its own weight as a context (0 if it is none); and the
    log probability of a character that was never seen.
    """
    tables = []
    for n in range(1, order + 1):
        gram, context, suffix, times = grams[n]
        counts = times.astype(float)
        if n < order:  # continuation counts: distinct symbols before the gram
            before = np.sort(grams[n + 1][2])
            continuation = np.searchsorted(before, gram, "right") - np.searchsorted(before, gram, "left")
            counts = np.where(continuation > 0, continuation, np.minimum(counts, 1)).astype(float)
        ones, twos = (counts == 1).sum(), (counts == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        keys, place = np.unique(context, return_inverse=True)
        total = np.bincount(place, counts)
        weight = discount * np.bincount(place) / total
        if n == 1:
            vocabulary = len(gram) + 1
            lower = np.full(len(gram), 1 / vocabulary)
            floor = float(np.log(weight[0] / vocabulary))
        else:
            at = np.minimum(np.searchsorted(lower_keys, suffix), len(lower_keys) - 1)
            lower = np.where(lower_keys[at] == suffix, lower_p[at], np.exp(floor))
            tables[-1][2][np.searchsorted(lower_keys, keys)] = np.log(weight)
        p = (counts - discount) / total[place] + weight[place] * lower
        adds = np.log(p) - (np.log(weight[place] * lower) if n > 1 else 0.0)
        by = np.argsort(gram)
        lower_keys, lower_p = gram[by], p[by]
        tables.append((lower_keys, adds[by], np.zeros(len(gram))))
    return tables, floor


def build_model(counts: dict[str, dict[int, tuple]], order: int = ORDER) -> Model:
    """Put the languages' tables together, in blocks."""
    languages = sorted(counts)
    blocks = []
    for at in range(0, len(languages), LANGUAGES_IN_BLOCK):
        own = [_kneser_ney(counts[lang], order) for lang in languages[at : at + LANGUAGES_IN_BLOCK]]
        tables = []
        for n in range(order):
            keys = np.unique(np.concatenate([parts[n][0] for parts, _ in own]))
            values = np.zeros((len(keys) + 1, len(own)))
            weights = np.zeros((len(keys) + 1, len(own))) if n + 1 < order else None
            if n == 0:
                values[:] = [floor for _, floor in own]
            for i, (parts, _) in enumerate(own):
                gram, adds, weight = parts[n]
                where = np.searchsorted(keys, gram)
                values[where, i] = adds + weight
                if weights is not None:
                    weights[where, i] = weight
            tables.append(Table(keys, values, weights))
        blocks.append(tables)
    return Model(languages, order, blocks)


def pieces(points: np.ndarray, seed: int) -> Iterator[np.ndarray]:
    """The folded text itself, and pieces of it of whole words in all calibrated lengths."""
    yield points
    spaces = np.nonzero(points == 0)[0]
    rng = np.random.default_rng(seed)
    for k in range(LENGTHS):
        last = int(np.searchsorted(spaces, len(points) - (1 << k)))
        for _ in range(PIECES if last else 0):
            start = spaces[rng.integers(0, last)]
            end = spaces[min(len(spaces) - 1, int(np.searchsorted(spaces, start + (1 << k))))]
            yield points[start : end + 1]


def shuffled(points: np.ndarray, seed: int) -> np.ndarray:
    """The folded text with its letters in another order, and its spaces where they were."""
    out, letters = points.copy(), np.nonzero(points)[0]
    out[letters] = points[np.random.default_rng(seed).permutation(letters)]
    return out


def calibration(sample: DataFrame, model: Model) -> pd.DataFrame:
    """lang, length class, cross-entropy, evidence, right: a row for every piece of the sample's texts.

    ``noise`` is the cross-entropy of the shuffled text and ``chars`` its length, in the
    row of the whole text; null in those of its pieces.
    """
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for lang, text, rank in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "rank")), strict=True):
                folded = fold(text)
                parts = [p for p in pieces(folded, rank) if len(p) > 1]
                if lang not in model.languages or not parts:
                    continue
                starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
                points = np.concatenate(parts)
                best, _, evidence, _ = model.judge(points, starts)
                mine = model.languages.index(lang)
                own = model.cross_entropies(points, starts)[:, mine]
                noise = float(model.cross_entropy(shuffled(folded, rank))[mine])
                rest = [None] * (len(parts) - 1)
                columns = {"lang": [lang] * len(parts), "size": length_class(np.diff(starts) - 1), "entropy": own, "evidence": evidence, "right": best == mine}
                whole = {"noise": pa.array([noise, *rest], pa.float64()), "chars": pa.array([len(folded) - 1, *rest], pa.int64())}
                yield pa.RecordBatch.from_pydict({**columns, **whole})

    schema = "lang string, size long, entropy double, evidence double, right boolean, noise double, chars long"
    return sample.select("lang", "text", "rank").repartition(16).mapInArrow(giving_back(run), schema).toPandas()


def thresholds(found: pd.DataFrame, languages: list[str], quantile: float = QUANTILE, margin: float = MARGIN) -> np.ndarray:
    """[language, length class]: the cross-entropy beyond which text is rejected."""
    lengths = np.arange(LENGTHS)
    own = found.groupby("lang")["entropy"].median()
    rest = found["entropy"] - found["lang"].map(own)
    middle = rest.groupby(found["size"]).median()
    longer = np.interp(lengths, middle.index, middle)  # how a length moves the median, in all languages
    off = (rest - longer[found["size"]]).groupby(found["size"])
    body, weight = off.quantile(BODY), np.sqrt(off.size())
    curve = np.stack([2.0 ** (-body.index.to_numpy() / 2), np.ones(len(body))], axis=1)
    fitted = np.linalg.lstsq(curve * weight.to_numpy()[:, None], body.to_numpy() * weight.to_numpy(), rcond=None)[0]
    a, b = np.maximum(0, fitted)
    tail = np.log(1 - quantile) / np.log(1 - BODY) * (a * 2.0 ** (-lengths / 2) + b) + margin
    whole = found[found["noise"].notna()]
    noise = (whole["noise"] * whole["chars"]).groupby(whole["lang"]).sum() / whole["chars"].groupby(whole["lang"]).sum()
    # A language without calibration text has the highest values of the others.
    own, gap = own.reindex(languages), (noise - own).reindex(languages)
    own, gap = own.fillna(own.max()).to_numpy()[:, None], gap.fillna(gap.max()).to_numpy()[:, None]
    return own + longer + np.maximum(tail, SHARE * gap)


def calibrate(model: Model, found: pd.DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> Model:
    """Set rejection thresholds and the score's curve."""
    if not len(found):
        return model
    model.thresholds = thresholds(found, model.languages, quantile, margin)
    x, y = found["evidence"].to_numpy(), found["right"].to_numpy(float)
    if 0 < y.mean() < 1:
        a, b = 1.0, 0.0
        for _ in range(200):  # logistic fit by Newton steps with a little shrinkage
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            w = p * (1 - p) + 1e-6
            g = np.array([((p - y) * x).sum() + 0.01 * a, (p - y).sum()])
            h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum()]])
            a, b = np.array([a, b]) - np.linalg.solve(h, g)
            a = max(a, 0.0)
        model.curve = (float(a), float(b))
    else:
        model.curve = (20.0, 0.0)
    return model


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on labelled documents: the distinct texts of least hash in each language.

    The sample bounds what the driver and the tasks hold: the n-grams of at most
    ``sample_docs`` texts a language.
    """
    labelled = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")
    )
    # The texts of least hash in each language. The share is taken from the distinct
    # texts and copies are made one before any rows of a language meet, so their
    # number does not matter.
    hashes = labelled.groupBy("lang", "h").agg(F.lit(1).alias("one"))
    sizes = materialise(hashes.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-sizes")
    share = (2.0 * sample_docs + 64.0) / F.col("n")
    low = labelled.join(small_or_shuffled(sizes), "lang").filter(F.pmod("h", F.lit(SPAN)) <= share * float(SPAN))
    low = low.groupBy("lang", "h").agg(F.min("text").alias("text"))
    by_hash = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(SPAN)), "h")
    ranked = low.withColumn("rank", F.row_number().over(by_hash)).filter(F.col("rank") <= sample_docs)
    ranked = materialise(ranked.select("lang", "text", "rank"), "language-sample")
    held = F.col("rank") % CALIBRATION_EVERY == 0
    frame = count_ngrams(ranked.filter(~held).repartition(16), order).toPandas()
    counts = {
        lang: {
            n: tuple(part[c].to_numpy(np.int64).view(np.uint64) for c in ("gram", "context", "suffix")) + (part["times"].to_numpy(),)
            for n, part in group.groupby("n")
        }
        for lang, group in frame.groupby("lang")
    }
    model = build_model({lang: c for lang, c in counts.items() if len(c) == order}, order)
    return calibrate(model, calibration(ranked.filter(held), model))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs as keep (its other columns), text, lang_pred, score, cross_entropy, rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rest = [F.col(c) for c in docs.columns if c != text_col] or [F.lit(True).alias("row")]
    rows = docs.select(F.struct(*rest).alias("keep"), F.col(text_col).alias("text"))

    def judged(piece: pa.RecordBatch) -> pa.RecordBatch:
        named, score, entropy, rejected = sent.value.predict(piece.column("text").to_pylist())
        columns = [pa.array(named, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)]
        return pa.RecordBatch.from_arrays([*piece.columns, *columns], [*piece.schema.names, "lang_pred", "score", "cross_entropy", "rejected"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = size = 0
            for i, n in enumerate(pa.compute.binary_length(batch.column("text")).to_pylist()):
                size += n or 0
                if size >= FOLD_CHARS:
                    yield judged(batch.slice(at, i + 1 - at))
                    at, size = i + 1, 0
            if at < batch.num_rows:
                yield judged(batch.slice(at))

    kind = rows.schema["keep"].dataType.simpleString()
    return rows.mapInArrow(giving_back(run), f"keep {kind}, text string, lang_pred string, score double, cross_entropy double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the rows that are not held out and predict all: doc_id, held_out, lang_pred, score, cross_entropy, rejected."""
    model = train(docs.filter(~held_out(F.col(id_col))), text_col, lang_col)
    found = predict(docs.select(id_col, text_col), model, text_col)
    doc_id = F.col("keep")[id_col]
    return found.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language is not rejected."""
    model = train(docs.filter(~held_out(F.col(id_col))), text_col, lang_col)
    found = predict(docs, model, text_col).filter(~F.col("rejected"))
    return found.select(*[F.col("text").alias(c) if c == text_col else F.col("keep")[c].alias(c) for c in docs.columns])
