"""Benchmark decontamination with an FM-index per training shard.

Every task cuts its documents into shards, writes each shard's words as numbers
of the benchmark's vocabulary (any other word ends a run, for no test phrase can
span it), and builds an FM-index: suffix order, Burrows-Wheeler transform, a
wavelet matrix for ranks, and suffix positions sampled along the text. All test
phrases are searched backwards at once; the occurrences are located by walking
back to a sampled position, and their word spans are merged per document.

Test phrases come from the benchmark in rounds of at most ROUND_WORDS words, so what
the driver holds and what is sent to the tasks does not grow with the benchmark. A
round is one job: it searches the shards for its phrases and stores the spans and
items of the texts that it hits, under a digest of the text; then its phrases are
dropped, and the next round begins. The last round adds the stored spans to its own.

Defined results: null or wordless text has no words and no hits; null or wordless
items have no phrases; an item that repeats counts once per item_id; items are listed
in string order; repeated documents are judged each; texts and items of any length
are searched whole (an item beyond a round's words is cut into rounds that overlap by
a window); other columns keep their names and values, whatever these are; empty
tables give empty results or no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itinera.llm.common import giving_back, join_counted, materialise

#: Words in a test phrase.
WINDOW = 10
#: Words of a shard after which it is indexed.
SHARD_WORDS = 1 << 19
#: A suffix position is kept for every so many words of text.
SAMPLE = 8
#: Words of test items that one round sends to the tasks: the bound on what the driver
#: holds and on the broadcast, about 100 bytes each.
ROUND_WORDS = 1_000_000

#: ASCII letters fold to lower case, digits stay, all other ASCII separates words.
FOLD = bytes(b if chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(128)) + bytes(range(128, 256))

#: A word of a text, upper-case letters included.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Ranks:
    """Wavelet matrix: how often a symbol occurs before a position, for many queries at once."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.depth = max(1, int(symbols - 1).bit_length())
        self.levels = []
        values = values.astype(np.int64)
        for bit in range(self.depth - 1, -1, -1):
            ones = (values >> bit) & 1
            padded = np.zeros((len(values) // 64 + 1) * 64, np.uint8)
            padded[: len(values)] = ones
            blocks = np.packbits(padded, bitorder="little").view("<u8")
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(blocks), dtype=np.int64)))
            zeros = int(len(values) - ones.sum())
            self.levels.append((blocks, before, zeros))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def _ones(self, level: tuple, at: np.ndarray) -> np.ndarray:
        blocks, before, _ = level
        block, rest = at >> 6, (at & 63).astype(np.uint64)
        return before[block] + np.bitwise_count(blocks[block] & ((np.uint64(1) << rest) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(at), at
        for i, level in enumerate(self.levels):
            one = (symbol >> (self.depth - 1 - i)) & 1 == 1
            low1, high1 = self._ones(level, low), self._ones(level, high)
            low, high = np.where(one, level[2] + low1, low - low1), np.where(one, level[2] + high1, high - high1)
        return high - low


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes that are not yet apart are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    new = np.concatenate(([True], text[order][1:] != text[order][:-1])) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    # The rank of a suffix is the first place of its group.
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else 0
    step = 1
    while n:
        last = np.concatenate((new[1:], [True]))
        places = np.nonzero(~(new & last))[0]
        if not len(places):
            break
        which = order[places]
        ahead = which + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        by = np.lexsort((second, rank[which]))
        which, second, first = which[by], second[by], rank[which][by]
        order[places] = which
        fresh = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        new[places] = fresh
        rank[which] = np.maximum.accumulate(np.where(fresh, places, 0))
        step *= 2
    return order


class FmIndex:
    """FM-index over an array of symbols 1..symbols-1; symbol 0 ends the text."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        text = np.concatenate((text, [0]))
        order = suffix_order(text)
        self.size = len(text)
        self.bwt = text[order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.ranks = Ranks(self.bwt, symbols)
        marked = order % sample == 0
        self.marked = np.cumsum(np.concatenate(([0], marked)))
        self.is_marked = marked
        self.sampled = order[marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase; phrases are right-aligned."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        width = phrases.shape[1]
        for back in range(width):
            live = np.nonzero((back < lengths) & (low < high))[0]
            if not len(live):
                break
            symbol = phrases[live, width - 1 - back]
            low[live] = self.first[symbol] + self.ranks.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.ranks.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by steps back to a sampled position."""
        rows, steps, found = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            there = self.is_marked[rows[todo]]
            done = todo[there]
            found[done] = self.sampled[self.marked[rows[done]]] + steps[done]
            todo = todo[~there]
            symbol = self.bwt[rows[todo]]
            rows[todo] = self.first[symbol] + self.ranks.rank(symbol, rows[todo])
            steps[todo] += 1
        return found


class Phrases:
    """The distinct windows of a set of items, as numbers of their words, and the items of each."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.names = [item_id for item_id, _ in items]
        parts, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int32)]
        for i, (_, text) in enumerate(items):
            words = words_of(text)
            ids = np.fromiter((self.number.setdefault(w, len(self.number) + 2) for w in words), np.int32, len(words))
            if not len(ids):
                continue
            if len(ids) < window:
                ids = np.concatenate((np.zeros(window - len(ids), np.int32), ids))  # right-aligned
            parts.append(np.lib.stride_tricks.sliding_window_view(ids, window))
            owners.append(np.full(len(parts[-1]), i, np.int32))
        self.symbols = len(self.number) + 2  # 0 ends a text, 1 is any other word
        self.table, place = np.unique(np.concatenate(parts), axis=0, return_inverse=True)
        self.lengths = (self.table > 0).sum(axis=1)
        self.least = int(self.lengths.min()) if len(self.table) else 0
        # The items of phrase p are owners[starts[p] : starts[p + 1]].
        place, owner = place.reshape(-1), np.concatenate(owners)
        by = np.argsort(place, kind="stable")
        self.owners = owner[by]
        self.starts = np.searchsorted(place[by], np.arange(len(self.table) + 1))

    def items_of(self, phrases: np.ndarray) -> list[str]:
        found = np.unique(np.concatenate([self.owners[self.starts[p] : self.starts[p + 1]] for p in phrases]))
        return sorted({self.names[i] for i in found})


def known_runs(ids: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard's text and, for each of its symbols, the word it came from (-1: a separator).

    Only runs of at least ``least`` known words are kept, each within a document
    and followed by one separator: a phrase fits into no other place.
    """
    known = ids != 1
    apart = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
    before = np.concatenate(([False], known[:-1])) & ~apart
    after = np.concatenate((known[1:] & ~apart[1:], [False]))
    starts, ends = np.nonzero(known & ~before)[0], np.nonzero(known & ~after)[0] + 1
    long = ends - starts >= max(1, least)
    starts, sizes = starts[long], (ends - starts)[long]
    run = np.repeat(np.arange(len(starts)), sizes)
    within = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    source = starts[run] + within
    text = np.ones(len(run) + len(starts), np.int64)
    place = np.full(len(text), -1, np.int64)
    target = np.arange(len(run)) + run
    text[target], place[target] = ids[source], source
    return text, place


def search_shard(texts: list[str | None], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Per document: its number of words, the merged hit spans [start, end) and the items found."""
    words = [words_of(text) for text in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    out: list = [(n, [], []) for n in sizes.tolist()]
    if not sizes.sum() or not len(phrases.lengths):
        return out
    ids = np.fromiter(map(phrases.number.get, chain.from_iterable(words), repeat(1)), np.int64, int(sizes.sum()))
    del words
    doc = np.repeat(np.arange(len(texts)), sizes)
    text, place = known_runs(ids, doc, phrases.least)
    index = FmIndex(text, phrases.symbols)
    low, high = index.search(phrases.table, phrases.lengths)
    counts = high - low
    which = np.repeat(np.arange(len(counts)), counts)
    rows = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    begins = place[index.locate(rows)]
    docs = doc[begins]
    begins = begins - (np.cumsum(sizes) - sizes)[docs]
    ends = begins + phrases.lengths[which]
    by = np.lexsort((begins, docs))
    docs, begins, ends, which = docs[by], begins[by], ends[by], which[by]
    cuts = np.concatenate(([0], np.nonzero(np.diff(docs))[0] + 1, [len(docs)])) if len(docs) else [0]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        spans = merge_spans(list(zip(begins[i:j].tolist(), ends[i:j].tolist(), strict=True)))
        out[docs[i]] = (int(sizes[docs[i]]), spans, phrases.items_of(np.unique(which[i:j])))
    return out


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that touch or overlap made one."""
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [tuple(x) for x in merged]


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in WORD.finditer(text)]
    pieces, at = [], 0
    for start, end in spans:
        pieces.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return "".join([*pieces, text[at:]])


def _pieces(items: DataFrame, round_words: int) -> DataFrame:
    """Stored items (item_id, text, size), those of more words than a round in overlapping pieces."""
    round_words = max(round_words, WINDOW)
    words = F.regexp_extract_all("text", F.lit(WORD.pattern), F.lit(0))
    sized = items.filter(F.col("text").rlike(WORD.pattern)).distinct().select("item_id", "text", F.size(words).alias("size"))
    long = sized.filter(F.col("size") > round_words)
    starts = F.sequence(F.lit(1), F.greatest(F.col("size") - WINDOW + 1, F.lit(1)), F.lit(max(1, round_words - WINDOW + 1)))
    cut = long.select("item_id", words.alias("w"), F.explode(starts).alias("at"))
    cut = cut.select("item_id", F.slice("w", F.col("at"), F.lit(round_words)).alias("w")).select("item_id", F.array_join("w", " ").alias("text"), F.size("w").alias("size"))
    return materialise(sized.filter(F.col("size") <= round_words).unionByName(cut), "test-items")


def _rounds(items: DataFrame, round_words: int) -> Iterator[list[tuple[str, str]]]:
    """Items in rounds of at most ``round_words`` words, each collected when it is its turn.

    Items fall into bins by hash, four to a round's worth of words, and a bin that is
    still too large into bins again; rounds are made of bins.
    """
    sized, round_words = _pieces(items, round_words), max(round_words, WINDOW)

    def split(part: DataFrame, depth: int) -> Iterator[tuple[DataFrame, int]]:
        total = part.agg(F.sum("size")).first()[0] or 0
        if total <= round_words:
            if total:
                yield part, total
            return
        bins = -(-4 * total // round_words)
        place = F.pmod(F.xxhash64(F.lit(depth), "item_id", "text"), F.lit(bins))
        counted = {r[0]: r[1] for r in part.groupBy(place.alias("bin")).agg(F.sum("size")).collect()}
        held, words = [], 0
        for b, n in sorted(counted.items()):
            if n > round_words:
                yield from split(part.filter(place == b), depth + 1)
                continue
            if words + n > round_words:
                yield part.filter(place.isin(held)), words
                held, words = [], 0
            held.append(b)
            words += n
        if held:
            yield part.filter(place.isin(held)), words

    for part, _ in split(sized, 0):
        yield [tuple(x) for x in part.select("item_id", "text").collect()]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = "array<struct<start: long, end: long>>", "array<string>"


def _search(rows: DataFrame, sent, cut: bool, shard_words: int) -> DataFrame:
    """Add what one round finds to n_words, spans and items of every row; with ``cut``, take all spans out of text."""

    def searched(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        shard = pa.Table.from_batches(waiting).combine_chunks()
        texts = shard.column("text").to_pylist()
        found = search_shard(texts, sent.value)
        spans, items = [], []
        for (_, a, x), b, y in zip(found, shard.column("spans").to_pylist(), shard.column("items").to_pylist(), strict=True):
            spans.append(merge_spans(a + [(s["start"], s["end"]) for s in b]) if b else a)
            items.append(sorted({*x, *y}) if y else x)
        if cut:
            texts = [cut_spans(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
        columns = {
            "keep": shard.column("keep").combine_chunks(),
            "text": pa.array(texts, pa.string()),
            "n_words": pa.array([n for n, _, _ in found], pa.int64()),
            "spans": pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], SPANS),
            "items": pa.array(items, pa.list_(pa.string())),
        }
        columns = {n: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for n, c in columns.items()}
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                waiting.append(batch.slice(at, 64))
                size += waiting[-1].column("text").nbytes
                if size >= 6 * shard_words:
                    yield searched(waiting)
                    waiting, size = [], 0
        if waiting:
            yield searched(waiting)

    return rows.mapInArrow(giving_back(run), rows.schema)


def _digest() -> Column:
    return F.sha2("text", 256)


def find_spans(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    cut: bool = False,
    shard_words: int = SHARD_WORDS,
    round_words: int = ROUND_WORDS,
) -> DataFrame:
    """Every row of docs as keep (its other columns), text, n_words, spans (start, end in words) and items."""
    context = docs.sparkSession.sparkContext
    named = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), F.col(item_text_col).alias("text"))
    rest = [F.col(c) for c in docs.columns if c != text_col] or [F.lit(True).alias("row")]
    none = [F.array().cast(kind).alias(name) for kind, name in zip(FOUND, ("spans", "items"), strict=True)]
    rows = docs.select(F.struct(*rest).alias("keep"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), *none)
    texts = docs.select(F.struct(F.lit(True).alias("row")).alias("keep"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), *none)

    rounds, stored = _rounds(named, round_words), []
    phrases = next(rounds, [])
    for following in rounds:
        sent = context.broadcast(Phrases(phrases))
        hits = _search(texts, sent, False, shard_words).filter(F.size("spans") > 0)
        hits = hits.groupBy(_digest().alias("digest")).agg(F.first("spans").alias("spans"), F.first("items").alias("items"), F.count(F.lit(1)).alias("n"))
        stored.append(materialise(hits, "round-hits"))
        sent.destroy()
        phrases = following
    if stored:
        before = stored[0]
        for more in stored[1:]:
            before = before.unionByName(more)
        before = before.groupBy("digest").agg(
            F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.first("n").alias("n")
        )
        before = materialise(before, "earlier-hits")
        keyed = rows.drop("spans", "items").withColumn("digest", F.coalesce(_digest(), F.lit("")))
        total = before.agg(F.sum("n")).first()[0] or 0
        held = [F.coalesce(name, F.array().cast(kind)).alias(name) for kind, name in zip(FOUND, ("spans", "items"), strict=True)]
        rows = join_counted(keyed, before, ["digest"], total, how="left").select("keep", "text", "n_words", *held)
    return _search(rows, context.broadcast(Phrases(phrases)), cut, shard_words)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    found = find_spans(docs.select(id_col, text_col), items, text_col, **options)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select(
        F.col("keep")[id_col].alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "spans",
    )


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents with test passages cut out of their texts; documents of nothing else go."""
    found = find_spans(docs, items, text_col, cut=True, **options)
    emptied = (F.size("spans") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(WORD.pattern)
    return found.filter(~emptied).select(*[F.col("text").alias(c) if c == text_col else F.col("keep")[c].alias(c) for c in docs.columns])
