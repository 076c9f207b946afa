"""Target-distribution importance resampling: documents drawn without replacement by how like the target they are.

Features are hashed to buckets; a bucket's gain is the logarithm of its share in the
target against its share in the corpus. A document's weight is the sum of its gains,
taken from one array, and its score adds a Gumbel draw that its id seeds, so that the
highest scores are a draw in proportion to the weights.

The draw is an external merge sort that ends early. Tasks write scored rows as runs,
sorted by score, and number them. Keys taken from the runs at even steps cut the order
into ranges of about equal numbers of rows; counting rows by range says which ranges the
draw reaches, and only those are shuffled, as slices of runs. A task merges the slices
of a range by a tournament tree and stops at the exact number. Rank is the place in the
range plus what the ranges before hold.

What reaches the driver is bounded: a number a bucket, and keys in proportion to the
shuffle partitions (KEYS_A_RANGE keys for each range that the draw reaches).

Defined results: null text has no features and weight 0; a null id is hashed as an empty
one and comes last among equal scores; repeated rows are documents of their own, which
take neighbouring ranks; texts of any length are read whole, a piece at a time; other
columns play no part, whatever their names; an empty corpus gives an empty result, an
empty target gives gains from the corpus alone; a draw of no documents ranks none.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itinera.llm.common import fold_table, materialise, words_within

#: Words in a feature at most, buckets, the seed, percent drawn, words that a drawn document has at least.
RUN = 1
BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
#: Rows of a sorted run at most.
RUN_ROWS = 1 << 18
#: Rows of a range at least and at most, about, and keys that are looked at for each.
RANGE_ROWS = (64, 1 << 20)
KEYS_A_RANGE = 16
FOLD = fold_table()
#: Distinct features whose bucket a Python worker keeps at most.
MEMO_FEATURES = 500_000


class Buckets(dict):
    """Bucket by feature, hashed when first met."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MEMO_FEATURES:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def features_of(text: bytes | None, run: int = RUN) -> Iterator[list[bytes]]:
    """All runs of 1 to ``run`` consecutive words of a text, a piece of it at a time."""
    before: list[bytes] = []
    for words in words_within(text, FOLD):
        yield words
        both = before + words
        for n in range(2, run + 1):
            skip = max(0, len(before) - n + 1)
            yield [b" ".join(both[i : i + n]) for i in range(skip, len(both) - n + 1)]
        before = both[len(both) - run + 1 :] if run > 1 else []


def count_buckets(docs: DataFrame, text_col: str = "text", run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Features by bucket over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, total, met = Buckets(buckets), np.zeros(buckets, np.int64), Counter()

        def settle() -> None:
            np.add.at(total, np.fromiter(map(bucket.__getitem__, met), np.int64, len(met)), np.fromiter(met.values(), np.int64, len(met)))
            met.clear()

        for batch in batches:
            for text in batch.column("text"):
                for features in features_of(text.as_py(), run):
                    met.update(features)
                if len(met) > MEMO_FEATURES:
                    settle()
        settle()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counted = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains_of(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed share in the target over that in the corpus), by bucket."""
    t_all, s_all, k = float(target.sum()), float(corpus.sum()), float(len(corpus))
    pairs = zip(target.tolist(), corpus.tolist(), strict=True)
    return np.array([math.floor(1000.0 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for t, s in pairs], np.int64)


def gumbel(doc_id, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0)))


def order_keys(id_null: np.ndarray, score: np.ndarray, doc_id: np.ndarray, n_features: np.ndarray, run: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rows' places in the order as bytes that compare alike: score descending, null ids last, then id, features, run and place."""
    flip = np.uint64(1) << np.uint64(63)
    parts = np.empty((len(score), 6), ">u8")
    parts[:, 0] = ~(score.astype(np.int64).view(np.uint64) ^ flip)
    parts[:, 1] = id_null
    parts[:, 2] = doc_id.astype(np.int64).view(np.uint64) ^ flip
    parts[:, 3], parts[:, 4], parts[:, 5] = n_features, run, place
    return np.frombuffer(parts.tobytes(), "S48")


def keys_of(batch: pa.RecordBatch) -> np.ndarray:
    null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
    return order_keys(null, *(batch.column(c).fill_null(0).to_numpy() for c in ("score", "doc_id", "n_features", "run", "place")))


SCORED = "doc_id long, n_features long, weight long, score long, eligible boolean, run long, place long"


def score_runs(docs: DataFrame, gains: np.ndarray, id_col: str, text_col: str, run: int, seed: int, least_words: int) -> DataFrame:
    """Every document with its weight and score, in sorted runs; place is that among the eligible rows of a run."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, part = Buckets(len(gains)), TaskContext.get().partitionId()
        waiting: list[tuple] = []
        number = 0

        def settle() -> pa.RecordBatch:
            doc_id, n, weight, total, fit = map(list, zip(*waiting, strict=True))
            waiting.clear()
            fit = np.array(fit)
            ids, null = pa.array(doc_id, pa.int64()), np.array([d is None for d in doc_id])
            zero = np.zeros(len(fit), np.int64)
            key = order_keys(null, np.array(total), ids.fill_null(0).to_numpy(zero_copy_only=False), np.array(n), zero, zero)
            order = np.lexsort((key, ~fit))
            columns = [ids, pa.array(n, pa.int64()), pa.array(weight, pa.int64()), pa.array(total, pa.int64()), pa.array(fit)]
            columns = [c.take(pa.array(order)) for c in columns]
            place = np.where(fit[order], np.arange(len(order)), -1)
            columns += [pa.array(np.full(len(order), part << 32 | number)), pa.array(place)]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCORED.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                n = words = weight = 0
                for i, features in enumerate(features_of(text.as_py(), run)):
                    found = np.fromiter(map(bucket.__getitem__, features), np.int64, len(features))
                    weight += int(gains[found].sum())
                    n += len(found)
                    words += len(found) if i % run == 0 else 0
                waiting.append((doc_id, n, weight, weight + gumbel(doc_id, seed), words >= least_words))
                if len(waiting) == RUN_ROWS:
                    yield settle()
                    number += 1
        if waiting:
            yield settle()

    return rows.mapInArrow(score, SCORED)


class Tournament:
    """Merges sorted sources: a tree of matches, replayed from the leaf whose row has been taken."""

    END = b"\xff" * 49

    def __init__(self, sources: list[Iterator[tuple[bytes, object]]]):
        self.sources = [iter(s) for s in sources]
        self.leaves = 1 << max(0, len(self.sources) - 1).bit_length()
        self.head = [next(s, (self.END, None)) for s in self.sources] + [(self.END, None)] * (self.leaves - len(self.sources))
        #: The winner of each match by node; leaves begin at ``leaves``.
        self.won = [0] * self.leaves + list(range(self.leaves))
        for node in range(self.leaves - 1, 0, -1):
            self._play(node)

    def _play(self, node: int) -> None:
        a, b = self.won[2 * node], self.won[2 * node + 1]
        self.won[node] = a if self.head[a][0] <= self.head[b][0] else b

    def __iter__(self) -> Iterator[tuple[bytes, object]]:
        while True:
            best = self.won[1]
            key, row = self.head[best]
            if key == self.END:
                return
            yield key, row
            self.head[best] = next(self.sources[best], (self.END, None))
            node = (best + self.leaves) // 2
            while node:
                self._play(node)
                node //= 2


def _splitters(runs: DataFrame, n: int, draw: int) -> list[bytes]:
    """Keys that cut the rows which the draw reaches, and a margin, into ranges of about equal size."""
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = min(max(draw // (2 * parts), RANGE_ROWS[0]), RANGE_ROWS[1])
    step = max(1, rows // KEYS_A_RANGE)
    # About what score the draw ends at: keys far below are not looked at. Only the number of keys depends on it.
    about = runs.agg(F.percentile_approx("score", max(0.0, 1 - 1.1 * draw / n), 1000)).first()[0]
    seen = runs.filter((F.col("score") >= about) & (F.pmod(F.col("place") + F.xxhash64("run"), F.lit(step)) == 0)).toArrow()
    keys = sorted(key for batch in seen.to_batches() for key in keys_of(batch).tolist())
    return keys[KEYS_A_RANGE - 1 :: KEYS_A_RANGE]


def _ranges(runs: DataFrame, splitters: list[bytes], sent: int | None = None) -> DataFrame:
    """Rows by range; with ``sent`` the slices of runs themselves, of the ranges before that number."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array(splitters, "S48")
        counted = np.zeros(len(bounds) + 1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = keys_of(batch)
            found = np.searchsorted(bounds, keys, "left")
            if sent is None:
                counted += np.bincount(found, minlength=len(counted))
                continue
            # A slice: neighbouring rows of one run and one range. Within a run they are sorted.
            run = batch.column("run").to_numpy()
            starts = np.concatenate(([0], np.flatnonzero((np.diff(found) != 0) | (np.diff(run) != 0)) + 1))
            ends = np.append(starts[1:], len(found))
            keep = found[starts] < sent
            starts, ends = starts[keep], ends[keep]
            raw = np.frombuffer(keys.tobytes(), np.uint8).reshape(-1, 48)
            rest = batch.column("weight").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
            rows = np.concatenate((raw, rest), axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[starts]), pa.array(run[starts]), pa.array(batch.column("place").to_numpy()[starts]), pa.array([rows[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())],
                ["range", "run", "place", "rows"],
            )
        if sent is None:
            some = np.flatnonzero(counted)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counted[some])], ["range", "n"])

    return runs.mapInArrow(cut, "range long, n long" if sent is None else "range long, run long, place long, rows binary")


def _merged(slices: DataFrame, ranges: int, before: list[int], draw: int) -> DataFrame:
    """The rows of each range in order, with their ranks, up to the exact number drawn."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(number: int, sources: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
            def rows(parts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
                for part in parts:
                    for i in range(0, len(part), 56):
                        yield part[i : i + 48], part[i : i + 56]

            rank, left = before[number], draw - before[number]
            tree = iter(Tournament([rows(parts) for parts in sources.values()]))
            while left > 0 and (taken := [row for _, (_, row) in zip(range(min(left, 1 << 14)), tree, strict=False)]):
                flat = b"".join(taken)
                words = np.frombuffer(flat, ">u8").reshape(-1, 7)
                flip = np.uint64(1) << np.uint64(63)
                n = len(words)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((words[:, 2].astype(np.uint64) ^ flip).view(np.int64), mask=words[:, 1] != 0),
                        pa.array(words[:, 3].astype(np.int64)),
                        pa.array(np.ascontiguousarray(np.frombuffer(flat, "<i8").reshape(-1, 7)[:, 6])),
                        pa.array((~words[:, 0].astype(np.uint64) ^ flip).view(np.int64)),
                        pa.array(words[:, 4].astype(np.int64)),
                        pa.array(words[:, 5].astype(np.int64)),
                        pa.array(np.arange(rank + 1, rank + 1 + n)),
                    ],
                    ["doc_id", "n_features", "weight", "score", "run", "place", "rank"],
                )
                rank, left = rank + n, left - n

        number, sources = None, {}
        for batch in batches:
            for r, run, data in zip(*(batch.column(c).to_pylist() for c in ("range", "run", "rows")), strict=True):
                if r != number and sources:
                    yield from one(number, sources)
                    sources = {}
                number = r
                sources.setdefault(run, []).append(data)
        if sources:
            yield from one(number, sources)

    dealt = slices.repartition(max(1, min(ranges, 1 << 16)), "range").sortWithinPartitions("range", "run", "place")
    return dealt.select("range", "run", "rows").mapInArrow(merge, "doc_id long, n_features long, weight long, score long, run long, place long, rank long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    run: int = RUN,
    buckets: int = BUCKETS,
    seed: int = SEED,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """Every document: doc_id, n_features, weight, score and, if it is drawn, its rank."""
    gains = gains_of(count_buckets(target, target_text_col, run, buckets), count_buckets(docs, text_col, run, buckets))
    scored = materialise(score_runs(docs, gains, id_col, text_col, run, seed, least_words), "scored")
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    undrawn = scored.withColumn("rank", F.lit(None).cast("long"))
    runs = scored.filter("eligible").select("doc_id", "n_features", "weight", "score", "run", "place")
    n = runs.count()
    draw = percent * n // 100
    if draw == 0:
        return undrawn.select(columns)
    splitters = _splitters(runs, n, draw)
    sizes = [0] * (len(splitters) + 1)
    for number, count in _ranges(runs, splitters).groupBy("range").agg(F.sum("n")).collect():
        sizes[number] = count
    before = np.concatenate(([0], np.cumsum(sizes)[:-1])).tolist()
    reached = sum(b < draw for b in before)
    drawn = materialise(_merged(_ranges(runs, splitters, reached), reached, before, draw), "drawn")
    last = drawn.filter(F.col("rank") == draw).first()

    def place(column) -> Column:
        return F.struct(-column("score"), column("doc_id").isNull(), F.coalesce(column("doc_id"), F.lit(0)), *map(column, ("n_features", "run", "place")))

    behind = place(F.col) > place(lambda name: F.lit(last[name]).cast("long"))
    return drawn.select(columns).unionByName(undrawn.filter(~F.col("eligible") | behind).select(columns))
