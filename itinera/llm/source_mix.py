"""Mixing sources to target weights by Sainte-Lague apportionment of token blocks.

The tokens that the mix takes are cut into blocks of equal size. Sources get
blocks by the highest quotients target / (2 * blocks + 1); the same rule hands a
source's blocks to its shards by their sizes, so every shard has an integer
quota before anything is drawn. Within a shard the documents lie in an order that
the seed sets, and the quota is a run of blocks around that ring from a seeded
start: whole rounds first, and the rest once more. So a document is taken at most
as often as its source's cap, nearly always whole, and reruns agree.

Only one row per source and per shard reaches the driver; there are at most
MOST_SHARDS shards, and more data makes them larger, not more. A source of any
size is spread over shards, each a range of document hashes.

Defined results: null text has size zero; the null source is a source, the last;
documents of size zero are never taken; of equal quotients the first source or shard
wins; repeated rows are documents of their own; texts of any length are counted
whole; other columns keep their names and values, whatever these are; an empty table,
or one without words, gives targets of zero.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itinera.llm.common import giving_back, materialise, small_or_shuffled

#: Weights of the sources in order, repeating; the share of all
#: tokens that the mix takes; how often a source may be repeated at most.
WEIGHTS = (5, 2, 1)
TAKE = Fraction(3, 2)
CAP = 2
#: Words in a block.
BLOCK = 8
#: Words in a shard at least, and shards at most.
SHARD_WORDS = 1 << 18
MOST_SHARDS = 1 << 16
SEED = 20240229

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD.pattern), F.lit(0))), F.lit(0)).cast("long")


def water_fill(sizes: Sequence[int], weights: Sequence[int], take: Fraction = TAKE, cap: int = CAP) -> list[float]:
    """Targets in proportion to the weights, none above ``cap`` times its size; the excess is shared again."""
    left = Fraction(sum(sizes)) * take
    targets: list[Fraction] = [Fraction(0)] * len(sizes)
    open_ = list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] > cap * sizes[i] * total]
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in full:
            targets[i] = Fraction(cap * sizes[i])
        left -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return [float(t) for t in targets]


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Seats by the highest quotients votes / (2 * seats + 1); ties go to the first. most: caps.

    A divisor is searched that gives nearly all seats at once; the quotients
    decide the last ones.
    """
    votes = np.asarray(votes, float)
    most = np.full(len(votes), np.inf) if most is None else np.asarray(most, float)
    seats = int(min(seats, most[votes > 0].sum())) if len(votes) else 0
    if seats <= 0 or votes.sum() <= 0:
        return np.zeros(len(votes), np.int64)

    def given(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(votes / divisor + 0.5), most)

    low, high = 0.0, 2 * votes.max() + 1  # too many seats at low, too few at high
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if given(middle).sum() > seats else (low, middle)
    out = given(high).astype(np.int64)
    while out.sum() < seats:
        quotient = np.where(out < most, votes / (2 * out + 1), -1.0)
        out[int(np.argmax(quotient))] += 1
    return out


def _ordered(source: str | None) -> tuple[bool, str]:
    return source is None, source or ""


def plan_mix(shards: list[tuple[str | None, int, int]], block: int = BLOCK) -> dict:
    """Quotas from (source, shard, words) rows: source -> (size, target, {shard: blocks})."""
    sizes: dict[str | None, int] = {}
    for source, _, words in shards:
        sizes[source] = sizes.get(source, 0) + words
    names = sorted(sizes, key=_ordered)
    targets = water_fill([sizes[s] for s in names], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(names))])
    own: dict[str | None, list[tuple[int, int]]] = {s: [] for s in names}
    for source, shard, words in sorted(shards, key=lambda x: (_ordered(x[0]), x[1])):
        own[source].append((shard, words))
    room = {s: np.array([CAP * -(-w // block) for _, w in own[s]]) for s in names}
    blocks = sainte_lague(np.array(targets), round(sum(targets) / block), np.array([room[s].sum() for s in names]))
    plan = {}
    for source, target, quota in zip(names, targets, blocks.tolist(), strict=True):
        each = sainte_lague(np.array([w for _, w in own[source]]), quota, room[source])
        plan[source] = sizes[source], target, {shard: q for (shard, _), q in zip(own[source], each.tolist(), strict=True)}
    return plan


def mix_sizes(sized: DataFrame, seed: int = SEED, block: int = BLOCK, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Add source_size, target, taken and the taken ranges to a stored table with row, source, size.

    ``once`` and ``twice`` are the word ranges [start, end) of a document that are
    taken at least once and twice; each has at most two parts.
    """
    spark = sized.sparkSession
    total = sized.agg(F.sum("size")).first()[0] or 0
    width = max(shard_words, -(-total // MOST_SHARDS))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(width))).cast("long"))
    same = sized["source"].eqNullSafe(sources["source"])
    dealt = sized.join(sources, same).drop(sources["source"])
    key = F.xxhash64(F.lit(seed), "row")
    dealt = dealt.withColumn("key", key).withColumn("shard", F.pmod("key", F.col("shards")))
    dealt = materialise(dealt, "mix-rows")

    counted = dealt.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    plan = plan_mix([tuple(r) for r in counted.collect()], block)
    quotas = [(s, shard, target, q) for s, (_, target, each) in plan.items() for shard, q in each.items()]
    quotas = spark.createDataFrame(quotas, "q_source string, q_shard long, target double, quota long")

    # Both sides have one row per shard or document; a shard is a bounded group.
    ring = Window.partitionBy("source", "shard")
    placed = dealt.withColumns(
        {
            "end": F.sum("size").over(ring.orderBy(F.xxhash64("key"), "row").rowsBetween(Window.unboundedPreceding, 0)),
            "words": F.sum("size").over(ring),
        }
    )
    fits = F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard"))
    placed = placed.join(quotas, fits)
    blocks = F.ceil(F.col("words") / F.lit(block))
    placed = placed.withColumns({"blocks": blocks, "begin": F.col("end") - F.col("size")})
    rounds = F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0)
    rest = F.when(F.col("blocks") > 0, F.col("quota") % F.col("blocks")).otherwise(0)
    first = F.when(F.col("blocks") > 0, F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.col("blocks"))).otherwise(0)
    placed = placed.withColumns({"rounds": rounds, "from": first * block, "to": (first + rest) * block, "round": F.col("blocks") * block})

    # The run of the rest is [from, to) on the ring; a part of it may lie beyond the ring's end.
    def part(start: Column, stop: Column) -> Column:
        a, b = F.greatest(F.col("begin"), start), F.least(F.col("end"), stop)
        return F.struct((a - F.col("begin")).alias("start"), (b - F.col("begin")).alias("end"))

    parts = F.array(part(F.lit(0), F.col("to") - F.col("round")), part(F.col("from"), F.col("to")))
    parts = F.filter(parts, lambda p: p["end"] > p["start"])
    whole = F.filter(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))), lambda p: p["end"] > p["start"])
    none = F.filter(whole, lambda p: F.lit(False))
    placed = placed.withColumn("run", parts)
    placed = placed.withColumns(
        {
            "once": F.when(F.col("rounds") >= 1, whole).otherwise(F.col("run")),
            "twice": F.when(F.col("rounds") >= 2, whole).when(F.col("rounds") == 1, F.col("run")).otherwise(none),
        }
    )

    def words(ranges: str) -> Column:
        return F.aggregate(ranges, F.lit(0).cast("long"), lambda acc, p: acc + p["end"] - p["start"])

    return placed.withColumn("taken", words("once") + words("twice")).drop("q_source", "q_shard")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    size = word_count(F.col(text_col))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    # The ring's order must not depend on how the table is split: rows are named by id, size and source.
    sized = materialise(sized.withColumn("row", F.xxhash64("doc_id", "size", "source")), "mix-sizes")
    return mix_sizes(sized, **options).select("doc_id", "size", "source_size", "target", "taken")


def take_words(text: str, ranges: list[tuple[int, int]]) -> str:
    """The words of the ranges, with what stands between them; ranges are joined by line ends."""
    places = [m.span() for m in WORD.finditer(text)]
    if ranges == [(0, len(places))]:
        return text
    return "\n".join(text[places[a][0] : places[b - 1][1]] for a, b in ranges)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each time that a document, or a part, is taken."""
    name = F.xxhash64(id_col, source_col, text_col)
    sized = docs.select(name.alias("row"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    plan = mix_sizes(materialise(sized, "mix-sizes"), **options).filter("taken > 0").select(F.col("row").alias("_row"), "once", "twice")
    plan = materialise(plan, "mix-plan")
    rest = [F.col(c) for c in docs.columns if c != text_col] or [F.lit(True).alias("row")]
    whole = docs.select(F.struct(*rest).alias("keep"), F.col(text_col).alias("text"), name.alias("row"))
    repeated = materialise(plan.groupBy("_row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_row"), "mix-repeats")
    single = plan.join(repeated, "_row", "left_anti")
    joined = whole.join(small_or_shuffled(single), F.col("row") == F.col("_row"))
    if not repeated.isEmpty():  # rows that share a name are told apart by their number among equals
        nth = lambda key, *by: F.row_number().over(Window.partitionBy(key).orderBy(*by))
        more = plan.join(repeated, "_row", "left_semi").withColumn("nth", nth("_row", F.to_json("once"), F.to_json("twice")))
        held = whole.join(repeated, F.col("row") == F.col("_row"), "left_semi").withColumn("nth", nth("row", "row"))
        both = held.join(more, (F.col("row") == F.col("_row")) & (held["nth"] == more["nth"])).drop("nth")
        joined = joined.unionByName(both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                texts = piece.column("text").to_pylist()
                which, out = [], []
                for ranges in (piece.column("once").to_pylist(), piece.column("twice").to_pylist()):
                    for i, r in enumerate(ranges):
                        if r:
                            which.append(i)
                            out.append(take_words(texts[i], [(x["start"], x["end"]) for x in r]))
                keep = piece.column("keep").take(pa.array(which, pa.int64()))
                yield pa.RecordBatch.from_arrays([keep, pa.array(out, pa.string())], ["keep", "text"])

    kind = whole.schema["keep"].dataType.simpleString()
    taken = joined.select("keep", "text", "once", "twice").mapInArrow(giving_back(run), f"keep {kind}, text string")
    return taken.select(*[F.col("text").alias(c) if c == text_col else F.col("keep")[c].alias(c) for c in docs.columns])
