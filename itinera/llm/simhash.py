"""SimHash near-dedup by tiled exact comparison.

Each document gets a 64-bit fingerprint of its word shingles. Equal fingerprints
collapse by a grouping, so only distinct ones are compared. The comparison is
exact and runs in tiles: numpy exclusive-or and bit counts over all pairs of a
tile pair, and tile pairs whose population counts differ by more than the radius
are skipped. Which fingerprints share tiles follows from the pigeonhole rule: two
that differ in at most 3 bits agree in all but 3 blocks of bits, so a tile holds
fingerprints that agree in some. Every tile is sorted by population count: rows meet
only the columns whose counts lie within the radius of theirs. A bucket with more
fingerprints than one tile takes is cut into tiles by population count and hash, and
each pair of its tiles is a work item of its own. A tile reports a spanning forest of
its links, never all pairs, and components settle in Spark.

Defined results: null text has no words and fingerprint zero, which links like
any other; the null ``doc_id`` keeps its fingerprint and takes the component of
that fingerprint; a component is named by its least id, so ties do not arise;
repeated rows link; texts of any length are shingled whole; other columns keep their
names and values, whatever these are; an empty table gives an empty result.

Few edited words change more than 3 bits, so ``drop_near_copies`` can also link
texts by the Jaccard similarity of their five-word shingles. Candidates share a
band of min-hashes (two texts at 0.8 share none of 32 with a chance of 5e-8), and
every link is checked on the whole shingle sets: first against two centres of each
band, then, where a band still holds several components, between all of these.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itinera.llm.common import discard, giving_back, join_counted, materialise, small_or_shuffled
from itinera.llm.components import connected_components

RADIUS = 3
BITS = 64
#: Fingerprints in a tile; a tile pair takes at most 8 * TILE**2 bytes for its differences.
TILE = 1024
#: Rows of a tile that are compared at once, with the columns of near population counts.
STRIP = 64
SHINGLE = 3
SEED = 42
#: Words of a shingle, and similarity of two shingle sets, from which on texts are near copies.
NEAR_SHINGLE = 5
NEAR_JACCARD = 0.8
#: Bands of min-hashes by which candidates are found.
BANDS, BAND_ROWS = 32, 4
_RANDOM = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * BAND_ROWS), dtype=np.uint64)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of the word shingles of one text in order, none without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """SimHash of the word shingles of one text, 0 without words."""
    hashes = shingle_hashes(text, width)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def shingle_set(text: str | None) -> np.ndarray:
    """Hashes of the distinct five-word shingles of one text, sorted; each word is hashed once."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(words)}
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(NEAR_SHINGLE, len(hashes))
    out = np.full(len(hashes) - width + 1, width, np.uint64)
    for i in range(width):
        out = (out ^ hashes[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band of min-hashes, none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * BAND_ROWS, 2**64 - 1, np.uint64)
    each = np.empty((256, BANDS * BAND_ROWS), np.uint64)
    for i in range(0, len(shingles), len(each)):
        part = each[: len(shingles[i : i + len(each)])]
        np.multiply(shingles[i : i + len(each), None], _RANDOM[0] | np.uint64(1), out=part)
        part += _RANDOM[1]
        np.minimum(low, part.min(axis=0), out=low)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, BAND_ROWS).T:
        key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ column
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted shingle sets reach the similarity of near copies."""
    if min(len(a), len(b)) < NEAR_JACCARD * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= NEAR_JACCARD * (len(a) + len(b) - common)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(giving_back(run), f"doc_id {id_type}, fp long")


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside ``left``, or between left and right.

    Both are distinct unsigned fingerprints; returns two arrays of linked ones.
    A component is gathered breadth first over the matrix of links, so a dense
    tile costs no more than its matrix.
    """
    left = left[np.argsort(np.bitwise_count(left), kind="stable")]
    other = left if right is None else right[np.argsort(np.bitwise_count(right), kind="stable")]
    mine, theirs = np.bitwise_count(left).astype(int), np.bitwise_count(other).astype(int)
    near = np.zeros((len(left), len(other)), bool)
    for at in range(0, len(left), STRIP):
        end = min(len(left), at + STRIP)
        low, high = np.searchsorted(theirs, [mine[at] - radius, mine[end - 1] + radius + 1])
        near[at:end, low:high] = np.bitwise_count(left[at:end, None] ^ other[None, low:high]) <= radius
    open_rows = near.sum(axis=1) > (right is None)  # inside one tile a row always meets itself
    open_columns = np.ones(len(other), bool)
    a, b = [], []
    for first in np.nonzero(open_rows)[0]:
        if not open_rows[first]:
            continue
        root, rows = left[first], np.array([first])
        while len(rows):
            open_rows[rows] = False
            columns = np.nonzero(near[rows].any(axis=0) & open_columns)[0]
            open_columns[columns] = False
            a += [left[rows], other[columns]]
            b += [np.full(len(rows) + len(columns), root)]
            rows = np.nonzero(near[:, columns].any(axis=1) & open_rows)[0]
    if not a:
        return (np.zeros(0, np.uint64),) * 2
    a, b = np.concatenate(a), np.concatenate(b)
    return a[a != b], b[a != b]


def _short_runs(fp: np.ndarray, key: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key and population count, for keys with few rows: row i against row i + d.

    Once no two rows at a distance share a key and have near population counts, none
    farther apart do.
    """
    a, b = [], []
    pop, d = np.bitwise_count(fp).astype(int), 1
    while d < len(fp):
        same = np.nonzero((key[:-d] == key[d:]) & (pop[d:] - pop[:-d] <= radius))[0]
        if not len(same):
            break
        near = same[np.bitwise_count(fp[same] ^ fp[same + d]) <= radius]
        a.append(fp[near])
        b.append(fp[near + d])
        d += 1
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


#: Runs of up to this many rows are compared row by row at a distance; longer ones as a tile.
SHORT_RUN = 24


def _whole_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches sorted by key, cut so that no key spans two parts."""
    fp, key = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        fp = np.concatenate([fp, batch["fp"].to_numpy(np.int64).view(np.uint64)])
        key = np.concatenate([key, batch["tile"].to_numpy(np.int64)])
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if cut:
            yield fp[:cut], key[:cut]
            fp, key = fp[cut:], key[cut:]
    if len(key):
        yield fp, key


def links_in_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links inside tiles that fit one item: rows (tile, fp), sorted by tile and population count."""
    for fp, key in _whole_tiles(batches):
        starts = np.concatenate(([0], np.nonzero(key[1:] != key[:-1])[0] + 1))
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        short = np.repeat(sizes <= SHORT_RUN, sizes)
        parts = [_short_runs(fp[short], key[short], RADIUS)]
        parts += [tile_links(fp[s : s + n], None) for s, n in zip(starts, sizes, strict=True) if n > SHORT_RUN]
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(a):
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def links_between_tiles(part: pd.DataFrame) -> pd.DataFrame:
    """Links of one tile pair: rows (pair, side, fp); a pair of a tile with itself has side 0 alone."""
    fp, side = part["fp"].to_numpy(np.int64).view(np.uint64), part["side"].to_numpy()
    right = fp[side == 1]
    a, b = tile_links(fp[side == 0], right if len(right) else None)
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def blocks_for(n: int) -> int:
    """Blocks of bits by which n fingerprints are dealt out, so that a bucket holds few of them.

    Two fingerprints within the radius differ in at most 3 blocks, so they agree in
    all others: 4 blocks give 4 keys of 16 bits, 5 give 10 of 25 and 6 give 20 of 32.
    """
    return 4 if n <= 1 << 22 else 5 if n <= 1 << 31 else 6


def bucket_keys(fp: Column, blocks: int) -> list[Column]:
    """A key for each choice of the blocks that may agree."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    keys = []
    for place, chosen in enumerate(combinations(range(blocks), blocks - RADIUS)):
        key = F.lit(place).cast("long")
        for i in chosen:
            width = cuts[i + 1] - cuts[i]
            block = F.shiftrightunsigned(fp, cuts[i]).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            key = F.shiftleft(key, width).bitwiseOR(block)
        keys.append(key)
    return keys


def near_links(distinct: DataFrame, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """Links (a, b) among distinct fingerprints, such that every pair within the radius is connected.

    distinct: one column fp, stored.
    """
    blocks = blocks or blocks_for(distinct.count())
    banded = distinct.select("fp", F.explode(F.array(*bucket_keys(F.col("fp"), blocks))).alias("tile"))
    sizes = banded.groupBy("tile").agg(F.count(F.lit(1)).alias("n"))
    hot = materialise(sizes.filter(F.col("n") > tile), "hot-buckets")

    # Buckets that fit a tile: whole buckets side by side in a partition.
    fitting = banded.join(hot.select("tile"), "tile", "left_anti")
    inside = (
        fitting.repartition("tile").sortWithinPartitions("tile", F.bit_count("fp")).mapInPandas(links_in_tiles, "a long, b long")
    )
    if hot.isEmpty():
        return inside

    # Larger ones: tiles by population count and hash, sized from exact counts.
    cells = banded.join(hot.select("tile"), "tile").withColumn("pop", F.bit_count("fp").cast("int"))
    cell_sizes = cells.groupBy("tile", "pop").agg(F.count(F.lit(1)).alias("n"))
    cell_sizes = cell_sizes.select("tile", "pop", F.ceil(F.col("n") / tile).cast("int").alias("parts"))
    cell_sizes = materialise(cell_sizes, "tile-cells")
    # All tiles within the radius of a cell, this cell's own included; pairs are ordered.
    near = cell_sizes.select("tile", F.col("pop").alias("pop2"), F.col("parts").alias("parts2"))
    partners = cell_sizes.withColumn("pop2", F.explode(F.sequence(F.col("pop") - RADIUS, F.col("pop") + RADIUS))).join(
        near, ["tile", "pop2"]
    )
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    rows = cells.join(partners, ["tile", "pop"]).withColumn("part", own)
    rows = rows.withColumn("part2", F.explode(F.sequence(F.lit(0), F.col("parts2") - 1)))
    mine, other = F.struct("pop", "part"), F.struct(F.col("pop2").alias("pop"), F.col("part2").alias("part"))
    rows = rows.select(
        "tile",
        F.least(mine, other).alias("low"),
        F.greatest(mine, other).alias("high"),
        F.when(mine <= other, 0).otherwise(1).alias("side"),
        "fp",
    )
    between = rows.groupBy("tile", "low", "high").applyInPandas(links_between_tiles, "a long, b long")
    return inside.unionByName(between)


#: Rows that are turned into Python objects at once.
SLICE = 500


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.slice(at, SLICE)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, fp, node (a hash of the shingle set) and the band keys of every row (doc_id, text)."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = batch.column("text").to_pylist()
            fps = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
            sets = [shingle_set(t) for t in texts]
            nodes = np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets), np.uint64, len(sets))
            keys = pa.array([band_keys(x) for x in sets], pa.list_(pa.int64()))
            columns = [batch.column("doc_id"), pa.array(fps.view(np.int64)), pa.array(nodes.view(np.int64)), keys]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "node", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(giving_back(run), f"doc_id {kind}, fp long, node long, keys array<long>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        sets = pa.array([shingle_set(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("node"), sets], ["node", "shingles"])


def _alike_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        sets = [[np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("sa", "sb")]
        near = pa.array([alike(x, y) for x, y in zip(*sets, strict=True)], pa.bool_())
        yield batch.select(["a", "b"]).filter(near)


def _alike_in_tiles(part: pd.DataFrame) -> pd.DataFrame:
    """Links that join components of one tile pair: rows (node, root, side, shingles)."""
    nodes, side = part["node"].to_numpy(np.int64), part["side"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in part["shingles"]]
    roots, between = part["root"].to_numpy(np.int64).copy(), bool(side.any())
    links = []
    for i in range(len(nodes)):
        for j in np.nonzero((roots != roots[i]) & ((side > side[i]) if between else (np.arange(len(nodes)) > i)))[0]:
            if roots[j] != roots[i] and alike(sets[i], sets[j]):
                links.append((nodes[i], nodes[j]))
                roots[roots == roots[j]] = roots[i]
    return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)


def shingle_links(docs: DataFrame, rows: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (a, b) among fingerprints by which all near copies in docs are connected.

    docs: doc_id (none, id, hash), text; rows: their stored sketches.
    """
    owners = materialise(rows.groupBy("node", "fp").agg(F.min("doc_id").alias("least")), "node-fingerprints")
    nodes = materialise(owners.groupBy("node").agg(F.min("fp").alias("head"), F.min("least").alias("least")), "nodes")
    same = owners.join(nodes, "node").filter("fp != head").select(F.col("fp").alias("a"), F.col("head").alias("b"))

    # Copies of one text are one node here, however many there are.
    sketched = rows.groupBy("node").agg(F.first("keys").alias("keys"))
    banded = materialise(sketched.select("node", F.explode("keys").alias("key")), "bands")
    shared = banded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("n"))
    shared = materialise(shared.filter("low != high"), "shared-bands")
    members = materialise(join_counted(banded, shared, ["key"], banded.count()), "band-members")
    ends = members.select("node", F.explode(F.array("low", "high")).alias("centre")).filter("node != centre")
    pairs = materialise(ends.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), "near-pairs")

    # Shingle sets are built again for the texts with candidates alone, of one document each.
    wanted = nodes.join(members.select("node").distinct(), "node").select("node", F.col("least.none").alias("_none"), F.col("least.id").alias("_id"), F.col("least.hash").alias("_hash"))
    wanted = materialise(wanted, "near-keys")
    here = (F.col("doc_id.none") == F.col("_none")) & F.col("doc_id.id").eqNullSafe(F.col("_id")) & (F.col("doc_id.hash") == F.col("_hash"))
    sets = docs.join(small_or_shuffled(wanted), here).select("node", "text").mapInArrow(giving_back(_sets), "node long, shingles binary")
    sets = materialise(sets.groupBy("node").agg(F.min("shingles").alias("shingles")), "shingle-sets")

    left = materialise(pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a"), "near-pairs")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")
    links = near = materialise(both.mapInArrow(giving_back(_alike_pairs), "a long, b long"), "near-texts")
    discard(left, pairs, wanted, banded, shared)

    # Bands whose members are not yet connected: all pairs of their components, in tiles.
    roots = connected_components(links)
    placed = members.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    placed = materialise(placed, "placed-members")
    unsettled = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r1"), F.max("root").alias("r2"))
    unsettled = unsettled.filter("n > 2 AND r1 != r2").select("key", F.ceil(F.col("n") / tile).cast("int").alias("parts"))
    unsettled = materialise(unsettled, "unsettled-bands")
    if not unsettled.isEmpty():
        part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        split = placed.join(unsettled, "key").join(sets, "node").withColumn("part", part)
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        split = split.select(
            "key", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"),
            (F.col("part") > F.col("other")).cast("int").alias("side"), "node", "root", "shingles",
        )
        more = split.groupBy("key", "first", "second").applyInPandas(_alike_in_tiles, "a long, b long")
        links = links.unionByName(more)
    heads = nodes.select("node", "head")
    links = links.join(heads.select(F.col("node").alias("a"), F.col("head").alias("fa")), "a").join(heads.select(F.col("node").alias("b"), F.col("head").alias("fb")), "b")
    found = materialise(same.unionByName(links.select(F.col("fa").alias("a"), F.col("fb").alias("b"))), "shingle-links")
    discard(owners, nodes, members, sets, near, placed, unsettled)
    return found


def _components(docs: DataFrame, id_col: str, text_col: str, tile: int, by_shingles: bool) -> tuple[DataFrame, list[DataFrame]]:
    """One row per document: doc_id, fp, component_id; and the stored tables that this reads."""
    rows = materialise(sketches(docs) if by_shingles else fingerprints(docs, id_col, text_col), "fingerprints")
    by_fp = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    by_fp = materialise(by_fp, "distinct-fingerprints")
    links = near_links(by_fp.select("fp"), tile)
    if by_shingles:
        more = shingle_links(docs, rows, tile)
        roots = connected_components(links.unionByName(more))
        discard(more)
    else:
        roots = connected_components(links)
    members = by_fp.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "least")
    heads = members.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = materialise(members.join(heads, "root").select("fp", "component_id"), "fingerprint-components")
    named = by_fp.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n")
    named = materialise(named, "fingerprint-classes")
    discard(by_fp, moved)
    return join_counted(rows, named, ["fp"], rows.count()).select("doc_id", "fp", "component_id"), [rows, named]


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE, by_shingles: bool = False) -> DataFrame:
    """One row per document: doc_id, fp, component_id (least doc_id that is reachable).

    With ``by_shingles`` near copies by shingle similarity are linked besides; doc_id
    is then a struct (none, id, hash).
    """
    return _components(docs, id_col, text_col, tile, by_shingles)[0]


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    found = simhash_components(docs, id_col, text_col)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE, by_shingles: bool = False) -> DataFrame:
    """One document of each component stays: that of the least id, and of repeated rows one.

    Components are those of the fingerprints, and with ``by_shingles`` of near copies
    by shingle similarity too.

    A document goes by its id and a hash of its text; only these and fingerprints
    are shuffled to decide. The texts are read again, and are shuffled only where
    the kept keys are too many to broadcast.
    """
    words = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull())
    none = F.col(id_col).isNull()
    keyed = docs.select(F.struct(none.alias("none"), F.col(id_col).alias("id"), words.alias("hash")).alias("doc_id"), F.col(text_col).alias("text"))
    judged, stored = _components(keyed, "doc_id", "text", tile, by_shingles)
    found = materialise(judged.select("doc_id", "component_id"), "near-copies")
    discard(*stored)
    kept = materialise(found.select("component_id").distinct(), "kept-keys")
    rows = docs.select(F.struct(*map(F.col, docs.columns)).alias("keep"), F.struct(none.alias("none"), F.col(id_col).alias("id"), words.alias("hash")).alias("key"))

    def same(other: Column) -> Column:
        return (F.col("key.none") == other["none"]) & F.col("key.id").eqNullSafe(other["id"]) & (F.col("key.hash") == other["hash"])

    out = rows.join(small_or_shuffled(kept), same(F.col("component_id")), "left_semi")
    repeated = found.groupBy(F.col("doc_id").alias("again")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("again")
    repeated = materialise(repeated, "repeated-keys")
    discard(found)
    if not repeated.isEmpty():
        # Rows that repeat an id and text: any one of each stays. Tasks keep one each before they meet.
        again = small_or_shuffled(repeated)
        one = out.join(again, same(F.col("again")), "left_semi").groupBy("key").agg(F.first("keep").alias("keep"))
        out = out.join(again, same(F.col("again")), "left_anti").select("keep").unionByName(one.select("keep"))
    return out.select("keep.*")
