"""Source divergence audit: how unlike the sources of a language are, and by which terms.

Terms are counted by language and source; counts and partial sums are then SQL that
DuckDB runs over shards of (language, term), each with all sources of its terms. Spark
deals the shards, merges their sums and ranks.

A term that a source lacks has the same smoothed share p0 there as any other such term.
So with f(p, q) the divergence of one term, a pair of sources has

    V f(p0, q0)  +  sum over terms in the first   of f(p, q0) - f(p0, q0)
                 +  sum over terms in the second  of f(p0, q) - f(p0, q0)
                 +  sum over terms in both        of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

where only the last needs pairs, those of sources that share a term, and the two before
need a row for each share that occurs in a shard. All numbers are integers; sums have
128 bits.

Sources of a language are meant to be comparable one by one: the result has a row for
each ordered pair of them, so their totals, a row each, are few beside it and go to
every task.

Defined results: null text, language and source are empty strings; a language without
kept terms has pairs of value 0 and no terms; repeated rows are documents of their own;
texts of any length are read whole, a piece at a time; equal values rank by item in UTF-8;
other columns play no part, whatever their names; an empty table gives an empty result;
a value beyond a long is an error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itinera.llm.common import discard, fold_table, materialise, words_within

#: Documents that a kept term has at least, smoothing, the scale of shares, ranks of terms.
LEAST_DOCS = 3
SMOOTHING = 1
SCALE = 1_000_000_000
TOP_TERMS = 200
#: Rows that a shard has, about; terms that a task counts before it passes them on.
SHARD_ROWS = 1 << 19
HELD_TERMS = 1 << 18

TERMS = fold_table(digits=False)
COUNTS = "lang string, term string, source string, n long, docs long"


def count_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", held: int = HELD_TERMS) -> DataFrame:
    """Occurrences and documents by language, source and term, added up within each task.

    Each group also has a row of the null term, for groups without any.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to) for c, to in ((lang_col, "lang"), (source_col, "source"))]
    rows = docs.select(*named, F.col(text_col).cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        seen: set[tuple[str, str]] = set()

        def settle() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in groups.items():
                terms = [*n, None] if (lang, source) not in seen else [*n]
                seen.add((lang, source))
                for at in range(0, len(terms), 1 << 16):
                    part = terms[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(part), pa.string()),
                            pa.array(part, pa.binary()).cast(pa.string()),
                            pa.array([source] * len(part), pa.string()),
                            pa.array([n.get(t, 0) for t in part], pa.int64()),
                            pa.array([docs.get(t, 0) for t in part], pa.int64()),
                        ],
                        [c.split()[0] for c in COUNTS.split(", ")],
                    )
            groups.clear()

        for batch in batches:
            keys = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
            for key, text in zip(keys, batch.column("text"), strict=True):
                if key not in groups:
                    groups[key] = Counter(), Counter()
                n, docs = groups[key]
                own: set[bytes] = set()
                for words in words_within(text.as_py(), TERMS):
                    n.update(words)
                    own.update(words)
                docs.update(own)
            if sum(len(n) for n, _ in groups.values()) > held:
                yield from settle()
        yield from settle()

    return rows.mapInArrow(count, COUNTS)


def _duck(tables: dict[str, pa.Table], sql: str) -> Iterator[pa.RecordBatch]:
    """What one thread of DuckDB, in memory, makes of the tables of a shard."""
    import duckdb

    with duckdb.connect() as con:
        con.execute("SET threads = 1")
        for name, data in tables.items():
            con.register(name, data)
        yield from con.sql(sql).to_arrow_table().to_batches()


def _sharded(rows: DataFrame, shards: int, sql: str, schema: str, **fixed: pa.Table) -> DataFrame:
    """Deal rows by language and term and run SQL over each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from _duck({"rows": pa.Table.from_batches(held), **fixed}, sql)

    return rows.repartition(shards, "lang", "term").mapInArrow(run, schema)


#: Counts of the kept terms of a shard; ``first`` marks one row of each term.
KEPT_SQL = """
    WITH summed AS (SELECT lang, term, source, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM rows GROUP BY ALL),
    told AS (SELECT *, sum(docs) OVER w AS lang_docs, row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS first
             FROM summed WINDOW w AS (PARTITION BY lang, term))
    SELECT lang, term, source, n, first FROM told WHERE lang_docs >= {least}
"""

#: Partial sums of pairs (term null) and the shard's best terms of each group (other null).
#: totals: lang, source, p0, whole (kept occurrences and smoothing of the group), lang_whole.
PART_SQL = """
    WITH shares AS MATERIALIZED (
        SELECT lang, term, source, p0,
               1 + ({scale}::HUGEINT * (n + 1) // whole)::BIGINT AS p,
               1 + ({scale}::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 1) // lang_whole)::BIGINT AS q
        FROM rows JOIN totals USING (lang, source)
    ),
    shared AS (
        SELECT a.lang, a.source, b.source AS other,
               sum(((a.p - b.p) * (a.p - b.p) // b.p - (a.p - b.p0) * (a.p - b.p0) // b.p0
                    - (a.p0 - b.p) * (a.p0 - b.p) // b.p + (a.p0 - b.p0) * (a.p0 - b.p0) // b.p0)::HUGEINT) AS value
        FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
        GROUP BY ALL
    ),
    levels AS (SELECT lang, source, p, p0, count(*) AS n FROM shares GROUP BY ALL),
    one AS (
        SELECT l.lang, l.source, t.source AS other,
               sum(l.n * ((l.p - t.p0) * (l.p - t.p0) // t.p0 - (l.p0 - t.p0) * (l.p0 - t.p0) // t.p0)::HUGEINT) AS there,
               sum(l.n * ((t.p0 - l.p) * (t.p0 - l.p) // l.p - (t.p0 - l.p0) * (t.p0 - l.p0) // l.p0)::HUGEINT) AS back
        FROM levels l JOIN totals t ON l.lang = t.lang AND l.source <> t.source
        GROUP BY ALL
    ),
    pairs AS (
        SELECT lang, source, other, sum(value) AS value
        FROM (SELECT lang, source, other, value FROM shared UNION ALL SELECT lang, source, other, there FROM one UNION ALL SELECT lang, other, source, back FROM one)
        GROUP BY ALL
    ),
    terms AS (
        SELECT lang, source, term, (p - q) * (p - q) // q AS value FROM shares WHERE p > q
        QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {top}
    )
    SELECT lang, source, other, NULL::VARCHAR AS term, value::DECIMAL(38, 0) AS value FROM pairs
    UNION ALL
    SELECT lang, source, NULL, term, value::DECIMAL(38, 0) FROM terms
"""
PART = "lang string, source string, other string, term string, value decimal(38,0)"


def _ranked(rows: DataFrame, most: int | None = None, salts: int = 1) -> DataFrame:
    """rank by value, then item; with ``most`` only so many, chosen among a share of the rows first."""

    def numbered(*more: str) -> DataFrame:
        order = Window.partitionBy("lang", "source", *more).orderBy(F.col("value").desc(), "item")
        return rows.withColumn("rank", F.row_number().over(order))

    if most is not None and salts > 1:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(salts)))
        rows = numbered("salt").filter(F.col("rank") <= most).drop("salt", "rank")
    out = numbered()
    return out if most is None else out.filter(F.col("rank") <= most)


def audit_sources(
    docs: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    least_docs: int = LEAST_DOCS,
    top_terms: int = TOP_TERMS,
    shard_rows: int = SHARD_ROWS,
    held: int = HELD_TERMS,
) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` rows to each other source, ``term`` rows of the source's terms."""
    spark = docs.sparkSession
    counted = materialise(count_terms(docs, lang_col, source_col, text_col, held), "term-counts")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(least, -(-counted.count() // shard_rows))
    terms = counted.filter("term IS NOT NULL")
    kept = materialise(_sharded(terms, shards, KEPT_SQL.format(least=least_docs), "lang string, term string, source string, n long, first boolean"), "kept-terms")

    groups = counted.filter("term IS NULL").select("lang", "source").distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("first").cast("long")).alias("first"))
    groups = groups.join(sums, ["lang", "source"], "left").na.fill(0)
    whole = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("first").alias("v"))
    totals = groups.join(whole, "lang").selectExpr(
        "lang", "source", "v", f"n + {SMOOTHING} * v AS whole", f"lang_n + {SMOOTHING} * v AS lang_whole", f"CASE WHEN v > 0 THEN 1 + {SCALE} DIV (n + {SMOOTHING} * v) END AS p0"
    )
    totals = materialise(totals, "term-totals")
    sent = totals.filter("v > 0").toArrow()
    discard(counted)

    parts = materialise(_sharded(kept.select("lang", "term", "source", "n"), shards, PART_SQL.format(scale=SCALE, top=top_terms), PART, totals=sent), "term-sums")
    added = parts.filter("other IS NOT NULL").groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("added"))
    other = totals.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = totals.join(other, "lang").filter("source <> item").join(added, ["lang", "source", "item"], "left")
    base = F.coalesce(F.expr("CAST(v AS DECIMAL(20, 0)) * ((p0 - q0) * (p0 - q0) DIV q0)"), F.lit(0))
    pairs = pairs.withColumn("value", (base + F.coalesce("added", F.lit(0))).cast("long"))
    best = parts.filter("term IS NOT NULL").select("lang", "source", F.col("term").alias("item"), F.col("value").cast("long").alias("value"))
    columns = ["lang", "source", F.lit("pair").alias("part"), "item", "value", "rank"]
    found = _ranked(pairs.select("lang", "source", "item", "value")).select(columns)
    columns[2] = F.lit("term").alias("part")
    return found.unionByName(_ranked(best, top_terms, max(1, int(shards**0.5))).select(columns))
