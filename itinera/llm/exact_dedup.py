"""Exact dedup by a heavy-hitter split, in DataFrame operations only.

A Misra-Gries summary over the digests (Spark's ``freqItems``) names every
digest that more than ``support`` of the rows may have. One aggregation counts
these candidates exactly and finds the row of each that stays; the verified
winners, at most ``1 / support`` rows, are broadcast, so copies in huge groups
are marked where they are read. Only the remaining digests are shuffled, and no
group among them holds more than ``support`` of the rows.

Defined results: null text counts as empty; the null ``doc_id`` sorts last, so
a null row stays only if its group has no other; of repeated rows with one
``doc_id`` and text exactly one stays; texts of any length are hashed whole; other
columns play no part, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itinera.llm.common import WHITE, materialise

#: Share of all rows above which a digest is a heavy hitter. It bounds the
#: broadcast: at most 1 / SUPPORT digests of 64 characters.
SUPPORT = 0.001


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def text_digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def group_copies(keyed: DataFrame, id_col: str, digest_col: str, support: float = SUPPORT) -> DataFrame:
    """Add keep_id, group_size and kept to a table of ids and digests.

    ``keyed`` is read several times; pass a stored table, not a costly plan.
    """
    rows = keyed.select(F.col(id_col).alias("_id"), F.col(digest_col).alias("_digest"))
    frequent = rows.stat.freqItems(["_digest"], support).select(F.explode("_digest_freqItems").alias("_digest"))
    # Misra-Gries can name digests that are not frequent: count them exactly, and keep those that are.
    winners = (
        rows.join(F.broadcast(frequent), "_digest", "left_semi")
        .groupBy("_digest")
        .agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter(F.col("group_size") > support * rows.count())
    )
    winners = materialise(winners, "heavy-digests")

    marked = rows.join(F.broadcast(winners), "_digest")
    leads = F.col("_id").eqNullSafe(F.col("keep_id"))
    copies = marked.filter(~leads).withColumn("kept", F.lit(False))
    # A winner's own row may be repeated in the table; one of the repeats stays.
    first = F.row_number().over(Window.partitionBy("_digest").orderBy("_id")) == 1
    leaders = marked.filter(leads).withColumn("kept", first)

    by_digest = Window.partitionBy("_digest")
    light = (
        rows.join(F.broadcast(winners.select("_digest")), "_digest", "left_anti")
        .withColumn("keep_id", F.min("_id").over(by_digest))
        .withColumn("group_size", F.count(F.lit(1)).over(by_digest))
        .withColumn("kept", F.row_number().over(by_digest.orderBy(F.col("_id").asc_nulls_last())) == 1)
    )
    columns = [
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        "kept",
        F.col("_digest").alias(digest_col),
    ]
    return copies.unionByName(leaders).unionByName(light).select(*columns)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("text_sha256"))
    return group_copies(materialise(keyed, "digests"), "doc_id", "text_sha256", support)
