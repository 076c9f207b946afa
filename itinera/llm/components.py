"""Connected components of a graph whose edges never leave the executors.

Alternating large-star and small-star rounds: every node is linked to the least
node it can see, until the edges stop changing. Each round is a grouped minimum
and an equi-join; no neighbour list is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itinera.llm.common import discard, join_counted, materialise

MOST_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One round over stored, distinct edges (a, b) with a > b; ``total`` is their number."""
    if large:  # every greater neighbour goes to the least of the closed neighbourhood
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:  # every lesser neighbour, and the node itself, goes to the least of these
        around = edges
    least = around.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", "a"))
    least = materialise(least, "least-neighbours")
    linked = join_counted(around, least, ["a"], total)
    if large:
        linked = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    out = materialise(linked.filter(F.col("a") != F.col("b")).distinct(), "edges")
    discard(least, edges)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of one comparable type; returns node, root for every node in an edge.

    root is the least node of the component. Edges may repeat, point either way
    or be loops; null ends are left out.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    edges = materialise(edges.filter("a != b").distinct(), "edges")
    state = _state(edges)
    if not state[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(MOST_ROUNDS):
        total = 2 * state[0]
        edges = _star(_star(edges, True, total), False, total)
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
