"""URL filter: path-aware host rules, then trust and distrust over the host graph.

Pages get the verdict of the longest rule that fits. The rest get the verdict of
their host by propagation in Spark: a personalised PageRank from trusted hosts
along links, and one from blocked hosts along reversed links (who links to a
blocked host shares its distrust). What a host without links would pass on goes back
to the seeds, so both sides always sum to one. A host whose distrust exceeds its
trust by more than ``margin`` is blocked. Each round is a join and a grouped sum over
distinct host edges, stored in the shared folder; rounds go on until the scores of
both sides change by less in sum than a thousandth of the blocking threshold. The
scores of hosts with very many links are broadcast to these, not the links shuffled
to one task.

Defined results: a null url, or one without ``://``, has empty host and path and
no rule and is allowed; null html has no links; links of a host to itself are
left out; of rules of equal length the last listed wins; repeated rows are judged
each; urls and pages of any length are read whole; other columns play no part,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itinera.llm.common import HOT_SHARE, ascii_lower, discard, materialise

# Verdict, host, path of each rule.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
DAMPING = 0.85
#: Summed change of a round at which the scores have settled, as a multiple of the blocking threshold.
SETTLED = 1e-3
#: A host is a seed if at least this share of its pages falls under rules of one verdict.
SEED_SHARE = 0.5
#: Distrust minus trust, as a multiple of the mean score of a host, from which on a host is blocked.
MARGIN = 0.25

LINK = r"""href\s*=\s*["']?(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for says, of_host, of_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of_host) | host.endswith(f".{of_host}")) & path.startswith(of_path)
        rule = F.when(fits, F.lit(of_host + of_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, host: Column, html_col: str) -> DataFrame:
    """Distinct links between different hosts: src, dst."""
    links = F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))
    edges = pages.select(host.alias("src"), F.explode(F.array_distinct(links)).alias("dst"))
    edges = edges.select("src", ascii_lower(F.col("dst")).alias("dst"))
    return edges.filter((F.col("src") != F.col("dst")) & (F.col("src") != "")).distinct()


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = 1e-9) -> DataFrame:
    """Trust and distrust of hosts. seeds: host, side (``trust``/``distrust``), weight.

    Both sides run in one loop: distrust uses the edges reversed. It ends after
    ``rounds``, or if none are given once the summed change of a round, looked at every
    fourth, is at most ``tolerance``; each round's change is at most ``damping`` times the last one's and
    the first one's at most 2 a side, which bounds them. Returns host, side, score.
    """
    out = edges.select(F.lit("trust").alias("side"), F.col("src").alias("host"), F.col("dst").alias("to"))
    back = edges.select(F.lit("distrust").alias("side"), F.col("dst").alias("host"), F.col("src").alias("to"))
    arcs = out.unionByName(back)
    degree = materialise(arcs.groupBy("side", "host").agg(F.count(F.lit(1)).alias("degree")), "host-degrees")
    most = max(1, int((degree.agg(F.sum("degree")).first()[0] or 0) * HOT_SHARE))
    hubs = F.broadcast(degree.filter(F.col("degree") > most))  # at most 1 / HOT_SHARE
    few = degree.filter(F.col("degree") <= most)
    from_hubs = materialise(arcs.join(hubs, ["side", "host"]), "hub-arcs")
    from_few = materialise(arcs.join(few, ["side", "host"]), "host-arcs")
    total = seeds.groupBy("side").agg(F.sum("weight").alias("total"))
    start = materialise(
        seeds.join(F.broadcast(total), "side").select("host", "side", (F.col("weight") / F.col("total")).alias("score")),
        "host-seeds",
    )
    if degree.isEmpty():
        return start
    most_rounds = rounds if rounds is not None else 2 + max(0, math.ceil(math.log(tolerance / 4) / math.log(damping)))
    none, scores, stored = F.lit(0.0), start, None
    for n in range(most_rounds):
        pushed = from_few.join(scores, ["side", "host"]).unionByName(
            from_hubs.join(F.broadcast(scores.join(hubs.select("side", "host"), ["side", "host"], "left_semi")), ["side", "host"])
        )
        moved = pushed.select(F.col("to").alias("host"), "side", (damping * F.col("score") / F.col("degree")).alias("moved"), none.alias("home"), none.alias("last"))
        home = start.select("host", "side", none.alias("moved"), F.col("score").alias("home"), none.alias("last"))
        before = scores.select("host", "side", none.alias("moved"), none.alias("home"), F.col("score").alias("last"))
        both = moved.unionByName(home).unionByName(before).groupBy("host", "side")
        both = materialise(both.agg(*[F.sum(c).alias(c) for c in ("moved", "home", "last")]), "host-scores")
        # All that was not moved along a link goes to the seeds.
        sums = {r.side: r.moved for r in both.groupBy("side").agg(F.sum("moved").alias("moved")).collect()}
        rest = F.when(F.col("side") == "trust", 1 - sums.get("trust", 0.0)).otherwise(1 - sums.get("distrust", 0.0))
        scored = both.withColumn("score", F.col("moved") + F.col("home") * rest)
        scores = scored.select("host", "side", "score")
        if stored is not None:
            discard(stored)
        stored = both
        if rounds is None and n % 4 == 3 and (scored.agg(F.sum(F.abs(F.col("score") - F.col("last")))).first()[0] or 0.0) <= tolerance:
            break
    return scores


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    rules: Sequence[tuple[str, str, str]] = RULES,
    seed_share: float = SEED_SHARE,
    margin: float = MARGIN,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust."""
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    named = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    ruled = named.withColumns({"rule": rule, "ruled": verdict})

    hosts = ruled.filter(F.col("host") != "").groupBy("host").agg(
        F.avg((F.col("ruled").eqNullSafe("allow")).cast("double")).alias("trust"),
        F.avg((F.col("ruled").eqNullSafe("block")).cast("double")).alias("distrust"),
    )
    hosts = materialise(hosts, "hosts")
    sides = hosts.select(
        "host", F.explode(F.create_map(F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))).alias("side", "weight")
    )
    seeds = sides.filter(F.col("weight") >= seed_share)
    edges = materialise(host_edges(pages, host, html_col), "host-edges")
    least = margin / max(1, hosts.count())
    scores = propagate(edges, seeds, tolerance=SETTLED * least)
    judged = (
        scores.groupBy("host")
        .agg(
            F.coalesce(F.sum(F.when(F.col("side") == "trust", F.col("score"))), F.lit(0.0)).alias("trust"),
            F.coalesce(F.sum(F.when(F.col("side") == "distrust", F.col("score"))), F.lit(0.0)).alias("distrust"),
        )
        .withColumn("blocked", F.col("distrust") - F.col("trust") > least)
    )
    judged = materialise(judged, "host-verdicts")
    zero = F.lit(0.0)
    return ruled.join(judged, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(F.col("blocked"), F.lit("block")), F.lit("allow")).alias("verdict"),
        F.coalesce("trust", zero).alias("trust"),
        F.coalesce("distrust", zero).alias("distrust"),
    )
