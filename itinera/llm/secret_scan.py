"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Positions come from two built-ins: splitting a text by a pattern gives the gaps,
extracting all its matches gives the pieces between them, and a running sum of
both lengths is where each match starts. Every candidate value is hashed, and
the hashes are aggregated by distinct repositories and owners: a value that many
owners or many repositories hold is a copied example, a high-entropy value that a
single owner holds in few repositories looks live. Live-looking tokens that no base pattern covers are added as spans
of kind ``live``; base spans always stay.

Defined results: null text is empty and gives no spans; a null repository or
owner counts as one repository or owner of its own; spans of one start go by kind as
listed; repeated rows are scanned each; texts of any length are scanned whole; other
columns play no part, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itinera.llm.common import join_counted, materialise

# The kinds in their listed order, with their patterns. The upper
# bounds on repetition are absent on purpose: whole runs are matched.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: kind, pattern, group that holds the value, least length of the value
KINDS = [("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32), ("live", TOKEN, 0, 20)]

#: From this many distinct owners on, a value counts as a copied example.
COPIED_OWNERS = 3
#: From this many distinct repositories on it does too, even of a single owner.
COPIED_REPOS = 10
#: Bits a character from which on a token looks random, not written.
LIVE_ENTROPY = 3.0


def entropy(value: Column) -> Column:
    """Shannon entropy of the characters of a value, in bits a character."""
    n = F.length(value).cast("double")

    def more(acc: Column, char: Column) -> Column:
        p = (n - F.length(F.replace(value, char, F.lit("")))) / n
        return acc - p * F.log2(p)

    return F.aggregate(F.array_distinct(F.split(value, "")), F.lit(0.0), more)


def _pieces(text: Column, pattern: str, group: int) -> tuple[Column, Column, Column]:
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    return gaps, found, values


def find_candidates(docs: DataFrame, doc_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """One stored row per document, with the lengths and values of its matches."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(doc_col).alias("doc_id"),
        F.col(repo_col).cast("string").alias("repo"),
        F.col(owner_col).cast("string").alias("owner"),
        text.alias("_text"),
    )
    columns = []
    for kind, pattern, group, _ in KINDS:
        gaps, found, values = _pieces(F.col("_text"), pattern, group)
        rows = F.transform(
            F.arrays_zip(F.transform(gaps, F.length).alias("gap"), found.alias("hit"), values.alias("value")),
            lambda x: F.struct(x["gap"].alias("gap"), F.length(x["hit"]).alias("hit"), x["value"].alias("value")),
        )
        columns.append(F.when(F.col("_text").rlike(pattern), rows).alias(kind))
    return materialise(
        base.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "repo", "owner", *columns), "secret-pieces"
    )


def locate(found: DataFrame) -> DataFrame:
    """A row per span: rid, repo, owner, k (place of its kind), start, end, value."""
    parts = []
    for k, (kind, _, _, least) in enumerate(KINDS):
        pieces = found.filter(F.col(kind).isNotNull()).select(
            "rid", "repo", "owner", F.lit(k).alias("k"), F.lit(least).alias("least"), F.posexplode(kind).alias("pos", "x")
        )
        parts.append(pieces.select("rid", "repo", "owner", "k", "least", "pos", "x.gap", "x.hit", "x.value"))
    pieces = parts[0]
    for part in parts[1:]:
        pieces = pieces.unionByName(part)
    so_far = Window.partitionBy("rid", "k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.coalesce(F.col("hit"), F.lit(0))).over(so_far)
    return (
        pieces.withColumn("end", end)
        .filter(F.col("hit").isNotNull() & (F.length("value") >= F.col("least")))
        .select("rid", "repo", "owner", "k", (F.col("end") - F.col("hit")).alias("start"), "end", "value")
    )


def ownership(spans: DataFrame) -> DataFrame:
    """Distinct repositories and owners of each value hash.

    Groupings pre-aggregate in each task, so a value in a third of all documents
    costs one row per task and repository. ``n`` counts the value's rows.
    """
    by_repo = spans.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n"))


def scan_secrets(
    docs: DataFrame,
    doc_col: str = "doc_id",
    text_col: str = "text",
    repo_col: str = "doc_id",
    owner_col: str = "source",
    copied_owners: int = COPIED_OWNERS,
    live_entropy: float = LIVE_ENTROPY,
    copied_repos: int = COPIED_REPOS,
) -> DataFrame:
    """One row per document: counts by kind, base_sha256, spans, n_live, n_copied."""
    found = find_candidates(docs, doc_col, text_col, repo_col, owner_col)
    live = len(KINDS) - 1
    spans = locate(found)
    # Bare tokens need letters and digits; values of base kinds are candidates as they are.
    spans = spans.filter((F.col("k") < live) | (F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")))
    spans = spans.select(
        "rid", "repo", "owner", "k", "start", "end", F.sha2("value", 256).alias("hash"), entropy(F.col("value")).alias("bits")
    )
    spans = materialise(spans, "secret-spans")
    # The owners of a value that very many spans hold are sent to them, not they to its owners.
    rated = join_counted(spans, materialise(ownership(spans), "secret-owners"), ["hash"], spans.count())
    few = F.col("n_repos") < copied_repos
    rated = rated.withColumn("is_live", (F.col("n_owners") == 1) & few & (F.col("bits") >= live_entropy)).withColumn(
        "is_copied", (F.col("n_owners") >= copied_owners) | ~few
    )

    # A bare token stays if it is live and touches no base span of its document.
    order = Window.partitionBy("rid").orderBy("start", "k", "end")
    is_base = F.col("k") < live
    before = F.max(F.when(is_base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(is_base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    rated = rated.withColumn("before", before).withColumn("after", after)
    free = (F.coalesce("before", F.lit(-1)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))
    rated = rated.filter(is_base | (F.col("is_live") & free))

    kinds = F.array(*[F.lit(kind) for kind, *_ in KINDS])
    span = F.struct("start", "k", "end")
    per_doc = rated.groupBy("rid").agg(
        *[F.count_if(F.col("k") == k).alias(f"n_{KINDS[k][0]}") for k in range(live)],
        F.count_if("is_live").alias("n_live"),
        F.count_if("is_copied").alias("n_copied"),
        F.array_sort(F.collect_list(span)).alias("all"),
    )

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["k"]], s["start"], s["end"])), ",")

    per_doc = per_doc.select(
        "rid",
        *[f"n_{KINDS[k][0]}" for k in range(live)],
        "n_live",
        "n_copied",
        joined(F.filter("all", lambda s: s["k"] < live)).alias("base"),
        joined(F.col("all")).alias("spans"),
    )
    zero = F.lit(0).cast("long")
    return (
        found.select("rid", "doc_id")
        .join(per_doc, "rid", "left")
        .select(
            "doc_id",
            *[F.coalesce(f"n_{KINDS[k][0]}", zero).alias(f"n_{KINDS[k][0]}") for k in range(live)],
            F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
            F.coalesce("spans", F.lit("")).alias("spans"),
            F.coalesce("n_live", zero).alias("n_live"),
            F.coalesce("n_copied", zero).alias("n_copied"),
        )
    )
