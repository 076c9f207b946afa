"""One query per operator, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from itinera.llm import byte_bpe, decontaminate, divergence, exact_dedup, language_id, personal_data, resampling, secret_scan, simhash, source_mix, token_files, url_filter, warc
from itinera.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_output(table(spark, sf_dir, "documents"), byte_bpe_path)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find_personal_data(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def byte_bpe_ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), byte_bpe_ranks_path, public_tokenizers.PATTERN)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_token_output": op2_token_output,
    "op3_language_id": op3_language_id,
    "op4_personal_data": op4_personal_data,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_warc": op6_warc,
    "op7_source_mix": op7_source_mix,
    "op8_url_filter": op8_url_filter,
    "op9_simhash": op9_simhash,
    "op10_decontaminate": op10_decontaminate,
    "op11_resample": op11_resample,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_divergence": op13_divergence,
}

def _secret_sql() -> str:
    """The secret scan in SQL: gaps and matches by the same patterns, positions by running sums."""
    parts = []
    for k, (_, pattern, group, least) in enumerate(secret_scan.KINDS):
        quoted = "'" + pattern.replace("'", "''") + "'"
        parts.append(
            f"SELECT doc_id, source, {k} AS k, {least} AS least, string_split_regex(text, {quoted}) AS gaps,"
            f" regexp_extract_all(text, {quoted}, 0) AS hits, regexp_extract_all(text, {quoted}, {group}) AS vals FROM t"
        )
    said = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e)"
    return f"""
        WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
        pieces AS ({' UNION ALL '.join(parts)}),
        flat AS (
            SELECT doc_id, source, k, least, i, length(gaps[i]) AS g, length(hits[i]) AS h, vals[i] AS v
            FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM pieces WHERE len(hits) > 0)
        ),
        ends AS (SELECT *, (sum(g + h) OVER (PARTITION BY doc_id, k ORDER BY i))::BIGINT AS e FROM flat),
        spans AS (
            SELECT doc_id, source, k, ['assign', 'access', 'hex', 'live'][k + 1] AS kind, e - h AS s, e, v,
                   list_sum(list_transform(list_distinct(string_split(v, '')), lambda c:
                       -(length(v) - length(replace(v, c, ''))) / length(v) * log2((length(v) - length(replace(v, c, ''))) / length(v)))) AS bits
            FROM ends WHERE length(v) >= least AND (k < 3 OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')))
        ),
        owners AS (
            SELECT v, count(*) AS n_owners, sum(repos) AS n_repos
            FROM (SELECT v, source, count(DISTINCT doc_id) AS repos FROM spans GROUP BY v, source) GROUP BY v
        ),
        rated AS (
            SELECT *, n_owners = 1 AND n_repos < {secret_scan.COPIED_REPOS} AND bits >= {secret_scan.LIVE_ENTROPY} AS is_live,
                   n_owners >= {secret_scan.COPIED_OWNERS} OR n_repos >= {secret_scan.COPIED_REPOS} AS is_copied,
                   max(e) FILTER (k < 3) OVER (PARTITION BY doc_id ORDER BY s, k, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
                   min(s) FILTER (k < 3) OVER (PARTITION BY doc_id ORDER BY s, k, e ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after
            FROM spans JOIN owners USING (v)
        ),
        kept AS (SELECT * FROM rated WHERE k < 3 OR (is_live AND coalesce(before, -1) <= s AND coalesce(after, e) >= e)),
        found AS (
            SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
                   count(*) FILTER (is_live) AS n_live, count(*) FILTER (is_copied) AS n_copied, {said} FILTER (k < 3) AS base, {said} AS spans
            FROM kept GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
        FROM t LEFT JOIN found USING (doc_id)
    """


ORACLES: dict[str, str] = {
    "op13_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
            FROM documents
        ),
        w AS (SELECT r, lang, source, unnest(words) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
        groups AS (SELECT DISTINCT lang, source FROM d),
        counts AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS whole FROM kept GROUP BY lang),
        wholes AS (SELECT lang, source, coalesce(sum(n), 0) AS whole FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
        shares AS (
            SELECT lang, source, term, coalesce(n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (wholes.whole + v))::BIGINT AS p,
                   (1 + 1000000000::HUGEINT * (lang_n + 1) // (langs.whole + v))::BIGINT AS q
            FROM groups JOIN wholes USING (lang, source) JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
        ),
        sums AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
        ),
        parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q
        )
        SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
        FROM parts QUALIFY part = 'pair' OR rank <= 200
    """,
    "op1_secret_scan": _secret_sql(),
    "op6_warc": r"""
        WITH hashed AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        bits AS (
            SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', h[i]) - 1), 4, '0')), '') AS b
            FROM hashed
        ),
        coded AS (
            SELECT page_id, strlen(html) AS payload_bytes, html,
                   array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
                       list_sum(list_transform(range(1, 6), lambda k: (b[5 * i + k] = '1')::INT * (1 << (5 - k))))::INT + 1]), '') AS payload_digest
            FROM bits
        ),
        first AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS lead FROM coded)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> lead THEN lead END AS refers_to, CASE WHEN page_id = lead THEN payload_bytes ELSE 0 END AS block_bytes
        FROM first
    """,
    "op10_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ),
        b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ),
        phrases AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS g
            FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
        ),
        sizes AS (SELECT DISTINCT k FROM phrases),
        grams AS (
            SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g
            FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes WHERE len(w) >= k)
        ),
        hits AS (SELECT doc_id, p, k, item_id FROM grams JOIN phrases USING (k, g)),
        words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS said
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op5_exact_dedup": r"""
        WITH hashed AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h
            FROM documents
        )
        SELECT doc_id,
               min(doc_id) OVER w AS keep_id,
               count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept,
               h AS text_sha256
        FROM hashed WINDOW w AS (PARTITION BY h)
    """,
}
