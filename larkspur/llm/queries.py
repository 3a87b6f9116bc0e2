"""The queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_documents
from .code_search import search_vectors
from .decontam import contaminated
from .html_text import main_text
from .line_dedup import dedup_lines
from .quality import score_quality
from .quality_rules import apply_rules
from .repeats import remove_repeats
from .shared import read_table
from .simhash import near_duplicates
from .source_audit import audit_sources
from .token_counts import count_tokens
from .warc import archive_pages
from .whitening import whiten


def op1_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op2_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(read_table(spark, sf_dir, "pages"))


def op4_code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_vectors(read_table(spark, sf_dir, "embeddings"), every=50, k=10)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=4, distance=4)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return held.select("doc_id", "item_id", "matched_windows", "item_windows", "same_values")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(read_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_repeat_removal, op2_bpe_encode, op3_warc, op4_code_search, op5_simhash, op6_token_counts, op7_decontamination, op8_line_dedup, op9_quality, op10_html_text, op11_source_audit, op12_whitening, op13_quality_rules)}

ORACLE_SQL: dict[str, str] = {
    "op1_repeat_removal": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        b AS (
            SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS x, CASE WHEN 2 * p + 100 <= length(h) THEN substr(h, 2 * p + 1, 100) END AS s
            FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS p FROM d)),
        f AS (SELECT s, min(doc_id) AS first FROM b WHERE s IS NOT NULL GROUP BY s),
        r AS (SELECT b.doc_id, b.p, b.x, coalesce(f.first < b.doc_id, false) AS starts FROM b LEFT JOIN f ON b.s = f.s),
        g AS (SELECT doc_id, p, x, bool_or(starts) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM r),
        e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM g),
        t AS (
            SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
                   string_agg(x, '' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM e GROUP BY doc_id)
        SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(kept, ''))) AS kept_sha256
        FROM d LEFT JOIN t ON d.doc_id = t.doc_id
    """,
    "op3_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS payload_digest,
                   CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes
            FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, p.payload_digest,
               CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id < page_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
    """,
    "op4_code_search": """
        WITH pairs AS (
            SELECT q.vec_id AS query_id, v.vec_id AS neighbor_id,
                   CAST(list_sum(list_transform(range(1, 65),
                        lambda i: CASE WHEN coalesce(q.embedding[i] > 0, false) <> coalesce(v.embedding[i] > 0, false) THEN 1 ELSE 0 END)) AS BIGINT) AS distance
            FROM embeddings q, embeddings v
            WHERE q.vec_id % 50 = 0 AND q.embedding IS NOT NULL AND v.embedding IS NOT NULL),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM pairs)
        SELECT query_id, neighbor_id, distance, rank FROM ranked WHERE rank <= 10
    """,
    "op8_line_dedup": """
        WITH every AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS j FROM documents),
        lines AS (
            SELECT doc_id, j, x, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS i,
                   length(regexp_extract_all(x, '[\\x{0e00}-\\x{0eff}\\x{1000}-\\x{109f}\\x{1780}-\\x{17ff}\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]|[^ \\x{0e00}-\\x{0eff}\\x{1000}-\\x{109f}\\x{1780}-\\x{17ff}\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]+')) AS w
            FROM every WHERE trim(x) <> ''),
        ahead AS (
            SELECT doc_id, i,
                   [x, lead(x, 1) OVER d, lead(x, 2) OVER d, lead(x, 3) OVER d, lead(x, 4) OVER d] AS xs,
                   [w, lead(w, 1) OVER d, lead(w, 2) OVER d, lead(w, 3) OVER d, lead(w, 4) OVER d] AS ws
            FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
        runs AS (
            SELECT doc_id, i, k, xs[1:k] AS run FROM ahead, (SELECT unnest(range(1, 6)) AS k)
            WHERE xs[k] IS NOT NULL AND list_sum(ws[1:k]) >= 5),
        placed AS (SELECT doc_id, i, k, min((doc_id, i)) OVER (PARTITION BY k, run) AS first FROM runs),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS i FROM placed WHERE first < (doc_id, i)),
        marked AS (
            SELECT e.doc_id, e.j, e.x, l.i, g.i AS gone_i
            FROM every e LEFT JOIN lines l ON e.doc_id = l.doc_id AND e.j = l.j
            LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i)
        SELECT doc_id, count(i) AS n_lines, count(gone_i) AS n_removed,
               sha256(coalesce(string_agg(x, chr(10) ORDER BY j) FILTER (WHERE gone_i IS NULL), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op11_source_audit": """
        WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        every AS (
            SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
            FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM every GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
        langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
        held AS (SELECT e.lang, e.source, e.term, count(*) AS n FROM every e JOIN kept k ON e.lang = k.lang AND e.term = k.term GROUP BY ALL),
        groups AS (
            SELECT g.lang, g.source, coalesce(l.v, 0) AS v, l.total AS lang_total, coalesce(sum(h.n), 0) AS total
            FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN langs l ON g.lang = l.lang LEFT JOIN held h ON g.lang = h.lang AND g.source = h.source
            GROUP BY ALL),
        shares AS (
            SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n,
                   1 + CAST(1000000000 AS HUGEINT) * (coalesce(h.n, 0) + 5) // CAST(g.total + 5 * g.v AS HUGEINT) AS p,
                   1 + CAST(1000000000 AS HUGEINT) * (k.n + 5) // CAST(g.lang_total + 5 * g.v AS HUGEINT) AS q
            FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
        far AS (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
            UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
        ranked AS (
            SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
                   CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
}
