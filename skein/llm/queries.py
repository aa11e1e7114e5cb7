"""The queries of this subpackage with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.bpe import bpe_round_trip
from skein.llm.decontamination import contaminated
from skein.llm.exact_dedup import exact_groups
from skein.llm.html_extract import extract_pages
from skein.llm.html_extract import train as train_pages
from skein.llm.near_dedup import near_groups
from skein.llm.suffix_dedup import remove_repeats
from skein.llm.token_counts import token_counts
from skein.llm.token_store import store_round_trip
from skein.llm.toxicity import score, train
from skein.llm.warc import archive_round_trip

TOKEN_LIMIT = 512
END_ID = 2


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = archive_round_trip(read(spark, sf_dir, "pages"))
    return captures.select(
        F.col("id").alias("page_id"), F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers").alias("refers_to"), F.col("time").alias("captured_at"), F.col("key").alias("url_key"), "position",
    )


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), TOKEN_LIMIT)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return extract_pages(pages, train_pages(pages))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_warc": op4_warc,
    "op5_near_dedup": op5_near_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_token_counts": op7_token_counts,
    "op8_html_extraction": op8_html_extraction,
    "op9_decontamination": op9_decontamination,
    "op10_token_store": op10_token_store,
}

ORACLE_SQL = {
    "op2_suffix_dedup": """
        WITH d AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
        ), s AS (
            SELECT doc_id, p, hash(substr(h, 2 * p + 1, 200)) AS x FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d WHERE n >= 100)
        ), f AS (
            SELECT x, min((doc_id, p)) AS first FROM s GROUP BY x
        ), o AS (
            SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true) AS new FROM s JOIN f USING (x) WHERE (doc_id, p) > first
        ), g AS (
            SELECT doc_id, p, count(*) FILTER (WHERE new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM o
        ), r AS (
            SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY doc_id, run
        ), k AS (
            SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM r
        ), c AS (
            SELECT doc_id, any_value(n) AS n, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id
        )
        SELECT doc_id, d.n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)
    """,
    "op3_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
        ), g AS (
            SELECT norm, count(*) AS group_size, max(cp) AS most FROM d GROUP BY norm
        ), k AS (
            SELECT norm, min(doc_id) AS keep_id FROM d JOIN g USING (norm) WHERE cp = most GROUP BY norm
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm) JOIN k USING (norm)
    """,
    "op4_warc": r"""
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x, regexp_extract(coalesce(url, ''), '^\w+://([^/?#]*)([^?#]*)([^#]*)', ['host', 'path', 'tail']) AS u FROM pages
        ), k AS (
            SELECT *, array_to_string(list_reverse(string_split(regexp_replace(lower(u.host), '^www\.', ''), '.')), ',') || ')' || lower(u.path || u.tail) AS url_key FROM p
        ), q AS (
            SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(x, 5 * i + 1, 5))::BIGINT) AS bits, max(page_id) OVER (PARTITION BY x) AS kept FROM k
        )
        SELECT page_id, payload_bytes,
            array_to_string(flatten(list_transform(bits, lambda v: list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> s) & 31)::INT, 1)))), '') AS payload_digest,
            CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < kept THEN kept END AS refers_to, strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured_at, url_key, row_number() OVER (ORDER BY url_key, page_id) - 1 AS position FROM q
    """,
    # What the tables' pages hold: one article of headings and paragraphs, and of character references &quot; and &amp; alone.
    "op8_html_extraction": r"""
        WITH a AS (
            SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS parts FROM pages
        ), b AS (
            SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS parts FROM a
        ), c AS (
            SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b
        )
        SELECT page_id, url, text, length(text) AS n_chars FROM c
    """,
}
