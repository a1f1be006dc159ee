"""op5 to op10: queries, and the SQL of op6 and op8.

SQL can't express the others: op5 and op10 are tested against plain readings, op7 against a
plain computation of its risk and by its accuracy on labels that it has not seen, op9 against
all paths and by the roles that it recovers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, html_text, quality, repeats, secrets, warc
from ._common import table


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), stretches AS (
  SELECT row_id, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM (SELECT row_id, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)
), again AS (
  SELECT row_id, i FROM stretches QUALIFY count(*) OVER (PARTITION BY m) > 1
), opened AS (
  SELECT row_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY row_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS opens FROM again
), numbered AS (
  SELECT row_id, i, sum(opens) OVER (PARTITION BY row_id ORDER BY i) AS run FROM opened
), runs AS (
  SELECT row_id, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY row_id, run
), kept AS (
  SELECT row_id, a, b, coalesce(lag(b) OVER (PARTITION BY row_id ORDER BY a), 0) AS since FROM runs
), cut AS (
  SELECT row_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS k
  FROM kept JOIN d USING (row_id) GROUP BY row_id
)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE k || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (row_id)
"""

QUERIES = {
    "op5_html_extraction": op5_html_extraction, "op6_suffix_dedup": op6_suffix_dedup, "op7_quality": op7_quality, "op8_warc": op8_warc, "op9_chat_formatting": op9_chat_formatting, "op10_secret_scan": op10_secret_scan,
}
ORACLES = {"op6_suffix_dedup": OP6_SQL, "op8_warc": OP8_SQL}
