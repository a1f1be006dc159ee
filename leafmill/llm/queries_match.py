"""op1 and op4: queries, and their SQL. That of op1 compares all texts that share a shingle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ._common import table
from .decontamination import contamination, digest
from .ngram_join import similar_classes


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


OP4_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item_starts AS (
  SELECT item_id, w, unnest(range(1, greatest(len(w) - 13 + 1, 1) + 1)) AS i FROM item_words WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + 12], ' ') AS phrase FROM item_starts
), lengths AS (
  SELECT DISTINCT n FROM windows
), doc_starts AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, lengths WHERE len(w) >= n
), hits AS (
  SELECT s.doc_id, s.i, s.n, t.item_id
  FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM doc_starts) s
  JOIN windows t ON s.phrase = t.phrase AND s.n = t.n
), covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM doc_words d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id
"""

OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), texts AS (
  SELECT array_to_string(w, ' ') AS plain, any_value(w) AS w, min(doc_id) AS text_id, count(*) AS n_copies FROM d GROUP BY 1
), shingles AS (
  SELECT DISTINCT text_id, hash(array_to_string(w[i : i + 4], ' ')) AS s
  FROM (SELECT text_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM texts WHERE len(w) > 0)
), sizes AS (
  SELECT text_id, count(*) AS n FROM shingles GROUP BY 1
), links AS (
  SELECT p.a, p.b FROM (SELECT x.text_id AS a, y.text_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.text_id <> y.text_id GROUP BY 1, 2) p
  JOIN sizes m ON m.text_id = p.a JOIN sizes n ON n.text_id = p.b WHERE 9 * p.c >= 4 * (m.n + n.n)
), reached(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), classes AS (
  SELECT a, least(min(b), a) AS class_id FROM reached GROUP BY a
), degrees AS (
  SELECT a, count(*) AS n_links FROM links GROUP BY a
)
SELECT d.doc_id, t.text_id, coalesce(c.class_id, t.text_id) AS class_id, coalesce(g.n_links, 0)::BIGINT AS n_links, t.n_copies
FROM d JOIN texts t ON array_to_string(d.w, ' ') = t.plain LEFT JOIN classes c ON c.a = t.text_id LEFT JOIN degrees g ON g.a = t.text_id
"""

QUERIES = {"op1_ngram_jaccard": op1_ngram_jaccard, "op4_decontamination": op4_decontamination}
ORACLES = {"op1_ngram_jaccard": OP1_SQL, "op4_decontamination": OP4_SQL}
