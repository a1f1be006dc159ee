"""op2 and op3: queries and oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ._common import table
from .exact_dedup import exact_dedup
from .mixing import mix


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS pos
  FROM documents
), per AS (
  SELECT source, count(*) AS n, sum(size)::BIGINT AS source_size FROM rows GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM per
), weighed AS (
  SELECT *, (rank % 3 + 1)::INTEGER AS weight, sum(source_size) OVER ()::BIGINT AS total, source_size * 3 AS cap FROM ranked
), filled AS (
  SELECT *, cap::DOUBLE / weight AS full_at FROM weighed
), levels AS (
  SELECT *, row_number() OVER w AS nth,
         (total - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM filled WINDOW w AS (ORDER BY full_at, rank)
), chosen AS (
  SELECT arg_min(level, nth) AS level FROM levels WHERE level <= full_at
), targets AS (
  SELECT l.source, l.rank, l.source_size, l.total,
         CASE WHEN c.level IS NULL THEN l.cap::DOUBLE ELSE least(l.cap::DOUBLE, c.level * l.weight) END AS target
  FROM levels l, chosen c
), placed AS (
  SELECT r.doc_id, r.size, r.pos, t.rank, t.source_size, t.target, t.total,
         sum(r.size) OVER (PARTITION BY t.rank ORDER BY r.pos, r.doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
), queue AS (
  SELECT doc_id, size, pos, rank, p.pass, total, (source_size * p.pass + upto)::DOUBLE / target AS time
  FROM placed, (VALUES (0), (1), (2)) AS p(pass)
  WHERE size > 0 AND target > 0 AND source_size * p.pass + upto - size < target
), cut AS (
  SELECT doc_id, size, total, sum(size) OVER (ORDER BY time, rank, pass, pos, doc_id ROWS UNBOUNDED PRECEDING) AS words FROM queue
), taken AS (
  SELECT doc_id, sum(size)::BIGINT AS taken FROM cut WHERE words <= total GROUP BY doc_id
)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM placed p LEFT JOIN taken t ON p.doc_id = t.doc_id
"""

OP3_SQL = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), best AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id ASC) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM rows
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM best
"""

QUERIES = {"op2_mixing": op2_mixing, "op3_exact_dedup": op3_exact_dedup}
ORACLES = {"op2_mixing": OP2_SQL, "op3_exact_dedup": OP3_SQL}
