"""Query op12: the words of each source against those of the others and of its language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .divergence import audit


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = {
    "op12_source_audit": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), u AS (SELECT r, lang, source, unnest(w) AS term FROM d
), kept AS (SELECT lang, term FROM (SELECT DISTINCT r, lang, term FROM u) GROUP BY lang, term HAVING count(*) >= 10
), g AS (SELECT DISTINCT lang, source FROM d
), v AS (SELECT g.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN kept k ON k.lang = g.lang GROUP BY g.lang
), c AS (SELECT u.lang, u.source, u.term, count(*) AS c FROM u JOIN kept k ON k.lang = u.lang AND k.term = u.term GROUP BY ALL
), n AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0)::HUGEINT AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL
), p AS (
  SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (n.n + 2 * v.v) AS p
  FROM n JOIN v ON v.lang = n.lang JOIN kept k ON k.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term
), q AS (
  SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (sum(c.c) + 2)) // (any_value(m.n) + 2 * any_value(v.v)) AS q
  FROM kept k JOIN c ON c.lang = k.lang AND c.term = k.term JOIN v ON v.lang = k.lang JOIN (SELECT lang, sum(n) AS n FROM n GROUP BY lang) m ON m.lang = k.lang GROUP BY k.lang, k.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL
), both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.c > 0 AND p.p > q.q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
WHERE part = 'pair' OR rank <= 10"""
}
QUERIES = {"op12_source_audit": op12_source_audit}
