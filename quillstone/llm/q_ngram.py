"""Query op9: near-duplicate components of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .ngram_join import similar_components


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))


SQL = {
    "op9_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM w
), u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s WHERE len(s) > 0
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2
), link AS (SELECT a, b FROM common WHERE 100 * c >= 90 * (na + nb - c)
), e AS (SELECT a AS x, b AS y FROM link UNION ALL SELECT b, a FROM link
), reach AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id FROM s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = s.doc_id"""
}
QUERIES = {"op9_ngram_join": op9_ngram_join}
