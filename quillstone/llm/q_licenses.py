"""Query op4: licences of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .license_texts import TEXTS, notices
from .licenses import COPYRIGHT, PUNCTUATION, SPELLINGS, scan_licenses


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), texts=list(TEXTS.items()))  # the texts that its SQL knows


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _lines(text: str) -> str:
    body = rf"regexp_replace(' ' || array_to_string(list_filter(string_split(lower(coalesce({text}, '')), chr(10)), lambda x: NOT regexp_matches(x, '{COPYRIGHT}')), ' ' || chr(10) || ' ') || ' ', '{PUNCTUATION}', ' ', 'g')"
    for said, same in SPELLINGS:
        body = f"replace({body}, {_quoted(said)}, {_quoted(same)})"
    return f"list_filter(list_transform(string_split({body}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def _values(pairs: list[tuple[str, str]]) -> str:
    return ", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in pairs)


SQL = {
    "op4_license_scan": f"""
WITH whole AS (SELECT sha256(array_to_string({_lines('t')}, ' ')) AS digest, min(k) AS license FROM (VALUES {_values(list(TEXTS.items()))}) v(k, t) GROUP BY 1),
notice AS (SELECT sha256(array_to_string({_lines('t')}, ' ')) AS digest, min(k) AS license FROM (VALUES {_values(notices())}) v(k, t) GROUP BY 1),
d AS (SELECT doc_id, {_lines('text')} AS lines FROM documents),
l AS (SELECT DISTINCT doc_id, sha256(line) AS digest FROM (SELECT doc_id, unnest(lines) AS line FROM d)),
f AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS notices FROM (SELECT DISTINCT doc_id, license FROM l JOIN notice USING (digest)) GROUP BY doc_id)
SELECT d.doc_id, sha256(array_to_string(lines, ' ')) AS digest, w.license, coalesce(f.notices, '') AS notices
FROM d LEFT JOIN whole w ON w.digest = sha256(array_to_string(lines, ' ')) LEFT JOIN f ON f.doc_id = d.doc_id"""
}
QUERIES = {"op4_license_scan": op4_license_scan}
