"""Queries over groups of documents: benchmark leaks and near duplicates."""

from __future__ import annotations

import string

from epochwise.llm import decontaminate, near_dup
from epochwise.llm.registry import query


@query("op4_decontaminate")
def op4_decontaminate(spark, table):
    """The documents that hold a benchmark item; no other document has a row."""
    found = decontaminate.matches(table("documents"), table("benchmark"))
    return decontaminate.contaminated(found)


OP8_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
           '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
                                 ELSE [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] END) AS s
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM common
  JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.b FROM reach r JOIN both_ways l ON r.y = l.a
)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(y) AS component_id, d.doc_id = min(y) AS kept
FROM documents d JOIN reach ON x = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
GROUP BY d.doc_id
"""


@query("op8_near_dup", OP8_SQL)
def op8_near_dup(spark, table):
    """Two-word shingles at 80 %."""
    return near_dup.groups(table("documents"), n=2).withColumnRenamed("id", "doc_id")
