"""Queries over tokens and words: token counts, spelling variants, periodic runs."""

from __future__ import annotations

import string

import public_tokenizers

from epochwise.llm import periodic, spelling, token_counts
from epochwise.llm.registry import query
from epochwise.session import scratch_path


#: The 256 remainders of CRC-32 by their rule, as the one-row list ``tab.tb``.
CRC_TABLE = """steps(i, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS tb FROM steps WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of an SQL string; needs ``tab`` in the FROM clause."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT"
    return f"""xor(4294967295, list_reduce(
      list_transform(range(octet_length(encode({text}))), lambda k: {byte}),
      lambda c, b: xor(c >> 8, tb[(xor(c, b) & 255) + 1]), 4294967295::BIGINT))"""


OP12_SQL = rf"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT doc_id, r, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(
          translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
          '[a-zÀ-ÿ]+')) AS r
        FROM documents)
  WHERE length(r) >= 6 GROUP BY doc_id, r
), marked AS (
  SELECT r, c, {crc_sql("concat(doc_id, ':', r)")} AS h FROM runs, tab
), words AS (
  SELECT word, sum(c)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, (h % length(r))::BIGINT) || substr(r, (h % length(r))::BIGINT + 2)
                    ELSE r END AS word, c FROM marked)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
), cuts AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS near FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT c.word, w.word FROM cuts c JOIN words w ON c.rest = w.word
  UNION
  SELECT w.word, c.word FROM cuts c JOIN words w ON c.rest = w.word
), ranked AS (
  SELECT p.word, p.near, w.n, count(*) OVER (PARTITION BY p.word) AS n_near,
         row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.near) AS place
  FROM pairs p JOIN words w ON w.word = p.near
), forms AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near,
         CASE WHEN r.n >= 5 * w.n THEN r.near END AS form, CASE WHEN r.n >= 5 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
), chain(word, last) AS (
  SELECT word, word FROM forms
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.last WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.last AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word JOIN forms e ON e.word = c.last AND e.form IS NULL
"""

OP13_SQL = rf"""
WITH RECURSIVE {CRC_TABLE}, split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), written AS MATERIALIZED (
  SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM split
), hashed AS (
  SELECT doc_id, len(w) AS n, {crc_sql("doc_id::VARCHAR")} AS h FROM split, tab
), placed AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a, (h // 10) % 8 AS e FROM hashed
), moved AS (
  SELECT doc_id, a, 1 + (n - a) // (3 + e) AS p, unnest(range(n)) AS i FROM placed
), tokens AS MATERIALIZED (
  SELECT m.doc_id, m.i, t.w
  FROM moved m JOIN written t ON t.doc_id = m.doc_id AND t.i = CASE WHEN m.i >= a THEN a + (m.i - a) % p ELSE m.i END
), periods AS (
  SELECT doc_id, n, unnest(range(1, n // 4 + 1)) AS q FROM placed
), anchors AS (
  SELECT doc_id, q, unnest(range(0, n - 3 * q, q)) AS x FROM periods
), pair AS MATERIALIZED (
  -- a run of four periods has its word at four multiples of the period in a row
  SELECT t.doc_id, t.q, t.x, a.w FROM anchors t
  JOIN tokens a ON a.doc_id = t.doc_id AND a.i = t.x
  JOIN tokens b ON b.doc_id = t.doc_id AND b.i = t.x + t.q
  WHERE (a.w = b.w) IS TRUE
), triple AS MATERIALIZED (
  SELECT p.* FROM pair p JOIN tokens c ON c.doc_id = p.doc_id AND c.i = p.x + 2 * p.q WHERE (c.w = p.w) IS TRUE
), possible AS MATERIALIZED (
  SELECT DISTINCT p.doc_id, p.q FROM triple p JOIN tokens d ON d.doc_id = p.doc_id AND d.i = p.x + 3 * p.q WHERE (d.w = p.w) IS TRUE
), shifted AS MATERIALIZED (
  SELECT p.doc_id, p.q, a.i, a.w FROM possible p JOIN tokens a ON a.doc_id = p.doc_id
), equal AS (
  SELECT s.doc_id, s.q, s.i, s.i - row_number() OVER (PARTITION BY s.doc_id, s.q ORDER BY s.i) AS island
  FROM shifted s JOIN tokens b ON b.doc_id = s.doc_id AND b.i = s.i + s.q WHERE (b.w = s.w) IS TRUE
), stretches AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS size FROM equal GROUP BY doc_id, q, island
), runs AS MATERIALIZED (
  SELECT doc_id, s, size, min(q) AS q FROM stretches WHERE size >= greatest(6, 4 * q) GROUP BY doc_id, s, size
), per_doc AS (
  SELECT doc_id, count(*) AS n_runs,
         string_agg(s || ',' || size || ',' || q || chr(10), '' ORDER BY s, q) AS listed
  FROM runs GROUP BY doc_id
), best AS (
  SELECT * FROM runs
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size::DOUBLE / q DESC, s, q) = 1
), kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS words FROM tokens t
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = t.doc_id AND t.i >= r.s + r.q AND t.i < r.s + r.size)
  GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.size AS length, b.q AS period,
       1000 * b.size // b.q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
       sha256(coalesce(words, '')) AS collapsed_sha256
FROM documents d LEFT JOIN per_doc USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op11_token_counts")
def op11_token_counts(spark, table):
    """Counts of all documents, from a cache that is empty at first."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_counts.count_tokens(table("documents"), "doc_id", "text", scratch_path(spark, "token-cache"), path)


@query("op12_spelling", OP12_SQL)
def op12_spelling(spark, table):
    return spelling.variants(spelling.count_words(table("documents"), "doc_id", "text"))


@query("op13_periodic_runs", OP13_SQL)
def op13_periodic_runs(spark, table):
    return periodic.periodic_runs(table("documents"), "doc_id", "text", plant=True)
