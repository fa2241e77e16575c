"""Queries over the texts of documents: secrets, quality, byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from epochwise.llm import byte_bpe, byte_cnn, secrets
from epochwise.llm.registry import query
from epochwise.session import scratch_path

# each match is replaced by a mark, its text and a mark; cutting at marks gives the positions
_SPANS_OF_KIND = r"""
  SELECT doc_id, '{kind}' AS kind, {rank} AS rank, start, start + len AS stop, piece
  FROM (
    SELECT doc_id, i, piece, len,
           sum(len) OVER (PARTITION BY doc_id ORDER BY i) - len AS start
    FROM (
      SELECT doc_id, i, pieces[i] AS piece, length(pieces[i]) AS len
      FROM (SELECT doc_id, pieces, unnest(range(1, len(pieces) + 1)) AS i
            FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '{pattern}',
                         chr(1) || '\0' || chr(1), '{flags}'), chr(1)) AS pieces
                  FROM documents))
    )
  )
  WHERE i % 2 = 0 AND {enough}
"""
# fixed values: the patterns and lengths of the base kinds
_ASSIGN = r"""(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""
_VALUE = r"""^(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$"""
OP1_SQL = f"""
WITH found AS (
  {_SPANS_OF_KIND.format(kind="assign", rank=0, pattern=_ASSIGN, flags="gi",
                         enough=f"length(regexp_extract(piece, '{_VALUE}', 1, 'i')) >= 12")}
  UNION ALL
  {_SPANS_OF_KIND.format(kind="access", rank=1, pattern="AKIA[A-Z0-9]+", flags="g", enough="len >= 18")}
  UNION ALL
  {_SPANS_OF_KIND.format(kind="hex", rank=2, pattern="[0-9a-f]+", flags="g", enough="len >= 16")}
), per_doc AS (
  SELECT doc_id,
         count(*) FILTER (WHERE kind = 'assign') AS n_assign,
         count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) AS spans
  FROM found GROUP BY doc_id
)
SELECT d.doc_id,
       coalesce(n_assign, 0) AS n_assign,
       coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per_doc p ON p.doc_id = d.doc_id
"""


@query("op1_secret_scan", OP1_SQL)
def op1_secret_scan(spark, table):
    """Every document is a path with one version; the ledger starts empty."""
    docs = table("documents").select("doc_id", "text")
    ledger = secrets.scan(docs, "doc_id", "text", scratch_path(spark, "secret-ledger"))
    found = secrets.by_path(docs, "doc_id", "text", ledger)
    of = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("bigint")
    spans = secrets.spans(F.col("findings"))
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(spans.cast("binary"), 256).alias("base_sha256"),
        spans.alias("spans"),
    )


@query("op2_quality")
def op2_quality(spark, table):
    docs = table("documents").select("doc_id", "text")
    out = byte_cnn.classify(docs, table("labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


@query("op3_byte_bpe")
def op3_byte_bpe(spark, table):
    docs = table("documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = byte_bpe.round_trip(docs, "text", path, public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
