"""Queries over vectors, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochwise.llm import chat, language, routed_ann
from epochwise.llm.registry import query


@query("op7_nearest")
def op7_nearest(spark, table):
    return routed_ann.search(table("embeddings"), F.col("id") % 100 == 0)


@query("op9_language")
def op9_language(spark, table):
    """All pages, with markup and host, and all documents, whose source stands for the host."""
    docs = table("documents")
    langs, logs = language.model(docs)
    pages = language.page_records(table("pages")).withColumn("doc_id", F.lit(None).cast("bigint"))
    texts = docs.select("doc_id", "text", F.col("source").alias("host")).withColumn("markup", F.lit(None).cast("string"))
    records = texts.withColumn("page_id", F.lit(None).cast("bigint")).unionByName(pages)
    return language.fuse(records, langs, logs)


OP10_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), prefixes AS (
  SELECT conv_id, pos, md5(string_agg(role || chr(31) || text || chr(30), '') OVER w) AS h,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
), whole AS (
  SELECT h, n, min(conv_id) AS conv_id, count(*) AS copies FROM prefixes WHERE pos = n GROUP BY h, n
), kept AS (
  SELECT * FROM whole WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.h = whole.h AND p.pos = whole.n AND p.pos < p.n)
)
SELECT k.conv_id, k.n AS n_turns, k.copies,
       string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |')
                  || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM kept k JOIN turns t ON t.conv_id = k.conv_id
GROUP BY k.conv_id, k.n, k.copies
"""


@query("op10_chat", OP10_SQL)
def op10_chat(spark, table):
    return chat.collapse(table("conversations"))
