"""Queries that write files and read them back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from epochwise.llm import shuffle_shards, token_files
from epochwise.llm.registry import query
from epochwise.session import scratch_path

VOCABULARY = 49_408
END_ID = 1


@query("op6_token_files")
def op6_token_files(spark, table):
    docs = table("documents")
    path = scratch_path(spark, "tokens")
    token_files.write(
        docs, "doc_id", "text", path, public_tokenizers.path("word_bpe_49k.json"), END_ID, VOCABULARY
    )
    rows = token_files.read(path, docs, "doc_id", VOCABULARY)
    return rows.select(
        F.col("key").alias("doc_id"),
        "start",
        "n_tokens",
        token_files.crc_of_ids(F.col("ids"), VOCABULARY).alias("ids_crc32"),
    )


@query("op5_sharding")
def op5_sharding(spark, table):
    """24 shards whose row counts are at most one apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table("documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    out = shuffle_shards.assign(docs, 24)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
