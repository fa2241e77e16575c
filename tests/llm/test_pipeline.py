"""The pipeline: its stages' contract, planted cases, odd input."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from epochwise.llm import byte_bpe
from epochwise.llm.near_dup import shingles

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    codec = byte_bpe.Codec(byte_bpe.serialise(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))), public_tokenizers.PATTERN)
    kept = []
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] > 50
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {i: set(shingles(t, 5).tolist()) for i, t in texts.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]]
    assert not [1 for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [i for i, t in texts.items() if any(x in t for x in items)]
    out = {r["doc_id"]: r for r in pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert {i: codec.decode(bytes(r["ids"])).decode() for i, r in out.items()} == texts
    whole = {r["doc_id"]: bytes(r["ids"]) for r in pipeline.run(spark, SF).collect()}
    assert whole == {i: bytes(r["ids"]) for i, r in out.items()}


def test_quality_keeps_good_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = {r["doc_id"] for r in pipeline.quality(spark, docs, "/root/testdata/sf0.01").collect()}
    rows = labels.filter("doc_id IS NOT NULL").collect()
    assert np.mean([r["doc_id"] in kept for r in rows if r["quality"] == 1]) >= 0.97
    assert np.mean([r["doc_id"] not in kept for r in rows if r["quality"] == 0]) >= 0.8


def test_odd_rows_pass_every_stage(spark):
    rows = [(None, None), (None, "Some text."), (1, ""), (1, ""), (2, "x " * 50_000), (3, "token = abcdefghijkl9"), (4, "token = abcdefghijkl9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    for c in ("score", "kept", "ids", "blob"):
        docs = docs.withColumn(c, F.lit("clash"))
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "encode" or out.columns == docs.columns
        assert out.count() <= len(rows)
        assert stage(spark, docs.limit(0), SF).count() == 0
    near = pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(str(r["doc_id"]) for r in near) == ["1", "1", "2", "3", "None", "None"]
    clean = {r["doc_id"]: r for r in pipeline.without_secrets(spark, docs, SF).collect()}
    assert (clean[3]["text"], clean[3]["n_chars"]) == ("[ASSIGN]", 8)


def test_rows_with_one_id_are_judged_by_their_texts(spark):
    """A clean text stays whatever other row has its id; of copies one row stays, with a null id too."""
    word = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [
        (5, word(1), "a"),
        (6, word(1), "a"),  # a copy of 5
        (6, word(2), "a"),  # clean, though its id is that of a copy
        (7, word(3), "b"),
        (7, word(3), "a"),  # the same row again
        (None, word(4), "a"),
        (None, word(4) + " end", "a"),  # near copies without ids
        (None, word(5), "a"),
        (None, word(1), "a"),  # a copy of 5 without an id
        (8, None, "a"),
        (8, "", "a"),
        (8, "", "a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    got = sorted(map(tuple, pipeline.near_duplicates(spark, docs, SF).collect()), key=str)
    want = [rows[0], rows[2], rows[4], rows[7], rows[9], rows[10], rows[11]]
    texts = {r[1] for r in got if r[0] is None} - {word(5)}
    assert len(texts) == 1 and texts <= {word(4), word(4) + " end"}
    assert [r for r in got if r[1] not in texts] == sorted(want, key=str)
