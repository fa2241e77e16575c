"""Shards and token files: exact laws, uniformity, round trips against the library, odd input."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from epochwise.llm import shuffle_shards, token_files
from epochwise.llm.catalogue import queries
from epochwise.session import scratch_path

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def documents(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# sharding --------------------------------------------------------------------------------------


def test_sharding_law(spark):
    rows = queries()["op5_sharding"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)


def test_matrix_margins_and_law(spark):
    """Exact margins, and means and variances of the hypergeometric law over many seeds."""
    sizes, shards = [700, 1, 0, 299, 53], 4
    counts = spark.createDataFrame([(p, n) for p, n in enumerate(sizes) if n], "part int, n long")
    drawn = []
    for seed in range(60):
        m = {r["part"]: np.diff([0, *r["ends"]]) for r in shuffle_shards.communication_matrix(counts, shards, seed).collect()}
        assert [int(m[p].sum()) for p in m] == [sizes[p] for p in m]
        total = sum(m.values())
        assert sorted(total, reverse=True) == list(total) and total.max() - total.min() <= 1 and total.sum() == sum(sizes)
        assert min(x.min() for x in m.values()) >= 0
        drawn.append(m[3])
    drawn = np.array(drawn)
    big, take, white = sum(sizes), 299, total[0]
    mean = take * white / big
    sd = (mean * (1 - white / big) * (big - take) / (big - 1)) ** 0.5
    assert abs(drawn.mean() - take / shards) < 1e-9
    assert np.all(np.abs(drawn.mean(0) - mean) < 4.5 * sd / len(drawn) ** 0.5 + 0.5)
    assert 0.5 * sd < drawn.std(0).mean() < 1.5 * sd


def test_shuffle_is_uniform(spark):
    """Any row is as likely in any shard; neighbours part."""
    df = spark.range(0, 4800, 1, 6)
    seen = np.zeros(4)
    for seed in range(5):
        rows = shuffle_shards.assign(df, 4, seed=100 * seed).collect()
        first = [r["shard"] for r in rows if r["id"] < 800]
        seen += np.bincount(first, minlength=4)
    assert np.all(np.abs(seen / seen.sum() - 0.25) < 0.04)


def test_sharding_odd_rows(spark):
    docs = documents(spark, [(None, None), (1, ""), (1, ""), (2, "x")]).withColumn("shard", F.lit(9)).withColumn("_bucket", F.lit("clash")).withColumn("row", F.lit(1))
    out = shuffle_shards.assign(docs, 3)
    assert sorted(out.columns) == sorted(["doc_id", "text", "_bucket", "row", "shard", "slot"])
    assert sorted(Counter(r["shard"] for r in out.collect()).values()) == [1, 1, 2]
    assert shuffle_shards.assign(docs.limit(0), 3).count() == 0
    same = spark.range(3000).select(F.lit(1).alias("doc_id"), F.lit("t").alias("text"))
    assert sorted(Counter(r["shard"] for r in shuffle_shards.assign(same, 7).collect()).values())[0] == 428
    path = scratch_path(spark, "shards")
    shuffle_shards.write_shards(out, path)
    assert spark.read.parquet(path).count() == 4


# token files -----------------------------------------------------------------------------------


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_words_like_whole_texts():
    rng = random.Random(4)
    alphabet = "ab eé́漢🙂 \n\t\r  '’sdtΣς0129.,!_-\x1c\x85İ<|endoftext|>"
    texts = ["", " ", "x" * 3000, *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000))]
    words = ["Straße", "ÉTÉ!?", "İx", "ıI", "ǅ", "ÿ.,", "don't", "a'b", "×3", "e\u0301", "ﬁ", "A`b", "x-y", "Ĳ", "ŉ", "ſ", "ABC.", "end..."]
    texts += words + [" ".join(rng.choice(words) for _ in range(6)) for _ in range(500)]
    encoder = token_files.WordEncoder(PATH, "<u2")
    assert encoder.plain
    for t, ids in zip(texts, library(texts)):
        assert np.frombuffer(encoder.encode(t), "<u2").tolist() == ids, repr(t[:80])


def test_special_tokens_like_the_plain_call():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    encoder = token_files.WordEncoder(PATH, "<u2")
    rng = random.Random(6)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "hello", "World", "endoftext", " ", "\n", "\t", ".", "é", "'s", "9"]
    texts = ["hello <|endoftext|> world", "a<|endoftext|>b", "<|startoftext|>", "<|endoftext|><|endoftext|>\n"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for t in texts:
        ids = plain.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(t), "<u2").tolist() == ids, repr(t)
    assert np.frombuffer(encoder.encode(texts[0]), "<u2").tolist() == [3306, 49407, 1002]


def test_query_like_the_library(spark):
    rows = {r["doc_id"]: r for r in queries()["op6_token_files"](spark, SF).collect()}
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    start = 0
    assert len(rows) == len(docs)
    for (i, _), ids in zip(docs, library([t for _, t in docs])):
        ids = [*ids, 1]
        want = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == want
        start += len(ids)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 30_000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        raw = token_files.dump_index(keys, np.zeros(len(keys)), np.arange(len(keys)), np.ones(len(keys)))
        mph, _ = token_files.PerfectHash.load(raw)
        assert sorted(mph.number(keys)) == list(range(len(keys)))  # minimal and perfect
        known, entries = token_files.look_up(raw, keys)
        assert len(known) == len(keys) and (entries["number"] == np.arange(len(keys))).all()
        others = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
        assert len(token_files.look_up(raw, np.setdiff1d(others, keys))[0]) <= 2  # 32-bit fingerprints


def test_token_files_odd_rows(spark):
    rows = [(None, "no key"), (3, None), (3, "b"), (3, "a"), (3, "a"), (1, ""), (2, "x y")]
    docs = documents(spark, rows).withColumn("shard", F.lit("clash")).withColumn("key", F.lit("clash"))
    path = scratch_path(spark, "tokens")
    manifest = token_files.write(docs, "doc_id", "text", path, PATH, 1, 49_408, shards=3)
    assert manifest.agg(F.sum("n_docs")).first()[0] == len(rows)
    asked = documents(spark, [(3, ""), (3, ""), (1, ""), (99, ""), (None, "")])
    got = token_files.read(path, asked, "doc_id", 49_408).collect()
    texts = library(["", "a", "a", "b", "no key"])
    want = Counter((3, bytes(np.array([*ids, 1], "<u2").tobytes())) for ids in texts[:4])
    want[1, np.array([1], "<u2").tobytes()] = 1
    assert Counter((r["key"], bytes(r["ids"])) for r in got) == want
    assert min(r["start"] for r in got) == len(texts[4]) + 1  # the document without a key comes first
    path = scratch_path(spark, "tokens")
    assert token_files.write(docs.limit(0), "doc_id", "text", path, PATH, 1, 49_408).count() == 0
    assert token_files.read(path, asked, "doc_id", 49_408).count() == 0


def test_text_keys_and_wide_ids(spark):
    docs = spark.createDataFrame([("b", "hello"), ("a", "world world")], "k string, t string")
    path = scratch_path(spark, "tokens")
    token_files.write(docs, "k", "t", path, PATH, 1, 100_000, shards=2)
    got = {r["key"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_files.read(path, docs, "k", 100_000).collect()}
    assert got == {k: [*ids, 1] for k, ids in zip("ba", library(["hello", "world world"]))}
