"""Secrets, quality classifier and byte-level BPE: brute force, held-out accuracy, round trips, odd input."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from epochwise.llm import byte_bpe, byte_cnn, secrets
from epochwise.llm.catalogue import queries
from epochwise.session import scratch_path

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "a", "  two  spaces \n\t x", "é ñ 漢字 🙂", "\x00\x1c\x85 ", "don't we're 12 345", "x" * 70_000, " " * 5000, "a b " * 30_000]


def documents(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# secrets ---------------------------------------------------------------------------------------


def brute_spans(text):
    out = []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for m in assign.finditer(text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 18:
            out.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 16:
            out.append((m.start(), 2, m.end(), "hex"))
    return [(k, a, z) for a, _, z, k in sorted(out)]


def test_spans_like_brute_force():
    rng = random.Random(1)
    bits = ["password", "Token", "API_KEY", "secret", ":", "=", " ", "'", '"', "AKIA", "ABCD1234EFGH5678", "deadbeef01", "0123456789abcdef", "é", "\n", "x.y-z=="]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))
        assert secrets.find(text, secrets.BASE_RULES) == brute_spans(text)


def test_short_value_takes_up_its_text():
    assert secrets.find("password: token: abcdefghijklmnop", secrets.BASE_RULES) == []


def test_ledger_scans_only_new_pairs(spark):
    path = scratch_path(spark, "ledger")
    key = "token = abcdefghijkl9"
    day1 = documents(spark, [(1, key), (2, key), (3, "clean"), (4, None)])
    first = secrets.scan(day1, "doc_id", "text", path)
    assert first.count() == 3  # the shared text, the clean one, the empty one
    day2 = documents(spark, [(1, key), (5, key), (6, "AKIA" + "A" * 16)])
    assert {r["_path"] for r in secrets.unseen(day2, "doc_id", "text", first, secrets.BASE_VERSION).collect()} == {6}
    second = secrets.scan(day2, "doc_id", "text", path)
    assert second.count() == 4
    found = {r["doc_id"]: r["s"] for r in secrets.by_path(day2, "doc_id", "text", second).select("doc_id", secrets.spans(F.col("findings")).alias("s")).collect()}
    assert found == {1: "assign:0:21", 5: "assign:0:21", 6: "access:0:20"}
    # a new rule version scans what was seen under the old one
    more = (*secrets.BASE_RULES, secrets.Rule("word", r"[a-z]+", 5))
    third = secrets.scan(day1, "doc_id", "text", path, more, "v2")
    assert third.filter("rule_version = 'v2'").count() == 3


def test_secrets_odd_rows(spark):
    rows = [(None, "x"), (None, "x"), (1, None), (1, "a"), (1, "b"), (2, "token=abcdefghijkl"), (2, "token=abcdefghijkl")]
    docs = documents(spark, rows).withColumn("blob", F.lit("clash")).withColumn("findings", F.lit(0))
    ledger = secrets.scan(docs, "doc_id", "text", scratch_path(spark, "ledger"))
    assert secrets.by_path(docs, "doc_id", "text", ledger).count() == len(rows)
    clean = secrets.redacted(docs, "doc_id", "text", ledger)
    assert clean.columns == docs.columns
    assert sorted(str(r["text"]) for r in clean.collect()) == ["None", "[ASSIGN]", "[ASSIGN]", "a", "b", "x", "x"]
    empty = documents(spark, [])
    ledger = secrets.scan(empty, "doc_id", "text", scratch_path(spark, "ledger"))
    assert secrets.by_path(empty, "doc_id", "text", ledger).count() == 0


# quality ---------------------------------------------------------------------------------------


def test_chunks_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 480, 481, 5000):
        raw = bytes(i % 251 for i in range(n))
        x = byte_cnn.chunks(raw)
        step = byte_cnn.CHUNK - byte_cnn.OVERLAP
        flat = np.full((len(x) - 1) * step + byte_cnn.CHUNK, byte_cnn.PAD)
        for i, c in enumerate(x):
            flat[i * step : i * step + byte_cnn.CHUNK] = c
        assert bytes(flat[:n].astype(np.uint8)) == raw
        assert (flat[n:] == byte_cnn.PAD).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = queries()["op2_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = out.filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.9
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    pairs = [(a["score"], b["score"]) for a in rows if a["quality"] for b in rows if not b["quality"]]
    assert np.mean([a > b for a, b in pairs]) >= 0.95


def test_score_does_not_depend_on_company(spark):
    rng = np.random.default_rng(0)
    texts = ["good text " * 40, "BAD!! WORSE!! " * 40] * 20
    model = byte_cnn.fit(texts, np.array([1, 0] * 20), steps=60)
    asked = [*ODD, "a" * 400_000]
    alone = np.array([byte_cnn.score_texts(model, [t])[0] for t in asked])
    order = rng.permutation(len(asked))
    together = byte_cnn.score_texts(model, [asked[i] for i in order])
    assert np.allclose(together, alone[order], atol=1e-5)
    assert ((alone >= 0) & (alone <= 1)).all()


def test_quality_odd_tables(spark):
    docs = documents(spark, [(1, None), (None, "x"), (2, ""), (2, "")]).withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = byte_cnn.classify(docs, none).collect()
    assert len(out) == 4 and all(0 <= r["score"] <= 1 for r in out)
    one = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert byte_cnn.classify(docs, one).count() == 4
    assert byte_cnn.classify(docs.limit(0), one).count() == 0


# byte-level BPE --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.Codec(byte_bpe.serialise(ranks), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_like_the_library_on_odd_texts(codec, tik):
    rng = random.Random(3)
    alphabet = "ab eé漢🙂 \n\t\r  '’sdt0129.,!_-\x1c\x85"
    texts = [*ODD, *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000))]
    for t in texts:
        ids = codec.encode(t)
        assert list(memoryview(ids).cast("I")) == tik.encode_ordinary(t), repr(t[:80])
        assert codec.decode(ids) == t.encode()


def test_bpe_query_like_the_library(spark, tik):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries()["op3_byte_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tik.encode_ordinary(texts[r["doc_id"]])
        packed = np.array(ids, "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bpe_odd_rows(spark):
    docs = documents(spark, [(1, None), (None, ""), (2, "a"), (2, "a")]).withColumn("ids", F.lit("clash"))
    out = byte_bpe.round_trip(docs, "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = out.select("text", F.octet_length("ids").alias("n"), "decoded").collect()
    assert sorted((r["n"], bytes(r["decoded"])) for r in rows) == [(0, b""), (0, b""), (4, b"a"), (4, b"a")]
    assert byte_bpe.round_trip(docs.limit(0), "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
