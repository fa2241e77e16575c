"""Token counts, spelling variants and periodic runs against the libraries and brute force, and odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from epochwise.llm import periodic, spelling, token_counts
from epochwise.llm.catalogue import queries
from epochwise.session import scratch_path

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def documents(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# token counts ----------------------------------------------------------------------------------------


def library(text):
    from tokenizers import Tokenizer

    return len(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids)


def test_token_counts_query(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries()["op11_token_counts"](spark, SF)
    assert dict(rows.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    got = {r["doc_id"]: tuple(r)[1:] for r in rows.collect()}
    want = {}
    for k, t in texts.items():
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want[k] = (len((t or "").encode()), n, n > 2048)
    assert got == want


ODD = [
    None,
    "",
    " \n\t ",
    "a",
    " a  b\t\nc ",
    "Á H̱ ́x  ́",
    "x<|endoftext|>y <|ENDOFTEXT|> <|startoftext|>",
    "don't can'T 12345 a1b2",
    " no break　wide line",
    "Straße İstanbul ΣΣ ퟿\U0001f600\U0001f600",
    "word " * 3000 + "end",
    "z" * 20000,
]


def test_token_counts_of_odd_texts_and_cache(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a"), (3, "a"), (3, "a")]
    docs = documents(spark, rows)
    cache, version = scratch_path(spark, "cache"), token_counts.version(PATH)
    stored = lambda: spark.read.parquet(f"{cache}/version={version}").count()
    out = sorted(((r[0], r[1], r[2]) for r in token_counts.count_tokens(docs, "doc_id", "text", cache, PATH).collect()), key=str)
    assert out == sorted(((k, len((t or "").encode()), library(t)) for k, t in rows), key=str)
    first = stored()
    assert first == len(ODD) - 2  # null, empty and blank texts are one
    keyed = lambda d: token_counts.digested(d, "text", PATH, "doc_id")
    assert token_counts.encode_misses(docs, "text", keyed(docs), cache, PATH) == 0 and stored() == first
    more = documents(spark, [(1, "a\n\n"), (2, "new"), (3, " new ")])
    assert token_counts.encode_misses(more, "text", keyed(more), cache, PATH) == 1 and stored() == first + 1
    # two counts side by side append the same digest twice; rows aren't doubled
    spark.read.parquet(f"{cache}/version={version}").coalesce(1).write.mode("append").parquet(f"{cache}/copy")
    spark.read.parquet(f"{cache}/copy").write.mode("append").parquet(f"{cache}/version={version}")
    again = sorted(((r[0], r[1], r[2]) for r in token_counts.count_tokens(docs, "doc_id", "text", cache, PATH).collect()), key=str)
    assert again == out


def test_token_counts_come_from_the_cache(spark):
    """A planted count is returned as it stands, and another tokenizer doesn't meet it."""
    cache = scratch_path(spark, "cache")
    docs = documents(spark, [(1, "one two"), (2, "three")])
    digest = hashlib.sha256(b"one two").digest()
    spark.createDataFrame([(digest, 99)], token_counts.CACHE).write.parquet(
        f"{cache}/version={token_counts.version(PATH)}"
    )
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, "doc_id", "text", cache, PATH).collect()}
    assert got == {1: 99, 2: library("three")}
    model = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    plain = sentencepiece.SentencePieceProcessor(model_file=model)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, "doc_id", "text", cache, model).collect()}
    assert got == {1: len(plain.encode("one two")), 2: len(plain.encode("three"))}
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert not token_counts.drops_white_space(other) and token_counts.drops_white_space(PATH)
    assert token_counts.encoder(other)("a  b") != token_counts.encoder(other)("a b")


def test_many_misses_are_joined(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "SENT_DIGESTS", 2)
    docs = documents(spark, [(i, f"text {i % 7}") for i in range(50)])
    out = token_counts.count_tokens(docs, "doc_id", "text", scratch_path(spark, "cache"), PATH)
    assert {(r["doc_id"], r["n_tokens"]) for r in out.collect()} == {(i, library(f"text {i % 7}")) for i in range(50)}


def test_token_counts_empty_and_clashing(spark):
    schema = "digest long, body string, n_bytes int, text string, n_tokens int"
    empty = documents(spark, [], schema)
    assert token_counts.count_tokens(empty, "digest", "body", scratch_path(spark, "c"), PATH).collect() == []
    docs = documents(spark, [(5, "two words", 1, "other", 7)], schema)
    got = token_counts.count_tokens(docs, "text", "body", scratch_path(spark, "c"), PATH).collect()
    assert [tuple(r) for r in got] == [("other", 9, 2, False)]


# spelling variants -----------------------------------------------------------------------------------


def are_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_near(words):
    """Each word's near words, and the one that occurs most."""
    near = {w: [v for v in words if are_near(w, v)] for w in words}
    return {w: (len(others), min(others, key=lambda v: (-words[v], v), default=None)) for w, others in near.items()}


def plain_variants(words, ratio=5):
    near, form = plain_near(words), {}
    for w, (_, best) in near.items():
        if best is not None and words[best] >= ratio * words[w]:
            form[w] = best
    out = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, words[w], near[w][0], words.get(form.get(w))))
    return out


def random_words(rng, count, letters="abß", longest=9):
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))): 0 for _ in range(count)}
    return {w: 5 * 5 ** rng.randint(0, 5) + rng.randint(0, 3) for w in words}


def test_search_finds_each_near_word_once():
    rng = random.Random(5)
    for _ in range(40):
        words = sorted(random_words(rng, rng.randint(1, 120)))
        v = spelling.Vocabulary(words)
        every = np.arange(len(words))
        found = []
        for mirrored, exact in ((False, v.size // 2), (True, v.size - v.size // 2)):
            who, met = v.search(every, exact, mirrored)
            pairs = list(zip(who.tolist(), met.tolist()))
            assert len(pairs) == len(set(pairs))
            found += [
                (a, b) for a, b in pairs if not mirrored or not words[b].startswith(words[a][: len(words[a]) // 2])
            ]
        assert len(found) == len(set(found))
        assert set(found) == {(a, b) for a in every for b in every if are_near(words[a], words[b])}


@pytest.mark.parametrize("block", [3, 8192])
def test_variants(spark, block):
    """Also where halves are cut into parts and words are spread over many tasks."""
    words = random_words(random.Random(11), 400, "abcd", 7)
    frame = documents(spark, list(words.items()), "word string, n long")
    met = {(r["word"], r["n_near"], r["best"]) for r in spelling.nearest_forms(frame, block, 200).collect()}
    assert met == {(w, *found) for w, found in plain_near(words).items()}
    if block > 3:
        assert {tuple(r) for r in spelling.variants(frame).collect()} == plain_variants(words)


def test_variants_of_long_and_few_words(spark):
    long = "ab" * 3000
    words = {long: 5, long[:2500] + "x" + long[2501:]: 30, long + "a": 200, "alone": 7, "a" * 40: 9, "a" * 41: 50}
    frame = documents(spark, list(words.items()), "word string, n long")
    assert {tuple(r) for r in spelling.variants(frame).collect()} == plain_variants(words)
    assert spelling.variants(documents(spark, [], "word string, n long")).collect() == []


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_spelling_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    words = plain_words(rows)
    # by the strings without one letter, as comparing all pairs would take too long
    cuts = {}
    for w in words:
        for i in range(len(w)):
            cuts.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    near = {w: set() for w in words}
    for rest, group in cuts.items():
        group = group | ({rest} & set(words))
        for w in group:
            near[w] |= {v for v in group if are_near(w, v)}
    got = {r["word"]: r for r in queries()["op12_spelling"](spark, SF).collect()}
    assert set(got) == set(words)
    for w, r in got.items():
        assert (r["n"], r["n_near"]) == (words[w], len(near[w]))
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 5 * words[w] else None
        assert (r["form"], r["form_n"]) == (form, words.get(form))
        assert r["root"] == (w if form is None else got[form]["root"])


def test_words_of_odd_texts(spark):
    rows = [(None, "Ordered"), (1, None), (2, ""), (3, "ÀÉÎõüÿ ÀÉÎõüÿ×÷ß Āabcdefā x_y"), (4, "abcdefg " * 2000)]
    rows += [(k, "Repeated_Repeated é") for k in range(40)] + [(7, "again again again again again again")] * 3
    docs = documents(spark, [(a, b, "clash", 1) for a, b in rows], "doc_id long, text string, word string, n int")
    got = {r["word"]: r["n"] for r in spelling.count_words(docs, "doc_id", "text", occurrences=1).collect()}
    want = Counter()
    for k, t in rows:
        want.update({w: n for w, n in plain_words([(k, t)] * 5).items()})
    assert got == {w: n // 5 for w, n in want.items()}
    assert spelling.count_words(docs.limit(0), "doc_id", "text").collect() == []


# periodic runs ---------------------------------------------------------------------------------------


def plain_runs(w):
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        x = 0
        while x < n - q:
            if w[x] != w[x + q]:
                x += 1
                continue
            y = x
            while y < n - q and w[y] == w[y + q]:
                y += 1
            size = y - x + q
            smaller = (all(w[i] == w[i + p] for i in range(x, x + size - p)) for p in range(1, q))
            if size >= max(6, 4 * q) and not any(smaller):
                out.add((x, size, q))
            x = y
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, plant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if plant and n and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + size for s, size, q in found)]
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    one = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *one, sha(listed), sha(" ".join(kept)))


def odd_words(rng):
    kind = rng.random()
    if kind < 0.3:
        return [rng.choice("ab") for _ in range(rng.randint(0, 60))]
    if kind < 0.7:
        w = []
        while len(w) < rng.randint(10, 200):
            w += ([rng.choice("abc") for _ in range(rng.randint(1, 20))] * rng.randint(1, 9))[: rng.randint(1, 120)]
        return w
    u, v = ["a"], ["a", "b"]
    for _ in range(rng.randint(0, 8)):
        u, v = v, v + u
    return (v * rng.randint(1, 5))[:400]


def test_runs_of_odd_words():
    rng = random.Random(3)
    for _ in range(150):
        docs = [odd_words(rng) for _ in range(rng.randint(1, 6))]
        texts = [" ".join(w) for w in docs]
        got = periodic.describe(list(range(len(docs))), [t.encode() for t in texts], True)
        assert [(i, *g) for i, g in enumerate(got)] == [plain_row(i, t) for i, t in enumerate(texts)]


def test_synchronising_set_is_consistent_and_dense():
    rng = random.Random(9)
    words = np.array([rng.randint(0, 2) for _ in range(600)] + [7, 8, 9] * 60 + [rng.randint(0, 2) for _ in range(300)])
    window, t = periodic._mix(words.astype(np.uint64)), 1
    while t <= 32:
        n = len(words) - t + 1
        aside = np.array([any((words[i : i + t - p] == words[i + p : i + t]).all() for p in range(1, t // 4 + 1)) for i in range(n)])
        s = set(periodic.synchronising(window[:n], aside, t).tolist())
        contexts = {}
        for i in range(len(words) - 2 * t + 1):
            contexts.setdefault(tuple(words[i : i + 2 * t]), set()).add(i in s)
        assert all(len(x) == 1 for x in contexts.values())
        for i in range(len(words) - 3 * t + 2):
            if not s & set(range(i, i + t)):
                assert aside[i : i + 2 * t].all()
        window, t = periodic._pairs(window, np.roll(window, -t)), 2 * t


def test_periodic_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r) for r in queries()["op13_periodic_runs"](spark, SF).collect()}
    assert set(got) == set(texts)
    for k, t in texts.items():
        if len(t or "") < 6000:
            assert got[k] == plain_row(k, t)


def test_periodic_odd_input(spark):
    line = " ".join(f"w{i}" for i in range(700))
    rows = [
        (None, "a " * 10),
        (1, None),
        (2, ""),
        (3, " \t\n\x0b\x0c\r "),
        (4, "x y z " * 4),
        (5, "a a a a a"),
        (6, "a a a a a a"),
        (7, " ".join([line] * 5)),
        (8, "a b " * 3 + "a b " + "c " * 6 + "a b " * 4),
        (9, "é " * 9 + "é " * 9),
    ]
    rows += [rows[4], (7, "other")]
    docs = documents(spark, [(a, b, "clash", 9) for a, b in rows], "doc_id long, text string, _text string, start int")
    for plant in (False, True):
        got = sorted(map(tuple, periodic.periodic_runs(docs, "doc_id", "text", plant).collect()), key=str)
        assert got == sorted((plain_row(a, b, plant) for a, b in rows), key=str)
    assert periodic.periodic_runs(docs.limit(0), "doc_id", "text").collect() == []


def test_groups_of_texts_are_cut_by_size(spark, monkeypatch):
    texts = [("ab " * k + "c " * (k % 9)) for k in range(40)]
    want = periodic.describe(list(range(40)), [t.encode() for t in texts], True)
    docs = documents(spark, list(enumerate(texts))).coalesce(1)
    got = sorted(map(tuple, periodic.periodic_runs(docs, "doc_id", "text", True).collect()))
    assert got == [(i, *w) for i, w in enumerate(want)]
    parts = [x for i in range(0, 40, 7) for x in periodic.describe(list(range(i, min(40, i + 7))), [t.encode() for t in texts[i : i + 7]], True)]
    assert parts == want
