"""Nearest neighbours, languages and conversations against brute force, twins and odd input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import compare
from epochwise.llm import chat, language, routed_ann
from epochwise.llm.catalogue import oracle_sql, queries

SF = "/root/testdata/sf0.001"


# nearest neighbours ----------------------------------------------------------------------------


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_scores(spark, sf):
    folder = f"/root/testdata/{sf}"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in table])
    x = np.array([r["embedding"] for r in table], dtype=np.float64)
    rows = queries()["op7_nearest"](spark, folder).collect()
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append(r)
    hit = 0
    asked = [i for i in ids if i % 100 == 0]
    assert set(by) == set(asked)
    for q in asked:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        got = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 11))
        assert [(r["score"], r["vec_id"]) for r in got] == sorted((r["score"], r["vec_id"]) for r in got)
        for r in got:
            assert abs(r["score"] - d[ids == r["vec_id"]][0]) < 1e-12
        hit += len(set(best) & {r["vec_id"] for r in got})
    assert hit / (10 * len(asked)) >= 0.9


def test_partitions_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 5, (16, 12))
    x = np.concatenate([c + rng.normal(0, 1, (100, 12)) for c in centres])
    graph = routed_ann.neighbour_graph(x, 10)
    part = routed_ann.balanced_parts(x, graph, 3)
    sizes = np.bincount(part)
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 1
    assert (part[graph] == part[:, None]).mean() > 0.8
    router = routed_ann.fit(x, 3)
    assert router.probes < 8
    home = router.ranked(x)[:, 0]
    assert np.mean([np.isin(home[graph[i]], router.ranked(x[i : i + 1])[0, : router.probes]).mean() for i in range(0, 1600, 7)]) > 0.9


def nearest(spark, rows, k=10, ids="vec_id long, embedding array<float>"):
    df = spark.createDataFrame(rows, ids)
    return sorted(tuple(r) for r in routed_ann.search(df, F.col("id") % 100 == 0, k).collect())


def test_nearest_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]),
        (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0]), (None, [1.0, 0.0]), (9, []), (100, [1.0, 0.5]), (200, None),
    ]
    half = 0.5
    assert nearest(spark, rows) == [
        (0, 1, 100, half), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (100, 1, 0, half), (100, 2, 1, half), (100, 3, 2, half),
    ]
    assert nearest(spark, rows[:0]) == []
    assert nearest(spark, [(0, [1.0])]) == []


def test_many_equal_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(routed_ann, "BLOCK_ROWS", 300)
    monkeypatch.setattr(routed_ann, "BLOCK_QUERIES", 5)
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(1000)] + [(i, rng.normal(size=3).tolist()) for i in range(1000, 2000)]
    got = nearest(spark, rows)
    assert [t for t in got if t[0] == 0] == [(0, r, r, 0.0) for r in range(1, 11)]
    assert [t[2] for t in got if t[0] == 500] == list(range(10))


# languages -------------------------------------------------------------------------------------


def test_languages_of_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries()["op9_language"](spark, folder).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    docs = [r for r in rows if r["doc_id"] is not None]
    pages = [r for r in rows if r["page_id"] is not None]
    assert len(docs) == len(truth) and len(pages) == spark.read.parquet(f"{folder}/pages.parquet").count()
    assert np.mean([r["lang"] == truth[r["doc_id"]] for r in docs]) >= 0.97
    assert all(0 < r["probability"] <= 1 for r in rows)


def small(spark, rows):
    docs = spark.createDataFrame(
        [(1, "the cat and the dog and the bird", "en"), (2, "der hund und die katze und das", "de"), (3, None, "en"), (4, "x", None)],
        "doc_id long, text string, lang string",
    )
    langs, table = language.model(docs)
    records = spark.createDataFrame(rows, "k long, text string, markup string, host string")
    return langs, {r["k"]: r for r in language.fuse(records, langs, table).collect()}


def test_evidence_is_fused(spark):
    many = [(100 + i, "und die katze und der hund", "de", "a.site.de") for i in range(30)]
    many += [(200 + i, "the dog and the cat", "en", "b.site.com") for i in range(30)]
    langs, out = small(spark, [*many, (1, "", "de", None), (2, None, None, "a.site.de"), (3, None, None, "new.site.de"), (4, None, None, "other.de"), (5, "the", "en", None), (6, None, None, None), (6, None, None, None), (7, "", "xx", "localhost")])
    assert langs == ["de", "en"]
    assert all(out[i]["lang"] == "de" for i in (1, 2, 3, 4)) and out[5]["lang"] == "en"
    assert out[2]["probability"] > out[3]["probability"] - 0.05 and out[3]["probability"] > 0.6
    assert abs(out[6]["probability"] - 0.5) < 0.1 and 0 < out[7]["probability"] <= 1


def test_language_odd_tables(spark):
    langs, out = small(spark, [])
    assert out == {}
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    langs, table = language.model(none)
    assert langs == []
    records = spark.createDataFrame([(1, "a", None, None)], "k long, text string, markup string, host string")
    assert language.fuse(records, langs, table).count() == 0
    _, out = small(spark, [(1, "the " * 200_000, None, None)])
    assert out[1]["lang"] == "en"


def test_page_parts(spark):
    page = '<!DOCTYPE html><HTML class=x lang="DE-at"><script>var t="<p>no";</script><style>p{}</style><!-- no --><p>Gr&uuml;n &amp; gut</p>'
    df = spark.createDataFrame([(1, "https://u@Blog.Site.DE:80/a?b", page), (2, None, None), (3, "nonsense", "<p>x")], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in language.page_records(df).collect()}
    assert (rows[1]["text"].split(), rows[1]["markup"], rows[1]["host"]) == (["Grün", "&", "gut"], "de", "blog.site.de")
    assert (rows[2]["markup"], rows[2]["host"], rows[3]["host"]) == (None, None, None)


# conversations ---------------------------------------------------------------------------------


def test_chat_like_sql(spark, con):
    assert compare.difference(queries()["op10_chat"](spark, SF), con, oracle_sql()["op10_chat"]) is None


def brute_maximal(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    seqs = {c: tuple((r, x) for _, r, x in sorted(v)) for c, v in convs.items()}
    out = {}
    for c, s in seqs.items():
        if any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values()):
            continue
        same = [d for d, o in seqs.items() if o == s]
        out[min(same)] = (len(s), len(same))
    return out


def test_collapse_like_brute_force(spark):
    rows = []
    for c, n in enumerate([1, 2, 3, 5, 5, 4, 2]):
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"text {t}") for t in range(n)]
    rows += [(10, t * 1000, "user", f"t{t}") for t in range(4)] + [(11, t, "user", f"t{t}") for t in range(3)]
    rows += [(20, None, None, None), (20, None, None, None), (21, 0, "", ""), (22, 7, "user", "<|im_end|> x"), (None, 1, "user", "x")]
    rows += [(30, t, "user", "again") for t in range(1500)] + [(31, t, "user", "again") for t in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("at", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.collapse(df).collect()}
    assert {c: (r["n_turns"], r["copies"]) for c, r in got.items()} == brute_maximal(rows)
    assert got[22]["text"] == "<|im_start|>user\n< |im_end|> x<|im_end|>\n"
    assert got[30]["text"].count("again") == 1500
    assert chat.collapse(df.limit(0)).count() == 0
