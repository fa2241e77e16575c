"""Near duplicates and benchmark leaks against brute force, planted cases and odd input."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import compare
from epochwise.llm import decontaminate, near_dup
from epochwise.llm.catalogue import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def documents(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def brute_groups(rows, n, percent):
    """{id: (set size, smallest reachable id)} by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
        sets[i] = s
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def groups(docs, n):
    return {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.groups(docs, n=n).collect()}


@pytest.mark.parametrize("n", [2, 5])
def test_like_brute_force(spark, n):
    """Chains of edits: neighbours are alike, the ends aren't; dense groups; short texts; exact copies."""
    rng = random.Random(n)
    words = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.randint(20, 90))]
        for _ in range(14):
            rows.append((i, " ".join(base)))
            i += 1
            base = list(base)
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = rng.choice(words)
    base = [rng.choice(words) for _ in range(60)]
    for _ in range(60):  # all of one text, at about the limit from one another
        copy = list(base)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(60)] = rng.choice(words)
        rows.append((i, " ".join(copy)))
        i += 1
    for t in ["", None, "one", "ONE", "one two", "one  two\n", "Éa b", "éa b", "one two three"]:
        rows.append((i, t))
        i += 1
    rng.shuffle(rows)
    assert groups(documents(spark, rows), n) == brute_groups(rows, n, 80)


def test_one_group_of_many_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows = []
    for i in range(1500):
        copy = list(base)
        copy[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    assert {c for _, c in groups(documents(spark, rows), 2).values()} == {0}


def test_odd_sketch_estimates_high_similarity():
    import numpy as np

    rng = np.random.default_rng(2)
    for share in (0.95, 0.8, 0.7):
        a = rng.integers(0, 1 << 62, 600).astype(np.uint64)
        m = round(600 * 2 * share / (1 + share) / 1)
        b = np.concatenate([a[: m // 1], rng.integers(0, 1 << 62, 600 - m).astype(np.uint64)]) if m < 600 else a
        x, y = (near_dup.odd_sketch(near_dup.minhash(s)) for s in (a, b))
        differ = sum(int(v).bit_count() for v in (x.view(np.uint64) ^ y.view(np.uint64)))
        bits = near_dup.SKETCH_WORDS * 64
        estimate = 1 + bits / (4 * near_dup.SAMPLES) * np.log(1 - 2 * differ / bits)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(estimate - true) < 0.08


def test_sketch_limit_lies_six_deviations_beyond_a_link():
    import numpy as np

    rng = np.random.default_rng(5)
    bits = near_dup.SKETCH_WORDS * 64
    differ = [
        int((np.bincount(rng.integers(0, bits, 2 * rng.binomial(near_dup.SAMPLES, 0.2)), minlength=bits) & 1).sum())
        for _ in range(4000)
    ]
    assert near_dup.xor_limit() >= np.mean(differ) + 6 * np.std(differ)


def test_odd_rows(spark):
    rows = [(None, "a b c"), (None, "a b c"), (5, "a b c"), (5, "a b c"), (6, "a b c"), (7, ""), (8, None)]
    docs = documents(spark, rows)
    for c in ("name", "id_", "bucket", "sketch", "kept"):
        docs = docs.withColumn(c, F.lit("clash"))
    out = near_dup.groups(docs, n=2).collect()
    assert sorted((str(r["id"]), r["component_id"], r["kept"]) for r in out) == [
        ("5", 5, True), ("5", 5, True), ("6", 5, False), ("7", 7, True), ("8", 8, True),
        ("None", None, True), ("None", None, True),
    ]
    assert near_dup.groups(docs.limit(0)).count() == 0
    long = documents(spark, [(1, "a b " * 100_000), (2, " ".join(map(str, range(60_000))))])
    assert groups(long, 2) == {1: (2, 1), 2: (59_999, 2)}


def test_query_like_sql(spark, con):
    name = "op8_near_dup"
    assert compare.difference(queries()[name](spark, SF), con, oracle_sql()[name]) is None
    assert name in entry.queries()


# benchmark leaks -------------------------------------------------------------------------------

ITEMS = [
    (1, "A farmer named Wilhelm Baker sells 12 baskets of ripe apples for 3 dollars each and then Wilhelm gives 12 away. How much money does Wilhelm Baker earn?"),
    (2, "short item"),
    (3, "the quick brown fox jumps over the lazy dog while seven sleepy cats look on from the garden wall"),
    (4, None),
    (5, "1 2 3 4 5 6 7 8"),
]
FILL = " Some words around it, of no meaning at all, to make the text longer than the passage is. "


def leaks(spark, rows, items=ITEMS):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(documents(spark, rows), bench).collect()}


def test_leaks(spark):
    other = ITEMS[0][1].replace("Wilhelm", "Johanna").replace("Baker", "Smith").replace("12", "45").replace("3 ", "7 ")
    mixed = other.replace("Johanna", "Peter", 1).replace("45", "46", 1).replace("Smith", "Jones", 1)
    rows = [
        (10, FILL + ITEMS[0][1] + FILL),
        (11, FILL + ITEMS[0][1].upper() + FILL),
        (12, FILL + other + FILL),
        (13, FILL + mixed + FILL),  # names and numbers change within the passage
        (14, FILL * 5),
        (15, "short item"),
        (16, FILL + " short item " + FILL),
        (17, ITEMS[2][1].replace("brown", "red")),
        (18, "9 8 7 6 5 4 3 2 1 0"),
        (19, None),
        (20, ""),
        (None, ITEMS[2][1]),
        (21, ITEMS[2][1]),
        (21, ITEMS[2][1]),
        (22, FILL + "1 2 3 4 5 6 7 8" + FILL),
    ]
    assert leaks(spark, rows) == {(10, 1), (11, 1), (12, 1), (15, 2), (17, 3), (21, 3), (22, 5)}


def test_leaks_of_a_part(spark):
    """Quotes of less than half of a long item: a run of 13 words is a leak, one of 12 isn't."""
    words = [f"word{i}" for i in range(200)]
    items = [(1, " ".join(words)), (2, " ".join(f"other{i}" for i in range(59)))]
    quote = lambda a, n: FILL + " ".join(words[a : a + n]) + FILL
    rows = [
        (30, quote(0, 13)),
        (31, quote(50, 99)),
        (32, quote(187, 13)),
        (33, quote(90, 12)),
        (34, quote(20, 12) + quote(60, 12)),
        (35, FILL + " ".join(f"other{i}" for i in range(20, 47)) + FILL),
        (36, FILL + " ".join(words[100 + i] if i != 6 else "changed" for i in range(13)) + FILL),
    ]
    assert leaks(spark, rows, items) == {(30, 1), (31, 1), (32, 1), (35, 2)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.matches(documents(spark, rows), bench).collect()}
    assert found[35]["exact"] and abs(found[35]["coverage"] - 23 / 55) < 1e-9


def test_leaks_filled_anew(spark):
    """Names that only open sentences, and windows with more slots than words."""
    items = [
        (1, "Sara bought 12 pens. Sara gave 4 away. Sara lost 3 more. How many pens remain?"),
        (2, "Compute 12 + 7 * 3 - 5 + 9 now."),
        (3, "From 10 20 30 40 50 60 70 km pick the longest road 5 8 2 6 4"),
    ]
    emma = items[0][1].replace("Sara", "Emma").replace("12", "15").replace("4", "6").replace("3", "2")
    rows = [
        (40, FILL + emma + FILL),
        (41, FILL + " in short " + emma + FILL),  # the first name is inside a sentence
        (43, FILL + "Compute 11 + 6 * 2 - 4 + 8 now." + FILL),
        (44, FILL + "Compute 11 - 6 + 2 * 4 - 8 now." + FILL),  # other operators
        (45, FILL + "9 8 7 6 5 4 3 2 1" + FILL),
        (46, FILL + "From 11 21 31 41 51 61 71 miles pick the longest road 6 9 3 7 5" + FILL),
        (47, FILL + "From 11 21 31 41 51 61 71 miles walk a very short way 6 9 3 7 5" + FILL),
    ]
    assert leaks(spark, rows, items) == {(40, 1), (41, 1), (43, 2), (46, 3)}


def test_span_hashes_depend_on_the_span_alone():
    h = lambda t: {(int(x), int(k > 0)) for x, k in zip(*(decontaminate.windows(t)[i] for i in (0, 2)))}
    for text in ("Compute 12 + 7 * 3 - 5 + 9 now.", "the 3 4 5 6 old 7 8 cats of 9", "Sara gave Tom 4. Sara left 2 3 4 there."):
        assert h(text) <= h("Many words. " + text + " And 5 6 more 7 words. ")
    assert h("Add up 1 + 2 * 3 now") & h("Add up 4 + 5 * 6 now") and not h("see 1 + 2 * 3 now") & h("see 4 - 5 * 6 now")


def test_leaks_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert leaks(spark, [(1, FILL + ITEMS[2][1]), (2, FILL)]) == {(1, 3)}


def test_leaks_odd_tables(spark):
    assert leaks(spark, [], ITEMS) == set()
    assert leaks(spark, [(1, "x")], []) == set()
    assert leaks(spark, [(1, ITEMS[2][1])], [(7, ITEMS[2][1]), (8, ITEMS[2][1]), (8, ITEMS[2][1])]) == {(1, 7), (1, 8)}
    clash = documents(spark, [(1, ITEMS[2][1])]).withColumn("key", F.lit(1)).withColumn("hash", F.lit(2))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("kind", F.lit(3))
    found = decontaminate.matches(clash, bench)
    assert decontaminate.clean(clash, found).count() == 0
    assert leaks(spark, [(1, " ".join(f"w{i}" for i in range(500_000)) + " " + ITEMS[2][1])]) == {(1, 3)}


def test_query_like_verbatim_search(spark):
    """At least the documents that hold a whole item, and none that shares no eight words with one."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = lambda t: {tuple(w[k : k + 8]) for w in [t.lower().split()] for k in range(len(w) - 7)}
    bench = set().union(*map(grams, items))
    whole = {d for d, t in docs.items() if any(i in t for i in items)}
    some = {d for d, t in docs.items() if grams(t) & bench}
    found = {r["doc_id"] for r in queries()["op4_decontaminate"](spark, SF).collect()}
    assert whole and whole <= found <= some
