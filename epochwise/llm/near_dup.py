"""Near-duplicate groups: banded MinHash, odd sketches, exact confirmation on full shingle sets.

1. Each document's shingle set gives ``BANDS * ROWS`` MinHash samples. The samples are folded into an
   odd sketch: a bitmap in which sample (i, value) flips one bit. The population count of the
   XOR of two sketches estimates how many samples differ, most precisely at high similarity.
2. Documents with equal sets form a class; only one document of a class goes on.
3. Two classes that share a band are candidates. First each member of a bucket is compared with the
   bucket's lead, the member that shares most buckets with others, which among near copies is
   the text they were made from. A candidate whose sketches differ too much is dropped, the others
   are confirmed by intersecting the full sets. Links give components. Besides the sketch of the samples there is
   one of the whole set. Each bit in which two of those differ stands for at least one shingle that only one
   of the sets has, so a pair with more such bits than a link may have single shingles is no link, for certain.
4. Buckets with members of different components go on. First their next ``LEADS`` members lead, against the members of
   other components. In those that are still mixed then, every member outside the bucket's largest component leads, so every
   pair of its components is compared. A pair is taken in the first band that it shares. So each pair of different
   texts of a bucket is compared by its sketches or joined through others, and a group of a million near copies of one text
   costs a million comparisons.

With 64 bands of 8 rows a pair at the limit of 0.8 shares no band with a chance of 8e-6. The sketch limit
lies seven standard deviations of the differing bits beyond those expected at 0.8 (186, with a deviation
of 16; the limit is 296), so hardly any link is lost by it; a link that is lost is one without a band
in common.

Nulls: a null text is empty; an empty set is linked with nothing. A null id is in no group: its
component is null. Rows with the same id are one document. Empty tables give no rows.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from epochwise.session import discard, materialise

BANDS, ROWS = 64, 8
SAMPLES = BANDS * ROWS
SKETCH_WORDS = 32  # of 64 bits
#: Estimated similarity below which a candidate is taken for no link at 0.8.
SKETCH_FLOOR = 0.66
PERCENT = 80
WORD_CACHE = 150_000
#: Members of a mixed bucket that lead after the first.
LEADS = 7


class _Words(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; of the whole sequence if it is shorter.

    Words are runs without space, tab and line-break characters; only A-Z are lower-cased.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(n, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for j in range(size):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - size + 1 + j])
    return np.unique(h)


@functools.cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240817)
    a = rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
    return a[:, None], rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)[:, None]


def minhash(s: np.ndarray) -> np.ndarray:
    """The smallest value of each of the permutations of 32 bits; blocks bound the memory."""
    a, b = _permutations()
    out = np.full(SAMPLES, (1 << 32) - 1, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(out, (x[at : at + 256] * a + b).min(axis=1), out=out)
    return out.astype(np.uint64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples, as signed 64-bit words."""
    bits = SKETCH_WORDS * 64
    place = _mix(samples + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bits)
    odd = np.bincount(place.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """Parity bitmap of a whole set: two differ in no more bits than the sets have shingles of their own."""
    bits = SKETCH_WORDS * 64
    odd = np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def xor_limit(floor: float = SKETCH_FLOOR) -> int:
    """Most differing bits expected at similarity ``floor``."""
    bits = SKETCH_WORDS * 64
    return math.ceil(bits / 2 * (1 - (1 - 2 / bits) ** (2 * SAMPLES * (1 - floor))))


def bands(samples: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64)
    for row in samples.reshape(BANDS, ROWS).T:
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + row)
    return h.view(np.int64)


def set_name(s: np.ndarray) -> str:
    return hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest()


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def signatures(docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """(id, name, n, bands, sketch, parity): the set's digest and size, its band keys and odd sketches."""
    keyed = _keyed(docs, doc_id, text)
    schema = T.StructType(
        [
            keyed.schema["id"],
            T.StructField("name", T.StringType()),
            T.StructField("n", T.LongType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
            T.StructField("sketch", T.ArrayType(T.LongType())),
            T.StructField("parity", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches):
        longs = pa.list_(pa.int64())
        for batch in _pieces(batches):
            names, sizes, keys, sketches, parities = [], [], [], [], []
            for value in batch.column("text"):
                s = shingles(value.as_py(), n)
                names.append(set_name(s))
                sizes.append(len(s))
                samples = minhash(s) if len(s) else None
                keys.append(None if samples is None else bands(samples))
                sketches.append(None if samples is None else odd_sketch(samples))
                parities.append(None if samples is None else parity_sketch(s))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(names, pa.string()),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, longs),
                    pa.array(sketches, longs),
                    pa.array(parities, longs),
                ],
                names=schema.names,
            )

    return keyed.mapInArrow(run, schema)


def full_sets(docs: DataFrame, doc_id: str, text: str, n: int, wanted: DataFrame) -> DataFrame:
    """(id, items) for the wanted (id, name); the texts move once, to the ids."""
    keyed = _keyed(docs, doc_id, text).join(wanted.hint("shuffle_hash"), "id").select("id", "name", "text")
    keyed = keyed.dropDuplicates(["id", "name", "text"])  # in place: the rows of an id are together already
    schema = T.StructType([keyed.schema["id"], T.StructField("items", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in _pieces(batches):
            ids, items = [], []
            for i in range(batch.num_rows):
                s = shingles(batch.column("text")[i].as_py(), n)
                if set_name(s) == batch.column("name")[i].as_py():
                    ids.append(i)
                    items.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(ids, pa.int64())), pa.array(items, pa.list_(pa.int64()))],
                names=schema.names,
            )

    return keyed.mapInArrow(run, schema)


def _differing(a: Column, b: Column) -> Column:
    return functools.reduce(
        lambda x, y: x + y, [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(SKETCH_WORDS)]
    )


def _may_link(a: dict[str, Column], b: dict[str, Column], percent: int) -> Column:
    """Whether sizes and sketches of two sets allow a link. Sizes and whole-set sketches never turn a link away."""
    single = (a["n"] + b["n"]) * (100 - percent) >= _differing(a["parity"], b["parity"]) * (100 + percent)
    sizes = F.least(a["n"], b["n"]) * 100 >= F.greatest(a["n"], b["n"]) * percent
    return sizes & single & (_differing(a["sketch"], b["sketch"]) <= xor_limit())


CARD = ("n", "sketch", "parity")


def _card(cards: DataFrame, side: str) -> DataFrame:
    """``cards`` with every column but those renamed here as ``side_*``, the id as ``side``."""
    return cards.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in CARD])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are at least ``percent`` alike."""
    left = pairs.select("a", "b").join(sets.select(F.col("id").alias("b"), F.col("items").alias("ib")), "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("items").alias("ia")), "a")
    common = F.size(F.array_intersect("ia", "ib"))
    union = F.size("ia") + F.size("ib") - common
    return both.filter(100 * common >= percent * union).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): every node of ``edges`` (a, b) with the smallest node that it reaches; a stored table.

    Large-star and small-star steps in turn. Each is a minimum per node, combined before the
    shuffle, and a join; no list of neighbours is ever built.
    """
    now = materialise(_oriented(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialise(_oriented(moved.unionByName(low.withColumnRenamed("m", "v"))), "edges")
        discard(now)
        now = after
    stars = now.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "id")
    centres = now.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    out = materialise(stars.unionByName(centres), "components")
    discard(now)
    return out


def _oriented(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller node; loops go."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``."""
    sig = materialise(signatures(docs, doc_id, text, n), "signatures")
    names = materialise(sig.select("id", "name", "n"), "names")
    usable = sig.filter(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = usable.groupBy("name").agg(
        F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "bands", "sketch", "parity")]
    )
    classes = materialise(classes, "classes")
    discard(sig)

    members = classes.select("id", F.posexplode("bands").alias("band", "key")).select(
        "id", F.xxhash64("band", "key").alias("bucket")
    )
    shared = members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    plain = materialise(members.join(shared, "bucket"), "buckets")
    degree = materialise(plain.groupBy("id").agg(F.sum("size").alias("degree")), "degrees")
    bucketed = materialise(plain.join(degree, "id").select("bucket", "id", "degree"), "buckets")
    wanted = classes.join(degree.select("id"), "id", "left_semi")
    cards = materialise(wanted.select("id", "name", "bands", *CARD), "cards")
    sets = materialise(full_sets(docs, doc_id, text, n, cards.select("id", "name")), "sets")
    discard(plain, degree)

    leads = bucketed.groupBy("bucket").agg(F.max_by("id", F.struct("degree", "id")).alias("lead"))
    stars = bucketed.join(leads, "bucket").filter("id <> lead")
    stars = stars.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
    tested = materialise(_close(stars, cards, percent), "tested")
    links = materialise(confirm(tested, sets, percent), "links")
    found = components(links)
    discard(tested, links)
    mixed = bucketed
    for leading in (_next_members, _outside_main):
        before, mixed = mixed, materialise(_mixed(mixed, found), "mixed")
        discard(before)
        if mixed.isEmpty():
            break
        pairs = materialise(_open_pairs(leading(mixed), cards, percent), "tested")
        links = materialise(confirm(pairs, sets, percent), "links")
        if not links.isEmpty():
            before, found = found, _merged(found, pairs.join(links, ["a", "b"], "left_semi"))
            discard(before)
        discard(pairs, links)
    discard(mixed, cards, sets)

    class_of = classes.select("name", "id").join(found, "id", "left").select(
        "name", F.coalesce("comp", "id").alias("_comp")
    )
    out = names.join(class_of, "name", "left")
    alone = (F.col("n") == 0) | F.col("id").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("_comp"))
    return out.select(
        "id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def _close(pairs: DataFrame, cards: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may be links by their sizes and sketches."""
    both = pairs.join(_card(cards, "a"), "a").join(_card(cards, "b"), "b")
    a, b = ({c: F.col(f"{side}_{c}") for c in CARD} for side in "ab")
    return both.filter(_may_link(a, b, percent)).select("a", "b")


def _merged(found: DataFrame, linked: DataFrame) -> DataFrame:
    """``found`` after the components ``ca`` and ``cb`` of each linked pair have become one; a stored table."""
    joined = components(linked.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    # a document that was alone is its own component
    alone = joined.select("id", F.col("id").alias("comp")).join(found, "id", "left_anti")
    moved = joined.select(F.col("id").alias("comp"), F.col("comp").alias("_to"))
    placed = found.unionByName(alone).join(moved, "comp", "left").select("id", F.coalesce("_to", "comp").alias("comp"))
    out = materialise(placed, "components")
    discard(joined)
    return out


def _mixed(bucketed: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, id, degree, comp) of the buckets with members of several components.

    The others are settled. They stay so, and are never looked at again.
    """
    placed = bucketed.select("bucket", "id", "degree").join(found, "id", "left")
    placed = placed.withColumn("comp", F.coalesce("comp", "id"))
    several = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    return placed.join(several.select("bucket"), "bucket").select("bucket", "id", "degree", "comp")


def _next_members(mixed: DataFrame) -> DataFrame:
    """``mixed`` with ``leads``: those numbered 2 to ``LEADS + 1`` by degree; the first has led already."""
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("degree"), F.desc("id")))
    return mixed.withColumn("_rank", rank).withColumn("leads", F.col("_rank").between(2, LEADS + 1)).drop("_rank")


def _outside_main(mixed: DataFrame) -> DataFrame:
    """``mixed`` with ``leads``: those outside the bucket's largest component. Of any two components one member leads."""
    sizes = mixed.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("_main"))
    return mixed.join(main, "bucket").withColumn("leads", F.col("comp") != F.col("_main")).drop("_main")


def _open_pairs(mixed: DataFrame, cards: DataFrame, percent: int) -> DataFrame:
    """(a, b, ca, cb): pairs of a lead and a bucket mate in another component, if they may be linked."""
    cards = cards.select("id", *CARD, F.transform("bands", lambda k, i: F.xxhash64(i, k)).alias("keys"))
    carded = mixed.select("bucket", "id", "comp", "leads").join(cards, "id")
    leads = carded.filter("leads").select("bucket", *[F.col(c).alias(f"l_{c}") for c in ("id", "comp", "keys", *CARD)])
    a, b = {c: F.col(f"l_{c}") for c in CARD}, {c: F.col(c) for c in CARD}
    # two leads meet once
    apart = (F.col("l_comp") != F.col("comp")) & (~F.col("leads") | (F.col("l_id") < F.col("id")))
    # the sketches are compared in the join, so only pairs that may be links come out of it, and each in the
    # first bucket that it shares; the order of the buckets is that of their bands
    common = F.filter(F.zip_with("l_keys", "keys", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
    pairs = leads.join(carded, "bucket").filter(apart & _may_link(a, b, percent) & (common[0] == F.col("bucket")))
    return pairs.select(
        F.least("l_id", "id").alias("a"),
        F.greatest("l_id", "id").alias("b"),
        F.least("l_comp", "comp").alias("ca"),
        F.greatest("l_comp", "comp").alias("cb"),
    )
