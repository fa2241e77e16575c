"""Benchmark decontamination by template windows and slot consistency.

Words are canonicalised: numbers, units and names (capitalised words) become typed placeholders. Every
window of ``WINDOW`` words is hashed as literal lower-case words, and, if it has a placeholder, as a
template. A capital that opens a sentence may be a name or not, so a window with one is a template
twice, with that word as it is and as a name. A template holds at least ``CONTENT`` other words; a window
with fewer is widened to the right, and to the left, until it does. There an operator between two
numbers counts as a word, and one real word is needed. Windows of documents
are hash-joined with those of the benchmark. For template windows the values in the slots must
map consistently: one item value to one document value along a diagonal (document position minus item
position). An item is leaked into a document when at least ``COVERAGE`` of its windows are found, or when
windows that follow one another on a diagonal span ``RUN_WORDS`` words, however long the item is.

An item without ``CONTENT`` such words in all has no template: it is only found as it stands.
A text shorter than a window has one window, its whole sequence; it matches only another such text.

Nulls: null texts and ids take no part. Repeated rows of a document count once; equal items are found
together. Empty tables give no rows.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from epochwise.session import materialise

WINDOW = 5
CONTENT = 3
COVERAGE = 0.5
#: Words in a row that are a leak whatever share of the item they are.
RUN_WORDS = 13
#: Share of an item's slot values on a diagonal that must have a single counterpart.
CONSISTENT = 0.75
#: Most distinct benchmark windows that are broadcast (16 MB); more are joined by a shuffle.
BROADCAST_WINDOWS = 2_000_000
WORD_CACHE = 400_000
#: Powers of the hash base that a worker keeps; longer texts have theirs made anew.
POWERS = 1 << 16
#: Characters of texts whose windows are worked out together.
PORTION = 1 << 18

# fixed values: words that stand for a number or a unit of measure
NUMBERS = set(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
    "sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety "
    "hundred thousand million billion half dozen".split()
)
UNITS = set(
    "mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms "
    "oz ounce ounces lb lbs pound pounds ton tons ml l liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros percent % degree degrees mph kph meter meters metre metres".split()
)
_NUMBER = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*%?")
_NUMBER_UNIT = re.compile(r"[-+]?\d[\d.,]*([a-z%°]+)")
_OPERATORS = set("+-*/=^<>")
_WORD, _NUM, _UNIT, _NUMUNIT, _CAPITAL, _NONE = range(6)
_EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "$%") + "“”‘’«»„…–—¿¡"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIXERS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _MIXERS[0]
    x ^= x >> np.uint64(27)
    x *= _MIXERS[1]
    x ^= x >> np.uint64(31)
    return x


class _Lexicon(dict):
    """Number of each word, with its literal hash, type and whether it is an operator or ends a sentence."""

    def __init__(self, room: int = WORD_CACHE):
        self.room = room
        self.hash = np.zeros(room, np.uint64)
        self.kind = np.zeros(room, np.uint8)
        self.sign = np.zeros(room, bool)
        self.ends = np.zeros(room, bool)

    def __missing__(self, word: str) -> int:
        n = len(self)
        bare = word.strip(_EDGES)
        low = bare.lower()
        if not bare:
            kind = _NONE
        elif low in NUMBERS or _NUMBER.fullmatch(bare):
            kind = _NUM
        elif low in UNITS:
            kind = _UNIT
        elif (m := _NUMBER_UNIT.fullmatch(low)) and m[1] in UNITS:
            kind = _NUMUNIT
        elif bare[0].isupper() and bare[1:].islower():
            kind = _CAPITAL
        else:
            kind = _WORD
        self.sign[n] = kind == _NONE and word.strip("()[]{}") in _OPERATORS
        self.hash[n] = xxhash.xxh3_64_intdigest(word.strip("()[]{}") if self.sign[n] else low)
        self.kind[n] = kind
        self.ends[n] = word.rstrip("\"')]}”’»").endswith((".", "!", "?", ":", "…"))
        self[word] = n
        return n


_lexicon = _Lexicon()
_PLACEHOLDER = np.array([xxhash.xxh3_64_intdigest(f"\x00slot{k}") for k in range(6)], np.uint64)


class _Words:
    """The words of some texts, one after another, with literal hashes, types, capitals that open a sentence and operators after words.

    ``text``: the text of each word. Its words lie from ``begin`` to ``end``.
    """

    def __init__(self, texts: list[str]):
        global _lexicon
        split = [t.split() for t in texts]
        lengths = [len(t) for t in split]
        self.tokens = tokens = list(itertools.chain.from_iterable(split))
        if len(_lexicon) + len(tokens) > _lexicon.room:
            _lexicon = _Lexicon(max(WORD_CACHE, len(tokens)))
        ids = np.fromiter(map(_lexicon.__getitem__, tokens), np.int64, len(tokens))
        kind = _lexicon.kind[ids]
        self.place = place = np.flatnonzero(kind != _NONE)
        self.text = np.repeat(np.arange(len(texts)), lengths)[place]
        self.count = np.bincount(self.text, minlength=len(texts))
        self.end = np.cumsum(self.count)
        self.begin = self.end - self.count
        follows = np.zeros(len(place), bool)
        follows[1:] = self.text[1:] == self.text[:-1]
        opens = ~follows  # the first word of a sentence, whose capital says nothing
        if len(place) > 1:
            ended = np.concatenate([[0], np.cumsum(_lexicon.ends[ids])])
            opens[1:] |= ended[place[1:]] > ended[place[:-1]]
        self.signs = np.zeros(len(place), np.uint64)
        at = np.flatnonzero(_lexicon.sign[ids])
        self.types = kind = kind[place]
        if len(at) and len(place) > 1:
            before = np.searchsorted(place, at) - 1
            number = (kind == _NUM) | (kind == _NUMUNIT)
            inner = (before >= 0) & (before < len(place) - 1)
            inner[inner] = number[before[inner]] & number[before[inner] + 1] & follows[before[inner] + 1]
            # several operators in a row keep their order
            np.add.at(self.signs, before[inner], _mix(_lexicon.hash[ids[at[inner]]] + (at - place[before])[inner].astype(np.uint64)))
        self.literal = _lexicon.hash[ids[place]]
        self.capital = (kind == _CAPITAL) & opens

    def slots(self, which: int) -> np.ndarray:
        """Types of the words in templates of kind 1 or 2."""
        return np.where(self.capital, _WORD, self.types) if which == 1 else self.types

    def values(self, start: int, size: int, which: int) -> list[str]:
        """The words in the slots of a window."""
        out = []
        for i in range(start, start + size) if which else ():
            kind = _WORD if which == 1 and self.capital[i] else self.types[i]
            if kind != _WORD:
                # "?": only taken for a name
                out.append(f"{'?' if self.capital[i] else ''}{kind}:{self.tokens[self.place[i]].strip(_EDGES).lower()}")
        return out


def _rolled(h: np.ndarray, size: int, salt: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the windows of ``size`` words, all of them or those that start ``at``."""
    out = np.full(len(h) - size + 1 if at is None else len(at), salt, np.uint64)
    for j in range(size):
        out *= np.uint64(_BASE)
        out += h[j : len(h) - size + 1 + j] if at is None else h[at + j]
    return _mix(out)  # the words' hashes are scrambled already


@functools.cache
def _power_table(count: int) -> np.ndarray:
    """Powers of the base, and of its inverse, up to ``count`` of them."""
    factors = np.full((2, count), [[_BASE], [_INVERSE]], np.uint64)
    factors[:, 0] = 1
    return np.cumprod(factors, axis=1, dtype=np.uint64)


def _powers(count: int) -> np.ndarray:
    if count > POWERS:  # rare and long texts have theirs made anew, so that a worker doesn't keep them
        return _power_table.__wrapped__(count)
    return _power_table(POWERS)


def _widened(words_of: _Words, template: np.ndarray, slot: np.ndarray, dense: np.ndarray, opened: np.ndarray | None):
    """Hashes and positions of the windows at ``dense``, widened to either side as far as needed, within their texts.

    ``opened``: running count of sentence-opening capitals, where only windows that hold one are asked for.
    """
    count, signs, text = len(template), words_of.signs, words_of.text[dense]
    words = np.concatenate([[0], np.cumsum(slot == 0)])
    joints = np.concatenate([[0], np.cumsum(signs != 0)])  # an operator belongs to the word before it
    upto = words + np.concatenate([[0], joints[:-1]])  # content before an end, the operator after it left out
    since = words + joints
    stop = np.searchsorted(upto, since[dense] + CONTENT)
    stop = np.maximum(np.maximum(stop, np.searchsorted(words, words[dense] + 1)), dense + WINDOW)
    start = np.searchsorted(since, upto[dense + WINDOW] - CONTENT, "right") - 1
    start = np.minimum(np.minimum(start, np.searchsorted(words, words[dense + WINDOW] - 1, "right") - 1), dense)
    right, left = stop <= words_of.end[text], (start >= words_of.begin[text]) & (start < dense)
    a = np.concatenate([dense[right], start[left]])
    z = np.concatenate([stop[right], dense[left] + WINDOW])
    at = np.concatenate([dense[right], dense[left]])
    if opened is not None:
        fresh = np.flatnonzero(opened[z] > opened[a])
        a, z, at = a[fresh], z[fresh], at[fresh]
    if not len(a):
        return template[:0], at
    # the hash of any span from prefix sums of x[k] * B^k, divided by B^a; the operator before a span isn't in it
    powers, inverse = _powers(count + 1)
    x = template.copy()
    x[1:] += signs[:-1]
    x = _mix(x)
    x *= powers[:count]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    inner = (sums[z] - sums[a + 1]) * inverse[a]
    return _mix(_mix(_mix(template[a]) + inner) + (z - a).astype(np.uint64)), at


def windows_of(texts: list[str]):
    """(hash, text, position, kind) of the literal (0) and template windows of some texts, with the words that give their slots.

    Templates are of kind 1, or 2 where capitals that open a sentence are taken for names. Positions count from the
    first word of all texts.
    """
    words = _Words(texts)
    found = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def take(hashes: np.ndarray, at: np.ndarray, which: int) -> None:
        for column, values in zip(found, (hashes, at, np.full(len(at), which))):
            column.append(values)

    opened = np.concatenate([[0], np.cumsum(words.capital)])
    whole = words.text[WINDOW - 1 :] == words.text[: len(words.text) - WINDOW + 1] if len(words.text) >= WINDOW else np.empty(0, bool)
    if whole.any():
        at = np.flatnonzero(whole)
        take(_rolled(words.literal, WINDOW, WINDOW)[at], at, 0)
    # texts that are shorter than a window, as a whole
    short = np.flatnonzero((words.count > 0) & (words.count < WINDOW))
    for i in short:
        at = words.begin[i : i + 1]
        take(_rolled(words.literal[at[0] : words.end[i]], words.count[i], int(words.count[i])), at, 0)
    for which in (1, 2) if opened[-1] else (1,):
        slot = words.slots(which)
        slots = np.concatenate([[0], np.cumsum(slot != _WORD)])
        if not slots[-1]:
            continue
        template = np.where(slot != _WORD, _PLACEHOLDER[slot], words.literal)
        for i in short:
            a, z, size = words.begin[i], words.end[i], int(words.count[i])
            inside = slots[z] - slots[a]
            if 0 < inside and size - inside >= min(CONTENT, size) and (which == 1 or opened[z] > opened[a]):
                take(_rolled(template[a:z], size, 64 + size), words.begin[i : i + 1], which)
        if not whole.any():
            continue
        inside = slots[WINDOW:] - slots[:-WINDOW]
        anew = (opened[WINDOW:] > opened[:-WINDOW]) if which == 2 else True
        few = WINDOW - inside < CONTENT
        use = np.flatnonzero(whole & (inside > 0) & ~few & anew)
        take(_rolled(template, WINDOW, 64 + WINDOW, use), use, which)
        dense = np.flatnonzero(whole & (inside > 0) & few)
        if len(dense):
            take(*_widened(words, template, slot, dense, opened if which == 2 else None), which)
    hashes, at, kinds = map(np.concatenate, found)
    return hashes, words.text[at], at, kinds, words


def windows(text: str | None):
    """Hashes, positions and kinds of the windows of one text, the number of literal ones, and a slot reader."""
    h, _, at, kind, words = windows_of([text or ""])
    size = min(WINDOW, int(words.count[0]))
    total = int(words.count[0]) - size + 1 if size else 0
    return h, at, kind, total, lambda start, which: words.values(start, size, which)


def _portions(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``PORTION`` characters; a longer text is one by itself."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > PORTION:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


WINDOW_FIELDS = [
    T.StructField("hash", T.LongType()),
    T.StructField("kind", T.IntegerType()),
    T.StructField("at", T.IntegerType()),
    T.StructField("total", T.IntegerType()),
    T.StructField("slots", T.ArrayType(T.StringType())),
]


def window_rows(rows: DataFrame, key: str, text: str, known=None) -> DataFrame:
    """(key, hash, kind, at, total, slots) per window; with ``known`` only windows hashed there.

    ``known`` is a broadcast sorted array of hashes. A table of 2^20 bits, by the lowest bits,
    turns nearly all others away before the search.
    """
    picked = rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    picked = picked.filter(F.col("key").isNotNull() & F.col("text").isNotNull())
    schema = T.StructType([picked.schema["key"], *WINDOW_FIELDS])
    arrow = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.uint64((1 << 20) - 1)
        if known is not None:
            hashes = known.value
            gate = np.zeros(1 << 20, bool)
            gate[hashes & low] = True
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, stop in _portions(texts):
                h, text, at, kind, words = windows_of(texts[start:stop])
                if known is not None:
                    keep = np.flatnonzero(gate[h & low]) if len(hashes) else np.empty(0, np.int64)
                    if len(keep):
                        found = np.minimum(np.searchsorted(hashes, h[keep]), len(hashes) - 1)
                        keep = keep[hashes[found] == h[keep]]
                    h, text, at, kind = h[keep], text[keep], at[keep], kind[keep]
                size = np.minimum(words.count[text], WINDOW)
                total = words.count[text] - size + 1
                slots = [words.values(*v) for v in zip(at.tolist(), size.tolist(), kind.tolist())]
                cols = h.view(np.int64), np.minimum(kind, 1), at - words.begin[text], total, slots
                arrays = [batch.column("key").take(pa.array(start + text, pa.int64()))]
                arrays += [pa.array(c, t) for c, t in zip(cols, arrow)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return picked.mapInArrow(run, schema)


def matches(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, coverage, exact) for every leaked pair of a document and an item.

    ``coverage``: share of the item's windows that were found; below ``COVERAGE`` where a run of
    ``RUN_WORDS`` words makes the leak. ``exact``: the literal windows alone reach a limit, else slots
    were filled anew.
    """
    spark = docs.sparkSession
    items = benchmark.filter(F.col(item_text).isNotNull()).groupBy(F.col(item_text).alias("_t")).agg(
        F.min(item_id).alias("_item")
    )
    bench = materialise(window_rows(items, "_item", "_t"), "benchmark-windows")
    hashes = bench.select("hash").distinct()
    known = None
    if hashes.count() <= BROADCAST_WINDOWS:
        held = np.array([r[0] for r in hashes.collect()], np.int64).view(np.uint64)
        known = spark.sparkContext.broadcast(np.sort(held))
    found = window_rows(docs, doc_id, text, known)
    b = bench.select(
        F.col("key").alias("item"), "hash", "kind", F.col("at").alias("item_at"),
        F.col("total").alias("item_total"), F.col("slots").alias("item_slots"),
    )
    hit = found.withColumnRenamed("key", "doc").join(b, ["hash", "kind"])
    hit = hit.select(
        "doc", "item", "kind", "at", "item_at", "item_total", "slots", "item_slots",
        (F.col("at") - F.col("item_at")).alias("shift"),
    )
    hit = materialise(hit.distinct(), "window-matches")

    pair = ["doc", "item", "shift"]
    slot = hit.filter("kind = 1").select(*pair, F.explode(F.arrays_zip("item_slots", "slots")).alias("s"))
    value, counterpart = (F.ltrim(F.col(c), F.lit("?")) for c in ("s.item_slots", "s.slots"))
    one = slot.groupBy(*pair, value.alias("value")).agg(
        F.min(counterpart).alias("lo"), F.max(counterpart).alias("hi"), F.min(F.col("s.item_slots").startswith("?")).alias("guess")
    )
    # a word that is only taken for a name and stays as it is says nothing
    idle = F.col("guess") & (F.col("lo") == F.col("value")) & (F.col("hi") == F.col("value"))
    fits = one.groupBy(*pair).agg(F.avg(F.when(~idle, (F.col("lo") == F.col("hi")).cast("double"))).alias("share"))
    fits = fits.filter(F.col("share") >= CONSISTENT).select(*pair)
    template = hit.filter("kind = 1").join(fits, pair, "left_semi")
    good = hit.filter("kind = 0").unionByName(template)
    seen = good.groupBy("doc", "item", "item_at", "item_total").agg(F.min("kind").alias("kind"))
    per_pair = seen.groupBy("doc", "item").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("kind") == 0, 1)).alias("literal"),
        F.max("item_total").alias("total"),
    )
    runs = _longest(good, "run").join(_longest(good.filter("kind = 0"), "literal_run"), ["doc", "item"], "left")
    per_pair = per_pair.join(runs, ["doc", "item"])
    enough = lambda n, run: (F.col(n) >= COVERAGE * F.col("total")) | (F.col(run) >= RUN_WORDS)
    per_pair = per_pair.filter(enough("n", "run"))
    # equal items were looked for once; each of them is reported
    same = benchmark.filter(F.col(item_text).isNotNull()).select(
        F.col(item_id).alias("item_id"), F.col(item_text).alias("_t")
    )
    alike = same.join(items, "_t").select("_item", "item_id")
    return per_pair.join(alike, per_pair["item"] == alike["_item"]).select(
        F.col("doc").alias("doc_id"),
        "item_id",
        (F.col("n") / F.col("total")).alias("coverage"),
        F.coalesce(enough("literal", "literal_run"), F.lit(False)).alias("exact"),
    )


def _longest(good: DataFrame, name: str) -> DataFrame:
    """(doc, item, ``name``): most words under windows that follow one another on one diagonal."""
    pair = ["doc", "item", "shift"]
    at = good.select(*pair, "item_at").distinct()
    # in a run, the position minus the row's number stays the same
    island = F.col("item_at") - F.row_number().over(Window.partitionBy(*pair).orderBy("item_at"))
    runs = at.withColumn("_island", island).groupBy(*pair, "_island").agg((F.count("*") + WINDOW - 1).alias("_words"))
    return runs.groupBy("doc", "item").agg(F.max("_words").alias(name))


def contaminated(found: DataFrame) -> DataFrame:
    """One row per document with a leak, with the items it holds."""
    return found.groupBy("doc_id").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"),
        F.max("coverage").alias("coverage"),
        F.max("exact").alias("exact"),
    )


def clean(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that hold an item; a null id stays."""
    bad = found.select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(bad, doc_id, "left_anti")
