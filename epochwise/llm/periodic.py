"""Periodic runs of words, found through string synchronising sets.

A run is a stretch of a document's words with smallest period q and at least ``EXPONENT * q`` words that
can't be made longer. Documents are worked on a batch at a time, as one array of word numbers in which
each document is followed by a number of its own, so no repetition crosses documents.

At scale t = 1, 2, 4, ... the runs with t <= q < 2t are found:

* Each window of t words has a hash (of its two halves). Windows of period t/4 or less are set aside; they lie in
  runs of smaller scales, which have been found by then, so those *highly periodic regions* are taken from there.
* Position i belongs to the *synchronising set* if the smallest hash among the windows at i..i+t that were not
  set aside is that of i or of i+t. That depends on the 2t words at i alone, and some position among the first
  t of every run of this scale belongs to it, or t + t windows in a row would have a period of t/4 or less, and
  with them the run a smaller one.
* Positions whose contexts of 2t words are equal are paired with the next such one. Within a run that
  one is exactly q away. So each pair at a distance d with t <= d < 2t proposes the period d.
* A proposal is extended to both sides on the words themselves, so a collision of hashes can't make a run.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXPONENT = 4
LEAST = 6
#: Texts are worked on in groups of about so many bytes; a longer text is a group of its own.
GROUP_BYTES = 3_000_000
TOP = np.uint64((1 << 64) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mix(left * np.uint64(0x9E3779B97F4A7C15) + right)


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of ``width`` neighbours from each position on; ``width - 1`` fewer positions."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def synchronising(window: np.ndarray, aside: np.ndarray, t: int) -> np.ndarray:
    """Positions of the synchronising set of scale ``t``; ``window``: hashes of the windows of ``t`` words."""
    seen = np.where(aside, TOP, window)
    least = _smallest(seen, t + 1)
    at = seen[: len(least)]
    return np.flatnonzero((least != TOP) & ((least == at) | (least == seen[t : t + len(least)])))


def _extent(words: np.ndarray, at: int, d: int) -> tuple[int, int]:
    """The longest stretch around ``at`` in which words ``d`` apart are equal, as (start, end)."""
    low, block = at, 16
    while low > 0:
        take = min(block, low)
        same = words[low - take : low] == words[low - take + d : low + d]
        differ = np.flatnonzero(~same)
        if len(differ):
            low = low - take + int(differ[-1]) + 1
            break
        low, block = low - take, block * 2
    high, block, last = at, 16, len(words) - d
    while high < last:
        take = min(block, last - high)
        differ = np.flatnonzero(words[high : high + take] != words[high + d : high + d + take])
        if len(differ):
            high += int(differ[0])
            break
        high, block = high + take, block * 2
    return low, high + d


def _scale(words: np.ndarray, window: np.ndarray, double: np.ndarray, aside: np.ndarray, t: int):
    """(start, length, period) of the runs with periods from ``t`` to ``2t - 1``."""
    s = synchronising(window, aside, t)
    s = s[s < len(double)]
    context = double[s]
    order = np.argsort(context, kind="stable")
    here, there = s[order[:-1]], s[order[1:]]
    d = there - here
    paired = (context[order[1:]] == context[order[:-1]]) & (d >= t) & (d < 2 * t)
    here, d = here[paired], d[paired]
    by = np.lexsort((here, d))
    here, d = here[by], d[by]
    # proposals of one period whose stretches of d + 2t words share d words or more are in one run
    fresh = np.ones(len(here), bool)
    fresh[1:] = (d[1:] != d[:-1]) | (here[1:] - here[:-1] > 2 * t)
    out = []
    for at, q in zip(here[fresh].tolist(), d[fresh].tolist()):
        if words[at] != words[at + q]:  # a collision
            continue
        start, end = _extent(words, at, q)
        if end - start >= EXPONENT * q:
            out.append((start, end - start, q))
    return out


def runs(words: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs with exponent ``EXPONENT`` or more, in the joined documents.

    ``words``: numbers of the words, each document followed by a number that occurs nowhere else;
    ``lengths``: the documents' lengths with that end mark.
    """
    found: list[tuple[int, int, int]] = []
    offset = np.concatenate([[0], np.cumsum(lengths)])
    origin = np.arange(len(words))  # where the words still looked at come from
    text, sizes, window = words, lengths, _mix(words.astype(np.uint64))
    regions = np.empty((0, 3), np.int64)
    t = 1
    while True:
        # documents too short for a run of this scale go
        stay = sizes > EXPONENT * t
        if not stay.all():
            keep = np.repeat(stay, sizes)
            text, origin, window, sizes = text[keep], origin[keep], window[keep], sizes[stay]
        if not len(sizes):
            return sorted(set(found))
        n = len(text)
        aside = np.zeros(n, bool)
        if t >= 4 and len(regions):
            edge = np.zeros(n + 1, np.int64)
            for start, length, q in regions:
                if length >= t and 4 * q <= t:
                    at = np.searchsorted(origin, start)
                    if at < n and origin[at] == start:
                        edge[at] += 1
                        edge[at + length - t + 1] -= 1
            aside = np.cumsum(edge[:-1]) > 0
        double = np.empty(0, np.uint64)
        if n > 2 * t:
            # windows at the end of the array wrap; they hold the last document's end mark, so nothing equals them
            double = _pairs(window, np.roll(window, -t))
            new = _scale(text, window[: n - t + 1], double[: n - 2 * t + 1], aside[: n - t + 1], t)
            new = [(int(origin[start]), length, q) for start, length, q in new]
            found += new
            if new:
                regions = np.concatenate([regions, np.array(new, np.int64)])
        else:
            return sorted(set(found))
        window, t = double, 2 * t


def planted(words: list[bytes], doc_id) -> list[bytes]:
    """The words of a document, from some place on repeated with a period if its id's checksum ends in 0."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // p)
    return words[:a] + (words[a : a + p] * times)[: n - a]


def _summary(words: list[bytes], own: list[tuple[int, int, int]]) -> tuple:
    """The result columns of one document; ``own``: its runs, by start and period."""
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in own)
    if not own:
        return (0, None, None, None, None, _sha(listed.encode()), _sha(b" ".join(words)))
    best = own[0]
    dropped = np.zeros(len(words) + 1, np.int64)
    for s, n, q in own:
        if n * best[2] > best[1] * q:
            best = (s, n, q)
        dropped[s + q] += 1
        dropped[s + n] -= 1
    gone = np.cumsum(dropped[:-1]) > 0
    kept = [w for w, g in zip(words, gone.tolist()) if not g]
    return (len(own), *best, 1000 * best[1] // best[2], _sha(listed.encode()), _sha(b" ".join(kept)))


def _sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def describe(ids: list, texts: list[bytes], plant: bool) -> list[tuple]:
    """The result columns of each of a group of documents."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    split, coded, lengths = [], [], []
    for doc_id, text in zip(ids, texts):
        words = text.split()  # of bytes: at blanks, tabs and line-break characters of ASCII
        split.append(planted(words, doc_id) if plant else words)
        coded.append(np.fromiter(map(number.__getitem__, split[-1]), np.int64, len(words)))
        lengths.append(len(words) + 1)
    marks = np.arange(len(number), len(number) + len(texts), dtype=np.int64)
    joined = np.concatenate([x for pair in zip(coded, marks[:, None]) for x in pair])
    ends = np.cumsum(lengths)
    own: list[list] = [[] for _ in texts]
    for start, length, q in runs(joined, np.array(lengths)):
        if length >= LEAST:
            doc = int(np.searchsorted(ends, start, side="right"))
            own[doc].append((start - int(ends[doc]) + lengths[doc], length, q))
    return [_summary(w, sorted(o, key=lambda r: (r[0], r[2]))) for w, o in zip(split, own)]


RESULT = [
    ("n_runs", T.LongType()),
    ("start", T.LongType()),
    ("length", T.LongType()),
    ("period", T.LongType()),
    ("exponent_milli", T.LongType()),
    ("runs_sha256", T.StringType()),
    ("collapsed_sha256", T.StringType()),
]


def periodic_runs(docs: DataFrame, doc_id: str, text: str, plant: bool = False) -> DataFrame:
    """One row per row of ``docs``: the number of its runs, the run with most repetitions, and digests.

    Digests are those of the list of all runs and of the text without the repetitions: a word goes if a run holds it
    after the run's first period. ``plant`` first repeats part of the documents whose id's checksum ends in 0.

    Nulls: a null text has no words and no runs, and so has an empty one; a null id is never planted. Repeated rows
    each have their result. Of runs with as many repetitions the first counts, then the one with the smaller period.
    Further columns are left out. An empty table gives no rows. Memory follows the longest text.
    """
    rows = docs.select(F.col(doc_id).alias(doc_id), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    schema = T.StructType([rows.schema[0]] + [T.StructField(n, k) for n, k in RESULT])
    kinds = [pa.string() if isinstance(k, T.StringType) else pa.int64() for _, k in RESULT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).cast(pa.binary()) if batch.num_rows else ()
            out, at, size = [], 0, 0
            for i in range(batch.num_rows):
                size += len(column[i].as_buffer() or b"")
                if size >= GROUP_BYTES or i + 1 == batch.num_rows:
                    part = slice(at, i + 1)
                    texts = [x.as_py() for x in column[part]]
                    out += describe([x.as_py() for x in batch.column(0)[part]], texts, plant)
                    at, size = i + 1, 0
            columns = zip(*out) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=schema.names
            )

    return rows.mapInArrow(run, schema)
