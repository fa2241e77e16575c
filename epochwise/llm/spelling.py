"""Spelling variants: words one insertion, deletion or replacement apart, through a bidirectional FM-index.

1. Words and their numbers of occurrences come from all texts, pre-counted per task.
2. One error leaves one half of a word as it is. So a word only meets the words that begin with its first half, and
   those that end with its last half. Each word is listed under the halves that a word as long as it, or one letter
   longer or shorter, can have, and asks under its own two. Words are dealt to tasks by these halves; a half with
   more than ``BLOCK`` words is cut into parts by the hash of the words, and who asks there asks in all parts.
3. A task holds the words it was dealt as one delimited text, ``$word$word...``, with the rank structures of its
   cyclic rotations and of those of the reversed text. A search matches ``$`` and the first half from right to left in
   one, keeping the interval of ranks in the other in step, and then extends to the right there, letter by
   letter up to the next ``$``, with one error allowed: all next letters of an interval are listed, and each that isn't the
   word's own is taken as a replacement or an insertion; leaving out the word's next letter is a deletion. An
   interval that holds the asking word alone is left. The last half is matched and extended to the left
   in the mirror image. All searches of a task go on in step, as arrays.
4. A pair is found once: errors in runs of a letter count at the run's end, and what begins with the first half isn't
   taken from the search by the last half.

Every near pair is found; nothing is cut off. A task's memory follows ``TASK_LETTERS`` and the longest word.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochwise.session import discard, materialise

#: Most words of one half that are held together.
BLOCK = 8_192
#: Letters of the words dealt to one task, about.
TASK_LETTERS = 400_000
#: Distinct words counted in a task before they are passed on.
HELD_WORDS = 300_000

# fixed values: the letters of a word; only A-Z are lower-cased
_LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0xC0, 0x100))
_LOWER = bytes(x for x in _LETTERS).lower()
#: Code points to letters; all else to a blank.
_TABLE = bytes(_LOWER[_LETTERS.index(x)] if x in _LETTERS else 0x20 for x in range(256))


# counting --------------------------------------------------------------------------------------------


def damaged(doc_id, words: Counter, every: int, least: int) -> Iterator[tuple[bytes, int]]:
    """Words of a document (in Latin-1) with their counts; each ``every``-th by checksum lacks one letter."""
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, count in words.items():
        size = len(word)
        if size < least:
            continue
        raw = word if word.isascii() else word.decode("latin-1").encode()
        h = zlib.crc32(raw, head)
        if every and h % every == 0:
            at = h % size
            word = word[:at] + word[at + 1 :]
            if size - 1 < least:
                continue
        yield word, count


def count_words(
    docs: DataFrame, doc_id: str, text: str, every: int = 199, least: int = 6, occurrences: int = 5
) -> DataFrame:
    """(word, n): the words of ``least`` letters or more that occur ``occurrences`` times or more in all texts.

    Null and empty texts have no words; a null id counts as the empty string in the checksum; a row that is there
    twice counts twice. Further columns aren't read. Empty tables give no rows.
    """
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def passed_on():
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=schema.names)

        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1)):
                # one byte for each code point; those above Latin-1 become a question mark, which ends a word
                letters = (value.as_py() or "").encode("latin-1", "replace").translate(_TABLE)
                for word, count in damaged(key.as_py(), Counter(letters.split()), every, least):
                    held[word] += count
                if len(held) >= HELD_WORDS:
                    yield passed_on()
                    held.clear()
        if held:
            yield passed_on()

    rows = docs.select(F.col(doc_id).alias("key"), F.col(text).cast("string").alias("text"))
    counted = rows.mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= occurrences)


# the index -------------------------------------------------------------------------------------------


def rotations(text: np.ndarray, bits: int) -> np.ndarray:
    """Starts of the cyclic rotations of ``text`` in their order, by doubling the length that is compared."""
    n, have = len(text), 1
    key = text.astype(np.int64)
    while have * 2 * bits <= 62:
        key = key << (bits * have) | np.roll(key, -have)
        have *= 2
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        placed = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(placed[1:] != placed[:-1])])
        if have >= n or rank[order[-1]] == n - 1:
            return order
        key = rank << 31 | np.roll(rank, -have)
        have *= 2


class Ranks:
    """The letters before the rotations of a text, in their order, as a wavelet matrix.

    For an interval of rotations it gives the interval after one more letter in front, and how many
    rotations of the interval have a smaller letter there, which moves the interval of the mirrored index.
    """

    def __init__(self, text: np.ndarray, bits: int):
        self.bits, self.order = bits, rotations(text, bits)
        letters = text[self.order - 1]
        sizes = np.bincount(text, minlength=(1 << bits) + 1)
        first = np.concatenate([[0], np.cumsum(sizes)])[: 1 << bits]
        self.zeros_before, self.zeros = [], []
        now = letters
        for level in range(bits - 1, -1, -1):
            one = (now >> level & 1).astype(bool)
            self.zeros_before.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))
            self.zeros.append(int(self.zeros_before[-1][-1]))
            now = np.concatenate([now[~one], now[one]])
        # where each letter's places begin behind the last level, against where its rotations begin
        begin = np.zeros(1 << bits, np.int64)
        for letter in range(1 << bits):
            at = 0
            for k in range(bits):
                z = int(self.zeros_before[k][at])
                at = self.zeros[k] + at - z if letter >> bits - 1 - k & 1 else z
            begin[letter] = at
        self.shift = first - begin

    def step(self, low: np.ndarray, high: np.ndarray, letter: np.ndarray):
        """(low, high, smaller) after ``letter`` in front of each interval."""
        smaller = np.zeros(len(low), np.int64)
        for k in range(self.bits):
            before, zeros = self.zeros_before[k], self.zeros[k]
            zl, zh = before[low].astype(np.int64), before[high].astype(np.int64)
            one = (letter >> self.bits - 1 - k & 1).astype(bool)
            smaller += np.where(one, zh - zl, 0)
            low, high = np.where(one, zeros + low - zl, zl), np.where(one, zeros + high - zh, zh)
        return low + self.shift[letter], high + self.shift[letter], smaller

    def letters(self, low: np.ndarray, high: np.ndarray):
        """(interval number, letter, low, high) for all letters before the rotations of the intervals."""
        which, letter = np.arange(len(low)), np.zeros(len(low), np.int64)
        for k in range(self.bits):
            before, zeros = self.zeros_before[k], self.zeros[k]
            zl, zh = before[low].astype(np.int64), before[high].astype(np.int64)
            left, right = zh > zl, high - zh > low - zl
            which = np.concatenate([which[left], which[right]])
            letter = np.concatenate([letter[left] << 1, letter[right] << 1 | 1])
            low, high = (
                np.concatenate([zl[left], zeros + (low - zl)[right]]),
                np.concatenate([zh[left], zeros + (high - zh)[right]]),
            )
        return which, letter, low + self.shift[letter], high + self.shift[letter]


class Vocabulary:
    """Distinct words in code-point order, as a delimited text with both indexes."""

    def __init__(self, words: list[str]):
        self.words = words
        points = np.frombuffer(("\0" + "\0".join(words)).encode("utf-32-le"), np.uint32)
        letters = np.unique(points)
        text = np.searchsorted(letters, points).astype(np.int64)
        bits = max(1, int(len(letters) - 1).bit_length())
        self.text, self.n = text, len(text)
        self.begin = np.flatnonzero(text == 0)
        self.size = np.diff(np.concatenate([self.begin, [self.n]])) - 1
        self.forward, self.backward = Ranks(text, bits), Ranks(text[::-1].copy(), bits)

    def _letters(self, word: np.ndarray, at: np.ndarray, mirrored: bool) -> np.ndarray:
        """The letter of each word at ``at``, counted from its end if mirrored; the delimiter before and behind it."""
        inside = (at >= 0) & (at < self.size[word])
        place = self.begin[word] + np.where(mirrored, self.size[word] - at, at + 1)
        return np.where(inside, self.text[np.where(inside, place, 0)], 0)

    def search(self, asking: np.ndarray, exact: np.ndarray, mirrored: bool) -> tuple[np.ndarray, np.ndarray]:
        """(number of the asking word in ``asking``, near word) for all near words that agree in the ``exact`` first letters.

        ``mirrored``: in the last letters.
        """
        near, far = (self.backward, self.forward) if mirrored else (self.forward, self.backward)
        low = np.zeros(len(asking), np.int64)
        high, other = low + self.n, low.copy()
        # the exact part from its inner end outwards, and the delimiter
        for t in range(int(exact.max(initial=0)) + 1):
            on = np.flatnonzero(exact >= t)
            letter = np.where(t == exact[on], 0, self._letters(asking[on], exact[on] - 1 - t, mirrored))
            low[on], high[on], smaller = near.step(low[on], high[on], letter)
            other[on] += smaller
        who = np.arange(len(asking))
        state = (who, other, other + high - low, exact.copy(), np.zeros(len(asking), bool))
        pairs = []
        while len(state[0]):
            who, low, high, at, erred = state
            word = asking[who]
            new = []
            # one error made: the rest as it is
            late = np.flatnonzero(erred)
            if len(late):
                letter = self._letters(word[late], at[late], mirrored)
                l, h, _ = far.step(low[late], high[late], letter)
                alive = h > l
                ended = alive & (letter == 0)
                pairs.append((who[late][ended], l[ended]))
                on = alive & (letter != 0)
                new.append((who[late][on], l[on], h[on], at[late][on] + 1, np.ones(int(on.sum()), bool)))
            # none made, and more than the word itself in the interval
            early = np.flatnonzero(~erred & (high - low > 1))
            if len(early):
                w, a, q = word[early], at[early], who[early]
                own = self._letters(w, a, mirrored)
                after = self._letters(w, a + 1, mirrored)
                out = (own != 0) & (own != after)
                new.append((q[out], low[early][out], high[early][out], a[out] + 1, np.ones(int(out.sum()), bool)))
                i, letter, l, h = far.letters(low[early], high[early])
                same = letter == own[i]
                on = same & (letter != 0)
                new.append((q[i][on], l[on], h[on], a[i][on] + 1, np.zeros(int(on.sum()), bool)))
                other = ~same & (letter != 0)
                put = other & (own[i] != 0)
                new.append((q[i][put], l[put], h[put], a[i][put] + 1, np.ones(int(put.sum()), bool)))
                new.append((q[i][other], l[other], h[other], a[i][other], np.ones(int(other.sum()), bool)))
            state = tuple(map(np.concatenate, zip(*new))) if new else ([],) * 5
        if not pairs:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        who, rank = map(np.concatenate, zip(*pairs))
        # the rotation begins with the delimiter before the word, in the mirrored text with the one behind it
        start = far.order[rank]
        if mirrored:
            return who, np.searchsorted(self.begin, start)
        behind = np.searchsorted(self.begin, self.n - 1 - start)
        return who, (behind - 1) % len(self.words)


# dealing ---------------------------------------------------------------------------------------------


def _listed(words: DataFrame) -> DataFrame:
    """(mirrored, half, word, n, asks): each word under the halves it may have to be found by, and where it asks itself."""
    size = F.length("word")
    firsts = F.array_distinct(F.array(*(F.floor((size + d) / 2).cast("int") for d in (-1, 0, 1))))
    lasts = F.array_distinct(F.array(*(F.ceil((size + d) / 2).cast("int") for d in (-1, 0, 1))))
    first = words.select("word", "n", F.lit(False).alias("mirrored"), F.explode(firsts).alias("k"))
    last = words.select("word", "n", F.lit(True).alias("mirrored"), F.explode(lasts).alias("k"))
    first = first.withColumn("half", F.expr("substring(word, 1, k)")).withColumn("asks", F.col("k") == F.floor(size / 2))
    last = last.withColumn("half", F.expr("substring(word, length(word) - k + 1, k)")).withColumn(
        "asks", F.col("k") == F.ceil(size / 2)
    )
    return first.unionByName(last).select("mirrored", "half", "word", "n", "asks")


def _dealt(words: DataFrame, block: int) -> DataFrame:
    """``_listed`` with ``part`` and ``home``: halves of more than ``block`` words in parts, in one of which a word is at home."""
    rows = _listed(words)
    large = rows.groupBy("mirrored", "half").agg(F.count("*").alias("size")).filter(F.col("size") > block)
    large = materialise(large.select("mirrored", "half", F.ceil(F.col("size") / block).cast("int").alias("parts")), "halves")
    if large.isEmpty():
        return rows.select("*", F.lit(0).alias("part"), F.lit(True).alias("home"))
    rows = rows.join(large, ["mirrored", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("parts") - 1)
    rows = rows.withColumn("_own", own).withColumn("part", F.explode(F.when(F.col("asks"), everywhere).otherwise(F.array(own))))
    return rows.select("mirrored", "half", "word", "n", "asks", "part", (F.col("_own") == F.col("part")).alias("home"))


def _found(table: pa.Table) -> pa.RecordBatch:
    """(word, n_near, form_n, form) for the words that ask in this task, where they have near words here."""
    words = sorted(set(table.column("word").to_pylist()))
    number = {w: i for i, w in enumerate(words)}
    word = np.fromiter((number[w] for w in table.column("word").to_pylist()), np.int64, table.num_rows)
    n = np.zeros(len(words), np.int64)
    n[word] = table.column("n").to_numpy()
    mirrored = np.array(table.column("mirrored").to_pylist(), bool)
    halves: dict = {}
    keys = zip(table.column("mirrored").to_pylist(), table.column("half").to_pylist(), table.column("part").to_pylist())
    group = np.fromiter((halves.setdefault(k, len(halves)) for k in keys), np.int64, table.num_rows)
    home = np.array(table.column("home").to_pylist(), bool)
    asks = np.array(table.column("asks").to_pylist(), bool)
    members = np.unique(group[home] * len(words) + word[home])
    vocabulary = Vocabulary(words)
    asked, near = [], []
    for side in (False, True):
        rows = np.flatnonzero(asks & (mirrored == side))
        if not len(rows):
            continue
        size = vocabulary.size[word[rows]]
        who, met = vocabulary.search(word[rows], size - size // 2 if side else size // 2, side)
        # only words listed under the half that was asked for: the others are met elsewhere
        meant = group[rows[who]] * len(words) + met
        at = np.searchsorted(members, meant)
        ok = (at < len(members)) & (members[np.minimum(at, len(members) - 1)] == meant)
        q, met = word[rows[who[ok]]], met[ok]
        if side:
            begins = (words[b].startswith(words[a][: len(words[a]) // 2]) for a, b in zip(q.tolist(), met.tolist()))
            fresh = ~np.fromiter(begins, bool, len(q))
            q, met = q[fresh], met[fresh]
        asked.append(q)
        near.append(met)
    q = np.concatenate(asked) if asked else np.empty(0, np.int64)
    met = np.concatenate(near) if near else q
    order = np.lexsort((met, -n[met], q))
    q, met = q[order], met[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, np.int64)
    counts = np.diff(np.concatenate([first, [len(q)]]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([words[i] for i in q[first].tolist()], pa.string()),
            pa.array(counts, pa.int64()),
            pa.array(n[met[first]], pa.int64()),
            pa.array([words[i] for i in met[first].tolist()], pa.string()),
        ],
        names=["word", "n_near", "form_n", "form"],
    )


def nearest_forms(words: DataFrame, block: int = BLOCK, task_letters: int = TASK_LETTERS) -> DataFrame:
    """(word, n, n_near, best, best_n): how many near words each word has, and the one that occurs most.

    ``words``: (word, n), each word once, without nulls; the character NUL can't be part of a word. Ties go to the word
    that is smaller by code points. Words of any length are taken, and words without near words keep their row.
    """
    letters = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    tasks = max(1, math.ceil(4 * letters / task_letters))
    rows = _dealt(words, block).repartition(tasks, "mirrored", "half", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield _found(pa.Table.from_batches(held))

    met = rows.mapInArrow(run, "word string, n_near long, form_n long, form string")
    best = met.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    )
    joined = words.join(best, "word", "left")
    return joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.col("best.form").alias("best"),
        (-F.col("best.less")).alias("best_n"),
    )


def _roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) of the words with a form: each round follows twice as many forms as the one before."""
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, steps))))):
        stored = materialise(now, "roots")
        onward = stored.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        now = stored.join(onward, "root", "left").select("word", F.coalesce("_on", "root").alias("root"))
    return now


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of ``words`` (word, n).

    A word's form is its most frequent near word, if that occurs ``ratio`` times as often as the word or more; the root is
    reached by following forms, and is the word itself without one. Counts grow by ``ratio`` with each form,
    which bounds the number of forms that can follow one another.
    """
    words = materialise(words, "words")
    met = nearest_forms(words)
    has = F.col("best_n") >= ratio * F.col("n")
    out = met.select(
        "word", "n", "n_near", F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")
    )
    out = materialise(out, "forms")
    low, high = words.agg(F.min("n"), F.max("n")).first()
    steps = 0
    while low and low * ratio <= high:
        low, steps = low * ratio, steps + 1
    roots = _roots(out.filter("form IS NOT NULL"), steps)
    joined = out.join(roots, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
