"""Boosted trees and perceptrons of all folds, fitted side by side: one scan of the rows per step, not one per fold and step.

A fold's training side is all rows but the fold's own. The rows lie in persisted blocks of numpy arrays, in an order that follows
from their ids. In a step every block adds, for every fold, sums over its rows: histograms of the features for boosting, the loss and
its gradient for a perceptron. The driver holds these sums, bounded by folds, features and bins or by folds and coefficients;
folds are fitted ``WAVE`` at a time.

Boosting is Spark ML's ``GBTClassifier`` with all rows and features in each round: thresholds at equal weights of at most
``SAMPLE_ROWS`` rows of a training side, regression trees on the gradient of the log loss. A perceptron is its
``MultilayerPerceptronClassifier``: its first coefficients, sigmoid layers, softmax, L-BFGS. Rows of the smaller class count as
often as ``events.oversample`` repeats them.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochwise.operators.ordering import hash_key

#: Folds that are fitted at once: a block holds bins and margins for each of them.
WAVE = 16
#: Rows of a training side whose values give the thresholds of boosting, chosen by the hash of their ids; as many as Spark ML takes.
SAMPLE_ROWS = 10_000
#: Rounds after which the blocks' margins are stored anew; the trees since then are run by each step.
KEPT_ROUNDS = 10
#: Deepest trees that are fitted here: a level's histograms grow with its nodes.
MAX_DEPTH = 6
#: Partitions that small tables are spread over, with so many rows in each: a step of a perceptron has far more to do for a row.
SPREAD, BOOST_ROWS, PERCEPTRON_ROWS = 12, 4_000, 800
#: Partitions whose sums go straight to the driver; more are added up in executors before.
STRAIGHT = 32


@dataclass
class Side:
    """A fold's training side: the fold's number, offsets and divisors of the columns, weights of the classes 0 and 1."""

    fold: int
    low: np.ndarray
    width: np.ndarray
    weights: np.ndarray


def packed(placed: DataFrame, cols: Sequence[str], number: Column, id_col: str) -> RDD:
    """Blocks (x, y, fold number, hash of the id) of rows in their places."""
    picked = placed.select(
        F.col("y").cast("int").alias("y"),
        number.cast("int").alias("fold"),
        F.coalesce(F.unhex(F.substring(hash_key(id_col), 1, 16)), F.lit(bytes(8))).alias("hash"),
        *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)],
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if any(c.null_count for c in batch.columns):
                raise ValueError("a row to be fitted has no class, fold or feature value")
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[3:]])
            y, fold = (batch.column(i).to_numpy().astype("<i4") for i in (0, 1))
            flat = [x.astype("<f8").tobytes(), y.tobytes(), fold.tobytes(), b"".join(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in flat], names=["x", "y", "fold", "hash"])

    def unpack(row: T.Row) -> tuple[np.ndarray, ...]:
        x, y, fold, h = row
        return np.frombuffer(x, "<f8").reshape(-1, len(cols)), np.frombuffer(y, "<i4"), np.frombuffer(fold, "<i4"), np.frombuffer(h, ">u8").astype(np.uint64)

    return picked.mapInArrow(pack, "x binary, y binary, fold binary, hash binary").rdd.map(unpack)


def summed(blocks: RDD, sums: Callable[..., np.ndarray]) -> np.ndarray:
    """``sums(*block)`` added up over all blocks."""

    def run(found: Iterator[tuple]) -> Iterator[np.ndarray]:
        total = None
        for block in found:
            part = sums(*block)
            total = part if total is None else total + part
        if total is not None:
            yield total

    per = blocks.mapPartitions(run)
    return per.reduce(add) if blocks.getNumPartitions() <= STRAIGHT else per.treeReduce(add)


# boosting


@dataclass
class Boosted:
    """Trees of one fold, complete to their depth: per round the features and last left bins of the nodes, and the leaves' values.

    A node that isn't split sends all to its left.
    """

    cuts: list[np.ndarray]
    feature: np.ndarray
    last: np.ndarray
    value: np.ndarray

    def p(self, x: np.ndarray) -> np.ndarray:
        margin = _margins(_codes(x, self.cuts), self.feature, self.last, self.value)
        return 1 / (1 + np.exp(-2 * margin))


def _codes(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of the columns: the number of cuts that lie below a value."""
    return np.column_stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)]).astype(np.uint8)


def _down(codes: np.ndarray, feature: np.ndarray, last: np.ndarray, levels: int) -> np.ndarray:
    """Number, within its level, of the node that each row reaches after so many levels of a tree."""
    node, each = np.zeros(len(codes), np.int64), np.arange(len(codes))
    for level in range(levels):
        at = node + (1 << level) - 1
        node = 2 * node + (codes[each, feature[at]] > last[at])
    return node


def _margins(codes: np.ndarray, feature: np.ndarray, last: np.ndarray, value: np.ndarray) -> np.ndarray:
    levels, out = int(value.shape[1]).bit_length() - 1, np.zeros(len(codes))
    for f, b, v in zip(feature, last, value):
        out += v[_down(codes, f, b, levels)]
    return out


def _thresholds(value: np.ndarray, weight: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between neighbouring values, at about equal weights; all of them where they are few."""
    found, at = np.unique(value, return_inverse=True)
    weights = np.bincount(at, weight)
    middle = (found[:-1] + found[1:]) / 2
    if len(middle) < bins:
        return middle
    upto = np.cumsum(weights)
    stride, out = upto[-1] / bins, []
    target = stride
    for i in range(1, len(found)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def cut_points(blocks: RDD, d: int, sides: Sequence[Side], sizes: np.ndarray, bins: int) -> list[list[np.ndarray]]:
    """Thresholds of every side and column; a column's values meet in one place, ``SAMPLE_ROWS`` of a side at most."""
    share = [min(1.0, SAMPLE_ROWS / max(int(sizes.sum() - sizes[s.fold].sum()), 1)) for s in sides]
    limits = [np.uint64(min(v * 2.0**64, 2.0**64 - 2048)) if v < 1 else np.uint64(2**64 - 1) for v in share]

    def spread(block: tuple) -> Iterator[tuple]:
        x, y, fold, h = block
        kept = h <= max(limits)
        for j in range(d):
            yield j, (x[kept, j], y[kept], fold[kept], h[kept])

    def cuts(parts: Sequence[tuple]) -> list[np.ndarray]:
        v, y, fold, h = (np.concatenate(c) for c in zip(*parts))
        use = [(h <= limit) & (fold != s.fold) for s, limit in zip(sides, limits)]
        return [_thresholds(v[u], s.weights[y[u]], bins) for s, u in zip(sides, use)]

    gathered = blocks.flatMap(spread).groupByKey(min(d, blocks.getNumPartitions())).mapValues(lambda p: cuts(list(p)))
    found = dict(gathered.collect())
    return [[found[j][k] for j in range(d)] for k in range(len(sides))]


def boost(blocks: RDD, d: int, sides: Sequence[Side], sizes: np.ndarray, estimator: GBTClassifier) -> list[Boosted]:
    """A boosting model for each side; a round has one scan per level of its trees."""
    depth, rounds, rate = estimator.getMaxDepth(), estimator.getMaxIter(), estimator.getStepSize()
    cuts = cut_points(blocks, d, sides, sizes, estimator.getMaxBins())
    bins, n = 1 + max(len(c) for side in cuts for c in side), len(sides)
    feature, last = np.zeros((n, rounds, (1 << depth) - 1), np.int64), np.full((n, rounds, (1 << depth) - 1), 255, np.int64)
    value = np.zeros((n, rounds, 1 << depth))

    def coded(block: tuple) -> tuple:
        x, y, fold, _ = block
        return np.stack([_codes(x, c) for c in cuts]), y, fold, np.zeros((n, len(y)))

    held = blocks.map(coded).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        kept = 0
        for m in range(rounds):
            if m - kept == KEPT_ROUNDS:
                since = feature[:, kept:m].copy(), last[:, kept:m].copy(), value[:, kept:m].copy()

                def moved(block: tuple, since=since) -> tuple:
                    codes, y, fold, margin = block
                    return codes, y, fold, margin + np.stack([_margins(c, *t) for c, *t in zip(codes, *since)])

                before, held, kept = held, held.map(moved).persist(StorageLevel.MEMORY_AND_DISK), m
                held.count()
                before.unpersist()
            for level in range(depth):
                trees = feature[:, kept : m + 1].copy(), last[:, kept : m + 1].copy(), value[:, kept : m + 1].copy()
                sums = summed(held, lambda *block, t=trees, v=level, first=m == 0: _histograms(sides, d, bins, t, v, first, *block))
                for k in range(n):
                    _split(sums[k], cuts[k], sides[k].weights.min() / 2, level, depth, feature[k, m], last[k, m], value[k, m])
            value[:, m] *= 1.0 if m == 0 else rate
    finally:
        held.unpersist()
    return [Boosted(c, *t) for c, *t in zip(cuts, feature, last, value)]


def _histograms(sides, d, bins, trees, level, first, codes, y, fold, margin) -> np.ndarray:
    """Per side, for weights and weighted gradients: sums by column, node of the level and bin."""
    out = np.zeros((len(sides), 2, d, 1 << level, bins))
    for k, side in enumerate(sides):
        use = np.flatnonzero(fold != side.fold)
        if not len(use):
            continue
        code, sign = codes[k][use], 2.0 * y[use] - 1
        feature, last, value = (t[k] for t in trees)
        now = margin[k][use] + _margins(code, feature[:-1], last[:-1], value[:-1])
        pull = sign if first else 4 * sign / (1 + np.exp(2 * sign * now))
        node = _down(code, feature[-1], last[-1], level)
        key = ((np.arange(d) << level) + node[:, None]) * bins + code
        w = side.weights[y[use]]
        for i, v in enumerate((w, w * pull)):
            out[k, i] = np.bincount(key.ravel(), np.repeat(v, d), minlength=out[k, i].size).reshape(out[k, i].shape)
    return out


def _split(sums, cuts, least, level, depth, feature, last, value) -> None:
    """Set the nodes of a level, and their leaves, from the sums of their rows. What weighs less than ``least`` has no row."""
    upto = np.cumsum(sums, axis=3)
    for node in range(1 << level):
        w, s = upto[0, 0, node, -1], upto[1, 0, node, -1]
        if w < least:
            continue
        span = 1 << (depth - level)
        leaves = value[node * span : (node + 1) * span]
        leaves[:] = s / w
        wl, sl = upto[:, :, node, :-1]
        wr, sr = w - wl, s - sl
        real = np.arange(wl.shape[1]) < np.array([len(c) for c in cuts])[:, None]
        open_ = real & (wl > least) & (wr > least)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(open_, (sl * sl / wl + sr * sr / wr - s * s / w) / w, 0.0)
        if not gain.size or gain.max() <= 1e-15:
            continue
        j, b = np.unravel_index(np.argmax(gain), gain.shape)
        feature[(1 << level) - 1 + node], last[(1 << level) - 1 + node] = j, b
        leaves[: span // 2], leaves[span // 2 :] = sl[j, b] / wl[j, b], sr[j, b] / wr[j, b]


# perceptrons


@dataclass
class Perceptron:
    """Coefficients of one fold, by layer the weights and then the offsets."""

    side: Side
    layers: list[int]
    theta: np.ndarray

    def p(self, x: np.ndarray) -> np.ndarray:
        return _forward((x - self.side.low) / self.side.width, _layers(self.theta, self.layers))[-1][:, 1]


def _layers(theta: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(layers[:-1], layers[1:]):
        out.append((theta[at : at + a * b].reshape(a, b), theta[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def _forward(x: np.ndarray, layers: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    out = [x]
    for i, (a, b) in enumerate(layers):
        z = out[-1] @ a + b
        if i + 1 < len(layers):
            out.append(1 / (1 + np.exp(-np.clip(z, -700, 700))))
        else:
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(z / z.sum(axis=1, keepdims=True))
    return out


def _loss(theta: np.ndarray, layers: Sequence[int], x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum of the weighted losses, and their gradient."""
    parts = _layers(theta, layers)
    out = _forward(x, parts)
    each = np.arange(len(y))
    loss = -(w * np.log(np.maximum(out[-1][each, y], 1e-300))).sum()
    delta = out[-1].copy()
    delta[each, y] -= 1
    delta *= w[:, None]
    found = []
    for i in range(len(parts) - 1, -1, -1):
        found += [delta.sum(axis=0), (out[i].T @ delta).ravel()]
        if i:
            delta = (delta @ parts[i][0].T) * out[i] * (1 - out[i])
    return np.concatenate([[loss], *found[::-1]])


def copies(blocks: RDD, sides: Sequence[Side], sizes: np.ndarray) -> list[Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    """For every side the number of copies of its rows, from their classes and hashes, as ``events.oversample`` repeats them.

    Rows of one hash at the end of the remainder share it.
    """
    n = np.array([sizes.sum(axis=0) - sizes[s.fold] for s in sides])
    small = n.argmin(axis=1)
    less, more = n.min(axis=1), n.max(axis=1)
    whole, rest = more // less, more % less
    prefix, wanted = np.zeros(len(sides), np.uint64), rest.copy()
    # the hash at which the remainder ends, 16 bits at a time
    for shift in (48, 32, 16, 0):

        def digits(x, y, fold, h, shift=shift, prefix=prefix.copy()) -> np.ndarray:
            out = np.zeros((len(sides), 1 << 16), np.int64)
            for k, s in enumerate(sides):
                use = (fold != s.fold) & (y == small[k])
                if shift < 48:
                    use &= h >> np.uint64(shift + 16) == prefix[k]
                out[k] = np.bincount(((h[use] >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
            return out

        for k, found in enumerate(summed(blocks, digits)):
            upto = np.cumsum(found)
            digit = min(int(np.searchsorted(upto, wanted[k])), (1 << 16) - 1)
            prefix[k] = (prefix[k] << np.uint64(16)) | np.uint64(digit)
            wanted[k] -= upto[digit] - found[digit]
            last = found[digit]
            if shift == 0:
                wanted[k] = (wanted[k] << 32) // max(int(last), 1)  # a fixed-point share

    def counter(k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        end, share, cls, times, some = prefix[k], wanted[k] / 2.0**32, small[k], float(whole[k]), bool(rest[k])

        def count(y: np.ndarray, h: np.ndarray) -> np.ndarray:
            extra = np.where(h < end, 1.0, np.where(h == end, share, 0.0)) if some else 0.0
            return np.where(y == cls, times + extra, 1.0)

        return count

    return [counter(k) for k in range(len(sides))]


def perceive(blocks: RDD, d: int, sides: Sequence[Side], sizes: np.ndarray, estimator: MultilayerPerceptronClassifier, first: np.ndarray) -> list[Perceptron]:
    """A perceptron for each side, from the coefficients ``first``; a step of all sides is one scan."""
    layers, counts = estimator.getLayers(), copies(blocks, sides, sizes)
    total = [2.0 * (sizes.sum(axis=0) - sizes[s.fold]).max() for s in sides]
    runs = [lbfgs(first, estimator.getMaxIter(), estimator.getTol()) for _ in sides]
    asked, done = {k: next(r) for k, r in enumerate(runs)}, {}
    while asked:

        def losses(x, y, fold, h, asked=dict(asked)) -> np.ndarray:
            out = np.zeros((len(asked), len(first) + 1))
            for row, (k, theta) in zip(out, asked.items()):
                use = fold != sides[k].fold
                if use.any():
                    z = (x[use] - sides[k].low) / sides[k].width
                    row[:] = _loss(theta, layers, z, y[use], counts[k](y[use], h[use]))
            return out

        sums, now = summed(blocks, losses), {}
        for k, row in zip(asked, sums):
            try:
                now[k] = runs[k].send((row[0] / total[k], row[1:] / total[k]))
            except StopIteration as end:
                done[k] = end.value
        asked = now
    return [Perceptron(s, layers, done[k]) for k, s in enumerate(sides)]


Ask = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


def lbfgs(x: np.ndarray, most: int, tol: float, memory: int = 10) -> Ask:
    """Minimise: yields points, is sent their (value, gradient), returns the last point.

    Ends after ``most`` steps, or when a value is within ``tol`` of the largest of the twenty before it, or the gradient is.
    """
    value, slope = yield x
    start, values, pairs, fresh = value, [], [], True
    for step in range(most):
        if np.linalg.norm(slope) <= max(tol * value, 1e-8):
            break
        way, used = -slope, []
        for s, t in reversed(pairs):
            a = (s @ way) / (s @ t)
            used.append(a)
            way = way - a * t
        if pairs:
            s, t = pairs[-1]
            way = way * ((s @ t) / (t @ t))
        for (s, t), a in zip(pairs, reversed(used)):
            way = way + s * (a - (t @ way) / (s @ t))
        found = yield from _search(x, value, slope, way, 1.0 if pairs else 1 / np.linalg.norm(way))
        if found is None:
            if fresh:
                break
            pairs, fresh = [], True
            continue
        fresh = False
        there, new, steep = found
        s, t = there - x, steep - slope
        if s @ t > 0:
            pairs = [*pairs, (s, t)][-memory:]
        values = [*values, value][-20:]
        x, value, slope = there, new, steep
        if len(values) == 20 and abs(value - max(values)) <= tol * start:
            break
    return x


def _search(x, value, slope, way, a, tries: int = 20):
    """(point, value, gradient) along ``way`` that meets the strong Wolfe conditions, the best so far after ``tries``, or none."""
    down = slope @ way
    if down >= 0:
        return None
    low, high, best = (0.0, value, down), None, None
    for _ in range(tries):
        there = x + a * way
        new, steep = yield there
        at = steep @ way
        fine = np.isfinite(new) and new <= value + 1e-4 * a * down
        if fine and (best is None or new < best[1]):
            best = there, new, steep
        if not fine or new >= low[1] and low[0] > 0:
            high = (a, new, at)
        else:
            if abs(at) <= -0.9 * down:
                return there, new, steep
            if at * ((high[0] if high else np.inf) - low[0]) >= 0:
                high = low
            low = (a, new, at)
        if high is None:
            a *= 1.5
            continue
        # the least point of the cubic through both ends, kept off them
        (l, fl, gl), (h, fh, gh) = low, high
        with np.errstate(all="ignore"):
            e = gl + gh - 3 * (fl - fh) / (l - h)
            r = np.sign(h - l) * np.sqrt(e * e - gl * gh)
            a = h - (h - l) * (gh + r - e) / (gh - gl + 2 * r)
        near, far = min(l, h), max(l, h)
        margin = 0.1 * (far - near)
        a = float(np.clip(a, near + margin, far - margin)) if np.isfinite(a) else (l + h) / 2
    return best


# both


def fits(estimator) -> bool:
    """Whether the folds of such a model can be fitted here."""
    if isinstance(estimator, MultilayerPerceptronClassifier):
        return estimator.getSolver() == "l-bfgs" and estimator.getLayers()[-1] == 2
    return (
        isinstance(estimator, GBTClassifier)
        and 0 < estimator.getMaxDepth() <= MAX_DEPTH
        and estimator.getMaxBins() <= 256
        and estimator.getSubsamplingRate() == 1.0
        and estimator.getFeatureSubsetStrategy() == "all"
        and estimator.getMinInstancesPerNode() == 1
        and estimator.getMinInfoGain() == estimator.getMinWeightFractionPerNode() == 0.0
    )


def part_rows(n: int, estimator, most: int) -> int:
    """Rows of a partition: few enough to spread small tables, and ``most`` in large ones."""
    few = PERCEPTRON_ROWS if isinstance(estimator, MultilayerPerceptronClassifier) else BOOST_ROWS
    return min(most, max(few, -(-n // SPREAD)))


def fit(placed: DataFrame, cols: Sequence[str], number: Column, count: int, sides: Sequence[Side], estimator, id_col: str = "id") -> list:
    """A model for each side, in their order. ``number``: a row's fold, counted from 0; there are ``count`` of them."""
    d, out = len(cols), []
    first = None
    if isinstance(estimator, MultilayerPerceptronClassifier):
        # Spark's own first coefficients: they follow from the seed and the layers
        two = placed.sparkSession.createDataFrame([(Vectors.dense([0.0] * d), 0.0), (Vectors.dense([1.0] * d), 1.0)], ["_x", "y"])
        first = estimator.copy({estimator.maxIter: 0}).fit(two.coalesce(1)).weights.toArray()
    blocks = packed(placed, cols, number, id_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:

        def classes(x, y, fold, h) -> np.ndarray:
            out = np.zeros((count, 2), np.int64)
            np.add.at(out, (fold, y), 1)
            return out

        sizes = summed(blocks, classes)
        for at in range(0, len(sides), WAVE):
            wave = sides[at : at + WAVE]
            if first is None:
                out += boost(blocks, d, wave, sizes, estimator)
            else:
                out += perceive(blocks, d, wave, sizes, estimator, first)
    finally:
        blocks.unpersist()
    return out


def score(rows: DataFrame, cols: Sequence[str], number: Column, models: dict[int, object], keep: Sequence[Column]) -> DataFrame:
    """(keep, p): every row by the model of its own fold; rows of folds without one are left out."""
    kept = rows.select(*keep, number.cast("int").alias("_number"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    kept = kept.filter(F.col("_number").isin(list(models)))
    first = len(keep)
    schema = T.StructType([*kept.schema.fields[:first], T.StructField("p", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column(first).to_numpy()
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[first + 1 :]])
            p = np.zeros(len(fold))
            for k in np.unique(fold):
                p[fold == k] = models[int(k)].p(x[fold == k])
            yield pa.RecordBatch.from_arrays([*batch.columns[:first], pa.array(p)], names=schema.names)

    return kept.mapInArrow(run, schema)
