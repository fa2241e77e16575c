"""Forests of all folds: a task grows whole trees and asks them at once for the votes of the held-out rows.

A fold's rows are coded as the bins of its thresholds, one byte a value, and dealt to some tasks of the fold; each grows its share
of the trees, level by level, on its training rows while the held-out rows go down with them. What leaves a task are votes; no
tree is kept, and the driver holds the thresholds alone. A task holds the bins of all rows, so tables of more than ``CELLS``
values are left to Spark ML, which adds up statistics of partitions instead.

The trees follow Spark ML's ``RandomForestClassifier``: thresholds as in ``together``, Poisson bags, a draw of columns for each
node, splits by Gini, leaves with one prediction joined to their parent, and shares of classes as votes. What is drawn differs: it
follows from the seed, the tree and the order of the rows' hashes, so neither tasks nor partitions matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwise.operators import together
from epochwise.operators.ordering import hash_key

#: Most values (rows times columns) of a table whose trees are grown here: a byte each in every task.
CELLS = 1 << 27
#: Most classes, as Spark ML has it where they aren't declared.
CLASSES = 100
#: Tasks that the trees of all folds are dealt to: so many for each core, and no more than ``TASKS`` unless there are more folds.
PER_CORE, TASKS = 4, 128
#: Most cells of a histogram of one column, by node, bin and class; nodes beyond are searched in portions.
PORTION = 1 << 20
#: Votes are whole numbers of this share, so their sums don't depend on their order.
VOTE = 2.0**-40


@dataclass
class Side:
    """A fold's training side: the fold's number and the weights of the classes."""

    fold: int
    weights: np.ndarray


def fits(estimator, rows: int, d: int) -> bool:
    """Whether such a forest is grown here."""
    return (
        isinstance(estimator, RandomForestClassifier)
        and rows * d <= CELLS
        and estimator.getMaxBins() <= 256
        and estimator.getImpurity() == "gini"
        and estimator.getSubsamplingRate() == 1.0
        and estimator.getBootstrap()
        and estimator.getNumTrees() > 1
        and estimator.getFeatureSubsetStrategy() in ("auto", "sqrt")
        and estimator.getMinInstancesPerNode() == 1
        and estimator.getMinInfoGain() == estimator.getMinWeightFractionPerNode() == 0.0
    )


class Bag:
    """The rows a tree is grown on, by the node they have reached, or those that ask it."""

    def __init__(self, rows: np.ndarray, d: int):
        self.rows, self.base, self.node = rows, rows * d, np.zeros(len(rows), np.int64)

    def keep(self, kept: np.ndarray) -> None:
        self.rows, self.base, self.node = self.rows[kept], self.base[kept], self.node[kept]

    def down(self, flat: np.ndarray, feature: np.ndarray, last: np.ndarray) -> None:
        """To the left child where the bin is ``last`` or below; children are numbered in pairs."""
        right = flat.take(self.base + feature.take(self.node)) > last.take(self.node)
        self.node = 2 * self.node + right


def vote(codes: np.ndarray, y: np.ndarray, weights: np.ndarray, train: np.ndarray, ask: np.ndarray, bins: int, depth: int, rng: np.random.Generator) -> np.ndarray:
    """Shares of the classes that one tree gives to the rows ``ask``."""
    (_, d), classes, flat = codes.shape, len(weights), codes.ravel()
    tries = math.ceil(math.sqrt(d))
    times = rng.poisson(1.0, len(train))
    bag, asked = Bag(train[times > 0], d), Bag(ask, d)
    times, y = times[times > 0].astype(float), y.astype(np.int64)
    label = y[bag.rows]
    place, end = np.arange(len(ask)), np.zeros(len(ask), np.int64)
    held = np.bincount(label, times, minlength=classes)[None, :]
    levels, lefts, first = [], [], 0
    for level in range(depth + 1):
        weighted = held * weights
        size = weighted.sum(axis=1)
        levels.append(weighted)
        left = np.full(len(held), -1)
        lefts.append(left)
        with np.errstate(divide="ignore", invalid="ignore"):
            mixed = 1 - ((weighted / size[:, None]) ** 2).sum(axis=1) > np.finfo(float).eps
        feature, last = np.zeros(len(held), np.int64), np.zeros(len(held), np.uint8)
        searched = np.flatnonzero(mixed) if level < depth else np.zeros(0, np.int64)
        if len(searched):
            drawn = rng.random((len(searched), d), np.float32).argpartition(tries - 1, axis=1)[:, :tries] if tries < d else np.tile(np.arange(d), (len(searched), 1))
            at = np.full(len(held), -1)
            at[searched] = np.arange(len(searched))
            inner = at[bag.node] >= 0
            bag.keep(inner)
            times, label = times[inner], label[inner]
            gain, f, b = _splits(flat, bag, at, drawn, held[searched], times, label, weights, bins)
            won = gain > 1e-15
            split = searched[won]
            left[split] = first + len(held) + 2 * np.arange(len(split))
            feature[split], last[split] = f[won], b[won]
        stays = left[asked.node] < 0
        end[place[stays]] = first + asked.node[stays]
        goes = left >= 0
        if not goes.any():
            break
        rank = np.cumsum(goes) - 1
        inner = goes[bag.node]
        bag.keep(inner)
        times, label = times[inner], label[inner]
        place = place[~stays]
        asked.keep(~stays)
        for rows in (bag, asked):
            rows.node = rank[rows.node]
            rows.down(flat, feature[goes], last[goes])
        first += len(held)
        children = 2 * int(goes.sum())
        held = np.bincount(bag.node * classes + label, times, minlength=children * classes).reshape(children, classes)
    return _shares(levels, lefts, end)


def _splits(flat, bag, at, drawn, held, times, label, weights, bins) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each searched node the largest gain of its columns, the column and the last bin of its left child."""
    n, classes = held.shape
    gain, feature, last = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.uint8)
    node, portion = at[bag.node], max(1, PORTION // (bins * classes))
    for start in range(0, n, portion):
        stop = min(n, start + portion)
        if portion >= n:
            now, base, key, count = node, bag.base, label, times
        else:
            use = np.flatnonzero((node >= start) & (node < stop))
            now, base, key, count = node[use], bag.base[use], label[use], times[use]
        key = (now - start) * (bins * classes) + key
        whole = held[start:stop] * weights
        size = whole.sum(axis=1)
        before = (whole * whole).sum(axis=1) / size
        for draw in drawn[start:stop].T:
            code = flat.take(base + draw.take(now - start))
            table = np.bincount(key + code * np.int64(classes), count, minlength=(stop - start) * bins * classes)
            # what lies in the bins up to each threshold; counts are whole numbers, so empty sides are exactly 0
            low = table.reshape(stop - start, bins, classes).cumsum(axis=1)[:, :-1]
            lows, highs, pull_low, pull_high = 0.0, 0.0, 0.0, 0.0
            for c, weight in enumerate(weights):
                x = low[:, :, c] * weight
                z = (held[start:stop, c, None] - low[:, :, c]) * weight
                lows, highs = lows + x, highs + z
                pull_low, pull_high = pull_low + x * x, pull_high + z * z
            with np.errstate(divide="ignore", invalid="ignore"):
                better = pull_low / lows + pull_high / highs
            better[(lows == 0) | (highs == 0)] = -np.inf
            best = better.argmax(axis=1)
            found = (better[np.arange(stop - start), best] - before) / size
            more = np.flatnonzero(found > gain[start:stop])
            gain[start + more], feature[start + more], last[start + more] = found[more], draw[more], best[more]
    return gain, feature, last


def _shares(levels: list[np.ndarray], lefts: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """The shares of the leaves ``end``, once leaves of one prediction are joined to their parent, from the lowest up."""
    weighted, left = np.concatenate(levels), np.concatenate(lefts)
    says, leaf, stands = weighted.argmax(axis=1), left < 0, np.arange(len(left))
    edges = np.cumsum([0, *map(len, levels)])
    inner = [a + np.flatnonzero(left[a:b] >= 0) for a, b in zip(edges[:-1], edges[1:])]
    for parents in inner[::-1]:
        l = left[parents]
        leaf[parents] = leaf[l] & leaf[l + 1] & (says[l] == says[l + 1])
    for parents in inner:
        joined = parents[leaf[parents]]
        stands[left[joined]] = stands[left[joined] + 1] = stands[joined]
    found = weighted[stands[end]]
    return found / np.maximum(found.sum(axis=1, keepdims=True), np.finfo(float).tiny)


def votes(placed: DataFrame, cols: Sequence[str], number: Column, count: int, sides: Sequence[Side], estimator: RandomForestClassifier, id_col: str = "id") -> DataFrame:
    """(side, _row, v0, v1, ...): what the trees of a side say of its held-out rows, in sums of ``VOTE`` by class.

    ``placed`` is a stored table with the numbers of its rows in ``_row``; ``number`` is a row's fold, counted from 0, of ``count``.
    """
    spark, d, classes = placed.sparkSession, len(cols), len(sides[0].weights)
    trees, depth, seed = estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getSeed() % 2**64
    blocks = together.packed(placed, cols, number, id_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:

        def sizes_of(x, y, fold, h) -> np.ndarray:
            if not np.isfinite(x).all():
                raise ValueError("a row to be fitted has a feature value that is no finite number")
            out = np.zeros((count, classes), np.int64)
            np.add.at(out, (fold, y), 1)
            return out

        sizes, cuts = together.summed(blocks, sizes_of), []
        for at in range(0, len(sides), together.WAVE):
            cuts += together.cut_points(blocks, d, sides[at : at + together.WAVE], sizes, estimator.getMaxBins())
    finally:
        blocks.unpersist()
    bins = 1 + max(len(c) for side in cuts for c in side)
    # tasks of a fold; what they grow doesn't depend on their number
    shares = min(trees, -(-max(min(PER_CORE * spark.sparkContext.defaultParallelism, TASKS), 1) // len(sides)))
    names = [f"v{c}" for c in range(classes)]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[4:]])
            y, fold, row = (batch.column(i).to_numpy().astype(t) for i, t in ((0, "<i4"), (1, "<i4"), (2, "<i8")))
            for k, side in enumerate(sides):
                flat = [together._codes(x, cuts[k]).tobytes(), y.tobytes(), (fold == side.fold).tobytes(), row.tobytes(), b"".join(batch.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *[pa.array([v], pa.binary()) for v in flat]], names=["side", *dealt])

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tasks: dict[tuple[int, int], list[list[bytes]]] = {}
        for batch in batches:
            for side, share, *flat in zip(*[c.to_pylist() for c in batch.columns]):
                tasks.setdefault((side, share), []).append(flat)
        for (k, share), parts in tasks.items():
            raw = [np.frombuffer(b"".join(p), t) for p, t in zip(zip(*parts), ("u1", "<i4", "?", "<i8", ">u8"))]
            order = np.lexsort((raw[3], raw[4]))
            codes, (y, held, row) = raw[0].reshape(-1, d)[order], (v[order] for v in raw[1:4])
            train, ask = np.flatnonzero(~held), np.flatnonzero(held)
            total = np.zeros((len(ask), classes), np.int64)
            for t in range(share, trees, shares):
                said = vote(codes, y, sides[k].weights, train, ask, bins, depth, np.random.default_rng([seed, t]))
                total += np.rint(said / VOTE).astype(np.int64)
            at = [pa.array(np.full(len(ask), k, np.int32)), pa.array(row[ask])]
            yield pa.RecordBatch.from_arrays([*at, *[pa.array(total[:, c]) for c in range(classes)]], names=["side", "_row", *names])

    dealt = ["codes", "y", "held", "row", "hash"]
    picked = placed.select(
        F.col("y").cast("int").alias("y"),
        number.cast("int").alias("fold"),
        F.col("_row").alias("row"),
        F.coalesce(F.unhex(F.substring(hash_key(id_col), 1, 16)), F.lit(bytes(8))).alias("hash"),
        *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)],
    )
    coded = picked.mapInArrow(code, "side int, " + ", ".join(f"{n} binary" for n in dealt))
    coded = coded.select("side", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), *dealt)
    spread = coded.repartitionById(len(sides) * shares, (F.col("side") * shares + F.col("share")).cast("int"))
    said = spread.mapInArrow(grown, "side int, _row long, " + ", ".join(f"{n} long" for n in names))
    return said.groupBy("side", "_row").agg(*[F.sum(n).alias(n) for n in names])

