"""Out-of-fold scoring with Spark ML.

Folds are few by construction (groups are hashed into folds when there are many), which is
checked. The feature table is written once; every fold reads it with its own filter. Fits are
submitted a few at a time so small folds share the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from threading import BoundedSemaphore

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochwise.operators import events, folds, grove, irls, together
from epochwise.session import discard, materialise

#: Most folds of models that are fitted once per fold; a parameter of ``fold_ids`` and ``Prepared``.
MAX_FOLDS = 256
#: Partitions of a fit: at least so many, and no more rows in one than ``FIT_ROWS``. A tree fit holds the statistics of all nodes
#: of a level once per partition, so partitions that follow ``spark.sql.shuffle.partitions`` cost more than the rows in them.
FIT_PARTS, FIT_ROWS = 8, 50_000
#: Most rows in a partition of forests and perceptrons, which may have a single one. What a partition of a forest costs is the
#: statistics of its nodes, however few its rows are, and a perceptron's cost is its rows.
FOREST_ROWS, PERCEPTRON_ROWS = 100_000, 10_000
#: Trees that are fitted together: pieces are fitted side by side, which needs no more partitions, but each looks for its thresholds.
PIECE_TREES = 50
#: Fits of forest pieces at once, in all folds together: each holds its own rows in bins.
_SLOTS = BoundedSemaphore(16)


@dataclass
class Spec:
    """A model: how to build the estimator, how to read its score, and what it needs.

    ``ridge``: a logistic regression with this penalty, whose folds are all fitted at once (``irls``).
    ``rows``: most rows in a partition of a fit, see ``in_place``.
    """

    name: str
    build: Callable[[int], object]
    weighted: bool = True
    balance_rows: bool = False
    scaled: bool = True
    ridge: float | None = None
    rows: int | None = None


@dataclass
class Scorer:
    """A model without a fit per fold: (rows, columns, fold column) to (id, subject, y, fold, p)."""

    name: str
    score: Callable[[DataFrame, list[str], str], DataFrame]


def random_forest(trees: int = 300, depth: int = 12, seed: int = 42, name: str = "rf", weighted: bool = True) -> Spec:
    """``weighted``: classes weigh inversely to their size, else all rows weigh one."""
    return Spec(
        name,
        lambda d: RandomForestClassifier(
            numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", labelCol="y", featuresCol="_x",
            **({"weightCol": "_w"} if weighted else {}),
        ),
        weighted=weighted,
        scaled=False,
        rows=FOREST_ROWS,
    )


def logistic(l1: float = 0.0, reg: float = 0.01, name: str = "logistic") -> Spec:
    return Spec(
        name,
        lambda d: LogisticRegression(
            elasticNetParam=l1, regParam=reg, maxIter=100, tol=1e-4, weightCol="_w", labelCol="y", featuresCol="_x"
        ),
        ridge=reg if l1 == 0 else None,
    )


def gaussian_nb(name: str = "gnb_ml") -> Spec:
    return Spec(
        name,
        lambda d: NaiveBayes(modelType="gaussian", labelCol="y", featuresCol="_x"),
        weighted=False,
    )


def boosting(rounds: int = 50, depth: int = 3, rate: float = 0.1, seed: int = 42, name: str = "gbt") -> Spec:
    return Spec(
        name,
        lambda d: GBTClassifier(
            maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, weightCol="_w", labelCol="y", featuresCol="_x"
        ),
        scaled=False,
        rows=FIT_ROWS,
    )


def linear_margin(reg: float = 0.01, iters: int = 20, name: str = "svm") -> Spec:
    return Spec(
        name,
        lambda d: LinearSVC(regParam=reg, maxIter=iters, tol=1e-4, weightCol="_w", labelCol="y", featuresCol="_x"),
        rows=FIT_ROWS,
    )


def perceptron(hidden: Sequence[int] = (64, 32), iters: int = 100, seed: int = 42, name: str = "mlp") -> Spec:
    """No weight column in Spark's perceptron, so the smaller class is repeated instead."""
    return Spec(
        name,
        lambda d: MultilayerPerceptronClassifier(
            layers=[d, *hidden, 2], maxIter=iters, seed=seed, labelCol="y", featuresCol="_x"
        ),
        weighted=False,
        balance_rows=True,
        rows=PERCEPTRON_ROWS,
    )


def class_one_score(model) -> Column:
    """Probability of class 1, or the logistic of the margin where there is none."""
    if hasattr(model, "getProbabilityCol"):
        return vector_to_array("probability")[1]
    return 1.0 / (1.0 + F.exp(-vector_to_array("rawPrediction")[1]))


def fold_ids(rows: DataFrame, fold: str, most: int = MAX_FOLDS) -> list:
    """The fold labels; a bounded list, or an error that says how to get one."""
    found = [r[0] for r in rows.select(fold).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} folds; use folds.group_kfold to hash groups into folds")
    return sorted(found)


class Prepared:
    """A stored feature table with its folds, weights and scalings, each worked out once.

    What is collected is one row per fold (and class); the number of folds is checked.
    """

    def __init__(self, rows: DataFrame, cols: Sequence[str], fold: str, most: int = MAX_FOLDS):
        self.rows, self.cols, self.fold = rows, list(cols), fold
        self.ids = fold_ids(rows, fold, most)
        self.weights: dict = {}
        for r in folds.class_weights(rows, fold).collect():
            self.weights.setdefault(r[fold], {})[r["y"]] = r["weight"]
        self._scales: dict = {None: {}}
        self._count: int | None = None

    def scale(self, kind: str | None) -> dict:
        """fold -> {column: (offset, divisor)} from the rows outside the fold."""
        if kind not in self._scales:
            make = folds.held_out_moments if kind == "standard" else folds.held_out_ranges
            stats = make(self.rows, self.fold, self.cols).collect()
            self._scales[kind] = {
                r[self.fold]: {c: (a, b or 1.0) for c, a, b in zip(self.cols, r["a"], r["b"])} for r in stats
            }
        return self._scales[kind]

    def one_class(self) -> list:
        """Folds whose training side has fewer than two classes."""
        return [f for f in self.ids if len(self.weights.get(f, {})) < 2]

    def count(self) -> int:
        if self._count is None:
            self._count = self.rows.count()
        return self._count


def vectors(rows: DataFrame, cols: Sequence[str], scale: dict | None = None) -> DataFrame:
    """Add the vector ``_x`` of columns, scaled by {column: (offset, divisor)} when given.

    Offsets and divisors are array literals, so all folds share one generated plan.
    """
    x = F.array(*[F.col(c).cast("double") for c in cols])
    if scale is not None:
        moved = F.zip_with(x, F.lit([float(scale[c][0]) for c in cols]), lambda v, a: v - a)
        x = F.zip_with(moved, F.lit([float(scale[c][1]) for c in cols]), lambda v, b: v / b)
    return rows.withColumn("_x", array_to_vector(x))


def fit(train: DataFrame, spec: Spec, d: int, weights: dict[int, float] | None = None, id_col: str = "id"):
    """Fit on rows with ``_x`` and ``y``.

    Spark's samples are drawn by the place of a row, and files aren't read in one order, so the rows are first put
    in their places by id; a fit then repeats.
    """
    estimator, held = spec.build(d), []

    def hold(rows: DataFrame) -> DataFrame:
        held.append(rows.persist())
        return held[-1]

    try:
        if spec.balance_rows:
            # the copies are counted and ranked in several scans
            train = events.oversample(hold(train.select(id_col, "y", "_x")), id_col)
        train = hold(in_place(train, id_col, spec.rows))
        if spec.weighted:
            w = weights or {}
            by_class = F.lit([float(w.get(0, 1.0)), float(w.get(1, 1.0))])
            train = train.withColumn("_w", F.element_at(by_class, F.col("y") + 1))
        return grow(estimator, train) if isinstance(estimator, RandomForestClassifier) else estimator.fit(train)
    finally:
        for rows in held:
            rows.unpersist()


class Forest:
    """The pieces of a forest as one model: the votes of all trees count alike."""

    def __init__(self, pieces: Sequence[RandomForestClassificationModel]):
        self.pieces = list(pieces)

    def getProbabilityCol(self) -> str:
        return "probability"

    @property
    def featureImportances(self) -> DenseVector:
        """The mean over the trees that split at all, as Spark has it for one forest."""
        split = [sum(t.numNodes > 1 for t in p.trees) for p in self.pieces]
        total = sum(n * p.featureImportances.toArray() for n, p in zip(split, self.pieces))
        return Vectors.dense(total / (sum(split) or 1))

    def transform(self, rows: DataFrame) -> DataFrame:
        """The rows with ``probability`` and ``prediction``; of equal votes the smaller class."""
        names = [f"_votes{i}" for i in range(len(self.pieces))]
        voted = rows
        for name, piece in zip(names, self.pieces):
            voted = piece.setRawPredictionCol(name).setProbabilityCol("").setPredictionCol("").transform(voted)
        voted = voted.select(*rows.columns, *[vector_to_array(n).alias(n) for n in names])
        classes = range(max(p.numClasses for p in self.pieces))
        votes = F.array(*[reduce(Column.__add__, [F.coalesce(F.get(n, F.lit(c)), F.lit(0.0)) for n in names]) for c in classes])
        shares = F.transform("_votes", lambda v: v / sum(p.getNumTrees for p in self.pieces))
        first = (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double")
        return voted.select(*rows.columns, votes.alias("_votes")).select(
            *rows.columns, array_to_vector(shares).alias("probability"), first.alias("prediction")
        )


def grow(forest: RandomForestClassifier, placed: DataFrame) -> RandomForestClassificationModel | Forest:
    """Fit a forest to rows in their places, ``PIECE_TREES`` at a time; ``placed`` should be stored or persisted.

    A piece has a seed of its own. Seeds lie apart, as Spark adds a partition's number to them.
    """
    trees = forest.getNumTrees()
    n = -(-trees // PIECE_TREES)
    if n < 2:
        return forest.fit(placed)

    def piece(i: int) -> RandomForestClassificationModel:
        with _SLOTS:
            return forest.copy().setNumTrees(trees // n + (i < trees % n)).setSeed(forest.getSeed() + 1_000_003 * i).fit(placed)

    return Forest(concurrently([lambda i=i: piece(i) for i in range(n)], n))


def in_place(rows: DataFrame, id_col: str = "id", part_rows: int | None = None) -> DataFrame:
    """The rows in partitions and in an order that follow from their ids and number alone, as few as their number needs.

    With ``part_rows`` those are one for so many rows, else one for ``FIT_ROWS``, but ``FIT_PARTS`` at least.
    """
    most, n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count()
    parts = min(most, max(1, -(-n // part_rows)) if part_rows else max(FIT_PARTS, -(-n // FIT_ROWS)))
    return rows.repartition(parts, id_col).sortWithinPartitions(id_col)


def stored_as_one(parts: Sequence[DataFrame]) -> DataFrame:
    """Tables of one schema made by ``materialise``, read in one scan."""
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*[p._stored_at for p in parts])


def concurrently(tasks: list[Callable], parallel: int = 4) -> list:
    carry = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        return [f.result() for f in [pool.submit(carry(t)) for t in tasks]]


def out_of_fold(
    rows: DataFrame | Prepared,
    cols: Sequence[str],
    spec: Spec,
    fold: str = "subject",
    id_col: str = "id",
    scale: str | None = "standard",
    protocol: str = "loso",
    parallel: int = 8,
    keep: Sequence[str] = ("subject", "y"),
    select: Callable[[DataFrame], list[str]] | None = None,
    skip_one_class: bool = False,
) -> DataFrame:
    """Scores of every row by a model that never saw its fold: (id, keep, fold, p, model, protocol).

    ``rows`` should be a stored table, as each fold scans it. ``select`` picks columns from the
    training rows of a fold, so a selection stays inside it. Fails if any row is left unscored;
    with ``skip_one_class`` the rows of ``Prepared.one_class()`` folds are, and no others.
    """
    ready = rows if isinstance(rows, Prepared) else Prepared(rows, cols, fold)
    if spec.ridge is not None and select is None:
        scored = _ridge(ready, cols, spec, id_col, scale, keep, skip_one_class)
        return _checked(materialise(_named(scored, spec.name, protocol), f"scored-{spec.name}"), ready)
    if select is None and together.fits(spec.build(len(cols))):
        scored = _together(ready, cols, spec, id_col, scale, keep, skip_one_class)
        return _checked(materialise(_named(scored, spec.name, protocol), f"scored-{spec.name}"), ready)
    if select is None and grove.fits(spec.build(len(cols)), ready.count(), len(cols)):
        return _checked(stored_as_one(_grown(ready, cols, spec, id_col, keep, skip_one_class, protocol, parallel)), ready)
    stats = ready.scale(scale if spec.scaled else None)

    def run(f) -> DataFrame | None:
        if len(ready.weights.get(f, {})) < 2:
            if skip_one_class:
                return None
            raise ValueError(f"fold {f!r}: the training side has one class only")
        held = F.col(ready.fold) == F.lit(f)
        train, test = ready.rows.filter(~held), ready.rows.filter(held)
        use = list(cols) if select is None else select(train)
        sc = stats.get(f)
        model = fit(vectors(train, use, sc), spec, len(use), ready.weights[f], id_col)
        scored = model.transform(vectors(test, use, sc))
        out = [id_col, *[k for k in keep if k != id_col]]
        scored = scored.select(*out, F.col(ready.fold).cast("string").alias("fold"), class_one_score(model).alias("p"))
        # every task of a scoring stage unpacks its models, so a fold is scored on its own, beside the fits of others
        return materialise(_named(scored, spec.name, protocol), f"scored-{spec.name}")

    parts = [p for p in concurrently([lambda f=f: run(f) for f in ready.ids], parallel) if p is not None]
    if not parts:
        raise ValueError("no fold has two classes on its training side")
    return _checked(stored_as_one(parts), ready)


def _ridge(ready: Prepared, cols: Sequence[str], spec: Spec, id_col: str, scale: str | None, keep: Sequence[str], skip_one_class: bool) -> DataFrame:
    """(id, keep, fold, p) with the models of all folds from one scan per step."""
    whole = [f for f in ready.ids if len(ready.weights.get(f, {})) == 2]
    if len(whole) < len(ready.ids) and not skip_one_class or not whole:
        raise ValueError("a fold's training side has one class only" if whole else "no fold has two classes on its training side")
    cells = [irls.Cell(((ready.fold, "" if f is None else str(f)),)) for f in whole]
    stats = ready.scale(scale)
    scales = [tuple(zip(*[stats[f][c] if scale else (0.0, 1.0) for c in cols])) for f in whole]
    fitted = irls.fit(ready.rows, cols, cells, scales, spec.ridge, spec.weighted)
    out = [id_col, *[k for k in keep if k != id_col], ready.fold]
    scored = irls.score(ready.rows, cols, list(zip(cells, fitted)), list(dict.fromkeys(out)))
    return scored.withColumn("_fold", F.col(ready.fold).cast("string")).select(*out[:-1], F.col("_fold").alias("fold"), "p")


def _together(ready: Prepared, cols: Sequence[str], spec: Spec, id_col: str, scale: str | None, keep: Sequence[str], skip_one_class: bool) -> DataFrame:
    """(id, keep, fold, p) with boosting or perceptrons of all folds from one scan per step."""
    whole = [f for f in ready.ids if len(ready.weights.get(f, {})) == 2]
    if len(whole) < len(ready.ids) and not skip_one_class or not whole:
        raise ValueError("a fold's training side has one class only" if whole else "no fold has two classes on its training side")
    stats, sides = ready.scale(scale if spec.scaled else None), []
    for f in whole:
        sc = stats.get(f) or {c: (0.0, 1.0) for c in cols}
        low, width = (np.array(v, float) for v in zip(*[sc[c] for c in cols]))
        weights = [float(ready.weights[f].get(c, 1.0)) if spec.weighted else 1.0 for c in (0, 1)]
        sides.append(together.Side(ready.ids.index(f), low, width, np.array(weights)))
    number = F.array_position(F.lit(list(ready.ids)), F.col(ready.fold)) - 1
    estimator = spec.build(len(cols))
    placed = in_place(ready.rows, id_col, together.part_rows(ready.count(), estimator, spec.rows or FIT_ROWS))
    fitted = together.fit(placed, cols, number, len(ready.ids), sides, estimator, id_col)
    kept = [F.col(c) for c in dict.fromkeys([id_col, *keep])] + [F.col(ready.fold).cast("string").alias("fold")]
    return together.score(ready.rows, cols, number, {s.fold: m for s, m in zip(sides, fitted)}, kept)


def _grown(ready: Prepared, cols: Sequence[str], spec: Spec, id_col: str, keep: Sequence[str], skip_one_class: bool, protocol: str, parallel: int) -> list[DataFrame]:
    """The stored scores of each fold by its forest; the trees of all folds are grown side by side."""
    whole = [f for f in ready.ids if len(ready.weights.get(f, {})) == 2]
    if len(whole) < len(ready.ids) and not skip_one_class or not whole:
        raise ValueError("a fold's training side has one class only" if whole else "no fold has two classes on its training side")
    sides = []
    for f in whole:
        weights = [float(ready.weights[f].get(c, 1.0)) if spec.weighted else 1.0 for c in (0, 1)]
        sides.append(grove.Side(ready.ids.index(f), np.array(weights)))
    number = F.array_position(F.lit(list(ready.ids)), F.col(ready.fold)) - 1
    placed, votes = voted(ready.rows, cols, number, len(ready.ids), sides, spec.build(len(cols)), ready.count(), id_col)
    kept = [F.col(c) for c in dict.fromkeys([id_col, *keep])] + [F.col(ready.fold).cast("string").alias("fold")]

    def run(k: int) -> DataFrame:
        rows = placed.filter(F.col(ready.fold) == F.lit(whole[k])).select(*kept, "_row")
        met = rows.join(votes.filter(F.col("side") == k), "_row")
        out = met.select(*rows.columns[:-1], _share_of_one().alias("p"))
        return materialise(_named(out, spec.name, protocol), f"scored-{spec.name}")

    parts = concurrently([lambda k=k: run(k) for k in range(len(whole))], parallel)
    discard(placed, votes)
    return parts


def voted(rows: DataFrame, cols: Sequence[str], number: Column, count: int, sides: Sequence, estimator: RandomForestClassifier, n: int, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """The rows with a number in ``_row``, and the votes of ``grove.votes`` on those held out, by ``side`` and ``_row``; both stored."""
    placed = in_place(rows, id_col, together.part_rows(n, estimator, FIT_ROWS))
    placed = materialise(placed.withColumn("_row", F.monotonically_increasing_id()), "placed")
    return placed, materialise(grove.votes(placed, cols, number, count, sides, estimator, id_col), "votes")


def held_out(train: DataFrame, test: DataFrame, cols: Sequence[str], spec: Spec, weights: dict[int, float], scale: dict | None = None, id_col: str = "id") -> DataFrame:
    """(y, p) of the rows of ``test`` by a model of ``train``."""
    estimator, n = spec.build(len(cols)), train.count() + test.count()
    if not grove.fits(estimator, n, len(cols)):
        model = fit(vectors(train, cols, scale), spec, len(cols), weights, id_col)
        return model.transform(vectors(test, cols, scale)).select("y", class_one_score(model).alias("p"))
    sides = [grove.Side(1, np.array([float(weights.get(c, 1.0)) if spec.weighted else 1.0 for c in (0, 1)]))]
    both = [rows.select(id_col, "y", *cols, F.lit(i).alias("_side")) for i, rows in enumerate((train, test))]
    placed, votes = voted(both[0].unionByName(both[1]), cols, F.col("_side"), 2, sides, estimator, n, id_col)
    return placed.join(votes, "_row").select("y", _share_of_one().alias("p"))


def _share_of_one() -> Column:
    return F.col("v1") / F.greatest(F.col("v0") + F.col("v1"), F.lit(1))


def _named(scored: DataFrame, name: str, protocol: str) -> DataFrame:
    return scored.withColumns({"model": F.lit(name), "protocol": F.lit(protocol)})


def _checked(stored: DataFrame, ready: Prepared) -> DataFrame:
    """The stored scores; an error if a row that should have a score has none."""
    got, skipped = stored.count(), ready.one_class()
    expect = ready.count() - (ready.rows.filter(F.col(ready.fold).isin(skipped)).count() if skipped else 0)
    if expect != got:
        raise RuntimeError(f"{expect - got} rows have no out-of-fold score")
    return stored


def with_folds(rows: DataFrame, protocol: str, id_col: str = "id", k: int = 5) -> tuple[DataFrame, str]:
    """Rows and the name of their fold column for ``loso`` or ``kfold``."""
    if protocol == "loso":
        return rows, "subject"
    return folds.stratified_kfold(rows, id_col, k), "fold"
