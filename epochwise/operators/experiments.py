"""Grids, sweeps, active learning, calibration, learning curves and cross-set tests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.operators import evaluate, folds, grove, irls, isotonic, models, ordering, prep
from epochwise.operators.models import Spec
from epochwise.operators.selection import _weights, standardised
from epochwise.session import discard, materialise


def grid(datasets: dict[str, tuple[DataFrame, list[str], list[str]]], scalers: Sequence[str], specs: Sequence[Spec | models.Scorer], parallel: int = 4) -> DataFrame:
    """Dataset x scaler x model x protocol: one metric row per cell, or its failure.

    A fold whose training side has one class can't be fitted. It is skipped and said so:
    ``n_scored`` of ``n_rows`` rows have a score, ``folds_skipped`` folds have none.

    ``datasets`` maps a name to (stored rows, columns, protocols). The scored rows of all cells
    are evaluated together at the end. A model that isn't scaled has the same fits under every scaler; they are made once.
    """
    cells = [
        (name, scaler, spec, protocol)
        for name, (_, _, protocols) in datasets.items()
        for spec in specs
        for scaler in (scalers if getattr(spec, "scaled", True) else scalers[:1])
        for protocol in protocols
    ]
    failed: list[tuple] = []
    coverage: list[tuple] = []
    # folds, weights and scalings are shared by all cells of a dataset and protocol
    ready = {}
    for name, (rows, cols, protocols) in datasets.items():
        for protocol in protocols:
            folded, fold = models.with_folds(rows, protocol)
            if fold != "subject":
                folded = materialise(folded, "folded")
            ready[name, protocol] = models.Prepared(folded, cols, fold)
            for scaler in scalers:
                ready[name, protocol].scale(scaler)

    def run(cell) -> DataFrame | None:
        name, scaler, spec, protocol = cell
        try:
            at = ready[name, protocol]
            if isinstance(spec, models.Scorer):
                moved = materialise(folds.scale_held_out(at.rows, at.fold, at.cols, scaler), "scaled")
                found = spec.score(moved, at.cols, at.fold).select("id", "subject", "y", "fold", "p")
                named = {"model": spec.name, "protocol": protocol, "dataset": name, "scaler": scaler}
                scored = materialise(found.withColumns({k: F.lit(v) for k, v in named.items()}), "scored")
                coverage.append((name, scaler, spec.name, protocol, scored.count(), at.count(), 0))
                return scored
            scored = models.out_of_fold(at, at.cols, spec, scale=scaler, protocol=protocol, skip_one_class=True)
            same = [scaler] if spec.scaled else list(scalers)
            coverage.extend((name, s, spec.name, protocol, scored.count(), at.count(), len(at.one_class())) for s in same)
            return scored.withColumn("dataset", F.lit(name)).withColumn("scaler", F.explode(F.array(*map(F.lit, same))))
        except Exception as e:  # a failed cell is reported, the grid goes on
            same = [scaler] if getattr(spec, "scaled", True) else list(scalers)
            failed.extend((name, s, spec.name, protocol, str(e)) for s in same)
            return None

    parts = [p for p in models.concurrently([lambda c=c: run(c) for c in cells], parallel) if p is not None]
    keys = ["dataset", "scaler", "model", "protocol"]
    spark = next(iter(datasets.values()))[0].sparkSession
    bad = spark.createDataFrame(failed, ", ".join(f"{k} string" for k in keys) + ", failure string")
    if not parts:
        return bad
    scored = reduce(DataFrame.unionByName, parts)
    covered = ", ".join(f"{k} string" for k in keys) + ", n_scored long, n_rows long, folds_skipped int"
    # a cell whose scored rows are of one class has no metrics, but it has its row
    result = spark.createDataFrame(coverage, covered).join(evaluate.pooled_vs_macro(scored, keys), keys, "left")
    return result.withColumn("failure", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)


def sweep(rows: DataFrame, cols: Sequence[str], specs: Sequence[Spec], test_subject: str, inner: int = 3) -> DataFrame:
    """Settings compared inside the training subjects only; the best by AUC meets the test subject.

    (model, inner_auc, chosen, test_auc, folds_skipped). Inner folds group by subject too; those
    whose training side has one class are skipped and counted.
    """
    train = materialise(folds.group_kfold(rows.filter(F.col("subject") != test_subject), inner), "sweep")
    ready = models.Prepared(train, cols, "fold")
    ready.count()
    # the settings don't need one another, and the trees of one don't fill a cluster to the end
    parts = models.concurrently([lambda s=s: models.out_of_fold(ready, cols, s, skip_one_class=True) for s in specs])
    scored = reduce(DataFrame.unionByName, parts)
    skipped = len(ready.one_class())
    inner_auc = evaluate.roc_auc(scored, ["model"]).collect()  # one row per setting
    ranked = sorted(((r.auc if r.auc is not None else -1.0, r.model) for r in inner_auc), key=lambda t: (-t[0], t[1]))
    best = ranked[0][1]
    spec = next(s for s in specs if s.name == best)
    sc = standardised(train, cols) if spec.scaled else None
    test = rows.filter(F.col("subject") == test_subject)
    out = models.held_out(train, test, cols, spec, _weights(train), sc).withColumn("model", F.lit(best))
    got = evaluate.roc_auc(out, ["model"]).first()
    table = [(m, float(a), int(m == best), float(got.auc) if m == best and got.auc is not None else None, skipped) for a, m in ranked]
    return rows.sparkSession.createDataFrame(table, "model string, inner_auc double, chosen int, test_auc double, folds_skipped int")


def active_learning(rows: DataFrame, cols: Sequence[str], spec: Spec, strategy: str = "uncertainty", seed_n: int = 150, batch: int = 100, rounds: int = 8, seed: str = "42", id_col: str = "id", test_share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(history, audit): label the rows the model is least sure of, or random ones, round by round.

    The labelled set is a table of ids, written each round; one round adds ``batch`` ids by a
    distributed top-k. The audit holds every query of every round, with its place in the round.
    """
    spark = rows.sparkSession
    split = materialise(folds.holdout(rows, id_col, test_share, seed), "active")
    pool, test = split.filter("is_test = 0").drop("is_test"), split.filter("is_test = 1").drop("is_test")
    labelled = materialise(prep.balance(pool, id_col, seed_n // 2, seed).select(id_col), "labelled-0")
    history, audit = [], []
    for r in range(rounds):
        known = materialise(pool.join(labelled, id_col, "left_semi"), "known")
        sc = standardised(known, cols)
        model = models.fit(models.vectors(known, cols, sc), spec, len(cols), _weights(known), id_col)
        p = models.class_one_score(model)
        tested = model.transform(models.vectors(test, cols, sc)).select("y", p.alias("p"))
        suite = evaluate.with_metrics(evaluate.confusion(tested, [])).first()
        history.append((r, strategy, known.count(), float(suite.accuracy), float(suite.sensitivity)))
        rest = pool.join(labelled, id_col, "left_anti")
        if strategy == "uncertainty":
            scored = model.transform(models.vectors(rest, cols, sc))
            picked = scored.select(id_col, "y", F.abs(p - 0.5).alias("_u")).orderBy("_u", id_col).limit(batch)
        else:
            picked = rest.select(id_col, "y", ordering.hash_key(id_col, f"{seed}:{r}").alias("_u")).orderBy("_u", id_col).limit(batch)
        picked = materialise(picked, f"picked-{r}")
        if picked.isEmpty():
            break
        audit.append(picked.select(F.lit(r).alias("round"), F.lit(strategy).alias("strategy"), F.col(id_col).cast("bigint").alias("queried_index"), F.col("y").cast("int").alias("human_label"), F.col("_u").cast("string").alias("order_key")))
        more = materialise(labelled.unionByName(picked.select(id_col)), f"labelled-{r + 1}")
        discard(known, labelled)
        labelled = more
    hist = spark.createDataFrame(history, "round int, strategy string, n_labelled long, test_accuracy double, test_sensitivity double")
    # fixed values: the first four names are those of a published audit row
    none = spark.createDataFrame([], "round int, strategy string, queried_index long, human_label int, order_key string")
    return hist, reduce(DataFrame.unionByName, audit, none)


def calibrated(rows: DataFrame, cols: Sequence[str], spec: Spec, fold: str = "subject", inner: int = 3) -> DataFrame:
    """Out-of-fold scores with isotonic calibration fitted inside the training side.

    The training rows of a fold are scored by inner folds, the isotonic map is fitted on those,
    then applied to the held-out scores. The maps of all folds are fitted together.
    """
    outer = models.out_of_fold(rows, cols, spec, fold=fold)
    # the inner fold of a subject doesn't depend on the outer one
    nested = folds.group_kfold(rows.withColumnRenamed("fold", "_outer") if fold == "fold" else rows, inner)
    nested = nested.withColumnRenamed("fold", "inner_fold")
    fold = "_outer" if fold == "fold" else fold
    nested, ids = materialise(nested, "calib"), models.fold_ids(rows, fold)
    if spec.ridge is not None:
        pairs = [(f, irls.Cell(((fold, str(f)), ("inner_fold", str(g))))) for f in ids for g in range(inner)]
        fitted = irls.fit(nested, cols, [c for _, c in pairs], None, spec.ridge, spec.weighted)
        scored = irls.score(nested, cols, [(c, m) for (_, c), m in zip(pairs, fitted)], ["y"])
        names = F.array(*[F.lit(str(f)) for f, _ in pairs])
        inside = materialise(scored.select(F.element_at(names, F.col("cell") + 1).alias("fold"), "p", "y"), "calib-scored")
    else:
        parts = []
        for f in ids:
            train = nested.filter(F.col(fold) != F.lit(f))
            scored = models.out_of_fold(train, cols, spec, fold="inner_fold", skip_one_class=True)
            parts.append(scored.select(F.lit(str(f)).alias("fold"), "p", "y"))
        inside = reduce(DataFrame.unionByName, parts)
    maps = materialise(isotonic.blocks(inside, ["fold"]), "calib-maps")
    return isotonic.apply(outer, maps, ["fold"])


def learning_curve(rows: DataFrame, cols: Sequence[str], spec: Spec, test_subjects: Sequence[str], sizes: Sequence[int], seed: str = "42") -> DataFrame:
    """(n_subjects, metrics): nested training subsets of subjects in a seeded order."""
    test = rows.filter(F.col("subject").isin(list(test_subjects)))
    others = rows.filter(~F.col("subject").isin(list(test_subjects)))
    ranked = ordering.hash_rank(others.select("subject").distinct(), [], "subject", seed, out="_r", limit=F.lit(max(sizes)))
    parts = []
    for n in sizes:
        train = materialise(others.join(ranked.filter(F.col("_r") <= n), "subject", "left_semi"), "curve")
        sc = standardised(train, cols)
        model = models.fit(models.vectors(train, cols, sc), spec, len(cols), _weights(train))
        out = model.transform(models.vectors(test, cols, sc))
        parts.append(out.select(F.lit(n).alias("n_subjects"), "subject", "y", models.class_one_score(model).alias("p")))
    return evaluate.pooled_vs_macro(materialise(reduce(DataFrame.unionByName, parts), "curve-scored"), ["n_subjects"])


def cross_set(rows: DataFrame, cols: Sequence[str], spec: Spec, dataset: str = "dataset") -> DataFrame:
    """Train on all other datasets, test on each: out-of-fold scoring with the dataset as group."""
    return models.out_of_fold(rows, cols, spec, fold=dataset, protocol="cross_set")


def multiclass_oof(rows: DataFrame, cols: Sequence[str], k: int = 5, trees: int = 300, depth: int = 12, seed: int = 42, parallel: int = 8) -> DataFrame:
    """Out-of-fold class of a multiclass forest: (id, y, pred) with y the class index."""
    from pyspark.ml.classification import RandomForestClassifier

    folded = materialise(folds.stratified_kfold(rows, "id", k), "multi")

    estimator = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="y", featuresCol="_x")
    n, classes = folded.agg(F.count(F.lit(1)), F.max("y") + 1).first()
    if n and classes and 1 < classes <= grove.CLASSES and grove.fits(estimator, n, len(cols)):
        held = [r[0] for r in folded.select("fold").distinct().orderBy("fold").collect()]
        sides = [grove.Side(f, np.ones(classes)) for f in held]
        placed, votes = models.voted(folded, cols, F.col("fold"), k, sides, estimator, n)
        said = F.array(*[F.col(f"v{c}") for c in range(classes)])
        # of equal votes the smaller class
        pred = (F.array_position(said, F.array_max(said)) - 1).cast("int")
        out = materialise(placed.join(votes, "_row").select("id", "y", pred.alias("pred")), "multi-scored")
        if out.count() < n:
            raise RuntimeError(f"{n - out.count()} rows have no out-of-fold class")
        discard(placed, votes)
        return out

    def run(f: int) -> DataFrame:
        train, test = folded.filter(F.col("fold") != f), folded.filter(F.col("fold") == f)
        placed = models.in_place(models.vectors(train, cols), part_rows=models.FOREST_ROWS).persist()
        model = models.grow(estimator, placed)
        placed.unpersist()
        out = model.transform(models.vectors(test, cols))
        # a fold is scored on its own: every task of a scoring stage unpacks its models
        return materialise(out.select("id", "y", F.col("prediction").cast("int").alias("pred")), "multi-scored")

    parts = models.concurrently([lambda f=f: run(f) for f in range(k)], parallel)
    return models.stored_as_one(parts)
