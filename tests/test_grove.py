"""Forests whose trees are grown in tasks, against Spark ML's trees and forests."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from epochwise.operators import evaluate, experiments, grove, models, together
from epochwise.session import materialise

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.RandomState(3)
    n = 300
    cls = rng.randint(0, 3, n)
    pdf = pd.DataFrame({"id": rng.permutation(n) * 7, "subject": [f"s{i % 4}" for i in range(n)], "cls": cls, "y": (cls == 0).astype("int32")})
    for i, c in enumerate(COLS):
        pdf[c] = rng.randn(n) * 10.0**i + (1.5 - 0.5 * i) * cls
    return materialise(spark.createDataFrame(pdf).withColumn("y", F.col("y").cast("int")), "grove")


class Whole:
    """Draws every row once; of one column there is nothing to draw."""

    def poisson(self, mean, n):
        return np.ones(n, np.int64)


@pytest.mark.parametrize("depth, portion", [(1, 1 << 20), (4, 1 << 20), (12, 1 << 20), (12, 64)])
@pytest.mark.parametrize("label", ["y", "cls"])
def test_a_tree_is_spark_mls(spark, rows, depth, portion, label, monkeypatch):
    """Thresholds, weights, splits, joined leaves and shares, for two and three classes."""
    monkeypatch.setattr(grove, "PORTION", portion)
    weights = np.array([2.5, 0.5] if label == "y" else [1.0, 1.0, 1.0])
    pdf = rows.toPandas()
    weigh = F.element_at(F.lit([float(w) for w in weights]), F.col(label).cast("int") + 1)
    x = models.vectors(rows, ["a"]).withColumn("_w", weigh).coalesce(1)
    tree = DecisionTreeClassifier(maxDepth=depth, labelCol=label, featuresCol="_x", weightCol="_w").fit(x)
    theirs = tree.transform(x).select("id", vector_to_array("probability").alias("p")).toPandas().set_index("id").p.loc[pdf.id]
    cuts = [together._thresholds(pdf.a.to_numpy(), weights[pdf[label]], 32)]
    codes, each = together._codes(pdf[["a"]].to_numpy(), cuts), np.arange(len(pdf))
    ours = grove.vote(codes, pdf[label].to_numpy(), weights, each, each, 32, depth, Whole())
    assert np.allclose(ours, np.stack(theirs), atol=1e-12)


def alone(*args, **kwargs):
    raise AssertionError("a forest was fitted on the driver")


def test_no_forest_passes_through_the_driver(rows, monkeypatch):
    """Out-of-fold scores of two and more classes, and the chosen setting of a sweep."""
    theirs = {}
    with monkeypatch.context() as m:
        m.setattr(grove, "fits", lambda *a: False)
        for weighted in (True, False):
            theirs[weighted] = models.out_of_fold(rows, COLS, models.random_forest(40, 5, weighted=weighted)).toPandas().set_index("id")
        plain = experiments.multiclass_oof(rows.select("id", F.col("cls").alias("y"), *COLS), COLS, 3, trees=40, depth=5).toPandas()
    monkeypatch.setattr(models, "fit", alone)
    monkeypatch.setattr(models, "grow", alone)
    for weighted, their in theirs.items():
        ours = models.out_of_fold(rows, COLS, models.random_forest(40, 5, weighted=weighted)).toPandas().set_index("id")
        assert len(ours) == len(their) == 300 and list(ours.columns) == list(their.columns)
        same = their.loc[ours.index]
        assert (ours.fold == same.fold).all() and (ours.y == same.y).all()
        # other draws, alike trees
        assert np.abs(ours.p - same.p).mean() < 0.05 and np.corrcoef(ours.p, same.p)[0, 1] > 0.95
    pred = experiments.multiclass_oof(rows.select("id", F.col("cls").alias("y"), *COLS), COLS, 3, trees=40, depth=5).toPandas()
    assert sorted(pred.id) == sorted(plain.id) and pred.pred.dtype == plain.pred.dtype
    both = pred.merge(plain, on="id")
    assert (both.pred_x == both.pred_y).mean() > 0.85
    specs = [models.random_forest(n, 4, name=f"rf-{n}") for n in (5, 20)]
    out = experiments.sweep(rows, COLS, specs, "s0").collect()
    assert len(out) == 2 and [r.chosen for r in out] == [1, 0] and out[0].test_auc > 0.8


def test_neither_tasks_nor_partitions_matter(spark, rows, monkeypatch):
    spec, found = models.random_forest(15, 4), []
    for per_core, spread in ((4, 4000), (1, 50)):
        monkeypatch.setattr(grove, "PER_CORE", per_core)
        monkeypatch.setattr(together, "BOOST_ROWS", spread)
        found.append(models.out_of_fold(rows.repartition(per_core), COLS, spec).select("id", "p").toPandas().set_index("id").p)
    assert (found[0] == found[1].loc[found[0].index]).all()


def test_rows_of_one_id_are_scored_each(rows):
    twice = rows.unionByName(rows.withColumn("a", F.col("a") + 1))
    scored = models.out_of_fold(materialise(twice, "twice"), COLS, models.random_forest(5, 3))
    assert scored.count() == 600


def test_large_tables_are_left_to_spark(rows):
    spec = models.random_forest()
    assert grove.fits(spec.build(64), 1_000_000, 64) and not grove.fits(spec.build(64), 3_000_000, 64)
    assert not grove.fits(models.boosting().build(64), 100, 64)


def test_values_that_are_no_numbers_are_an_error(rows):
    bad = rows.withColumn("a", F.when(F.col("id") == 7, float("nan")).otherwise(F.col("a")))
    with pytest.raises(Exception, match="finite"):
        models.out_of_fold(bad, COLS, models.random_forest(5, 3))
