"""Boosting and perceptrons of all folds at once, against Spark ML's fit of each fold."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from epochwise.operators import events, models, together
from epochwise.session import materialise

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """Training sides have 512 rows with their copies: Spark's perceptron means over 128 rows and then over these, so no row weighs more."""
    rng = np.random.RandomState(5)
    sizes = {("s0", 0): 128, ("s1", 0): 128, ("s2", 0): 128, ("s0", 1): 30, ("s1", 1): 35, ("s2", 1): 41}
    keys = [k for k, count in sizes.items() for _ in range(count)]
    n, y = len(keys), np.array([c for _, c in keys])
    pdf = pd.DataFrame({"id": rng.permutation(n) * 3 + 1, "subject": [s for s, _ in keys], "y": y})
    for i, c in enumerate(COLS):
        pdf[c] = rng.randn(n) * 10.0**i + (1.0 - 0.4 * i) * y
    return materialise(spark.createDataFrame(pdf).withColumn("y", F.col("y").cast("int")), "together")


def one_by_one(rows, spec, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(together, "fits", lambda estimator: False)
        return models.out_of_fold(rows, COLS, spec)


@pytest.mark.parametrize("spec", [models.boosting(12), models.perceptron((5, 4), 4)], ids=lambda s: s.name)
def test_folds_are_fitted_at_once_as_spark_fits_each(rows, spec, monkeypatch):
    theirs = one_by_one(rows, spec, monkeypatch).toPandas().set_index("id")

    def alone(*args, **kwargs):
        raise AssertionError("a fold was fitted on its own")

    monkeypatch.setattr(models, "fit", alone)
    monkeypatch.setattr(together, "KEPT_ROUNDS", 5)
    monkeypatch.setattr(together, "WAVE", 2)
    ours = models.out_of_fold(rows, COLS, spec).toPandas().set_index("id")
    assert list(ours.columns) == list(theirs.columns) and len(ours) == len(theirs) == 490
    assert (ours.fold == theirs.fold.loc[ours.index]).all() and (ours.y == theirs.y.loc[ours.index]).all()
    # two splits that part the training rows alike have one gain, and rounding chooses; few held-out rows lie between them
    apart = np.abs(ours.p - theirs.p.loc[ours.index])
    assert (apart > 1e-6).mean() <= (0.02 if spec.name == "gbt" else 0.0)


def test_rows_of_the_smaller_class_count_as_often_as_they_were_repeated(rows):
    number = F.substring("subject", 2, 1).cast("int")
    blocks = together.packed(models.in_place(rows), COLS, number, "id")
    pdf = rows.toPandas()
    sizes = np.array([[((pdf.subject == f"s{k}") & (pdf.y == c)).sum() for c in (0, 1)] for k in range(3)])
    sides = [together.Side(k, np.zeros(3), np.ones(3), np.ones(2)) for k in range(3)]
    counts = together.copies(blocks, sides, sizes)
    for k in range(3):
        got = sorted(v for x, y, fold, h in blocks.collect() for v in counts[k](y[fold != k], h[fold != k]))
        train = rows.filter(F.col("subject") != f"s{k}")
        want = sorted(r["count"] for r in events.oversample(train, "id").groupBy("id").count().collect())
        assert got == want


def test_two_classes_on_a_training_side_are_needed(rows):
    bad = rows.withColumn("y", F.when(F.col("subject") == "s0", F.col("y")).otherwise(0))
    with pytest.raises(ValueError, match="one class"):
        models.out_of_fold(bad, COLS, models.boosting(2))
    kept = models.out_of_fold(bad, COLS, models.boosting(2), skip_one_class=True)
    assert {r[0] for r in kept.select("subject").distinct().collect()} == {"s1", "s2"}
